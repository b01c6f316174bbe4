"""Strings inside binary blobs: Shift-JIS and UTF-16LE runs."""

from __future__ import annotations

import re

import numpy as np

from ..sources import dsc
from . import chars
from .codec import decode_auto

_SJIS = re.compile(rb"(?:[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]|[\x20-\x7E\xA1-\xDF])+")
_SJIS_LINE = re.compile(rb"(?:[\x81-\x9F\xE0-\xEF][\x40-\x7E\x80-\xFC]|[\x09\x0A\x0D\x20-\x7E\xA1-\xDF])+")
_CTRL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
# Characters inside a text that are no CJK, and punctuation of readable lines.
NEUTRAL = " 　\t0123456789０１２３４５６７８９!?！？.,，、-—~〜…・:：;；'\"“”()（）[]【】/／+＋"
READABLE = " 　!?.,:;'\"()[]{}<>-_/\\|~^+=*&%$#@!、。「」『』【】！？．，：；・…―—−～〜·♪♥☆★←↑→↓"
_ANCHOR = (*chars.FULL_KANA, *chars.IDEOGRAPH)
_SEGMENT = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _ANCHOR) + re.escape(chars.CJK_PUNCT) + "][" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _ANCHOR) + re.escape(chars.CJK_PUNCT + NEUTRAL) + "]*")


def _has(text: str, *ranges, extra: str = "") -> bool:
    return bool(chars.within(chars.code_points(text), ranges, extra).any())


def sjis_runs(data: bytes, least: int = 4) -> list[str]:
    """Runs of Shift-JIS characters with full-width kana, ideographs or CJK punctuation."""
    runs = (m.group().decode("cp932", "replace").strip() for m in _SJIS.finditer(data) if len(m.group()) >= least)
    return [r for r in runs if len(r) >= least and _has(r, *_ANCHOR, extra=chars.CJK_PUNCT)]


def _spans(good: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def utf16_runs(data: bytes, least: int = 4) -> list[str]:
    """Runs of readable UTF-16LE units at even places."""
    units = np.frombuffer(data[: len(data) // 2 * 2], "<u2")
    spans = _spans((chars.BMP_WEIGHT[units] >= 1) & (units > 0x1F))
    runs = (units[a:b].tobytes().decode("utf-16-le", "replace").strip() for a, b in spans if b - a >= least)
    return [r for r in runs if len(r) >= least and _has(r, *_ANCHOR, extra=chars.CJK_PUNCT)]


def plausible_run(text: str, least: int, aggressive: bool = False) -> bool:
    """Language rather than chance: few half-width or private characters, an anchor, enough CJK, a fair score."""
    if len(text) < least:
        return False
    p = chars.code_points(text)
    share = lambda m: float(m.sum()) / len(p)
    half, private = chars.within(p, ((0xFF66, 0xFF9F),)), chars.within(p, ((0xE000, 0xF8FF),))
    if ((chars.weights(p) <= -25) & ~half & ~private).any() or share(half) > 0.25 or share(private) > 0.05:
        return False
    if not chars.within(p, chars.FULL_KANA, chars.CJK_PUNCT).any():
        return False
    if share(chars.within(p, _ANCHOR, chars.CJK_PUNCT)) < (0.30 if aggressive else 0.50):
        return False
    return chars.language_score(text) >= (0.0 if aggressive else 2.0)


def scan_strings(data: bytes, least: int = 4, aggressive: bool = True) -> list[str]:
    """Distinct plausible CJK segments of both kinds of runs."""
    out: dict[str, None] = {}
    for run in sjis_runs(data, least) + utf16_runs(data, least):
        for m in _SEGMENT.finditer(run):
            s = m.group().strip()
            if len(m.group()) >= least and plausible_run(s, least, aggressive):
                out.setdefault(s)
    return list(out)


def _clean(line: str) -> str:
    return _CTRL.sub("", line).replace("　", " ").strip()


def _readable(line: str) -> bool:
    good = sum(c in READABLE or "぀" <= c <= "ヿ" or "一" <= c <= "鿿" or "＀" <= c <= "￯" or (c.isascii() and c.isalnum()) for c in line)
    return bool(line) and good * 10 >= len(line) * 8


_CJK = ((0x3000, 0x303F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF))


def _rank(lines: list[str]) -> int:
    n = [int(chars.within(chars.code_points(s), _CJK).sum()) for s in lines]
    return sum(len(s) + 3 * k - 2 * (k == 0) for s, k in zip(lines, n, strict=True))


def compiled_lines(data: bytes, least: int = 2) -> list[str]:
    """Lines of a compiled script: by its mark, else the better of a Shift-JIS and a UTF-16LE scan; what does not unpack has none."""
    if data.startswith(dsc.MAGIC):
        try:
            data = dsc.unpack(data)
        except ValueError:
            return []
    if data.startswith((b"\xef\xbb\xbf", b"\xff\xfe")):
        found = [_clean(x) for x in decode_auto(data)[0].splitlines()]
    else:
        sjis = []
        for m in _SJIS_LINE.finditer(data):
            try:
                sjis += [s for s in map(_clean, re.split(r"[\r\n]+", m.group().decode("cp932"))) if len(s) >= least and _readable(s)]
            except UnicodeDecodeError:
                continue
        wide = []
        units = np.frombuffer(data[: len(data) // 2 * 2], "<u2")
        for a, z in _spans(chars.within(units, (*_CJK, (0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E)))):
            text = units[a:z].tobytes().decode("utf-16-le")
            if chars.within(chars.code_points(text), _CJK).mean() >= 0.35:
                wide += [s for s in map(_clean, re.split(r"[\r\n]+", text)) if len(s) >= least]
        found = sjis if _rank(sjis) >= _rank(wide) else wide
    return list(dict.fromkeys(s for s in found if s))
