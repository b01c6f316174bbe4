"""Encoding detection and byte-level text gates: Python codecs over Arrow batches."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars

# Byte order marks and candidate encodings in order; the first of equal scores wins.
MARKS = ((b"\xef\xbb\xbf", "utf-8", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32-le", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be", "utf-32-be"), (b"\xff\xfe", "utf-16-le", "utf-16-le"), (b"\xfe\xff", "utf-16-be", "utf-16-be"))
CANDIDATES = ("utf-16-le", "utf-16-be", "cp932", "cp936", "cp950", "euc-jp", "cp1252")
SAMPLE = 65536
XOR = bytes(b ^ 0x84 for b in range(256))
_CJK_LETTER, _KAG_WORD = (re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in r) + "]") for r in (chars.CJK_LETTER, chars.KAG_WORD))


class Decoded(NamedTuple):
    text: str
    encoding: str
    confidence: float


def plausible_utf16(sample: bytes, little: bool) -> bool:
    """Without a mark: at least 12 units other than 0, 95 % of them readable."""
    if len(sample) < 32:
        return False
    units = np.frombuffer(sample[: len(sample) // 2 * 2], "<u2" if little else ">u2")
    units = units[units != 0]
    return len(units) >= 12 and float((chars.BMP_WEIGHT[units] >= 1).mean()) >= 0.95


def _certain(data: bytes, cut: bool = False) -> Decoded | None:
    """What a mark or strict UTF-8 settles; a cut may have split the last character."""
    if not data:
        return Decoded("", "empty", 0.0)
    marked = [Decoded(data[len(m) :].decode(codec, "replace"), name, 1.0) for m, codec, name in MARKS if data.startswith(m)][:1]
    if marked:
        return marked[0]
    try:
        return Decoded(codecs.getincrementaldecoder("utf-8")().decode(data, not cut), "utf-8", 1.0)
    except UnicodeDecodeError:
        return None


def encoding_scores(sample: bytes) -> dict[str, float]:
    """How much a sample looks like language in each candidate encoding that it could have."""
    fits = [c for c in CANDIDATES if not c.startswith("utf-16") or plausible_utf16(sample, c == "utf-16-le")]
    return {c: chars.language_score(sample.decode(c, "replace")) for c in fits}


def decode_auto(data: bytes, cut: bool = False) -> Decoded:
    """Text, encoding and confidence: mark, else strict UTF-8, else the candidate whose text scores best.

    `cut` says that the data is the beginning of something longer.
    """
    found = _certain(data, cut)
    if found is None:
        scores = encoding_scores(data[:SAMPLE])
        # max() takes the first of equals, and cp932 always is there to be scored.
        name = max(scores, key=scores.__getitem__)
        found = Decoded(data.decode(name, "replace"), name, float(np.clip((scores[name] + 12) / 30, 0, 1)))
    return found


#: Zero bytes, as a share of the first 4096, beyond which an unmarked KAG script is tried as UTF-16LE.
LADDER_ZEROS = 1 / 8


def decode_ladder(data: bytes) -> Decoded:
    """The rule of KAG scripts: a 16-bit or UTF-8 mark, else the first encoding that takes all bytes, else cp932 with losses."""
    if not data or data.startswith(("\ufeff".encode("utf-16-le"), "\ufeff".encode("utf-16-be"), "\ufeff".encode())):
        name = next((n for m, _, n in MARKS if len(m) < 4 and data.startswith(m)), "empty")
        return Decoded(decode_with(data, name.removesuffix("-sig")).removeprefix("\ufeff") if data else "", name, float(bool(data)))
    head = np.frombuffer(data[:4096], np.uint8)
    wide = len(head) >= 4 and bool(np.count_nonzero(head == 0) > max(1, int(LADDER_ZEROS * len(head))))
    for name in ("utf-16-le",) * wide + ("utf-8", "cp932", "gbk"):
        try:
            return Decoded(data.decode(name), name, 1.0)
        except UnicodeDecodeError:
            continue
    return Decoded(data.decode("cp932", "replace"), "cp932", 0.0)


def decode_with(data: bytes, encoding: str) -> str:
    """A given encoding, bad bytes replaced; ValueError if there is no such encoding."""
    try:
        return data.decode(encoding, "replace")
    except LookupError as e:
        raise ValueError(f"unknown encoding: {encoding}") from e


@dataclass(frozen=True)
class Gate:
    """A test that blobs pass before they count as text: few zero bytes, then what their beginning decodes to."""

    #: Blobs that begin so may hold zero bytes.
    excused: tuple[bytes, ...]
    #: Bytes that are decoded.
    sample: int
    admits: Callable[[Decoded, bool], bool]
    #: Zero bytes allowed in the first 4096: this share, and at least so many.
    zeros: float = 0.25
    spare: int = 0

    def __call__(self, data: bytes) -> bool:
        if not data:
            return False
        head = np.frombuffer(data[:4096], np.uint8)
        if not data.startswith(self.excused) and np.count_nonzero(head == 0) > max(self.spare, self.zeros * len(head)):
            return False
        cut = len(data) > self.sample
        return self.admits(decode_auto(data[: self.sample], cut), cut)


_WIDE_MARKS = (b"\xff\xfe", b"\xfe\xff")


def _is_language(d: Decoded, cut: bool) -> bool:
    return d.encoding != "binary" and (d.confidence >= 0.35 or _CJK_LETTER.search(d.text[:4096]) is not None)


def _is_script(d: Decoded, cut: bool) -> bool:
    # A cut may split the last character.
    text = d.text.removesuffix("\ufffd") if cut else d.text
    points = np.array([c.isprintable() or c in "\r\n\t" for c in text], bool)
    return bool(len(points)) and "\ufffd" not in text and points.sum() >= int(0.95 * len(points)) and _KAG_WORD.search(text) is not None


#: Text of any kind, and text with a word in it that could be a script.
looks_like_text = Gate(_WIDE_MARKS, 16384, _is_language)
plausible_script = Gate((*_WIDE_MARKS, b"\xef\xbb\xbf"), 8192, _is_script, spare=1)


def _script_counts(text: str) -> tuple[int, float, int]:
    """Markers, share of CJK characters and number of characters at the beginning of a text."""
    from ..operators.nscript import MARKERS, SAMPLE as WIDTH

    head = chars.code_points(text[:WIDTH])
    cjk = chars.within(head, (*chars.FULL_KANA, *chars.IDEOGRAPH), chars.CJK_PUNCT).sum()
    return sum(m in text for m in MARKERS), float(cjk) / max(1, len(head)), len(head)


def script_score(text: str) -> float:
    """How much a text looks like an NScripter script."""
    if not text:
        return -1.0
    markers, share, _ = _script_counts(text)
    return 4.0 * markers + min(20, text.count("\n*") + text.startswith("*")) + 10.0 * share


def script_like(data: bytes) -> bool:
    """Does a blob, hidden or not, hold a marker or enough CJK to be a script?"""
    markers, share, n = _script_counts(decode_script(data).text)
    return markers > 0 or (n >= 8 and share >= (0.5 if n < 64 else 0.05))


def decode_script(data: bytes) -> Decoded:
    """As it is or XOR 0x84, whichever scores higher; as it is on a tie."""
    return max((decode_auto(data), decode_auto(data.translate(XOR))), key=lambda d: script_score(d.text))


DECODED = "text string, encoding string, confidence double"


def decoded(data: Column, encoding: str = "auto", script: Column | None = None) -> Column:
    """struct<text, encoding, confidence>; rows where `script` holds are tried as hidden scripts too.

    `encoding` is auto, ladder (the rule of KAG scripts) or a codec's name.
    """

    @F.pandas_udf(DECODED)
    def decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        forced = {"auto": None, "ladder": decode_ladder}.get(encoding, lambda b: Decoded(decode_with(b, encoding), encoding, 1.0))
        for blobs, hidden in batches:
            rows = [(forced or (decode_script if h else decode_auto))(bytes(b)) if b is not None else Decoded("", "empty", 0.0) for b, h in zip(blobs, hidden, strict=True)]
            yield pd.DataFrame(rows, columns=list(Decoded._fields))

    return decode(data, F.lit(False) if script is None else script)


def text_like(data: Column) -> Column:
    """Does the blob pass looks_like_text?"""

    @F.pandas_udf("boolean")
    def gate(blobs: pd.Series) -> pd.Series:
        return pd.Series([b is not None and looks_like_text(bytes(b)) for b in blobs], dtype=bool)

    return gate(data)
