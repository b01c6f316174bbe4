"""Character classes and the weight table.

Each class is a list of code point ranges; from it come a regular expression class
(Java and RE2 syntax) and, for the decoders, a numpy table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of code points.
CJK_LETTER = ((0x3040, 0x318F), (0x31F0, 0x31FF), (0x3200, 0x32FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF))
KANA = ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))
FULL_KANA = ((0x3040, 0x30FF), (0x31F0, 0x31FF))
IDEOGRAPH = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
CJK_PUNCT = "。、，．・「」『』（）〈〉《》【】！？：；…‥〜～—―　·"
KAG_WORD = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xAC00, 0xD7AF), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))
#: What str.strip() removes.
BLANK = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
ZERO_WIDTH = ((0x200B, 0x200F), (0x202A, 0x202E), (0xFEFF, 0xFEFF))
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# Weights of code point ranges; later entries overwrite earlier ones, every other one of the BMP weighs -8, beyond it 3.
WEIGHTS = (
    (1, ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA0, 0x24F), (0x370, 0x4FF), (0x2000, 0x20CF), (0x2100, 0x218F), (0x2190, 0x22FF), (0x2460, 0x27BF), (0x3000, 0x303F), (0xFF00, 0xFF65), (0xFFA0, 0xFFEF))),
    (3, CJK_LETTER),
    (0, ((0x200B, 0x200F), (0xFE00, 0xFE0F))),
    (-4, ((0xFF66, 0xFF9F),)),
    (-6, ((0xE000, 0xF8FF),)),
    (-25, ((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x9F), (0xD800, 0xDFFF), (0xFFFD, 0xFFFD))),
)


def regex_class(ranges: tuple, extra: str = "") -> str:
    """A bracket expression for ranges and single characters."""
    one = lambda c: f"\\x{{{c:X}}}"
    return "[" + "".join(one(a) + (f"-{one(b)}" if b > a else "") for a, b in ranges) + "".join(one(ord(c)) for c in extra) + "]"


RE_CJK_LETTER, RE_KANA, RE_FULL_KANA, RE_IDEOGRAPH = (regex_class(r) for r in (CJK_LETTER, KANA, FULL_KANA, IDEOGRAPH))
RE_CJK_PUNCT = regex_class((), CJK_PUNCT)
RE_CJK_CHAR = regex_class((*FULL_KANA, *IDEOGRAPH), CJK_PUNCT)
RE_KAG_WORD, RE_BLANK, RE_ZERO_WIDTH = (regex_class(r) for r in (KAG_WORD, BLANK, ZERO_WIDTH))


def has_cjk_letter(c: Column) -> Column:
    """A kana, ideograph, Hangul, Bopomofo or enclosed CJK character of the BMP."""
    return c.rlike(RE_CJK_LETTER)


def has_kana(c: Column) -> Column:
    return c.rlike(RE_KANA)


def has_full_kana(c: Column) -> Column:
    return c.rlike(RE_FULL_KANA)


def has_ideograph(c: Column) -> Column:
    return c.rlike(RE_IDEOGRAPH)


def has_cjk_punct(c: Column) -> Column:
    return c.rlike(RE_CJK_PUNCT)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def count_of(c: Column, char_class: str) -> Column:
    """Number of characters of a class."""
    return F.regexp_count(c, F.lit(char_class))


def strip(c: Column) -> Column:
    """Unicode blanks off both ends."""
    return F.regexp_replace(c, rf"\A{RE_BLANK}+|{RE_BLANK}+\z", "")


def _table() -> np.ndarray:
    t = np.full(0x10000, -8, np.int16)
    for weight, ranges in WEIGHTS:
        for a, b in ranges:
            t[a : b + 1] = weight
    return t


BMP_WEIGHT = _table()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def weights(points: np.ndarray) -> np.ndarray:
    return np.where(points > 0xFFFF, 3, BMP_WEIGHT[np.minimum(points, 0xFFFF)])


def within(points: np.ndarray, ranges: tuple, extra: str = "") -> np.ndarray:
    """Which code points lie in some range or are one of the extra characters."""
    out = np.isin(points, [ord(c) for c in extra]) if extra else np.zeros(len(points), bool)
    for a, b in ranges:
        out |= (points >= a) & (points <= b)
    return out


def language_score(text: str) -> float:
    """How much a decoded text looks like language: mean weight, kana up, half-width and bad characters down."""
    if not text:
        return float("-inf")
    p = code_points(text)
    w = weights(p)
    share = lambda m: float(m.sum()) / len(p)
    return (
        float(w.sum()) / len(p)
        + 9 * share(within(p, ((0x3040, 0x309F),)))
        + 4 * share(within(p, ((0x30A0, 0x30FF), (0x31F0, 0x31FF))))
        - 14 * share(within(p, ((0xFF66, 0xFF9F),)))
        - 30 * share(w <= -25)
        - 45 * share(p == 0xFFFD)
    )
