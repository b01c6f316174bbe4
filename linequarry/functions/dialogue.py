"""Speakers and spoken text of one line, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import CleanOptions
from . import chars, clean

_B = chars.RE_BLANK
# Quotation marks and the longest names.
OPEN, CLOSE = "「『\"“", "」』\"”"
NAME = r"[^「」『』\"“”\s\x{3000}:：,，。]{1,16}"
#: A quoted body: no quotation mark but whole inner quotes of the other or the same kind.
_INNER = r"(?:[^「」『』\"“”]|「[^「」]*」|『[^『』]*』)"
WHOLE_LINE = rf"(?s)\A{_B}*({NAME}){_B}*[{OPEN}]({_INNER}+){'[' + CLOSE + ']'}{_B}*\z"
INLINE = r"「(?:[^「」\n]|「[^「」\n]*」){1,400}」|『(?:[^『』\n]|『[^『』\n]*』){1,400}』|[\"“][^\"“”\n]{1,400}[\"”]"
COLON = rf"(?s)\A{_B}*([^:：\s\x{{3000}}]{{1,16}}){_B}*[:：]{_B}*(.+)\z"
SPEAKER_TAGS = ("name", "speaker", "chara", "chr", "char", "actor", "person", "chara_show", "chara_mod", "chara_new", "chara_face", "chara_ptext")
PLACEHOLDERS = ("name", "speaker", "char", "chara", "text", "msg", "message", "str", "string", "label", "print", "echo", "mes", "say")

_NONE = "cast(array() as array<struct<speaker:string,text:string>>)"


def _pair(speaker: Column, text: Column) -> Column:
    return F.struct(speaker.alias("speaker"), text.alias("text"))


def prepared(line: Column, opts: CleanOptions) -> Column:
    """The line that extract() parses: tags stripped if wanted, normalised."""
    base = F.coalesce(line, F.lit(""))
    return clean.normalize_text(clean.strip_tags(base) if opts.strip_tags else base)


def extract(line: Column, opts: CleanOptions) -> Column:
    """array<struct<speaker, text>> of a prepared line, texts distinct.

    A line that is a name and one quotation gives that alone. Else every quotation is a
    text, the first with the at most 16 characters before it as speaker if they read as
    a name; else `name: text`; else narration.
    """
    none = F.expr(_NONE)
    shaped = lambda rows: F.filter(rows, lambda r: clean.dialogue_shape(r["text"], opts))
    name, body = F.regexp_extract(line, WHOLE_LINE, 1), F.regexp_extract(line, WHOLE_LINE, 2)
    whole = shaped(F.array(_pair(clean.squeeze(name), clean.squeeze(body))))

    spans = F.regexp_extract_all(line, F.lit(INLINE), F.lit(0))
    bodies = F.filter(spans, lambda m: F.substring(m, 1, 1).isin("「", "『") | chars.has_cjk_letter(m))
    before = F.regexp_extract(line, rf"(?s)\A([^{OPEN}{CLOSE}]{{0,16}})[{OPEN}]", 1)
    cut = F.regexp_replace(before, r"\A[ \t,，:：=(\{\[]+|[ \t,，:：=(\{\[]+\z", "")
    cut = chars.strip(F.regexp_replace(cut, rf"\A[A-Za-z0-9_.\[\]]*{_B}*", ""))
    # Only the first quotation can have a name before it: a later one has quotation marks there.
    first = F.substring(line, F.char_length(before) + 1, 1).isin(*OPEN) & chars.has_cjk_letter(cut) & ~clean.looks_like_command(cut)
    leads = F.when(first, clean.squeeze(cut)).otherwise("")
    pairs = F.transform(bodies, lambda m, i: _pair(F.when((i == 0) & (F.get(spans, F.lit(0)) == m), leads).otherwise(""), clean.squeeze(F.substring(m, F.lit(2), F.char_length(m) - 2))))
    inline = _distinct(shaped(pairs))

    c_name, c_body = F.regexp_extract(line, COLON, 1), F.regexp_extract(line, COLON, 2)
    colon = F.when((c_name != "") & chars.has_cjk_letter(c_body), shaped(F.array(_pair(clean.squeeze(c_name), clean.squeeze(c_body))))).otherwise(none)
    narration = shaped(F.array(_pair(F.lit(""), line))) if opts.keep_narration else none
    return F.when(line.isNull() | (line == ""), none).when(name != "", whole).when(F.size(inline) > 0, inline).when(F.size(colon) > 0, colon).otherwise(narration)


def _distinct(rows: Column) -> Column:
    """The first row of each text."""
    return F.filter(rows, lambda r, i: F.array_position(F.transform(rows, lambda x: x["text"]), r["text"]) == i + 1)


def declaration(line: Column) -> Column:
    """Speaker that a tag of the line declares, or ''.

    The first allowed tag with an attribute text, name or value (at most 24 characters),
    or with one positional value of at most 12.
    """
    tag = rf"(?i)\[(?:{'|'.join(SPEAKER_TAGS)})(?![A-Za-z0-9_])([^\]\n]*)\]"
    args = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(tag), F.lit(1))

    def value(a: Column) -> Column:
        attr = r"(?:^|[\s])(?:text|name|value)\s*=\s*(?:\"([^\"]{1,24})\"|'([^']{1,24})'|([^\s\]\"']{1,24}))"
        named = chars.strip(F.concat(*[F.regexp_extract(a, attr, k) for k in (1, 2, 3)]))
        place = F.regexp_replace(chars.strip(a), r"\A[\"']+|[\"']+\z", "")
        return F.when(named != "", named).when((place != "") & ~F.contains(place, F.lit("=")) & (F.char_length(place) <= 12), place).otherwise("")

    return F.coalesce(F.get(F.filter(F.transform(args, value), lambda v: v != ""), F.lit(0)), F.lit(""))


def split_speaker(line: Column) -> Column:
    """struct<speaker, text> of a line by its quotation or colon; placeholder names do not count."""
    s = chars.strip(F.coalesce(line, F.lit("")))
    q_name, q_body = F.regexp_extract(s, WHOLE_LINE, 1), F.regexp_extract(s, WHOLE_LINE, 2)
    c_name, c_body = F.regexp_extract(s, COLON, 1), F.regexp_extract(s, COLON, 2)
    alone = F.regexp_extract(s, rf"(?s)\A{_B}*[{OPEN}](.+?)[{CLOSE}]{_B}*\z", 1)
    sound = lambda n, b: (n != "") & (b != "") & chars.has_cjk_letter(b) & ~F.lower(n).isin(*PLACEHOLDERS)
    return (
        F.when(sound(q_name, q_body), _pair(q_name, chars.strip(q_body)))
        .when((q_name != "") & (q_body != ""), _pair(F.lit(""), chars.strip(q_body)))
        .when(alone != "", _pair(F.lit(""), chars.strip(alone)))
        .when(sound(c_name, c_body) & ~clean.looks_like_command(c_name) & (F.char_length(c_name) <= 12), _pair(c_name, chars.strip(c_body)))
        .otherwise(_pair(F.lit(""), s))
    )
