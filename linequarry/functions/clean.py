"""Cleaning and line predicates as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import CleanOptions
from . import chars

# Patterns of tags and control sequences.
BRACKET_TAG = r"\[/?[A-Za-z_][A-Za-z0-9_]*(?:\s+[^\[\]\n]{0,200})?\]"
ANGLE_TAG = r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[^<>\n]{0,120})?/?>"
CONTROL = r"\\[nrt]|\{[0-9A-Fa-fxX,\s]{1,20}\}"
REPEATED = "!?！？。、,.~〜ー…"
CODE_SYMBOLS = "{}()[]<>=;:\\|&!$%^~`"
# How a line of code or a command starts.
COMMANDS = (
    "*", ";", "//", "#", "@", "::", "function", "function ", "var ", "int ", "float ", "if ", "else", "for ", "while ", "switch", "case ", "break", "continue", "return", "goto ",
    "class ", "struct ", "import ", "export ", "include", "#include", "#define", "const ", "let ", "typedef", "namespace ", "using ", "end", "endif", "endfunction", "endmacro",
    "macro ", "setvar", "getvar", "mov ", "jmp ", "call ", "push ", "pop ", "sf.", "kag.", "Script", "Storage", "Plugins", "System.", "Debug.", "Console.", "Window.", "Layer.",
    "Timer.", "Storages.", "include ", "loadplugin", "caption", "version", "define", "def ", "mesbox", "clickstr", "savegame", "textspeed", "automode", "effect", "bgm ", "bg ",
    "se ", "wait ", "ld ", "csp ", "dwave", "mp3loop", "play ", "stop", "resettimer", "goto",
)
#: A prefix of at most so many characters counts only before a blank, a tab, ( = . or the end.
SHORT_PREFIX = 4


def command_pattern() -> str:
    """One regular expression for looks_like_command, in the syntax that Java and RE2 share."""
    entries = [re.escape(p) + (r"(?:[ \t(=.]|\z)" if len(p) <= SHORT_PREFIX else "") for p in dict.fromkeys(COMMANDS)]
    return rf"\A{chars.RE_BLANK}*(?:\z|</|<\?|(?i:{'|'.join(entries)}))|://"


def strip_tags(c: Column) -> Column:
    for pattern in (BRACKET_TAG, ANGLE_TAG, CONTROL):
        c = F.regexp_replace(c, pattern, "")
    return c


def squeeze(c: Column) -> Column:
    """normalize_text without composition; usable inside lambdas."""
    c = F.regexp_replace(c, chars.RE_ZERO_WIDTH + r"|\r", "")
    c = F.regexp_replace(c, r"[ \t\n\x{3000}\x{A0}]+", " ")
    c = F.regexp_replace(c, rf"([{re.escape(REPEATED)}])\1{{3,}}", "$1$1")
    return chars.strip(c)


def compose(c: Column) -> Column:
    """NFC; ASCII strings pass as they are."""
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False))
    return F.when(c.isNull(), None).when(chars.is_ascii(c), c).otherwise(made)


def normalize_text(c: Column) -> Column:
    """Zero-width characters and CR out, blanks folded, repeated punctuation to two, NFC, trimmed."""
    return chars.strip(compose(squeeze(c)))


def looks_like_command(c: Column) -> Column:
    return c.rlike(command_pattern())


def symbol_ratio(c: Column) -> Column:
    """Share of code symbols; 1 for the empty string."""
    left = F.char_length(F.translate(c, CODE_SYMBOLS, ""))
    return F.when(F.char_length(c) == 0, 1.0).otherwise((F.char_length(c) - left) / F.greatest(F.char_length(c), F.lit(1)))


def _surplus(c: Column, opening: str, closing: str) -> Column:
    return F.abs(F.char_length(F.translate(c, opening, "")) - F.char_length(F.translate(c, closing, "")))


def dialogue_shape(c: Column, opts: CleanOptions) -> Column:
    """Does a cleaned line read as dialogue under the options?"""
    ok = F.char_length(c).between(max(1, opts.min_len), opts.max_len)
    if opts.require_cjk:
        ok &= chars.has_cjk_letter(c)
    if opts.chinese_only:
        ok &= ~chars.has_kana(c)
    if opts.aggressive:
        return ok & ~(looks_like_command(c) & (symbol_ratio(c) > 0.4))
    if opts.drop_ascii_only:
        ok &= ~chars.is_ascii(c)
    return ok & ~looks_like_command(c) & (symbol_ratio(c) <= 0.30) & (_surplus(c, "(", ")") <= 1) & (_surplus(c, "{", "}") <= 1)


def bare_name(c: Column) -> Column:
    """A line of 1 to 8 characters that could be a name of its own."""
    # Fixed value: characters that no name has.
    bad = "。！？…、，．,.!?；;：:「」『』（）()[]{}<>\"'“”‘’·~～—–-"
    s = chars.strip(c)
    return F.char_length(s).between(1, 8) & ~s.rlike("[" + re.escape(bad) + r"\x00-\x7F]") & chars.has_cjk_letter(s)


def display(speaker: Column, text: Column) -> Column:
    return F.when(F.coalesce(speaker, F.lit("")) != "", F.concat_ws("：", speaker, text)).otherwise(text)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)\z", 1))


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.1f MB", n / 1024.0**2))
        .otherwise(F.format_string("%.1f GB", n / 1024.0**3))
    )


def safe_relative(path: Column, root: str) -> Column:
    """Path below a root with forward slashes; the path itself if it lies elsewhere."""
    p, base = F.translate(path, "\\", "/"), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(base)), F.substring(p, F.lit(len(base) + 1), F.char_length(p))).otherwise(p)
