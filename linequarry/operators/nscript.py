"""NScripter scripts: the script gate and the lines that are no commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars

# What only scripts hold, and the words that start a command.
MARKERS = ("*define", "*start", "*label", "*game", "*save", "nsa ")
COMMANDS = frozenset(
    """
    allclear arc autosave autoresume bar barclear bg bgm blt br btnwait btnwait2 cdfile cell clicstr click clickpos cmode csp cspex cursor date defspeed delay dwave effect
    end erasetext exec fileexist for game getbgm getcursor getreg getspmode gettext getversion getz gosub goto humanz if inc intlimit itoa jumpb jumpf ld loadgame logsp loop
    makematrix menuselect mesbox monkey mov movemode mp3 mp3loop mp3save msp mul nsa numalias print puttext quake resettimer return rnd rubout savegame savescreenshot se
    select setcursor setfont setwindow skip songplay spbtn spcale spcorner spfont spgetinfo spstr spt stop stralias sub systemcall tablegoto textcolor textoff texton
    textspeed textwindow timer trap version wait wave wavebreak waveloop wavestop windoweffect yesno zoom resume textbtnwait spcl buttonwait bgmvol sevol mp3vol spbtnwait caption
    """.split()
)
SAMPLE = 65536


def looks_like_script(text: Column) -> Column:
    """A marker, or enough CJK among the first 65,536 characters."""
    head = F.substring(text, 1, SAMPLE)
    n = F.char_length(head)
    ratio = chars.count_of(head, chars.RE_CJK_CHAR) / F.greatest(n, F.lit(1))
    marked = F.lit(False)
    for m in MARKERS:
        marked |= F.contains(text, F.lit(m))
    return marked | ((n >= 8) & (ratio >= F.when(n < 64, 0.5).otherwise(0.05)))


def nscript_candidates(lines: DataFrame, scope: list[str], line_no: str = "line_no", line: str = "line") -> DataFrame:
    """scope, line_no, part_no, hint, line: lines of text, and of command lines their quoted CJK arguments."""
    s = chars.strip(F.col(line))
    kept = lines.withColumn(line, s).filter((s != "") & ~s.rlike(r"[\x00-\x08\x0A-\x1F]") & ~s.rlike(r"\A(?:[*;#]|//)"))
    command = F.lower(F.regexp_extract(F.col(line), r"\A([A-Za-z_][A-Za-z0-9_]*)", 1)).isin(*COMMANDS)
    quoted = F.filter(F.regexp_extract_all(F.col(line), F.lit(r'"([^"\n]{1,400})"'), F.lit(1)), chars.has_cjk_letter)
    parts = F.when(command, quoted).otherwise(F.array(line))
    return kept.select(*scope, line_no, F.posexplode(parts).alias("part_no", "line")).select(*scope, line_no, "part_no", F.lit("").alias("hint"), "line")
