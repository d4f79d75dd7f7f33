"""Text expressions as Column -> Column: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by the Unicode property, controls that act as blanks and invisible signs.
BLANK = r"[\s\p{Z}\x{0085}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]"
RUNTIMES = ("omp", "claude", "codex", "droid", "kimi")


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space at both ends (trim() strips U+0020 only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_form(c: Column) -> Column:
    """Lower case with runs of white space as one space."""
    return F.lower(collapse_ws(c))


def fold_case(c: Column) -> Column:
    """Case folding that also joins sharp s with ss.

    The optimizer turns lower(upper(x)) into lower(x); what stands between keeps both.
    """
    return F.lower(F.translate(F.upper(c), "\u0001", "\u0001"))


def bare_letters(c: Column) -> Column:
    """Only letters, digits and combining marks, case folded: equal for texts that differ in blanks, case or punctuation."""
    return F.regexp_replace(fold_case(c), r"[^\p{L}\p{N}\p{M}]+", "")


def words(c: Column) -> Column:
    """All runs of letters and digits, case folded, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def word_count(c: Column) -> Column:
    w = collapse_ws(c)
    return F.when(w == "", F.lit(0)).otherwise(F.size(F.split(w, " ")))


def bare_session_id(c: Column) -> Column:
    """Lower-case hex digits of a session id written with blanks, capitals or runtime and separator in front; blank gives null."""
    low = F.lower(F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", ""))
    return F.nullif(F.regexp_replace(low, rf"^(?:{'|'.join(RUNTIMES)})[^0-9a-z]+", ""), F.lit(""))


def is_blank_value(c: Column) -> Column:
    """Null, empty, white space only or the word None."""
    return c.isNull() | F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "").isin("", "None")
