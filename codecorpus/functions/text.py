"""Column -> Column text functions (all JVM-side built-ins, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_newlines(text) -> Column:
    """Python text-mode reading: CRLF and lone CR become LF."""
    return F.regexp_replace(_col(text), r"\r\n?", "\n")


def py_strip(text) -> Column:
    """``str.strip()``: removes Python's whitespace set at both ends (plain
    ``trim`` only removes spaces)."""
    return F.trim(_col(text), F.lit(P.PY_WHITESPACE))


def count_char(text, ch: str) -> Column:
    t = _col(text)
    return F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))


def _replace_matches(text: Column, pattern: str, keep_only_breaks: bool) -> Column:
    """Replace every match of ``pattern``: either by its LF/CR characters only,
    or by one space per non-LF/CR character.  Pieces between matches come from
    ``split`` and the matches from ``regexp_extract_all``; both walk the same
    left-to-right match sequence, so zipping them rebuilds the text."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    if keep_only_breaks:
        fixed = F.transform(matches, lambda m: F.regexp_replace(m, r"[^\n\r]", ""))
    else:
        fixed = F.transform(matches, lambda m: F.regexp_replace(m, r"[^\n\r]", " "))
    return F.array_join(F.zip_with(pieces, fixed, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def strip_keep_newlines(text) -> Column:
    """STR-1: remove ``// `` comments (space required) and block comments,
    keeping only the line breaks inside them."""
    return _replace_matches(_col(text), P.COMMENT_SPACED, keep_only_breaks=True)


def strip_keep_layout(text) -> Column:
    """STR-2: blank out ``//`` (no space needed) and block comments character
    by character; length and line count are preserved."""
    return _replace_matches(_col(text), P.COMMENT_ANY, keep_only_breaks=False)


def strip_all(text) -> Column:
    """STR-3: remove comments (space required after ``//``) wholly."""
    return F.regexp_replace(_col(text), P.COMMENT_SPACED, "")


def rust_line_count(text) -> Column:
    """Line count as ``str::lines().count()``: number of LFs plus one when the
    text after the last LF is non-empty."""
    t = _col(text)
    return count_char(t, "\n") + F.when(
        (F.length(t) > 0) & ~t.endswith(F.lit("\n")), F.lit(1)
    ).otherwise(F.lit(0))


def split_lines(text) -> Column:
    """``text.split('\\n')``: trailing empty piece kept, ``''`` gives ``['']``."""
    return F.split(_col(text), "\n", -1)


def base_name(path) -> Column:
    """Last path component, accepting both slash kinds."""
    return F.regexp_extract(_col(path), r"[^/\\]+$", 0)


def extension(name) -> Column:
    """``os.path.splitext(name)[1]``: the last dot-suffix, unless the dots are
    all leading."""
    return F.regexp_extract(_col(name), r"^\.*[^.][^/\\]*?(\.[^./\\]*)$", 1)


def stem(name) -> Column:
    """File name without its extension (``os.path.splitext(name)[0]``)."""
    n = _col(name)
    return F.left(n, F.length(n) - F.length(extension(n)))
