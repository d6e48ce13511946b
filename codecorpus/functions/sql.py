"""UDF-1: the text and labelling functions as SQL functions, so SQL users can
call them (``SELECT strip_keep_newlines(content) FROM ...``).  They are SQL
UDFs over built-in expressions (no Python), generated from the same fixed
patterns as the Column API."""

from __future__ import annotations

from pyspark.sql import SparkSession

from codecorpus.functions import patterns as P


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _zip_strip(pattern: str, repl: str) -> str:
    p = _lit(pattern)
    return (f"array_join(zip_with(split(t, {p}, -1), "
            f"transform(regexp_extract_all(t, {p}, 0), m -> regexp_replace(m, {_lit('[^\\n\\r]')}, {_lit(repl)})), "
            f"(a, b) -> concat(a, coalesce(b, ''))), '')")


def _label() -> str:
    return (f"CASE WHEN (lower(name) LIKE '%bad%' AND lower(name) NOT LIKE '%good%') OR lower(name) LIKE '%badsink%' "
            f"THEN '{P.POSITIVE}' WHEN lower(name) LIKE '%good%' OR suffix = '_good' THEN '{P.NEGATIVE}' "
            f"WHEN name = 'main' THEN '{P.NEGATIVE}' WHEN suffix = '_bad' THEN '{P.POSITIVE}' ELSE '{P.NEGATIVE}' END")


FUNCTIONS = {
    "strip_keep_newlines": ("t STRING", "STRING", _zip_strip(P.COMMENT_SPACED, "")),
    "strip_keep_layout": ("t STRING", "STRING", _zip_strip(P.COMMENT_ANY, " ")),
    "strip_all": ("t STRING", "STRING", f"regexp_replace(t, {_lit(P.COMMENT_SPACED)}, '')"),
    "function_label": ("name STRING, suffix STRING", "STRING", _label()),
}


_LINES = r"split(t, '\\n', -1)"

#: Table functions, for ``FROM files f, LATERAL source_lines(f.content)``: the lines of a text (from 0), and
#: those of a window round a location (a 0-based line index), which itself has the number
#: ``least(location, lines_before)``.  All that reads an argument stands inside the generator: then a call is one narrow step, else it would be a join on the text.
TABLE_FUNCTIONS = {
    "source_lines": ("t STRING", "line_no INT, line STRING", f"SELECT pos, col FROM posexplode({_LINES})"),
    "window_lines": (
        "t STRING, location INT, lines_before INT, lines_after INT", "line_no INT, line STRING",
        f"SELECT pos, col FROM posexplode(CASE WHEN location >= 0 AND location < size({_LINES}) THEN "
        f"slice({_LINES}, greatest(0, location - lines_before) + 1, least(location, lines_before) + lines_after + 1) END)"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    for name, (args, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {body}")
    return [*FUNCTIONS, *TABLE_FUNCTIONS]
