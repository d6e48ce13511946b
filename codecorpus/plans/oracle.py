"""DuckDB oracle SQL: independent formulations of the same results.

Each query string is a chain of CTEs over the driver's pre-registered tables.
Where the Spark side uses windows tuned for scale, the oracle uses the plain
relational form (e.g. brace matching as join + min) so the two are genuinely
independent checks.  Patterns are shared from ``functions.patterns``.
"""

from __future__ import annotations

from codecorpus.functions import patterns as P
from codecorpus.sources.corpus import CORPUS_SQL, LONG_CORPUS_SQL


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def with_ctes(*ctes: tuple[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n" + body


EXT_RE = r"^\.*[^.][^/\\]*?(\.[^./\\]*)$"
NAME_RE = r"[^/\\]+$"


def _tcid(fn: str, fx: str) -> str:
    prim = f"regexp_extract({fn}, {q(P.GROUP_PRIMARY)}, 1)"
    stem = f"left({fn}, length({fn}) - length({fx}))"
    return f"CASE WHEN {prim} <> '' THEN {prim} ELSE regexp_replace({stem}, {q(P.GROUP_FALLBACK)}, '', 'g') END"


def _count(col: str, ch: str) -> str:
    return f"(length({col}) - length(replace({col}, {q(ch)}, '')))"


CORPUS = ("corpus", CORPUS_SQL)
LONG_CORPUS = ("corpus", LONG_CORPUS_SQL)

FILES = ("files", f"""
  SELECT file_id, path, file_name, ext,
         CASE lower(ext) WHEN '.c' THEN 'c' WHEN '.cpp' THEN 'c' WHEN '.java' THEN 'java' WHEN '.cs' THEN 'cs' END AS language,
         {_tcid('file_name', 'ext')} AS test_case_id,
         regexp_replace(content, '\\r\\n?', chr(10), 'g') AS content
  FROM (SELECT file_id, path, content, fn AS file_name, regexp_extract(fn, {q(EXT_RE)}, 1) AS ext
        FROM (SELECT *, regexp_extract(path, {q(NAME_RE)}, 0) AS fn FROM corpus))
  WHERE lower(ext) IN ('.c', '.cpp', '.java', '.cs')""")

LINES = ("lines_x", f"""
  SELECT file_id, language, i, line,
         {_count('line', '{')} - {_count('line', '}')} AS d,
         contains(line, '{{') AS has_open
  FROM (SELECT file_id, language, unnest(arr) AS line, generate_subscripts(arr, 1) - 1 AS i
        FROM (SELECT file_id, language, string_split(content, chr(10)) AS arr FROM files))""")

LINES_C = ("lines_c", """
  SELECT *, sum(d) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
         coalesce(lead(has_open, 1) OVER (PARTITION BY file_id ORDER BY i), false) AS open1,
         coalesce(lead(has_open, 2) OVER (PARTITION BY file_id ORDER BY i), false) AS open2
  FROM lines_x""")

_TRIMMED = f"trim(line, {q(P.PY_WHITESPACE)})"

CANDS = ("cands", f"""
  SELECT file_id, language, i, name, i + off AS b,
         CASE WHEN language = 'cs' THEN c - 1
              ELSE coalesce((SELECT sum(l2.d) FROM lines_c l2 WHERE l2.file_id = h.file_id AND l2.i < h.i + off), 0) END AS t
  FROM (SELECT *, CASE WHEN language = 'cs' THEN 0 WHEN has_open THEN 0 WHEN open1 THEN 1 WHEN open2 THEN 2 END AS off
        FROM (SELECT *, CASE WHEN NOT contains(line, '(') THEN ''
                             WHEN language <> 'cs' AND (tl = '' OR starts_with(tl, '//') OR starts_with(tl, '/*')) THEN ''
                             WHEN language = 'c' THEN regexp_extract(tl, {q(P.HEADER_C)}, 1)
                             WHEN language = 'java' THEN regexp_extract(tl, {q(P.HEADER_JAVA)}, 1)
                             ELSE regexp_extract(tl, {q(P.HEADER_CS)}, 1) END AS name
              FROM (SELECT *, {_TRIMMED} AS tl FROM lines_c)) WHERE name <> '') h
  WHERE off IS NOT NULL""")

ENDS = ("ends", """
  SELECT k.file_id, k.language, k.name, k.i + 1 AS start_line,
         coalesce(min(l.i), k.b) + 1 AS end_line
  FROM cands k LEFT JOIN lines_c l ON l.file_id = k.file_id AND l.c = k.t AND l.i > k.b
  GROUP BY k.file_id, k.language, k.name, k.i, k.b""")

KEPT = ("kept", """
  SELECT file_id, name, start_line, end_line FROM ends WHERE language = 'cs'
  UNION ALL
  SELECT file_id, f.name, f.start_line, f.end_line FROM (
    SELECT file_id, unnest(list_reduce(
        list_sort(list({'start_line': start_line, 'end_line': end_line, 'name': name})),
        lambda acc, x: CASE WHEN x.start_line > acc.last
                            THEN {'last': x.end_line, 'kept': list_append(acc.kept, x)} ELSE acc END,
        {'last': 0, 'kept': []::STRUCT(start_line INT, end_line INT, name VARCHAR)[]}).kept) AS f
    FROM ends WHERE language <> 'cs' GROUP BY file_id)""")

_BODY = "array_to_string(string_split(fl.content, chr(10))[k.start_line + 1 : k.end_line - 1], chr(10))"
_CLEAN = (
    f"trim(regexp_replace(regexp_replace(regexp_replace({_BODY}, {q(P.BODY_LINE_COMMENT)}, '', 'g'), "
    f"{q(P.BODY_BLOCK_COMMENT)}, '', 'g'), '\\s+', ' ', 'g'))"
)

EXTRACTED = ("extracted", f"""
  SELECT k.file_id, k.name, k.start_line, k.end_line,
         ({_count('t', ';')} <= {P.MAX_WRAPPER_STATEMENTS} AND regexp_matches(t, {q(P.CALL_STATEMENT)})) AS trivial
  FROM (SELECT k.*, {_CLEAN} AS t FROM kept k JOIN files fl ON fl.file_id = k.file_id) k""")

_LABEL = f"""CASE WHEN (contains(lower(name), 'bad') AND NOT contains(lower(name), 'good')) OR contains(lower(name), 'badsink') THEN '{P.POSITIVE}'
            WHEN contains(lower(name), 'good') OR sfx = '_good' THEN '{P.NEGATIVE}'
            WHEN name = 'main' THEN '{P.NEGATIVE}'
            WHEN sfx = '_bad' THEN '{P.POSITIVE}'
            ELSE '{P.NEGATIVE}' END"""

FUNCTIONS = ("functions", f"""
  SELECT language, test_case_id, path, file_id, name, start_line, end_line, end_line - start_line + 1 AS lines,
         {_LABEL} AS label
  FROM (SELECT e.*, f.path, f.language, f.test_case_id,
               CASE WHEN contains(f.file_name, '_bad') THEN '_bad' WHEN contains(f.file_name, '_good') THEN '_good' ELSE '' END AS sfx
        FROM extracted e JOIN files f USING (file_id) WHERE NOT e.trivial)""")

FUNCTION_CHAIN = (CORPUS, FILES, LINES, LINES_C, CANDS, ENDS, KEPT, EXTRACTED, FUNCTIONS)
