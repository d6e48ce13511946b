"""The virtual source corpus: code-like files derived from ``documents``.

The driver tables hold prose only, so every document becomes one source file
with comments, three functions and a flaw location.  The rules are fixed (see
FIXTURES.md section 2) so the DuckDB oracle derives the very same files.
Output: ``file_id long, path, file_name, ext, content, cwe, vulnerability_location``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.text import count_char

NL = "\n"
TEMPLATE_NEWLINES = 20  # line breaks the file template adds around the text
TABLE_LINES = 40  # shortest body of the long form's extra function, a whole window


def _s(c: Column) -> Column:
    return c.cast("string")


def virtual_corpus(documents: DataFrame, long: bool = False) -> DataFrame:
    """One file per document.  The ``long`` form adds a function of 40 to 62
    statements, so that files hold whole 40-line windows (curation queries)."""
    k = F.col("doc_id")
    n = F.lit(15) + F.floor(k / 24).cast("bigint") % 20
    vv = F.lpad(_s(k % 60), 2, "0")
    ext = (
        F.when(k % 4 == 0, ".c").when(k % 4 == 1, ".cpp").when(k % 4 == 2, ".java").otherwise(".cs")
    )
    st = F.floor(k / 4).cast("bigint") % 6
    cwe_n = F.concat(F.lit("CWE"), _s(n))
    name_stem = (
        F.when(st == 0, F.concat(cwe_n, F.lit("_Alpha_Beta_"), vv))
        .when(st == 1, F.concat(cwe_n, F.lit("_Alpha__beta_"), vv, F.lit("a")))
        .when(st == 2, F.concat(cwe_n, F.lit("_Alpha__beta_"), vv, F.lit("_bad")))
        .when(st == 3, F.concat(cwe_n, F.lit("_Alpha__beta_"), vv, F.lit("_goodG2B")))
        .when(st == 4, F.concat(cwe_n, F.lit("_Alpha_Beta_"), vv, F.lit("_bad")))
        .otherwise(F.concat(F.lit("io_"), vv))
    )
    first_fn = F.when(k % 3 == 0, "bad").when(k % 3 == 1, "goodG2B").otherwise("action")
    second_fn = F.when(k % 3 == 0, "helper_badSink").when(k % 3 == 1, "main").otherwise("goodB2G")
    body = F.replace(
        F.replace(F.col("text"), F.lit('"'), F.lit("~")),
        F.lit(NL),
        F.lit('"); // n' + NL + '    say("'),
    )
    table_lines = (F.lit(TABLE_LINES) + k % 23).cast("int")
    content = F.concat(
        F.lit("/* file "), _s(k), F.lit(NL + "   block */" + NL + "// spaced comment" + NL + "//tight comment" + NL),
        F.lit('#include "x.h"' + NL),
        F.lit("void "), first_fn, F.lit("()" + NL + "{" + NL),
        F.lit('    say("'), body, F.lit('");' + NL + "}" + NL),
        F.lit("int "), second_fn, F.lit("(int a) {" + NL),
        F.lit("    if (a) {" + NL + "        call(a);" + NL + "    }" + NL + "    a = 1; a = 2;" + NL
              + "    return a;" + NL + "}" + NL),
        F.lit("static void wrap()" + NL + "{" + NL + "    next(1);" + NL + "}" + NL),
        *([F.lit("static void table()" + NL + "{" + NL), F.repeat(F.lit("    step(1);" + NL), table_lines),
           F.lit("}" + NL)] if long else []),
        F.when(k % 5 == 0, F.lit("// end")).otherwise(F.lit("")),
    )
    # The template adds exactly TEMPLATE_NEWLINES line breaks and maps every
    # newline of the text to exactly one, so the file's newline count is known
    # from the text alone; the location then needs no built content (Catalyst
    # prunes the content on branches that only need the location).
    files = documents.select(
        k.alias("file_id"),
        n.alias("n"),
        ext.alias("ext"),
        F.concat(name_stem, ext).alias("file_name"),
        content.alias("content"),
        (count_char(F.col("text"), NL) + TEMPLATE_NEWLINES + (table_lines + 3 if long else F.lit(0))).alias("n_lf"),
    )
    location = F.when(F.col("file_id") % 7 == 3, F.lit("9,11")).otherwise(
        _s(F.lit(1) + (F.col("file_id") * 37) % (F.col("n_lf") + 3))
    )
    return files.select(
        "file_id",
        F.concat(F.lit("/cases/CWE"), _s(F.col("n")), F.lit("/d"), _s(F.col("file_id")), F.lit("/"),
                 F.col("file_name")).alias("path"),
        "file_name",
        "ext",
        "content",
        F.concat(F.lit("CWE-"), _s(F.col("n")), F.lit(": Alpha")).alias("cwe"),
        location.alias("vulnerability_location"),
    )


def _corpus_sql(table: str) -> str:
    return """
WITH a AS (
  SELECT doc_id AS k, text, 15 + cast(floor(doc_id / 24) AS bigint) % 20 AS n,
         lpad(cast(doc_id % 60 AS varchar), 2, '0') AS vv,
         CASE doc_id % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' WHEN 2 THEN '.java' ELSE '.cs' END AS ext,
         cast(floor(doc_id / 4) AS bigint) % 6 AS st
  FROM documents),
b AS (
  SELECT k, text, n, ext,
         CASE st WHEN 0 THEN 'CWE' || n || '_Alpha_Beta_' || vv
                 WHEN 1 THEN 'CWE' || n || '_Alpha__beta_' || vv || 'a'
                 WHEN 2 THEN 'CWE' || n || '_Alpha__beta_' || vv || '_bad'
                 WHEN 3 THEN 'CWE' || n || '_Alpha__beta_' || vv || '_goodG2B'
                 WHEN 4 THEN 'CWE' || n || '_Alpha_Beta_' || vv || '_bad'
                 ELSE 'io_' || vv END || ext AS file_name
  FROM a),
c AS (
  SELECT k, n, ext, file_name,
    '/* file ' || k || chr(10) || '   block */' || chr(10) || '// spaced comment' || chr(10) || '//tight comment' || chr(10)
    || '#include "x.h"' || chr(10)
    || 'void ' || CASE k % 3 WHEN 0 THEN 'bad' WHEN 1 THEN 'goodG2B' ELSE 'action' END || '()' || chr(10) || '{' || chr(10)
    || '    say("' || replace(replace(text, '"', '~'), chr(10), '"); // n' || chr(10) || '    say("') || '");' || chr(10) || '}' || chr(10)
    || 'int ' || CASE k % 3 WHEN 0 THEN 'helper_badSink' WHEN 1 THEN 'main' ELSE 'goodB2G' END || '(int a) {' || chr(10)
    || '    if (a) {' || chr(10) || '        call(a);' || chr(10) || '    }' || chr(10) || '    a = 1; a = 2;' || chr(10) || '    return a;' || chr(10) || '}' || chr(10)
    || 'static void wrap()' || chr(10) || '{' || chr(10) || '    next(1);' || chr(10) || '}' || chr(10)
    || {table}CASE WHEN k % 5 = 0 THEN '// end' ELSE '' END AS content
  FROM b)
SELECT k AS file_id, '/cases/CWE' || n || '/d' || k || '/' || file_name AS path, file_name, ext, content,
       'CWE-' || n || ': Alpha' AS cwe,
       CASE WHEN k % 7 = 3 THEN '9,11'
            ELSE cast(1 + (k * 37) % (length(content) - length(replace(content, chr(10), '')) + 3) AS varchar) END AS vulnerability_location
FROM c
""".replace("{table}", table)


CORPUS_SQL = _corpus_sql("")
LONG_CORPUS_SQL = _corpus_sql(
    f"'static void table()' || chr(10) || '{{' || chr(10) || "
    f"repeat('    step(1);' || chr(10), CAST({TABLE_LINES} + k % 23 AS integer)) || '}}' || chr(10) || ")
