"""Function mining (JN-5, WIN-4, WIN-5, FLT-5, FLT-7, STR-9..12).

The reference scans each file line by line.  Here a file stays one row, and its
work is a chain of array expressions over its lines: nothing is exploded, sorted
across rows or shuffled before the functions themselves are rows.

1. events: the lines with a brace or a header of the file's language, with the
   brace balance after them (a running sum over the events alone);
2. candidates: C/C++/Java take the opening brace from the header line or one of
   the next two lines, C# needs it on the header line; the target is the balance
   just before the brace line (C# counts the header as exactly one open brace);
3. end line: the first later line whose balance equals the target.  The balance
   changes at brace lines only, so that is the line after the brace line or a brace
   line; those and the candidates are sorted by (balance, place), and the nearest
   brace line behind a candidate is its answer if it has the same balance;
4. C/C++/Java resume scanning after an accepted function: a fold over the
   candidates keeps one only when it starts after the last kept end; C# keeps every
   candidate;
5. trivial wrappers (at most two statements, one of them a call) are dropped
   and the rest labelled.

Running values take log2(n) passes over a file's events and the fold gathers its
result in blocks, so a file of many functions costs little more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P
from codecorpus.functions.arrays import bind, blocks, running
from codecorpus.functions.code import file_suffix, function_label, language, test_case_id
from codecorpus.functions.text import base_name, count_char, extension, normalize_newlines, py_strip, split_lines


def catalog(corpus: DataFrame) -> DataFrame:
    """SRC-4 + PRJ-1 + PRJ-3 + PRJ-4: per file its name, extension, language
    (NULL when no extractor exists) and test-case id; no text."""
    name = base_name(F.col("path"))
    ext = extension(name)
    return corpus.select(
        "file_id", "path", name.alias("file_name"), ext.alias("ext"),
        language(ext).alias("language"), test_case_id(name).alias("test_case_id"),
    )


def source_files(corpus: DataFrame) -> DataFrame:
    """Files with an extractor, with LF-normalised text (SRC-5)."""
    name = base_name(F.col("path"))
    ext = extension(name)
    return corpus.select(
        "file_id", "path", name.alias("file_name"), ext.alias("ext"),
        language(ext).alias("language"), test_case_id(name).alias("test_case_id"),
        normalize_newlines(F.col("content")).alias("content"),
    ).filter(F.col("language").isNotNull())


def by_file(files: DataFrame) -> DataFrame:
    """One shuffle places each file (and so all of its lines) in one
    partition, for the windows of ``exploded_lines``."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file_id")


def exploded_lines(files: DataFrame) -> DataFrame:
    """STR-5 + WIN-4: one row per line (0-based ``i``) with its brace delta ``d``
    and the running balance ``c`` after the line."""
    lines = files.select("file_id", "language", F.posexplode(split_lines(F.col("content"))).alias("i", "line"))
    w = Window.partitionBy("file_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("d", _delta(F.col("line"))).withColumn("c", F.sum("d").over(w))


def _delta(line: Column) -> Column:
    return count_char(line, "{") - count_char(line, "}")


def _header_name(line: Column, lang: Column) -> Column:
    """Name of the function whose header the line is, else empty."""
    def read(trimmed: Column) -> Column:
        name = (
            F.when(lang == "c", F.regexp_extract(trimmed, P.HEADER_C, 1))
            .when(lang == "java", F.regexp_extract(trimmed, P.HEADER_JAVA, 1))
            .otherwise(F.regexp_extract(trimmed, P.HEADER_CS, 1))
        )
        is_comment = trimmed.startswith("//") | trimmed.startswith("/*")
        return F.when((lang != "cs") & is_comment, F.lit("")).otherwise(name)

    return F.when(_may_name(line), bind(py_strip(line), read)).otherwise(F.lit(""))


def _may_name(line: Column) -> Column:
    """Guards implied by every header pattern: the line holds "(" and the text
    before the first "(" separates type and name by whitespace."""
    return line.contains("(") & py_strip(F.substring_index(line, "(", 1)).rlike(r"\s")


def _events(lines: Column, lang: Column) -> Column:
    """Steps 1: ``i, d, brace, open, name, c`` of the lines with a brace or a header."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    marked = F.filter(numbered, lambda e: e["line"].contains("{") | e["line"].contains("}") | _may_name(e["line"]))
    events = F.filter(F.transform(marked, lambda e: F.struct(
        e["i"].alias("i"), _delta(e["line"]).alias("d"), e["line"].rlike("[{}]").alias("brace"), e["line"].contains("{").alias("open"),
        _header_name(e["line"], lang).alias("name"))), lambda e: e["brace"] | (e["name"] != ""))

    def balanced(ev: Column) -> Column:
        sums = running(F.transform(ev, lambda e: e["d"]), "int", lambda before, x: x + F.coalesce(before, F.lit(0)))
        return F.zip_with(ev, sums, lambda e, c: F.struct(*[e[f].alias(f) for f in ("i", "d", "brace", "open", "name")], c.alias("c")))

    return bind(events, balanced)


def _probe(e: Column, lines: Column, lang: Column) -> Column:
    """Step 2: a header's target balance ``v``, brace line ``pos``, and whether
    the line after that has the target too (``at_once``); null ``pos`` without a brace."""
    after = [F.get(lines, e["i"] + k) for k in (1, 2)]
    has = [F.coalesce(x.contains("{"), F.lit(False)) for x in after]
    off = F.when((lang == "cs") | e["open"], F.lit(0)).when(has[0], F.lit(1)).when(has[1], F.lit(2))
    c1 = e["c"] + F.coalesce(_delta(after[0]), F.lit(0))
    c2 = c1 + F.coalesce(_delta(after[1]), F.lit(0))

    def place(o: Column) -> Column:
        target = F.when(lang == "cs", e["c"] - 1).when(o == 0, e["c"] - e["d"]).when(o == 1, e["c"]).otherwise(c1)
        here = F.when(o == 0, e["c"]).when(o == 1, c1).otherwise(c2)
        plain = F.coalesce(~F.get(lines, e["i"] + o + 1).rlike("[{}]"), F.lit(False))
        return _row(target, e["i"] + o, 1, e["i"] + 1, e["name"], (here == target) & plain)

    return bind(off, place)


def _row(v, pos, kind, start=None, name=None, at_once=None) -> Column:
    none = lambda x, t: (F.lit(None) if x is None else x).cast(t)
    return F.struct(v.cast("int").alias("v"), pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), none(start, "int").alias("start_line"),
                    none(name, "string").alias("name"), none(at_once, "boolean").alias("at_once"))


_FN = "struct<start_line:int,end_line:int,name:string>"


def _candidates(events: Column, lines: Column, lang: Column) -> Column:
    """Steps 2 and 3: ``start_line, end_line, name`` of every candidate, in order."""
    probes = F.filter(F.transform(F.filter(events, lambda e: e["name"] != ""), lambda e: _probe(e, lines, lang)), lambda p: p["pos"].isNotNull())
    braces = F.transform(F.filter(events, lambda e: e["brace"]), lambda e: _row(e["c"], e["i"], 0))

    def matched(rows: Column) -> Column:
        own = F.transform(F.reverse(rows), lambda r: F.when(r["kind"] == 0, F.struct(r["v"].alias("v"), r["pos"].alias("pos"))))
        behind = F.reverse(running(own, "struct<v:int,pos:int>", lambda before, x: F.coalesce(x, before)))
        ends = F.zip_with(rows, behind, lambda r, n: F.struct(
            r["start_line"].alias("start_line"),
            (F.when(r["at_once"], r["pos"] + 2).when(n["v"] == r["v"], n["pos"] + 1).otherwise(r["pos"] + 1)).cast("int").alias("end_line"),
            r["name"].alias("name")))
        return F.array_sort(F.filter(ends, lambda f: f["start_line"].isNotNull()))

    return bind(F.array_sort(F.concat(braces, probes)), matched)


def _resolved(cands: Column, lang: Column, block: int = 64) -> Column:
    """Step 4: C/C++/Java keep a candidate only when it starts after the end of
    the last kept one (the reference resumes scanning there); C# keeps all."""
    none = F.array().cast(f"array<{_FN}>")

    def keep(acc: Column, x: Column) -> Column:
        taken = F.struct(x["end_line"].alias("last"), F.array_append(acc["kept"], x).alias("kept"))
        return F.when(x["start_line"] > acc["last"], taken).otherwise(acc)

    def one(acc: Column, piece: Column) -> Column:
        start = F.struct(acc["last"].alias("last"), none.alias("kept"))
        return bind(F.aggregate(piece, start, keep), lambda r: F.struct(r["last"].alias("last"), F.array_append(acc["all"], r["kept"]).alias("all")))

    init = F.struct(F.lit(0).alias("last"), F.array().cast(f"array<array<{_FN}>>").alias("all"))
    folded = F.when(F.size(cands) > 0, F.flatten(F.aggregate(blocks(cands, block), init, one)["all"])).otherwise(none)
    return F.when(lang == "cs", cands.cast(f"array<{_FN}>")).otherwise(folded)


def trivial_flag(body) -> Column:
    """FLT-5 / STR-12 on the body text: line comments, then block comments,
    then whitespace collapse; trivial iff <= 2 semicolons and a call."""
    t = F.regexp_replace(body, P.BODY_LINE_COMMENT, "")
    t = F.regexp_replace(t, P.BODY_BLOCK_COMMENT, "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return (count_char(t, ";") <= P.MAX_WRAPPER_STATEMENTS) & t.rlike(P.CALL_STATEMENT)


def found_functions(content: Column, lang: Column) -> Column:
    """``name, start_line, end_line, trivial`` of every function of a text, in order."""
    def flagged(f: Column, lines: Column) -> Column:
        # the body: lines start+1 .. end-1 (1-based)
        body_len = F.greatest(f["end_line"] - f["start_line"] - 1, F.lit(0))
        body = F.array_join(F.slice(lines, f["start_line"] + 1, body_len), "\n")
        return F.struct(f["name"].alias("name"), f["start_line"].alias("start_line"), f["end_line"].alias("end_line"), trivial_flag(body).alias("trivial"))

    def mined(lines: Column) -> Column:
        cands = bind(_events(lines, lang), lambda ev: _candidates(ev, lines, lang))
        return F.transform(bind(cands, lambda c: _resolved(c, lang)), lambda f: flagged(f, lines))

    return bind(split_lines(content), mined)


def extracted_functions(files: DataFrame) -> DataFrame:
    """Every function the extractors report (before the trivial filter), with
    its trivial flag and file metadata; one narrow stage over the files."""
    found = files.select("file_id", "language", "path", "file_name", "test_case_id",
                         F.explode(found_functions(F.col("content"), F.col("language"))).alias("f"))
    return found.select("file_id", "language", "path", "file_name", "test_case_id", "f.*")


def functions(files: DataFrame) -> DataFrame:
    """J6 result, flat: one row per non-trivial function with its label."""
    return label_functions(extracted_functions(files))


def label_functions(extracted: DataFrame, suffix_from: str = "file_name") -> DataFrame:
    """Drop trivial wrappers (FLT-5) and label the rest (PRJ-2, PRJ-5).
    ``suffix_from="path"`` takes the ``_bad``/``_good`` flag from the full path
    (PRJ-2b, the notebook's variant)."""
    f = extracted.filter(~F.col("trivial"))
    return f.select(
        "language", "test_case_id", "path", "file_id", "name", "start_line", "end_line",
        (F.col("end_line") - F.col("start_line") + 1).alias("lines"),
        function_label(F.col("name"), file_suffix(F.col(suffix_from))).alias("label"),
    )
