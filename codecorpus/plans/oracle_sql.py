"""Oracle SQL per query key (DuckDB dialect, driver tables as views)."""

from __future__ import annotations

from codecorpus.functions import patterns as P
from codecorpus.plans.oracle import CORPUS, FILES, FUNCTION_CHAIN, LINES, LINES_C, LONG_CORPUS, NAME_RE, q, with_ctes


def _thresholds(ts) -> str:
    return "(VALUES " + ", ".join(f"({int(t)})" for t in ts) + ") AS th(threshold)"


THRESHOLD_RETENTION = with_ctes(
    *FUNCTION_CHAIN,
    ("base", """SELECT count(*) AS bt, count(*) FILTER (WHERE label = 'POSITIVE') AS bp,
                       count(*) FILTER (WHERE label = 'NEGATIVE') AS bn FROM functions"""),
    ("per", f"""SELECT threshold, count(f.lines) AS total,
                       count(*) FILTER (WHERE f.label = 'POSITIVE') AS positive,
                       count(*) FILTER (WHERE f.label = 'NEGATIVE') AS negative
                FROM {_thresholds(P.NOTEBOOK_THRESHOLDS)} LEFT JOIN functions f ON f.lines >= th.threshold
                GROUP BY threshold"""),
    body="""SELECT threshold, total, positive, negative,
       round(CASE WHEN total > 0 THEN positive * 100.0::DOUBLE / total ELSE 0 END, 6) AS pos_pct,
       round(CASE WHEN bt > 0 THEN total * 100.0::DOUBLE / bt ELSE 0 END, 6) AS retained_pct,
       round(CASE WHEN bp > 0 THEN positive * 100.0::DOUBLE / bp ELSE 0 END, 6) AS pos_retained_pct,
       round(CASE WHEN bn > 0 THEN negative * 100.0::DOUBLE / bn ELSE 0 END, 6) AS neg_retained_pct,
       bt AS baseline_total, bp AS baseline_positive, bn AS baseline_negative
FROM per, base""",
)

FUNCTIONS = with_ctes(*FUNCTION_CHAIN, body="SELECT * FROM functions")


def _zip_strip(col: str, pattern: str, repl: str) -> str:
    """Rebuild text from split pieces and transformed matches (mirrors the
    newline-keeping / layout-keeping strippers)."""
    p = f"string_split_regex({col}, {q(pattern)})"
    m = f"regexp_extract_all({col}, {q(pattern)})"
    return (f"array_to_string(list_transform(generate_series(1, len({p})), "
            f"lambda k: {p}[k] || coalesce(regexp_replace({m}[k], '[^\\n\\r]', {q(repl)}, 'g'), '')), '')")


STRIP_NL = _zip_strip("content", P.COMMENT_SPACED, "")
STRIP_LAYOUT = _zip_strip("content", P.COMMENT_ANY, " ")
STRIP_ALL = f"regexp_replace(content, {q(P.COMMENT_SPACED)}, '', 'g')"


def _rust_lines(t: str) -> str:
    return (f"((length({t}) - length(replace({t}, chr(10), ''))) + "
            f"CASE WHEN length({t}) > 0 AND NOT suffix({t}, chr(10)) THEN 1 ELSE 0 END)")


def _sfx(path: str) -> str:
    fn = f"regexp_extract({path}, {q(NAME_RE)}, 0)"
    return f"CASE WHEN contains({fn}, '_bad') THEN '_bad' WHEN contains({fn}, '_good') THEN '_good' ELSE '' END"


ORACLE: dict[str, str] = {
    "lines": with_ctes(CORPUS, FILES, LINES, LINES_C, body=(
        "SELECT file_id, i + 1 AS line_no, line, c AS depth FROM lines_c")),
    "strip_keep_newlines": with_ctes(CORPUS, body=f"SELECT file_id, {STRIP_NL} AS content FROM corpus"),
    "strip_keep_layout": with_ctes(CORPUS, body=f"SELECT file_id, {STRIP_LAYOUT} AS content FROM corpus"),
    "strip_all": with_ctes(CORPUS, body=f"SELECT file_id, {STRIP_ALL} AS content FROM corpus"),
    "comment_audit": with_ctes(CORPUS, ("a", f"""SELECT file_id, {_rust_lines('content')} AS lines_before,
            {_rust_lines(STRIP_NL)} AS lines_newlines, {_rust_lines(STRIP_LAYOUT)} AS lines_layout FROM corpus"""),
        body="""SELECT file_id, lines_before, lines_newlines, lines_layout,
                lines_before = lines_newlines AS ok_newlines, lines_before = lines_layout AS ok_layout FROM a"""),
    "testcase_groups": with_ctes(CORPUS, FILES, body="""
        SELECT test_case_id, count(*) AS n_files, min(path) AS first_path, max(path) AS last_path
        FROM files GROUP BY test_case_id"""),
    "testcase_limit": with_ctes(CORPUS, FILES, body="""
        SELECT test_case_id, path FROM files
        WHERE test_case_id IN (SELECT DISTINCT test_case_id FROM files ORDER BY test_case_id LIMIT 5)"""),
    "file_counts": with_ctes(CORPUS, FILES, body="SELECT ext, language, count(*) AS n_files FROM files GROUP BY ext, language"),
    "subfolders": with_ctes(CORPUS, body=f"""SELECT regexp_extract(path, {q(r'^(.*)[/\\][^/\\]+$')}, 1) AS folder_name,
        count(*) AS n_files, min(path) AS first_path FROM corpus GROUP BY 1"""),
    "functions": FUNCTIONS,
    "function_names": with_ctes(*FUNCTION_CHAIN, body="""
        SELECT DISTINCT f.test_case_id, e.name FROM extracted e JOIN files f USING (file_id)"""),
    "function_labels": with_ctes(*FUNCTION_CHAIN, body=f"""
        SELECT path, name, start_line, {_sfx('path')} AS file_suffix, label FROM functions"""),
    "function_labels_note": with_ctes(*FUNCTION_CHAIN, ("has", """
        SELECT f.test_case_id, bool_or(e.name = 'badSink') AS has_badsink
        FROM extracted e JOIN files f USING (file_id) GROUP BY f.test_case_id"""), body="""
        SELECT path, name, start_line, label,
               CASE WHEN contains(name, 'badSink') OR (contains(name, 'bad') AND NOT coalesce(has_badsink, false))
                    THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label_note
        FROM functions LEFT JOIN has USING (test_case_id)"""),
    "line_labels": with_ctes(*FUNCTION_CHAIN, body="""
        SELECT file_id, name, label, unnest(generate_series(start_line, end_line)) AS line_no FROM functions"""),
    "testcase_summary": with_ctes(*FUNCTION_CHAIN, ("g", "SELECT test_case_id, count(*) AS n_files FROM files GROUP BY 1"),
        ("p", """SELECT test_case_id, count(*) AS total_functions,
                 count(*) FILTER (WHERE label = 'POSITIVE') AS positive_functions,
                 count(*) FILTER (WHERE label = 'NEGATIVE') AS negative_functions FROM functions GROUP BY 1"""),
        body="""SELECT test_case_id, n_files, coalesce(total_functions, 0) AS total_functions,
                coalesce(positive_functions, 0) AS positive_functions, coalesce(negative_functions, 0) AS negative_functions
                FROM g LEFT JOIN p USING (test_case_id)"""),
    "dataset_summary": with_ctes(*FUNCTION_CHAIN,
        ("ft", """SELECT coalesce(language, 'ALL') AS language, count(DISTINCT test_case_id) AS test_cases, count(*) AS files
                  FROM files GROUP BY ROLLUP (language)"""),
        ("fn", """SELECT coalesce(language, 'ALL') AS language, count(*) AS total_functions,
                  count(*) FILTER (WHERE label = 'POSITIVE') AS positive_functions,
                  count(*) FILTER (WHERE label = 'NEGATIVE') AS negative_functions FROM functions GROUP BY ROLLUP (language)"""),
        body="""SELECT language, test_cases, files, coalesce(total_functions, 0) AS total_functions,
                coalesce(positive_functions, 0) AS positive_functions, coalesce(negative_functions, 0) AS negative_functions
                FROM ft LEFT JOIN fn USING (language)"""),
    "threshold_retention": THRESHOLD_RETENTION,
    "size_stats": with_ctes(*FUNCTION_CHAIN, body="""
        SELECT coalesce(label, 'ALL') AS label, count(*) AS n, round(avg(lines), 6) AS mean,
               round(quantile_cont(lines, 0.5), 6) AS median, min(lines) AS min_lines, max(lines) AS max_lines,
               round(stddev_pop(lines), 6) AS std_pop
        FROM functions GROUP BY ROLLUP (label)"""),
    "size_histogram": with_ctes(*FUNCTION_CHAIN, ("r", "SELECT min(lines) AS mn, max(lines) AS mx FROM functions"),
        ("c", f"""SELECT CASE WHEN mx = mn THEN {P.HIST_BINS // 2}
                         ELSE least(floor((lines - mn) * {P.HIST_BINS} / (mx - mn)), {P.HIST_BINS - 1}) END AS bin,
                         count(*) AS n FROM functions, r GROUP BY 1"""),
        body=f"""SELECT b.bin,
                round(CASE WHEN mx = mn THEN (mn - 0.5) + b.bin * 1.0 / {P.HIST_BINS} ELSE mn + b.bin * (mx - mn) / {P.HIST_BINS} END, 6) AS lo,
                round(CASE WHEN mx = mn THEN (mn - 0.5) + (b.bin + 1) * 1.0 / {P.HIST_BINS} ELSE mn + (b.bin + 1) * (mx - mn) / {P.HIST_BINS} END, 6) AS hi,
                coalesce(c.n, 0) AS n
                FROM range({P.HIST_BINS}) b(bin) CROSS JOIN r LEFT JOIN c ON c.bin = b.bin"""),
    "size_histogram_by_label": with_ctes(*FUNCTION_CHAIN, ("r", "SELECT max(lines) AS mx FROM functions"),
        ("c", f"""SELECT label, least(floor(lines * {P.LABEL_HIST_EDGES - 1} / mx), {P.LABEL_HIST_EDGES - 2}) AS bin, count(*) AS n
                  FROM functions, r GROUP BY 1, 2"""),
        body=f"""SELECT l.label, b.bin, round(b.bin * mx / {P.LABEL_HIST_EDGES - 1}.0, 6) AS lo,
                round((b.bin + 1) * mx / {P.LABEL_HIST_EDGES - 1}.0, 6) AS hi, coalesce(c.n, 0) AS n
                FROM (VALUES ('POSITIVE'), ('NEGATIVE')) l(label) CROSS JOIN range({P.LABEL_HIST_EDGES - 1}) b(bin) CROSS JOIN r
                LEFT JOIN c ON c.label = l.label AND c.bin = b.bin"""),
    "size_boxplot": with_ctes(*FUNCTION_CHAIN, ("qs", """SELECT label, quantile_cont(lines, 0.25) AS q1,
                quantile_cont(lines, 0.5) AS median, quantile_cont(lines, 0.75) AS q3 FROM functions GROUP BY label"""),
        body=f"""SELECT label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
                min(lines) FILTER (WHERE lines >= q1 - {P.WHISKER} * (q3 - q1)) AS whisker_lo,
                max(lines) FILTER (WHERE lines <= q3 + {P.WHISKER} * (q3 - q1)) AS whisker_hi,
                count(*) FILTER (WHERE lines < q1 - {P.WHISKER} * (q3 - q1) OR lines > q3 + {P.WHISKER} * (q3 - q1)) AS n_outliers
                FROM functions JOIN qs USING (label) GROUP BY label, q1, median, q3"""),
    "size_ecdf": with_ctes(*FUNCTION_CHAIN, ("c", "SELECT lines, count(*) AS n FROM functions GROUP BY lines"),
        body="""SELECT lines, n, sum(n) OVER (ORDER BY lines) AS cum_n,
                round(sum(n) OVER (ORDER BY lines) / sum(n) OVER (), 6) AS ecdf FROM c"""),
    "size_middle": with_ctes(*FUNCTION_CHAIN, ("r", """SELECT *, row_number() OVER (ORDER BY lines, test_case_id, path, start_line) - 1 AS pos,
                count(*) OVER () AS n FROM functions"""),
        body="""SELECT pos, name, lines, label, test_case_id, path, start_line FROM r
                WHERE pos BETWEEN n // 2 - 2 AND n // 2 + 2"""),
    "size_smallest": with_ctes(*FUNCTION_CHAIN, body="""SELECT name, lines, label, test_case_id, path, start_line FROM functions
                ORDER BY lines, test_case_id, path, start_line LIMIT 5"""),
    "size_largest": with_ctes(*FUNCTION_CHAIN, body="""SELECT name, lines, label, test_case_id, path, start_line FROM functions
                ORDER BY lines DESC, test_case_id DESC, path DESC, start_line DESC LIMIT 5"""),
}


# --- curation, windows, features -------------------------------------------------
from codecorpus.plans.oracle import EXT_RE  # noqa: E402

W = P.WINDOW_LINES
_H = "(('0x' || substr(md5({}), 1, 8))::BIGINT)"


def _h(expr: str) -> str:
    return _H.format(expr)


MAN = ("man", f"""
  SELECT file_id AS doc_pos, 0 AS file_pos, file_name,
         CASE WHEN file_id % 11 = 0 THEN 'CWE-000: Other' ELSE cwe END AS cwe,
         vulnerability_location, len(string_split(vulnerability_location, ',')) AS n_lines
  FROM corpus WHERE file_id % 13 <> 0""")

INGEST = ("ingest", f"""
  SELECT * FROM (
    SELECT file_id, regexp_extract(path, {q(r'^(.*)[/\\][^/\\]+$')}, 1) AS folder, path, fn AS file_name,
           regexp_extract(fn, {q(EXT_RE)}, 1) AS file_extension, content
    FROM (SELECT *, regexp_extract(path, {q(NAME_RE)}, 0) AS fn FROM corpus))
  WHERE starts_with(file_name, 'CWE') AND file_extension IN ('.java', '.c', '.cpp') AND folder <> ''""")

TESTCASE = ("testcase", """
  SELECT i.file_id, i.folder, i.path, i.file_name, i.file_extension, i.content, l.cwe, l.vulnerability_location
  FROM ingest i JOIN (SELECT file_name, arg_max(cwe, doc_pos) AS cwe, arg_max(vulnerability_location, doc_pos) AS vulnerability_location
                      FROM man GROUP BY file_name) l USING (file_name)""")

CASES = ("cases", f"""
  SELECT file_id,
         CASE WHEN rn <= floor(n * 70 / 100) THEN 0 WHEN rn <= floor(n * 70 / 100) + floor(n * 20 / 100) THEN 1 ELSE 2 END AS model_id,
         file_name, file_extension, {STRIP_NL} AS file_content, cwe, vulnerability_location
  FROM (SELECT *, row_number() OVER (PARTITION BY file_extension ORDER BY path, file_id) AS rn,
               count(*) OVER (PARTITION BY file_extension) AS n FROM testcase)""")

WIN = ("win", f"""
  SELECT file_id, file_name, cwe, 0 AS cwe_int,
         CASE WHEN inside THEN L - st END AS vulnerability_location,
         CASE WHEN inside THEN array_to_string(lines[st + 1 : en], chr(10)) ELSE '' END AS vlw_content,
         0 AS "offset", model_id
  FROM (SELECT *, L >= 0 AND L < len(lines) AS inside, greatest(0, L - bf) AS st,
               least(len(lines), L + ({W - 1} - bf) + 1) AS en
        FROM (SELECT file_id, file_name, cwe, model_id, TRY_CAST(trim(vulnerability_location) AS INTEGER) AS L,
                     string_split(file_content, chr(10)) AS lines, ({_h("'vlw' || file_id")} % {W - 1}) + 1 AS bf
              FROM cases WHERE NOT contains(vulnerability_location, ','))
        WHERE L IS NOT NULL)""")

HS = ("hs", f"""SELECT file_id, file_name, model_id,
       CASE WHEN {_h("'split' || file_id")} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM win""")

TOK = ("tok", f"""
  SELECT file_id, line_no, pos, token FROM (
    SELECT file_id, line_no, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (
      SELECT file_id, line_no, string_split(line, ' ') AS t FROM (
        SELECT file_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no
        FROM (SELECT file_id, string_split(vlw_content, chr(10))[1:{W}] AS l FROM win))))
  WHERE token <> ''""")

VOCAB = ("vocab", """SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS token_id
                     FROM (SELECT token, count(*) AS n FROM tok GROUP BY token)""")

ENC = ("enc", """SELECT file_id, line_no, list(token_id ORDER BY pos) AS ids FROM tok JOIN vocab USING (token)
                 GROUP BY file_id, line_no""")

_PAD = ("list_concat(CASE WHEN len(x) > 98 THEN x[len(x) - 97 : len(x)] ELSE x END, "
        "list_transform(range(greatest(98 - len(x), 0)), lambda i: 0))")

TR = ("tr", f"""SELECT w.file_id, w.file_name, h.split, w.vulnerability_location AS rel FROM win w JOIN hs h USING (file_id)
                WHERE len(string_split(w.vlw_content, chr(10))[1:{W}]) = {W}""")
PADDED = ("padded", f"""SELECT file_id, line_no, {_PAD.replace('x', 'coalesce(e.ids, [])')} AS ids
                        FROM (SELECT file_id, unnest(range({W})) AS line_no FROM tr) l LEFT JOIN enc e USING (file_id, line_no)""")
SEQS = ("seqs", """SELECT file_id, array_to_string(list(array_to_string(ids, ',') ORDER BY line_no), '|') AS seq,
                   count(*) AS n_lines, count(*) FILTER (WHERE len(ids) <> 98) AS bad_lines FROM padded GROUP BY file_id""")

CUR = (LONG_CORPUS, MAN, INGEST, TESTCASE, CASES, WIN)
FEAT = CUR + (HS, TOK, VOCAB, ENC)
TRAIN = FEAT + (TR, PADDED, SEQS)

SCORES = ("scores", """SELECT l.doc_id AS row_id, l.toxic AS label, l.quality, (d.n_chars % 997) / 997.0::DOUBLE AS score
                       FROM labels l JOIN documents d USING (doc_id)""")
EP = ("ep", """SELECT user_id AS trial, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
                      value AS valid_loss FROM events""")


def _auroc(label: str, name: str) -> str:
    return f"""SELECT (sum(pos) + sum(neg))::BIGINT AS n, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
       round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                  THEN sum(pos * (neg_below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) ELSE 0 END, 6) AS auroc,
       '{name}' AS label_name
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS neg_below
      FROM (SELECT 1.0::DOUBLE / (1.0::DOUBLE + exp(-score)) AS s, sum({label})::DOUBLE AS pos, sum(1 - {label})::DOUBLE AS neg
            FROM scores GROUP BY 1))"""


def _clog(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN greatest(ln({x}), -100.0) ELSE -100.0 END"


ORACLE.update({
    "manifest_flaws": with_ctes(LONG_CORPUS, MAN, body="SELECT doc_pos, file_pos, file_name, cwe, vulnerability_location, n_lines FROM man"),
    "manifest_nested": with_ctes(CORPUS, body="""
        SELECT file_id AS doc_pos, 0 AS file_pos, file_name,
               CASE file_id % 4 WHEN 1 THEN 'CWE-9: Last' WHEN 2 THEN 'A & B > C' ELSE cwe END AS cwe,
               vulnerability_location || CASE WHEN file_id % 4 = 1 THEN ',99' ELSE '' END AS vulnerability_location,
               len(string_split(vulnerability_location, ',')) + CASE WHEN file_id % 4 = 1 THEN 1 ELSE 0 END AS n_lines
        FROM corpus WHERE file_id % 8 <> 3
        UNION ALL
        SELECT file_id, 1, file_name || '.inner', cwe, vulnerability_location, len(string_split(vulnerability_location, ','))
        FROM corpus WHERE file_id % 4 = 1"""),
    "manifest_rejects": with_ctes(CORPUS, body="""
        SELECT file_id AS doc_pos, length('<testcase><file path="' || file_name || '">' || array_to_string(list_transform(
               string_split(vulnerability_location, ','), lambda x: '<flaw line="' || x || '" name="' || cwe || '"/>'), '') || '</testcase>') AS n_chars
        FROM corpus WHERE file_id % 8 = 3"""),
    "manifest_join": with_ctes(LONG_CORPUS, MAN, INGEST, TESTCASE, body="""
        SELECT file_id, folder, path, file_name, file_extension, cwe, vulnerability_location FROM testcase"""),
    "prefix_split": with_ctes(LONG_CORPUS, MAN, INGEST, TESTCASE, CASES, body="""
        SELECT file_id, model_id, file_name, file_extension, cwe, vulnerability_location, md5(file_content) AS content_md5 FROM cases"""),
    "cases": with_ctes(LONG_CORPUS, MAN, INGEST, TESTCASE, CASES, body=f"""
        SELECT c.file_id, c.model_id, c.file_name, c.cwe, c.vulnerability_location, md5(c.file_content) AS content_md5
        FROM cases c JOIN testcase t USING (file_id) WHERE {_rust_lines('c.file_content')} = {_rust_lines('t.content')}"""),
    "case_rejects": with_ctes(LONG_CORPUS, MAN, INGEST, TESTCASE, CASES, body=f"""
        SELECT c.file_id, c.model_id, c.file_name, c.file_extension, {_rust_lines('t.content')} AS lines_before, {_rust_lines('c.file_content')} AS lines_after
        FROM cases c JOIN testcase t USING (file_id) WHERE {_rust_lines('c.file_content')} <> {_rust_lines('t.content')}"""),
    "line_windows_one_based": with_ctes(LONG_CORPUS, MAN, INGEST, TESTCASE, CASES,
        (WIN[0], WIN[1].replace("AS INTEGER) AS L", "AS INTEGER) - 1 AS L")), body="""
        SELECT file_id, coalesce(TRY_CAST(regexp_extract(cwe, '[0-9]+', 0) AS BIGINT), 0) AS cwe_int, vulnerability_location,
               md5(vlw_content) AS content_md5 FROM win"""),
    "window_rejects": with_ctes(LONG_CORPUS, MAN, INGEST, TESTCASE, CASES, body="""
        SELECT file_id, file_name, 'L' || vulnerability_location AS vulnerability_location FROM cases
        WHERE file_id % 9 = 0 AND NOT contains(vulnerability_location, ',')"""),
    "pk_violations": with_ctes(*CUR, body="""
        SELECT 'Cases' AS table_name, model_id::BIGINT AS model_id, file_name, count(*) AS n FROM cases
        GROUP BY model_id, file_name HAVING count(*) > 1
        UNION ALL
        SELECT 'VLW2', NULL::BIGINT, file_name, count(*) FROM win GROUP BY file_name HAVING count(*) > 1"""),
    "class_histogram": with_ctes(*CUR, body="SELECT cwe, count(cwe) AS total FROM win GROUP BY cwe"),
    "line_windows": with_ctes(*CUR, body="""
        SELECT file_id, file_name, cwe, cwe_int, vulnerability_location, "offset", model_id, vlw_content FROM win"""),
    "hash_split": with_ctes(*CUR, HS, body="SELECT file_id, file_name, model_id, split FROM hs"),
    "vocab": with_ctes(*CUR, TOK, VOCAB, body="SELECT token, n, token_id FROM vocab"),
    "token_encode": with_ctes(*FEAT, body="SELECT file_id, line_no, array_to_string(ids, ' ') AS ids FROM enc"),
    "token_lengths": with_ctes(*FEAT, body="""
        SELECT coalesce(split, 'ALL') AS split, max(len(ids)) AS max_tokens FROM enc JOIN hs USING (file_id) GROUP BY ROLLUP (split)"""),
    "training_rows": with_ctes(*TRAIN, body=f"""
        SELECT tr.file_id, file_name, split, seq,
               array_to_string(list_transform(range({W}), lambda i: CASE WHEN i = rel THEN 1 ELSE 0 END), ',') AS label
        FROM tr JOIN seqs USING (file_id)"""),
    "training_rejects": with_ctes(*CUR, HS, body=f"""
        SELECT * FROM (
          SELECT w.file_id, w.file_name, split, n_lines, loc AS vulnerability_location,
                 CASE WHEN n_lines < {W} THEN 'lines' WHEN loc IS NULL THEN 'no location'
                      WHEN loc NOT BETWEEN 0 AND {W - 1} THEN 'location out of range' END AS reason
          FROM (SELECT file_id, file_name, len(string_split(vlw_content, chr(10)))::BIGINT AS n_lines,
                       vulnerability_location + CASE WHEN file_id % 7 = 0 THEN {W} ELSE 0 END AS loc FROM win) w
          JOIN hs ON hs.file_id = w.file_id) WHERE reason IS NOT NULL"""),
    "window_lines": with_ctes(*CUR, body="""
        SELECT file_id, unnest(range(len(l))) AS line_no, unnest(l) AS line, unnest(range(len(l))) = loc AS is_location
        FROM (SELECT file_id, vulnerability_location AS loc, string_split(vlw_content, chr(10)) AS l FROM win
              WHERE vulnerability_location IS NOT NULL)"""),
    "shape_audit": with_ctes(*TRAIN, body=f"""
        SELECT count(*) AS rows, count(*) FILTER (WHERE n_lines <> {W} OR bad_lines > 0) AS bad_seq,
               count(*) FILTER (WHERE rel IS NULL OR rel < 0 OR rel >= {W}) AS bad_label
        FROM tr JOIN seqs USING (file_id)"""),
    "batches": with_ctes(*TRAIN, ("b", f"""SELECT tr.*, row_number() OVER (PARTITION BY split ORDER BY {_h("'batch' || file_id")}, file_id) AS rn
                                          FROM tr JOIN seqs USING (file_id)"""), body=f"""
        SELECT split, (rn - 1) // {P.BATCH_SIZE} AS batch_id, count(*) AS n_rows, sum(rel) AS label_pos_sum, min(file_id) AS first_file_id
        FROM b GROUP BY 1, 2 HAVING count(*) = {P.BATCH_SIZE}"""),
    "embedding_lookup": with_ctes(*CUR, TOK, VOCAB, body="""
        SELECT file_id, dim, n_tokens, n_matched, CASE WHEN v = 0 THEN 0 ELSE v END AS value FROM (
        SELECT t.file_id, d.dim, sum(t.n)::BIGINT AS n_tokens, coalesce(sum(t.n) FILTER (WHERE e.vec_id IS NOT NULL), 0)::BIGINT AS n_matched,
               round(sum(t.n * coalesce(e.embedding[d.dim + 1]::DOUBLE, 0)) / sum(t.n), 4) AS v
        FROM (SELECT file_id, token_id, count(*) AS n FROM tok JOIN vocab USING (token) GROUP BY 1, 2) t
        LEFT JOIN embeddings e ON e.vec_id = t.token_id CROSS JOIN range(64) d(dim) GROUP BY t.file_id, d.dim)"""),
    "sequence_vectors": with_ctes(*CUR, TOK, VOCAB, body="""
        SELECT file_id, line_no, count(*) AS n_tokens, md5(string_agg(array_to_string(list_transform(range(1, 65),
                 lambda i: CAST(round(coalesce(e.embedding[i]::DOUBLE, 0) * 10000) AS BIGINT)), ','), ';' ORDER BY pos)) AS vectors_md5
        FROM tok JOIN vocab USING (token) LEFT JOIN embeddings e ON e.vec_id = token_id GROUP BY file_id, line_no"""),
    "sequence_attention": with_ctes(*CUR, TOK, VOCAB,
        ("sc", """SELECT file_id, n, v, list_reduce(list_transform(range(64), lambda i: v[i + 1] * ((i % 7 - 3) / 10.0::DOUBLE)), lambda a, x: a + x, 0.0::DOUBLE) AS s
                  FROM (SELECT t.file_id, t.n, list_transform(range(1, 65), lambda i: coalesce(e.embedding[i]::DOUBLE, 0)) AS v
                        FROM (SELECT file_id, token_id, count(*) AS n FROM tok JOIN vocab USING (token) GROUP BY 1, 2) t
                        LEFT JOIN embeddings e ON e.vec_id = t.token_id)"""),
        ("ex", "SELECT sc.*, n * exp(s - max(s) OVER (PARTITION BY file_id)) AS e FROM sc"),
        body="""SELECT file_id, dim - 1 AS dim, CASE WHEN v = 0 THEN 0 ELSE v END AS value FROM (
                  SELECT file_id, dim, round(sum(e * x) / any_value(z), 4) AS v FROM (
                    SELECT file_id, e, sum(e) OVER (PARTITION BY file_id) AS z, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM ex)
                  GROUP BY file_id, dim)"""),
    "mean_pool": """SELECT label, dim - 1 AS dim, round(avg(x::DOUBLE), 5) AS value, count(*) AS n
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim""",
    "attention_pool": with_ctes(
        ("w", "SELECT list_transform(range(64), lambda d: ((d % 7) - 3) / 10.0::DOUBLE) AS w"),
        ("sc", """SELECT e.label, e.vec_id, e.embedding,
                  list_reduce(list_transform(range(64), lambda i: e.embedding[i + 1] * w.w[i + 1]), lambda a, x: a + x, 0.0::DOUBLE) AS s
                  FROM embeddings e, w"""),
        ("ex", "SELECT sc.*, exp(s - max(s) OVER (PARTITION BY label)) AS e FROM sc"),
        body="""SELECT label, dim - 1 AS dim, round(sum(e * x) / any_value(z), 5) AS value FROM (
                  SELECT label, e, sum(e) OVER (PARTITION BY label) AS z, unnest(embedding)::DOUBLE AS x,
                         generate_subscripts(embedding, 1) AS dim FROM ex) GROUP BY label, dim"""),
    "auroc": with_ctes(SCORES, body=_auroc("label", "toxic") + "\nUNION ALL\n" + _auroc("quality", "quality")),
    "bce_loss": with_ctes(SCORES, body=f"""SELECT count(*) AS n,
        round(avg(-(label * {_clog('score')} + (1 - label) * {_clog('1 - score')})), 6) AS bce FROM scores"""),
    "bce_epoch": with_ctes(SCORES, ("c", f"""SELECT row_number() OVER (ORDER BY {_h("'batch' || row_id")}, row_id) AS rn,
            -(label * {_clog('score')} + (1 - label) * {_clog('1 - score')}) AS cell FROM scores"""),
        body=f"""SELECT count(*) AS batches, round(avg(m), 6) AS bce_epoch
                 FROM (SELECT (rn - 1) // {P.BATCH_SIZE} AS batch, avg(cell) AS m FROM c GROUP BY 1)"""),
    "weighted_bce": with_ctes(SCORES, body=f"""SELECT count(*) AS n,
        round(avg(-({P.WEIGHTED_BCE_ALPHA} * label * ln(score + {P.WEIGHTED_BCE_EPS}) + (1 - {P.WEIGHTED_BCE_ALPHA}) * (1 - label) * ln(1 - score + {P.WEIGHTED_BCE_EPS}))), 6) AS wbce,
        round(avg(-({P.WEIGHTED_BCE_ALPHA} * label * ln(score + {P.WEIGHTED_BCE_EPS}) - (1 - {P.WEIGHTED_BCE_ALPHA}) * (1 - label) * ln(1 - score + {P.WEIGHTED_BCE_EPS}))), 6) AS wbce_as_written
        FROM scores"""),
    "early_stopping": with_ctes(EP,
        ("es", """SELECT *, min(valid_loss) OVER (PARTITION BY trial ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_min
                  FROM ep"""),
        # reports since an improvement: place inside the run of rows that follow it (the run before the first improvement has none to skip)
        ("es1", """SELECT *, sum(CASE WHEN valid_loss < coalesce(prior_min, 'inf'::DOUBLE) THEN 1 ELSE 0 END)
                   OVER (PARTITION BY trial ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS streak FROM es"""),
        ("es2", """SELECT *, row_number() OVER (PARTITION BY trial, streak ORDER BY epoch)
                   - CASE WHEN streak > 0 THEN 1 ELSE 0 END AS counter FROM es1"""),
        ("per", f"""SELECT trial, count(*) AS n_epochs, min(epoch) FILTER (WHERE counter = {P.PATIENCE}) AS stop_epoch FROM es2 GROUP BY trial"""),
        body="""SELECT trial, n_epochs, stop_epoch, count(*) AS epochs_run, round(min(valid_loss), 6) AS best_loss
                FROM ep JOIN per USING (trial) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY trial, n_epochs, stop_epoch"""),
    "best_trial": with_ctes(EP, body="""SELECT trial, epoch, round(valid_loss, 6) AS loss FROM (
        SELECT trial, max(epoch) AS epoch, arg_max(valid_loss, epoch) AS valid_loss FROM ep GROUP BY trial)
        ORDER BY valid_loss, trial LIMIT 1"""),
    "learning_curve": with_ctes(EP, body="""SELECT trial, epoch, round(valid_loss, 6) AS valid_loss,
        round(min(valid_loss) OVER (PARTITION BY trial ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_so_far
        FROM ep"""),
    "testcase_members": with_ctes(CORPUS, FILES, body="SELECT test_case_id, path FROM files"),
    "first_functions": with_ctes(*FUNCTION_CHAIN, ("r", """SELECT test_case_id, path, start_line, name,
                row_number() OVER (PARTITION BY test_case_id ORDER BY path, start_line, name) AS rank FROM functions"""),
        body="SELECT test_case_id, path, start_line, name, rank FROM r WHERE rank <= 3"),
    "audit_rejects": with_ctes(CORPUS, body=f"""SELECT file_id, path, {_rust_lines('content')} AS lines_before, {_rust_lines(STRIP_NL)} AS lines_after
        FROM corpus WHERE {_rust_lines('content')} <> {_rust_lines(STRIP_NL)}"""),
    "exact_split": with_ctes(*CUR, ("r", f"""SELECT file_id, row_number() OVER (ORDER BY {_h("'split' || file_id")}, file_id) AS rn,
                count(*) OVER () AS n FROM win"""), body="""
        SELECT file_id, CASE WHEN rn <= ceil(n * 20 / 100) THEN 'test' ELSE 'train' END AS split FROM r"""),
})
