import random

from codecorpus.operators import functions as fx
from codecorpus.schemas import SOURCE_FILE

SNIPPETS = {
    "/t/a.c": "int f(int a)\n{\n  if (a) {\n    x(a);\n  }\n  return a;\n}\nvoid g() {\n  y();\n}\n",
    # T10: unclosed function -> end = brace line
    "/t/unclosed.c": "void u()\n{\n  z(1);\n",
    # T9: `else if` is a header when outside an accepted function
    "/t/elseif.c": "  else if (x) {\n  a = 1; b = 2; c = 3;\n}\n",
    # T10: one-line balanced body ends at the first later line with balance 0
    "/t/oneline.c": "int one() { return 1; }\nint two() { return 2; }\n",
    # C#: brace on the next line -> no function; nested headers reported (T8)
    "/t/a.cs": "void Next()\n{\n}\npublic void Outer() {\n  if (x) {\n  }\n  private void Inner() {\n  }\n}\n",
    "/t/A.java": "public class A {\n  public static void main(String[] args) throws IOException, X {\n    go(); go();\n"
                 "    stop(); more();\n  }\n  // void no() {\n  private int bad_1()\n\n  {\n  }\n}\n",
    "/t/cmt.c": "/* void c() { */\nvoid d() { // {\n  e(); f(); g();\n}\n",
}


def _frame(spark, files):
    rows = [(i, p, c) for i, (p, c) in enumerate(files.items())]
    return spark.createDataFrame(rows, SOURCE_FILE)


def _got(spark, files):
    ex = fx.extracted_functions(fx.source_files(_frame(spark, files)))
    return {(r.file_id, r.name, r.start_line, r.end_line, r.trivial) for r in ex.collect()}


def test_snippets(spark):
    """Every function of the snippets, by hand: file, name, first and last line, trivial."""
    assert _got(spark, SNIPPETS) == {
        (0, "f", 1, 7, True), (0, "g", 8, 10, True), (1, "u", 1, 2, False), (2, "if", 1, 3, False), (3, "one", 1, 2, False),
        (4, "Inner", 7, 8, False), (4, "Outer", 4, 9, False), (5, "bad_1", 7, 10, False), (5, "main", 2, 5, False), (6, "d", 2, 2, False)}


def test_golden_cases(spark):
    got = _got(spark, SNIPPETS)
    by = {(fid, n): (s, e) for fid, n, s, e, _ in got}
    assert by[(1, "u")] == (1, 2)          # unclosed: end = brace line
    assert (2, "if") in by                 # T9
    assert by[(3, "one")] == (1, 2) and (3, "two") not in by  # T10: next line swallowed
    assert (4, "Next") not in by           # C# needs the brace on the header line
    assert (4, "Inner") in by and (4, "Outer") in by


def _random_file(rng):
    parts = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        if kind < 0.3:
            parts.append(rng.choice(["int", "void", "static char *"]) + f" f{rng.randint(0, 9)}(int a)")
            parts.append(rng.choice(["{", "", "  {"]))
        elif kind < 0.5:
            parts.append(rng.choice(["{", "}", "{ }", "}}", "x(1);", "a = 1; b = 2;", "// {", "/* } */"]))
        elif kind < 0.7:
            parts.append(f"void g{rng.randint(0, 9)}() {{ " + rng.choice(["", "}", "h(); }"]))
        else:
            parts.append(rng.choice(["", "  y(2);", "  if (a) {", "  }", "return a;"]))
    return "\n".join(parts)


def test_random_files_keep_the_rules(spark):
    """Braces balance at a function's end and not before; C and Java functions do not overlap."""
    rng = random.Random(7)
    files = {}
    for i in range(120):
        ext = rng.choice(["c", "cpp", "java", "cs"])
        files[f"/r/f{i}.{ext}"] = _random_file(rng)
    got, texts = _got(spark, files), list(files.items())
    assert got
    for i in range(len(texts)):
        path, text = texts[i]
        lines = text.split("\n")
        found = sorted((s, e) for fid, _, s, e, _ in got if fid == i)
        if not path.endswith(".cs"):
            assert all(a[1] < b[0] for a, b in zip(found, found[1:]))
        for s, e in found:
            open_at = next(k for k in range(s - 1, len(lines)) if "{" in lines[k])
            assert open_at <= s + 1 and s <= e <= len(lines)
            balance = lambda k: sum(x.count("{") - x.count("}") for x in lines[open_at:k])  # noqa: E731, B023
            if e > open_at + 1 and balance(e) == 0:
                assert all(balance(k) != 0 for k in range(open_at + 2, e))


def test_labelled_functions(spark):
    files = {"/x/CWE1_A_01_bad.c": "void helper()\n{\n  a(); b(); c();\n}\nint main(int c)\n{\n  q = 1; r = 2; s = 3;\n}\n"}
    f = fx.functions(fx.source_files(_frame(spark, files))).collect()
    lab = {r.name: r.label for r in f}
    assert lab == {"helper": "POSITIVE", "main": "NEGATIVE"}
    assert all(r.lines == r.end_line - r.start_line + 1 for r in f)


def test_suffix_of_the_path(spark):
    """PRJ-2b: the flag of the whole path, not only of the file's name."""
    files = {"/x_bad/CWE1_A_01.c": "void helper()\n{\n  a(); b(); c();\n}\n"}
    ex = fx.extracted_functions(fx.source_files(_frame(spark, files)))
    assert [r.label for r in fx.label_functions(ex, suffix_from="path").collect()] == ["POSITIVE"]
    assert [r.label for r in fx.label_functions(ex).collect()] == ["NEGATIVE"]


def test_mining_plan_has_no_shuffle(spark, capsys):
    fx.functions(fx.source_files(_frame(spark, SNIPPETS))).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Sort" not in plan and "Python" not in plan


def test_long_and_odd_files(spark):
    """Many functions and unbalanced braces in one file, in time that grows with its length."""
    many = "".join(f"void f{i}()\n{{\n  a(); b(); c();\n}}\n" for i in range(3000))
    files = {"/l/many.c": many, "/l/open.c": "void f() {\n" * 2000, "/l/close.java": "}\n" * 2000, "/l/empty.c": "", "/l/none.cs": "x"}
    got = _got(spark, files)
    assert {g[1:4] for g in got if g[0] == 0} == {(f"f{i}", 4 * i + 1, 4 * i + 4) for i in range(3000)}
    assert {g[0] for g in got} == {0, 1} and len([g for g in got if g[0] == 1]) == 2000
