"""Small tables with every awkward case, and real rows around them."""

import random

import pandas as pd

WORDS = "the cat sat on a mat and saw the dog run over red hills far away from any town while rain fell".split()


def texts():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "."]) for _ in range(n))
    passage, base = prose(60), prose(200)
    words = base.split()
    rows = [(i, prose(r.randint(1, 120))) for i in range(1, 15)]
    rows += [(20, base), (21, base), (22, " ".join([*words[:100], "xyzzy", *words[101:]])), (23, f"{prose(30)} {passage} {prose(20)}"),
             (24, f"{passage}\n{prose(5)}"), (25, f"é{passage}ü"), (26, "a" * 300), (27, "a" * 200 + " b"), (28, "un deux"), (29, "un  deux"),
             (30, None), (31, ""), (32, " \n\t "), (33, "# * $ | < >\n# * $ | < >\n\nlast <|endoftext|> 日本語 \x1c\u00a0x\u2003y 😀"),
             (34, f"{passage} {passage}"), (20, base), (35, prose(4000)), (36, None), (None, base), (None, prose(40)), (None, None)]
    return rows


def documents(spark):
    rows = texts()
    frame = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": pd.Series([r[1] for r in rows], dtype=object)})
    values = [(None if pd.isna(a) else int(a), t, "en", None if i % 7 == 3 else f"s{i % 3}", len(t or ""), "x", i, "k", 1, "k", 2)
              for i, (a, t) in enumerate(zip(frame["doc_id"], frame["text"], strict=True))]
    # names that the operators use inside, as columns of the table
    return spark.createDataFrame(values, "doc_id long, text string, lang string, source string, n_chars long, quality_verdict string, "
                                         "mix_place int, simhash_fp string, doc_order int, doc_key string, repeat_at int")


def empty(spark):
    return documents(spark).limit(0)
