"""Ranked search, prefix trie and decontamination against brute force."""

import hashlib
import math
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from codecorpus.llm import prefix_trie, treap, winnowing
from codecorpus.session import checkpoint_dir
from tests.llm import fixtures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def rows(df, n=None):
    return sorted((tuple(r)[:n] for r in df.collect()), key=repr)


# ---- ranked search -----------------------------------------------------------

def brute_ranked(docs, items, k=20):
    read = [(d, words(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in read), sum(len(w) for _, w in read)
    df = Counter(t for _, w in read for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(words(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, w in read:
            tf, score = Counter(w), 0
            for t, times in terms.items():
                if tf[t]:
                    m = 100 - 25 + (25 * len(w) * n) // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def searched():
    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "cé", "日", "the", "Of", "X1", "zz", f"rare{r.randint(0, 40)}"])
    docs = [(i, " ".join(word() + r.choice(["", ",", "-"]) for _ in range(r.randint(0, 30)))) for i in range(200)]
    docs += [(None, "a b rare1"), (None, "a b rare1"), (None, None), (7, "a b rare1"), (7, "a b rare1"), (2**63 - 1, "a b rare1"), (-5, "a b rare1"),
             (201, ""), (202, "--"), (203, "rare2 " * 3000), (204, "w" * 100_000)]
    items = [(i, " ".join(word() for _ in range(r.randint(0, 8)))) for i in range(30)]
    return docs, items + [(3, "zz zz"), (None, "a rare2"), (50, None), (51, "nowhere"), (52, "rare1 rare1 a"), (53, "W" * 100_000)]


@pytest.mark.parametrize("shard", [16 << 20, 300])
def test_ranked_search_equals_brute_force(spark, shard):
    docs, items = searched()
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, score string")
    b = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, term string")
    assert rows(treap.ranked(d, b, shard=shard)) == brute_ranked(docs, items)
    assert treap.ranked(d.limit(0), b).count() == 0 and treap.ranked(d, b.limit(0)).count() == 0


def test_one_index_answers_several_searches(spark):
    docs, items = searched()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    size = treap.corpus_size(d.selectExpr("text", "0L as doc_order"))
    index = treap.index(d, size, shard=500)
    for part in (items[:9], items[9:]):
        b = spark.createDataFrame(part, "item_id long, text string")
        assert rows(treap.search(index, b, size[0], k=3)) == brute_ranked(docs, part, 3)


def test_blocks_of_items_meet_every_shard(spark, monkeypatch):
    docs, items = searched()
    monkeypatch.setattr(treap, "ITEMS", 4)
    monkeypatch.setattr(treap, "TERMS", 8)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(i if i is None else str(i), t) for i, t in items], "item_id string, text string")
    found = [(i if i is None else int(i), *x) for i, *x in rows(treap.ranked(d, b, shard=300))]
    assert sorted(found, key=repr) == brute_ranked(docs, items)


def test_shards_are_not_shuffled(spark):
    docs, items = searched()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    size = treap.corpus_size(d.selectExpr("text", "0L as doc_order"))
    found = treap.search(treap.index(d, size, shard=500), spark.createDataFrame(items, "item_id long, text string"), size[0])
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\n\(\d+\) Exchange\nInput[^\n]*", plan)
    assert moved and "masks#" in plan and not any("masks#" in x for x in moved)


def test_a_reader_of_an_index_holds_few_shards(spark, tmp_path):
    r = random.Random(4)
    docs = [(i, " ".join(f"{r.getrandbits(40):x}" for _ in range(2000))) for i in range(400)]  # 8 MB
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    treap.ranked(d, spark.createDataFrame([(1, "none")], "item_id long, text string"), shard=1 << 20)
    newest = max(pathlib.Path(checkpoint_dir(spark).removeprefix("file:")).glob("treaps-*"), key=lambda p: p.stat().st_mtime)
    groups = [g for f in newest.glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) > 5 and max(g.num_rows for g in groups) <= 2


def test_items_hold_no_shards():
    ids = pa.array(range(100_000), pa.int64())
    lists = pa.array([["a"]] * len(ids))
    asked = pa.StructArray.from_arrays([ids, lists, pa.array([[1]] * len(ids)), ids], ["item_id", "terms", "weights", "floor"])
    assert treap.Block(asked.slice(5, 2), 3).ids.get_total_buffer_size() < 1000


def test_quadtree_holds_every_point():
    r = np.random.default_rng(1)
    for n, bits in ((1, 1), (2, 3), (500, 6), (3000, 12)):
        code = r.choice(1 << 2 * bits, n, replace=False)
        row, col, value = code >> bits, code & ((1 << bits) - 1), r.integers(1, 1000, n)
        masks, losses, rests = treap.quadtree(row, col, value, bits)
        t = treap.Treap(bits, masks.tobytes(), treap.packed(losses), treap.packed(rests))
        assert t.top[0] == value.max() and (t.mask == 0).sum() == n
        for k in range(0, n, 7):  # descend to the point
            node = np.array([0])
            for left in range(bits, 0, -1):
                there, node = t.halves(node, row[k:k + 1], np.array([left]), int(col[k] >> (left - 1)) & 1)
                assert there[0]
            assert t.top[node[0]] == value[k]


# ---- prefix trie -------------------------------------------------------------

def brute_trie(turns):
    convs = {}
    for c, t, r, x in turns:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    said = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    rebuilt, members, below = {}, {}, {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(said.get(c - int(math.fmod(c, 5)), [])[:h] + said[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(rebuilt[c][:d], []).append(c)
    for path in members:
        if path:
            below.setdefault(path[:-1], []).append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        kids = below.get(path, [])
        sums[path] = (sum(sums[k][0] for k in kids) if kids else 1,
                      sum(sums[k][1] for k in kids) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0))
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p))))
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, [])), *sums[p],
                    hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()), key=repr)


def talk():
    r = random.Random(1)
    out = [(c, t if r.random() > 0.1 else None, r.choice(["u", "a", None]), r.choice(["x", "yé", "z", None]))
           for c in [*range(-12, 60), None, 2**62] for t in range(r.randint(0, 12))]
    out += [(c, t, "u", f"same {t}") for c in range(100, 160) for t in range(3)]  # one conversation many times
    out += [(200, t, "u", "long" * (t % 3)) for t in range(700)] + [(201, t, "u", "long" * (t % 3)) for t in range(650)]
    return out + [(61, 1, "u", "again")] * 3


@pytest.mark.parametrize("base,arcs", [(4096, 400_000), (4, 60)])
def test_trie_equals_brute_force(spark, base, arcs):
    turns = talk()
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn int, role string, text string, depth int, at string")
    got = prefix_trie.prefix_trie(df, base=base, arcs_a_task=arcs).collect()
    assert sorted((tuple(r)[:8] for r in got), key=repr) == brute_trie(turns)
    # the tour: every place once, arcs nested
    spots = [x for r in got for x in (r.enter_at, r.exit_at)]
    assert sorted(spots) == list(range(2 * len(got))) and all(r.exit_at > r.enter_at for r in got)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_ids_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 7)
    turns = [(c, 0, "u", "same") for c in range(-50, 50)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    assert rows(prefix_trie.prefix_trie(df), 8) == brute_trie(turns)


def test_random_mates_rank_a_list(spark):
    r = random.Random(6)
    order = [(r.randint(-99, 99), i) for i in range(60)]
    r.shuffle(order)
    weights = [(1, r.randint(0, 1), r.randint(0, 9)) for _ in order]
    links = [(*order[i], *(order[i + 1] if i + 1 < len(order) else (None, None)), *weights[i]) for i in range(len(order))]
    df = spark.createDataFrame(links, "conv long, at long, next_conv long, next_at long, rank long, leaves long, saved long")
    got = {(x.conv, x.at): (x.rank, x.leaves, x.saved) for x in prefix_trie.positions(df, base=3).collect()}
    assert got == {o: tuple(map(sum, zip((0, 0, 0), *weights[:i], strict=True))) for i, o in enumerate(order)}


# ---- decontamination -----------------------------------------------------------

def brute_overlap(docs, items, span=10):
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(span, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[a:a + size]), set()).update([] if i is None else [str(i)])
    out = []
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a:a + size]) in windows:
                    hit.update(range(a, a + size))
                    met |= windows[tuple(w[a:a + size])]
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaked():
    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "Cé"])
    docs = [(i, " ".join(word() + r.choice(["", ",", "-"]) for _ in range(r.randint(0, 60)))) for i in range(200)]
    docs += [(None, "a b a"), (None, None), (7, "a b b a"), (7, "a b b a"), (201, ""), (202, "--"), (203, "ha " * 3000), *fixtures.texts()]
    items = [(i, " ".join(word() for _ in range(r.choice([3, 5, 9, 10, 14, 20])))) for i in range(30)]
    return docs, items + [(3, "b b b b a b"), (None, "a a a a a a a a a a a"), (50, None), (51, "--"), (52, "ha " * 25), (53, "un deux"), (54, "deux")]


def test_overlaps_equal_brute_force(spark):
    docs, items = leaked()
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, doc_order int, items string")
    b = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, window string")
    assert rows(winnowing.digests(d, b)) == brute_overlap(docs, items)
    assert rows(winnowing.digests(d, b, span=4)) == brute_overlap(docs, items, 4)
    assert winnowing.digests(d.limit(0), b).count() == 0
    assert winnowing.digests(d, b.limit(0)).filter("contaminated").count() == 0


def test_spans_are_maximal(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = f"x y {' '.join(f'W{i}' for i in range(3, 20))}. z {' '.join(f'w{i}' for i in range(12, 25))}"
    d, b = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("q", item)], "item_id string, text string")
    r = winnowing.overlaps(d, b).first()
    assert [tuple(s) for s in r.spans] == [(2, 18), (20, 32)] and r["items"] == ["q"] and r.n_words == 33


def test_every_window_is_found_by_a_fingerprint():
    r = np.random.default_rng(2)
    h = r.integers(0, 2**63, 400).astype(np.uint64)
    for span in (1, 2, 3, 7, 10):
        of, least, at, many = winnowing.prints(h, np.zeros(400, np.int64), np.zeros(1, np.int64), span)
        covered = [(a + j, x) for a, n, x in zip(at.tolist(), many.tolist(), least.tolist(), strict=True) for j in range(n)]
        places, alone = winnowing.minima(h, np.zeros(400, np.int64), span)
        assert covered == list(zip(places.tolist(), alone.tolist(), strict=True))
        if span > 1:
            assert len(at) < 0.75 * len(places)
    assert pd.Series(covered).is_unique
