"""Operators on texts against brute force, with nulls, ties, repeats, clashes."""

import hashlib
import os

import numpy as np
import pytest
import xxhash

from codecorpus.llm import bpe, exchange, quality_rules, simhash, suffix_array, suffix_tree
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def order(i):
    return exchange.LAST if i is None else i


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def cut_bytes(rows, size=50):
    """What each text loses, window by window."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - size + 1):
            w = b[j:j + size]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - size + 1):
            if first[b[j:j + size]] < order(i):
                gone[j:j + size] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def test_suffix_array_equals_brute_force(spark):
    got = rows_of(suffix_array.digests(fixtures.documents(spark)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cut_bytes(fixtures.texts())
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(suffix_array.digests(spark.read.parquet(f"{SF}/documents.parquet")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cut_bytes(real)


def test_suffix_array_pieces_and_small_bins(spark, monkeypatch):
    """Texts cut into pieces and many bins give the same result."""
    monkeypatch.setattr(suffix_array, "PIECE", 150)
    monkeypatch.setattr(suffix_array, "BIN_BYTES", 500)
    got = rows_of(suffix_array.digests(fixtures.documents(spark)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == cut_bytes(fixtures.texts())


def test_suffix_array_cleaned_keeps_columns(spark):
    docs = fixtures.documents(spark)
    out = suffix_array.cleaned(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {(r.doc_id, r.mix_place): r.text for r in out.collect()}
    assert by[30, 24] is None and by[21, 15] == "" and by[20, 14] == by[20, 29] == dict(fixtures.texts())[20]
    assert suffix_array.digests(fixtures.empty(spark)).count() == 0


def cut_words(rows, size=20):
    texts = list(dict.fromkeys(rows))  # rows of one id and text are one document
    seen = {}
    for k, (i, t) in enumerate(texts):
        w = (t or "").encode().split()
        for j in range(len(w) - size + 1):
            seen.setdefault(tuple(w[j:j + size]), []).append((order(i), k, j))
    out = {}
    for k, (i, t) in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if any(o < order(i) or kk == k and jj < j for o, kk, jj in seen[tuple(w[j:j + size])]):
                gone[j:j + size] = [True] * size
        out[i, t] = (i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted((out[r] for r in rows), key=repr)


@pytest.mark.parametrize("options", [{}, {"bin_windows": 40, "cells": 64}])
def test_suffix_trees_equal_brute_force(spark, options):
    got = rows_of(suffix_tree.digests(fixtures.documents(spark), **options), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == cut_words(fixtures.texts())


def test_suffix_trees_on_real_rows_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(suffix_tree.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == cut_words([(r.doc_id, r.text) for r in docs.collect()])
    assert suffix_tree.digests(fixtures.empty(spark)).count() == 0


def test_prefixes_grow_where_groups_are_large():
    counts = np.array([[90, 10], [50, 50], [60, 40], [30, 70], [100, 0]])
    table, bins = suffix_tree.bins_of(counts, 40)
    assert table[0][0] == -1 and table[0][1] >= 0 and (table[-1] >= 0).all() and table.max() < bins


def fingerprint(text, seed=42):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    fp = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3 and group[a] != group[b]:
                group = [group[a] if g == group[b] else g for g in group]
    least = {g: min((order(rows[k][0]) for k in range(len(rows)) if group[k] == g)) for g in set(group)}
    name = [None if least[g] == exchange.LAST else least[g] for g in group]
    return sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fp, name, strict=True)), key=repr)


@pytest.mark.parametrize("limit", [2048, 3])
def test_simhash_equals_brute_force(spark, limit):
    got = rows_of(simhash.near_duplicates(fixtures.documents(spark), bucket_limit=limit), "doc_id", "fingerprint", "component_id")
    assert got == components(fixtures.texts())


def test_simhash_links_close_codes_through_divided_buckets(spark):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 2**63, 12)]
    codes = {b ^ sum(1 << int(k) for k in r.choice(60, r.integers(0, 4), replace=False)) for b in base for _ in range(40)}
    codes = sorted(codes)
    df = spark.createDataFrame([(c, k) for k, c in enumerate(codes)], "fp long, doc_id long")
    got = {x.fp: x.component_id for x in simhash.components(df, bucket_limit=8).collect()}
    group = list(range(len(codes)))
    for a in range(len(codes)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= 3 and group[a] != group[b]:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert [got[c] for c in codes] == group


def test_simhash_one_of_each(spark):
    docs = fixtures.documents(spark)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    rows = components(fixtures.texts())
    want = {c for _, _, c in rows}
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(want) and set(ids) == want
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


def test_simhash_one_of_each_unlinked_null_ids(spark):
    """Every component of null ids keeps one row, counted by brute force."""
    r = np.random.default_rng(9)
    prose = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 80)) for _ in range(6)]
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[1]), (None, prose[2]), (1, prose[3]), (None, prose[3]), (2, prose[4]), (5, prose[4]), (3, prose[5])]
    fp = [fingerprint(t) for _, t in rows]
    assert all((a ^ b).bit_count() > 3 for a in set(fp) for b in set(fp) if a != b)
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, prose[0]), (None, prose[1]), (None, prose[2]), (1, prose[3]), (2, prose[4]), (3, prose[5])]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_masks_cover_every_three_bits():
    import itertools

    masks = simhash.covering_masks()
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in itertools.combinations(range(64), 3))


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_equals_the_library(spark, tokenizer):
    path, library = tokenizer
    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())

    real = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (fixtures.documents(spark), real):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = rows_of(bpe.digests(spark, docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        assert got == sorted((want(*r) for r in rows), key=repr)
    assert bpe.digests(spark, fixtures.empty(spark), path).count() == 0


def test_bpe_every_character_and_round_trip(spark, tokenizer):
    path, library = tokenizer
    a = bpe.Automaton(bpe.load(path))
    for low in range(0, 0x30000, 512):
        text = "".join(f"a{chr(c)} {chr(c)}1 {chr(c)}{chr(c)}\n" for c in range(low, low + 512) if not 0xD800 <= c < 0xE000)
        ids = library.encode(text, add_special_tokens=False).ids
        assert a.encode(text) == ids and a.decode(ids) == text
    docs, ids = bpe.encoded(spark, fixtures.documents(spark), path)
    back, name = bpe.decoded(spark, docs, path, ids)
    assert all(r[name] == (r.text or "") for r in back.collect())


def base_measures(text):
    t = text or ""
    blanks = " \t\n\x0b\x0c\r"
    w = "".join("\n" if c in blanks else c for c in t).split("\n")
    w = [x for x in w if x]
    tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    hit = set()
    for k, x in enumerate(tri):
        if tri.count(x) > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if any(c not in blanks for c in x)]
    bad = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), bad


def hashed(*words):
    h = 42
    for x in words:
        h = xxhash.xxh64_intdigest(x.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def test_quality_rules_equal_brute_force(spark):
    import math

    docs = fixtures.documents(spark)
    trusted = spark.createDataFrame([(i,) for i in (3, 4, 20, 23)], "doc_id long")
    buckets = 512
    judged, name = quality_rules.judge(docs, trusted, buckets=buckets, threshold=0.0)
    assert name == "quality_verdict_" and judged.columns == [*docs.columns, name]
    split = lambda t: [x for x in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in t or "").split("\n") if x]
    def cells(t):
        w = split(t)
        return [hashed(x) % buckets for x in w] + [hashed(a, b) % buckets for a, b in zip(w, w[1:], strict=False)]

    raw, target = np.zeros(buckets), np.zeros(buckets)
    rows = fixtures.texts()
    for i, t in rows:
        for c in cells(t):
            raw[c] += 1
            target[c] += i in (3, 4, 20, 23)
    llr = np.log((target + 4) / (target.sum() * raw / raw.sum() + 4))
    got = {(r.doc_id, r.mix_place): r[name] for r in judged.collect()}
    for k, (i, t) in enumerate(rows):
        r, c = got[i, k], cells(t)
        base = base_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        mean = llr[c].mean() if c else None
        assert (r.llr is None) == (mean is None) and (mean is None or math.isclose(r.llr, mean, rel_tol=1e-9, abs_tol=1e-12))
        assert r.kept == (not base[-1] and mean >= 0)
    assert quality_rules.keep(docs, trusted).columns == docs.columns
    assert quality_rules.judge(fixtures.empty(spark), trusted)[0].count() == 0
    nothing = quality_rules.judge(docs, trusted.limit(0))[0]
    assert nothing.filter(nothing[name]["kept"] == nothing[name]["base_failed"]).count() == 0


def test_quality_rules_keep_clean_and_drop_junk(spark):
    """Held against labels on rows the target has not seen."""
    sf = os.path.join(os.path.dirname(SF), "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept, name = quality_rules.judge(docs, quality_rules.trusted_ids(labels.filter("doc_id % 2 = 0")))
    rows = kept.join(labels.filter("doc_id % 2 = 1"), "doc_id").filter(~kept[name]["base_failed"]).select("quality", f"{name}.kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.02
