"""Byte-pair encoding and decoding with a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over
tokens that accepts exactly the correct tokenizations.  It starts as one state
with a loop for each byte.  The gadget for the merge ``a b`` copies the state that
``a`` leads to, without its ``b`` arc, and lets ``a`` lead to the copy; every state
that had the path ``a b`` gets an arc ``ab`` to where ``b`` led.  A state is stored as
what its copy took away (its parent, the label gone, the merge's number), so a
merge costs one state; arcs follow by comparing numbers:

* ``ab`` leaves a state iff ``a`` left it when the merge was compiled;
* a copy lacks a label from its own merge on.

Encoding cuts text into words with the tokenizer's pattern, and walks the one
path through the automaton whose labels spell a word; each transition is looked
up in a table (state, token) that fills as it is used.  Decoding emits the labels of the
arcs.  Words seen before come from a bounded cache.

The vocabulary (a fixed size) is read by the driver from the file given and
broadcast; a worker compiles it once and keeps it for its later tasks.

Defined results: a null or empty text has no tokens; special tokens in a text
count as the tokenizers library counts them; repeated rows are encoded alike;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.common import fresh

#: Fixed value: the published pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker (the cache is emptied when full).
CACHE_WORDS = 250_000
NEVER = 1 << 60
#: Texts below this code point are cut by plain character ranges (same words, faster).
LATIN_END = 0x250


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the
    others in turn from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def latin_pattern() -> str:
    """PATTERN with its classes spelled out for characters below LATIN_END."""
    def spelled(cls: str) -> str:
        return "".join(re.escape(c) for c in map(chr, range(LATIN_END)) if regex.match(cls, c))

    letter, number, space = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    return (rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+")


def load(path: str) -> dict:
    """Plain data of a byte-level BPE vocabulary file: token bytes by id,
    merges as id triples, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in enumerate(byte_letters())}
    spell = lambda s: bytes(back[c] for c in s)
    ids = spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    labels = {i: spell(s) for s, i in ids.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels |= {i: s.encode() for s, i in special.items()}
    return {"labels": labels, "merges": [(ids[a], ids[b], ids[a + b]) for a, b in pairs], "special": special}


class Automaton:
    def __init__(self, spec: dict):
        self.labels: dict[int, bytes] = spec["labels"]
        self.decimal = {i: str(i) for i in self.labels}
        self.special: dict[str, int] = spec["special"]
        self.find_any = regex.compile(PATTERN).findall
        self.find_latin = re.compile(latin_pattern()).findall
        self.beyond_latin = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if self.special else lambda t: [t]
        taken = set(self.special.values())
        self.prefixes: dict[bytes, int] = {}
        for i, s in self.labels.items():
            if i not in taken:
                for n in range(1, len(s)):
                    self.prefixes.setdefault(s[:n], -1)
                self.prefixes[s] = i
        # gadgets: states as (parent, label gone, number of the merge)
        self.parent, self.gone, self.born = [-1], [-1], [-1]
        self.made = {i: (-1, -1) for i, s in self.labels.items() if len(s) == 1}  # token: its merge's number, its left part
        self.leads = dict.fromkeys(self.made, 0)
        for number, (a, b, ab) in enumerate(spec["merges"]):
            self.parent.append(self.leads[a])
            self.gone.append(b)
            self.born.append(number)
            self.leads[ab] = self.leads[b]
            self.leads[a] = len(self.parent) - 1
            self.made[ab] = (number, a)
        self.lost: dict[int, dict[int, int]] = {}
        self.table: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _lost(self, state: int) -> dict[int, int]:
        """Labels that the state's copies took away, with the first merge that did."""
        if state not in self.lost:
            out, s = {}, state
            while s > 0:
                out[self.gone[s]] = self.born[s]  # parents are older: the last one written is the first
                s = self.parent[s]
            self.lost[state] = out
        return self.lost[state]

    def arc(self, state: int, token: int) -> bool:
        """Does the state have an arc with this label?"""
        key = (state, token)
        if key not in self.table:
            lost, label, until = self._lost(state), token, NEVER
            while label != -1 and lost.get(label, NEVER) > until or label != -1 and label not in lost:
                until, label = self.made[label]
            self.table[key] = label == -1
        return self.table[key]

    def word(self, w: bytes) -> tuple[int, ...]:
        """The one accepted path that spells ``w``: longest arcs first, dead ends
        remembered."""
        n, get, leads, table = len(w), self.prefixes.get, self.leads, self.table
        path: list[int] = []
        ends = [0]
        open_: list[list[tuple[int, int]]] = []
        dead: set[tuple[int, int]] = set()
        at, state = 0, 0
        while at < n:
            if len(open_) == len(path):
                found, end, t = [], at + 1, get(w[at:at + 1])
                while t is not None:
                    if t >= 0:
                        found.append((t, end))
                    if end == n:
                        break
                    end += 1
                    t = get(w[at:end])
                open_.append(found)
            found = open_[-1]
            while found:
                t, end = found.pop()
                ok = table.get((state, t))
                if ok is None:
                    ok = self.arc(state, t)
                if ok and (t, end) not in dead:
                    path.append(t)
                    ends.append(end)
                    at, state = end, leads[t]
                    break
            else:
                open_.pop()
                dead.add((path.pop(), ends.pop()))
                at, state = ends[-1], leads[path[-1]] if path else 0
        return tuple(path)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for piece in self.cut(text):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            for w in (self.find_any if self.beyond_latin(piece) else self.find_latin)(piece):
                ids = cache.get(w)
                if ids is None:
                    ids = self.word(w.encode())
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    if len(w) <= 64:
                        cache[w] = ids
                out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        return self.ids_digest(self.encode(text or ""))

    def ids_digest(self, ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join(map(self.decimal.__getitem__, ids))
        return (len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest())


def _compiled(shared) -> Automaton:
    """The worker's automaton: the broadcast value stays with the worker, the
    compiled form beside it."""
    spec = shared.value
    if "automaton" not in spec:
        spec["automaton"] = Automaton(spec)
    return spec["automaton"]


def encoded(spark: SparkSession, docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and a column of token ids (array of int), and its name."""
    shared, name = spark.sparkContext.broadcast(load(path)), fresh(docs, "token_ids")

    @F.pandas_udf("array<int>")
    def udf(texts: pd.Series) -> pd.Series:
        a = _compiled(shared)
        return pd.Series([a.encode(t or "") for t in texts], dtype=object)

    return docs.withColumn(name, udf(F.col(text))), name


def decoded(spark: SparkSession, ids: DataFrame, path: str, column: str = "token_ids") -> tuple[DataFrame, str]:
    """``ids`` and the text that its token ids spell, and that column's name."""
    shared, name = spark.sparkContext.broadcast(load(path)), fresh(ids, "decoded")

    @F.pandas_udf("string")
    def udf(rows: pd.Series) -> pd.Series:
        a = _compiled(shared)
        return pd.Series([a.decode([] if r is None else r) for r in rows], dtype=object)

    return ids.withColumn(name, udf(F.col(column))), name


def digests(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: tokens, hash of the ids, hash of the decoded text."""
    shared = spark.sparkContext.broadcast(load(path))

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def udf(texts: pd.Series) -> pd.DataFrame:
        a = _compiled(shared)
        return pd.DataFrame([a.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype(
            {"ids_sha256": object, "decoded_sha256": object})

    rows = docs.select(F.col(doc_id).alias("doc_id"), udf(F.col(text)).alias("d"))
    return rows.select("doc_id", "d.*")


def sequences(spark: SparkSession, docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and a struct of the token ids and what ``digests`` says of them,
    each text encoded once, and that column's name."""
    shared, name = spark.sparkContext.broadcast(load(path)), fresh(docs, "sequence")

    @F.pandas_udf("token_ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def udf(texts: pd.Series) -> pd.DataFrame:
        a = _compiled(shared)
        ids = [a.encode(t or "") for t in texts]
        return pd.DataFrame([(x, *a.ids_digest(x)) for x in ids], columns=["token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]).astype(
            {"token_ids": object, "ids_sha256": object, "decoded_sha256": object})

    return docs.withColumn(name, udf(F.col(text))), name
