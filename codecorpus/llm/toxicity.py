"""Toxicity: noisy-channel restoration of disguised words, then a learned score.

1. A character trigram model is counted over the words of the whole corpus (counts
   in a fixed number of hashed cells; every task adds up its own, Spark the rest).
2. Pieces of text that look disguised - letters mixed with look-alike digits and
   signs, letters three times or more in a row, letters or look-alikes with
   separators between them - become lattices: a look-alike may stand for several
   letters, a repeated letter or a separator may be noise, a space in a row of single
   letters and a look-alike before or after all letters may be a word's end.  Viterbi decoding under the trigram model with channel costs picks the
   likeliest reading, which replaces the piece.
3. The restored text is scored by its words and word beginnings: those that labelled
   toxic documents hold much more often than others carry their log odds; a
   document's sum is calibrated by isotonic regression on labelled documents that
   the log odds have not seen.

At most ``max_rows`` labelled documents (smallest id hashes) teach step 3; they are
few enough to broadcast their ids, and every document is restored and scored.

Defined results: a null or empty text has sum 0; a null label or id teaches nothing;
without training rows every score is 0; repeated rows score alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.quality_model import isotonic

MAX_ROWS = 20_000
#: Hashed cells of the counts of one, two and three characters.
CELLS = (1 << 10, 1 << 14, 1 << 16)
#: Words counted before a task folds them into cells.
WORDS_HELD = 500_000
#: A word teaches if it stands in this share of the toxic rows, and in three at least.
SUPPORT = 0.005
MIN_WEIGHT = 3.0
BINS, BIN_WIDTH = 80, 1.0
CALIBRATE = 4
#: Letters that digits and signs look like.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
             "!": "i", "|": "il", "+": "t", "*": "aeiou", "#": "aeiou", "(": "c", "<": "c"}
SEPARATORS = " .-_~'"
COST = {"look": 0.7, "star": 2.0, "drop": 0.5, "repeat": 0.3, "double": 3.0, "keep": 0.0, "end": 0.5}
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters, and letters or digits, and whatever may stand for a letter; none of them is a separator.
_L, _A, _X = r"[^\W\d_]", r"[^\W_]", r"[^\W_]|[@$!|+*#(<]"
#: Separated: two repeats or more of one letter or look-alike, three or more with double letters.  A run
#: is found once and read if a letter stands alone in it.
_RUN = rf"(?<!{_A}')(?:{_X})(?!{_A})(?:(?:[ .\-_~']++(?:{_L}{_L}|{_X})(?!{_A})){{3,}}|(?:[ .\-_~']++(?:{_X})(?!{_A})){{2,}})"
_ALONE = re.compile(rf"(?<!{_A}){_L}(?!{_A})")
#: A piece ends before white space and before any sign that is no look-alike.
_MIXED = (
    # look-alikes among letters, at either end too
    rf"(?<![\w@$!|+*#(<])_*+(?:{_L}[^\W0-9]*+[0-9@$!|+*#(<]|[0-9@$!|+*#(<][0-9@$!|+*#(<_]*+{_L})[\w@$!|+*#(<]*+"
    # repeated
    rf"|(?<!\w)\w*({_L})\1\1\w*")
#: No piece starts inside a word, which is asked first as most places of a text are inside one.
DISGUISED = re.compile(rf"(?<!{_A})(?:(?P<run>{_RUN})|" + _MIXED.replace(r"\1", r"\2") + ")")
MIXED = re.compile(_MIXED)
#: Characters of a piece that are read together (the reading so far is then settled), and of one that is remembered.
STRETCH, REMEMBERED = 512, 64


def cell(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % CELLS[len(s) - 1]


def character_counts(docs: DataFrame, text: str = "text") -> list[np.ndarray]:
    """Counts of characters, pairs and triples inside words (a word starts with two
    blanks and ends with one), summed over all documents."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(c, np.int64) for c in CELLS]
        cells: dict[str, int] = {}

        def fold(words: Counter) -> None:
            grams: Counter = Counter()
            for w, n in words.items():
                s = f"  {w} "
                for i in range(len(s) - 2):
                    grams[s[i:i + 3]] += n
            for g, n in grams.items():
                for size in (1, 2, 3):
                    at = g[3 - size:]
                    if at not in cells:
                        cells[at] = cell(at)
                    total[size - 1][cells[at]] += n

        words: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                if t:
                    words.update(LETTERS.findall(t.lower()))
            if len(words) > WORDS_HELD:
                fold(words)
                words = Counter()
        fold(words)
        for size, c in enumerate(total):
            at = np.flatnonzero(c)
            yield pd.DataFrame({"size": size, "cell": at, "n": c[at]})

    sums = docs.select(F.col(text).alias("text")).mapInPandas(count, "size int, cell int, n bigint").groupBy("size", "cell").agg(F.sum("n").alias("n"))
    out = [np.zeros(c, np.int64) for c in CELLS]
    for r in sums.collect():  # at most as many rows as cells
        out[r["size"]][r["cell"]] = r["n"]
    return out


class Restorer:
    """Reads disguised pieces back under a character model."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts = counts
        self.total = float(counts[0].sum())
        self.costs: dict[str, float] = {}
        self.seen: dict[str, str] = {}

    def cost(self, gram: str) -> float:
        """Minus the log probability of the third character after the first two,
        smoothed by the pair and the character alone."""
        if gram not in self.costs:
            one, two, three = self.counts
            p = (one[cell(gram[2])] + 0.1) / (self.total + 100)
            p = (two[cell(gram[1:])] + 5 * p) / (one[cell(gram[1])] + 5)
            p = (three[cell(gram)] + 5 * p) / (two[cell(gram[:2])] + 5)
            self.costs[gram] = -math.log(min(1.0, max(p, 1e-12)))
        return self.costs[gram]

    def lattice(self, piece: str) -> list[list[tuple[str, float]]]:
        """What each character may stand for ('' for noise), with channel costs."""
        out = []
        first = next((i for i, c in enumerate(piece) if c.isalpha()), 0)
        last = next((i for i in range(len(piece) - 1, -1, -1) if piece[i].isalpha()), len(piece))
        for i, c in enumerate(piece):
            inner = 0 < i < len(piece) - 1
            options = []
            if c.isalpha():
                options.append((c, COST["keep"]))
                if i and piece[i - 1] == c:  # two of a kind are mostly meant, three are not
                    run = c * 3 in piece[max(0, i - 2):i + 3]
                    options.append(("", COST["repeat"] if run else COST["double"]))
            elif c in LOOKALIKE:
                options += [(x, COST["star"] if c in "*#" else COST["look"]) for x in LOOKALIKE[c]]
                if not c.isdigit() or i and piece[i - 1] == c:
                    options.append(("", COST["drop"] if not inner else COST["star"]))
                if not first <= i <= last:  # a number or a sign beside a whole word
                    options.append((" ", COST["end"]))
            elif c in " _":
                options += [(" ", COST["end"]), ("", COST["drop"])]
            else:
                options.append(("", COST["drop"] if c in SEPARATORS else 0.0))
            out.append(options)
        return out

    def read(self, piece: str) -> str:
        """The likeliest reading of one piece (lower case)."""
        best: dict[str, tuple[float, int]] = {"  ": (0.0, -1)}
        trace: list[tuple[int, str]] = []  # (earlier entry, character)
        settled: list[str] = []
        known = self.costs.get
        for place, options in enumerate(self.lattice(piece), 1):
            after: dict[str, tuple[float, int, str]] = {}
            for state, (score, entry) in best.items():
                for c, cost in options:
                    s = score + cost
                    if not c or c == " " and state == "  ":
                        to = state
                    else:
                        to, gram = "  " if c == " " else state[1] + c, state + c
                        own = known(gram)
                        s += self.cost(gram) if own is None else own
                    before = after.get(to)
                    if before is None or s < before[0]:
                        after[to] = (s, entry, c)
            best = {}
            for to, (s, entry, c) in after.items():
                if c:
                    trace.append((entry, c))
                    entry = len(trace) - 1
                best[to] = (s, entry)
            if place % STRETCH == 0:
                state = min(best, key=lambda x: (best[x][0], x))
                settled.append(self._spelt(trace, best[state][1]))
                best, trace = {state: (0.0, -1)}, []
        end = min(best.items(), key=lambda x: (x[1][0] + (self.cost(x[0] + " ") if x[0] != "  " else 0.0), x[0]))
        settled.append(self._spelt(trace, end[1][1]))
        return " ".join("".join(settled).split())

    @staticmethod
    def _spelt(trace: list[tuple[int, str]], entry: int) -> str:
        out = []
        while entry >= 0:
            entry, c = trace[entry]
            out.append(c)
        return "".join(reversed(out))

    def restored(self, text: str) -> str:
        """The text, lower case, with its disguised pieces read back."""
        def one(m: re.Match) -> str:
            piece = m.group(0)
            if m.re is DISGUISED and m["run"] and not _ALONE.search(piece):
                return MIXED.sub(one, piece)
            if len(piece) > REMEMBERED:
                return self.read(piece)
            if piece not in self.seen:
                if len(self.seen) >= 100_000:
                    self.seen.clear()
                self.seen[piece] = self.read(piece)
            return self.seen[piece]

        return DISGUISED.sub(one, text.lower())


def marks(text: str) -> set[str]:
    """Words of a restored text and the beginnings of longer ones."""
    words = set(LETTERS.findall(text))
    return words | {w[:5] + "*" for w in words if len(w) > 5} | {w[:6] + "*" for w in words if len(w) > 6}


def _restorer(shared) -> Restorer:
    """One restorer a worker: it stays beside the broadcast value."""
    held = shared.value
    if "restorer" not in held:
        held["restorer"] = Restorer(held["counts"])
    return held["restorer"]


def _mark_counts(rows: DataFrame, shared, only: frozenset | None = None) -> DataFrame:
    """``mark, n``: documents that hold each mark (of ``only``, if given)."""
    frame = lambda c: pd.DataFrame({"mark": pd.Series(list(c), dtype=object), "n": pd.Series(list(c.values()), dtype="int64")})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, held = _restorer(shared), Counter()
        for b in batches:
            for t in b["text"]:
                found = marks(r.restored(t or ""))
                held.update(found if only is None else found & only)
            if len(held) > WORDS_HELD:
                yield frame(held)
                held.clear()
        yield frame(held)

    return rows.select("text").mapInPandas(count, "mark string, n bigint").groupBy("mark").agg(F.sum("n").alias("n"))


def lexicon(rows: DataFrame, shared, support: float = SUPPORT, min_weight: float = MIN_WEIGHT) -> dict[str, float]:
    """Log odds of the marks of toxic rows (``text, y``).  Its size is bounded by the
    training rows: a mark needs ``support`` of the toxic ones."""
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, others = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, math.ceil(support * toxic))
    inside = {r["mark"]: r["n"] for r in _mark_counts(rows.filter("y = 1"), shared).filter(F.col("n") >= least).collect()}
    outside = {r["mark"]: r["n"] for r in _mark_counts(rows.filter("y = 0"), shared, frozenset(inside)).collect()} if inside else {}
    weigh = lambda m, n: math.log((n + 0.5) / (toxic + 1)) - math.log((outside.get(m, 0) + 0.5) / (others + 1))
    return {m: w for m, n in inside.items() if (w := weigh(m, n)) >= min_weight}


def evidence(text: str | None, restorer: Restorer, lexicon: dict[str, float]) -> float:
    """Sum of the lexicon's log odds of ``marks`` of the restored text."""
    if not text or not lexicon:
        return 0.0
    words = set(LETTERS.findall(restorer.restored(text)))
    found = words & lexicon.keys()
    for size in (5, 6):  # only beginnings that the lexicon has become marks
        begun = {w[:size] for w in words if len(w) > size}
        found |= {m for b in begun if (m := b + "*") in lexicon} if len(begun) < len(lexicon) else {m for m in lexicon if len(m) == size + 1 and m[-1] == "*" and m[:-1] in begun}
    return sum(lexicon[m] for m in sorted(found))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", cut: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of rows that meet
    ``held_out`` (over ``doc_id``) are never read."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast({"counts": character_counts(docs)})
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    rows = rows.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    known = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(rows), "id")
    fold = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(CALIBRATE))
    learned = context.broadcast(lexicon(known.filter(fold != 0), shared))

    @F.pandas_udf("double")
    def summed(texts: pd.Series) -> pd.Series:
        r, words = _restorer(shared), learned.value
        return pd.Series([evidence(t, r, words) for t in texts], dtype=float)

    step = F.least(F.floor(F.col("z") / BIN_WIDTH + F.when(F.col("z") > 0, 1).otherwise(0)), F.lit(BINS - 1)).cast("int")
    steps = known.filter(fold == 0).select("y", summed("text").alias("z")).groupBy(step.alias("at")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).orderBy("at").collect()  # at most BINS rows
    # two made-up rows, one of each label, at the ends keep the scores inside 0 and 1
    n, hits = np.zeros(BINS), np.zeros(BINS)
    for r in steps:
        n[r["at"]], hits[r["at"]] = r["n"], r["hits"]
    n[0] += 1
    n[-1], hits[-1] = n[-1] + 1, hits[-1] + 1
    used = np.flatnonzero(n)
    curve = np.interp(np.arange(BINS), used, isotonic(hits[used] / n[used], n[used]))
    if not steps:
        curve = np.zeros(BINS)

    @F.pandas_udf("double")
    def scored(z: pd.Series) -> pd.Series:
        at = np.minimum(z / BIN_WIDTH + (z > 0), BINS - 1)
        return pd.Series(np.clip(np.interp(at, np.arange(BINS), curve), 0, 1))

    out = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), scored(summed("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
