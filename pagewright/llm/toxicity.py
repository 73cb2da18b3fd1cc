"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w[i] + sum over pairs of <v[i], v[j]>) over the terms in a text: a linear
weight for each term, and for each pair the product of the terms' vectors, so that two terms
together can weigh more, or less, than apart. Terms are a text's distinct lower-cased words and their first
3 to 6 letters, as 64-bit hashes.

Training. At most about SAMPLE_DOCS labelled documents, drawn by a hash of doc_id. Term counts, and counts of pairs of words
that stand within NEAR words of each other, are gathered over them in Spark. Terms that tell the labels apart alone (log-likelihood
ratio above MIN_RATIO) are kept, and so are words that do so only together: pairs whose ratio exceeds that of either word by
MIN_PAIR. The documents' terms among these, a few numbers each, are
fitted on the driver by Adam. The sample bounds all that the driver holds.

Scoring reads every whole text in one pass, without a shuffle.

Defined results
- null or empty texts, and texts without known terms: the score of no terms, sigmoid(w0).
- no labels to learn from: score 0. Labels of one kind only: their rate.
- null labels aren't learned from; of repeated labels of a document the largest counts; any
  label but 0 is toxic.
- null doc_id: not held out, not learned from. Repeated rows get equal scores.
- empty tables: an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.columns import bounded_batches
from pagewright.llm.language import held_out
from pagewright.sources.session import checkpoint, prepare_workers, table

SAMPLE_DOCS = 8_000
MIN_RATIO = 12.0
#: Words apart at which two still make a pair, by how much a pair must tell more than its words, and in how many documents it must be.
NEAR, MIN_PAIR, PAIR_DOCS = 5, 30.0, 5
#: Lengths of the prefixes that are terms besides the words.
PREFIXES = (3, 4, 5, 6)
FACTORS = 8
THRESHOLD = 0.3
#: Words that a worker remembers.
CACHE = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    return [digest(word.encode()) >> 1, *(digest(b"^" + word[:k].encode()) >> 1 for k in PREFIXES if len(word) >= k)]


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """A fitted factorization machine: terms in ascending order with weights and vectors."""

    bias: float
    terms: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    vector: np.ndarray = field(default_factory=lambda: np.empty((0, FACTORS)))

    def scores(self, rows: list[Iterable[int]]) -> np.ndarray:
        """rows: each text's distinct term numbers."""
        counts = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((i for r in rows for i in sorted(r)), np.int64, int(counts.sum()))
        return _sigmoid(_raw(self.bias, self.weight, self.vector, flat, counts)[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows, empty ones too."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, 0, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _raw(bias: float, weight: np.ndarray, vector: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = vector[flat]
    s = _sums(v, counts)
    return bias + _sums(weight[flat], counts) + 0.5 * (s * s - _sums(v * v, counts)).sum(1), s


def fit(rows: list[list[int]], labels: list[int], terms: np.ndarray, steps: int = 400, rate: float = 0.05, shrink: float = 1e-3, seed: int = 7) -> Machine:
    """Logistic loss with L2, full gradients, Adam. The same rows give the same machine."""
    y = np.array(labels, float)
    if not len(y):
        return Machine(-math.inf)
    mean = y.mean()
    if mean in (0.0, 1.0):
        return Machine(math.inf if mean else -math.inf)
    counts = np.array([len(r) for r in rows], np.int64)
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(rows)), counts)
    bias = np.array([math.log(mean / (1 - mean))])
    state = [bias, np.zeros(len(terms)), np.random.default_rng(seed).normal(0, 0.05, (len(terms), FACTORS))]
    first, second = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    for t in range(1, steps + 1):
        bias, weight, vector = state
        z, s = _raw(float(bias[0]), weight, vector, flat, counts)
        error = (_sigmoid(z) - y) / len(y)
        e = error[owner]
        pull = e[:, None] * (s[owner] - vector[flat])
        grads = [
            np.array([error.sum()]),
            np.bincount(flat, e, len(terms)) + shrink * weight / len(y),
            np.stack([np.bincount(flat, pull[:, k], len(terms)) for k in range(FACTORS)], 1) + 10 * shrink * vector / len(y),
        ]
        for p, g, m, q in zip(state, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            q += 0.001 * (g * g - q)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
    return Machine(float(state[0][0]), terms, state[1], state[2])


def _ratio(a: np.ndarray, b: np.ndarray, positives: int, total: int) -> np.ndarray:
    """Log-likelihood ratio of a term in a of positives and b of the other documents."""

    def part(k, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            p = k / n
            return np.where(k > 0, k * np.log(p), 0) + np.where(k < n, (n - k) * np.log1p(-p), 0)

    return 2 * (part(a, positives) + part(b, total - positives) - part(a + b, total))


def _pair_terms(rows: DataFrame, found: DataFrame, lift: Column, positives: int, total: int) -> np.ndarray:
    """The words of pairs that tell more together than either does alone."""
    often = frozenset(found.where(F.col("n") >= PAIR_DOCS).toArrow().column("term").to_pylist())  # of the sample's terms

    class Known(dict):
        """Word -> its term, or 0 if that is too rare."""

        def __missing__(self, word: str) -> int:
            term = xxhash.xxh3_64_intdigest(word.encode()) >> 1
            if len(self) >= CACHE:
                self.clear()
            self[word] = term = term if term in often else 0
            return term

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            n, positive = Counter(), Counter()
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = list(map(known.__getitem__, _WORD.findall((text or "").lower())))
                pairs = {(v, w) if v < w else (w, v) for k in range(1, NEAR + 1) for v, w in zip(words, words[k:], strict=False) if v and w and v != w}
                n.update(pairs)
                if y:
                    positive.update(pairs)
            left, right = [p[0] for p in n], [p[1] for p in n]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array([positive[p] for p in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["v", "w", "a", "n"])

    pairs = rows.mapInArrow(counted, "v long, w long, a long, n long").groupBy("v", "w").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).where((F.col("n") >= PAIR_DOCS) & (lift > 3))
    own = lambda p: found.select(F.col("term").alias(p), F.col("a").alias(f"a_{p}"), F.col("n").alias(f"n_{p}"))
    got = pairs.join(own("v"), "v").join(own("w"), "w").toArrow().to_pydict()
    v, w = (np.array(got[k], np.int64) for k in ("v", "w"))
    ratio = lambda p: _ratio(x := np.array(got[f"a{p}"], np.int64), np.array(got[f"n{p}"], np.int64) - x, positives, total)
    more = ratio("") - np.maximum(ratio("_v"), ratio("_w")) > MIN_PAIR
    return np.concatenate([v[more], w[more]])


def _train_rows(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """(doc_id, text, y) of the labelled documents in the sample."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("y"))
    n = known.count()
    draw = lambda c: F.shiftrightunsigned(F.xxhash64(c.cast("long")), 11) / F.lit(2.0**53) < min(1.0, sample_docs / max(n, 1))
    some = F.broadcast(known.where(draw(F.col("of"))))  # about sample_docs rows of two integers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(draw(F.col("doc_id")))
    return rows.join(some, rows["doc_id"] == some["of"]).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    spark = docs.sparkSession
    prepare_workers(spark)
    bounded_batches(docs)
    rows = _train_rows(docs, labels, sample_docs)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, positive = Counter(), Counter()
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = {t for w in text_words(text) for t in terms_of(w)}
                n.update(found)
                if y:
                    positive.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array([positive[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["term", "a", "n"])

    size = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    total, positives = int(size[0]), int(size[1])
    if not total or positives in (0, total):
        return fit([], [int(positives > 0)] * min(total, 1), np.empty(0, np.int64))
    found = rows.mapInArrow(counted, "term long, a long, n long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).where("n > 2")
    found = checkpoint(found)
    # a term's deviation in SQL leaves out most terms, whose ratio can't reach the limit
    rate = positives / total
    lift = F.abs(F.col("a") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = found.where(lift > 2).collect()
    terms, a, n = (np.array([r[k] for r in best], np.int64) for k in ("term", "a", "n"))
    terms = terms[_ratio(a, n - a, positives, total) > MIN_RATIO]
    terms = np.unique(np.concatenate([terms, _pair_terms(rows, found, lift, positives, total)]))
    wanted = {t: i for i, t in enumerate(terms.tolist())}

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted({wanted[t] for w in text_words(text) for t in terms_of(w) if t in wanted}) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "y", "terms"])

    sample = sorted(rows.mapInArrow(kept, "doc_id long, y int, terms array<int>").collect(), key=lambda r: (r["doc_id"], r["terms"], r["y"]))
    return fit([r["terms"] for r in sample], [r["y"] for r in sample], terms)


def score(rows: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns `keep` and the score of every row's text."""
    spark = rows.sparkSession
    prepare_workers(spark)
    bounded_batches(rows)
    source = rows.select(*keep, F.col("text").cast("string").alias("__text"))
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {t: i for i, t in enumerate(machine.terms.tolist())}
        known: dict[str, tuple[int, ...]] = {}
        nothing: tuple[int, ...] = ()
        for batch in batches:
            found = []
            for text in batch.column(n_keep).to_pylist():
                own: set[int] = set()
                for w in text_words(text):
                    got = known.get(w)
                    if got is None:
                        got = tuple(wanted[t] for t in terms_of(w) if t in wanted) or nothing
                        if len(known) >= CACHE:
                            known.clear()
                        known[w] = got
                    if got:
                        own.update(got)
                found.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(machine.scores(found))], [*batch.schema.names[:n_keep], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n_keep]) + ", score double"
    return source.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = train(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(rows, machine, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
