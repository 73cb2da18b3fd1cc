"""Language ID by cross-parsing: the language whose text needs the fewest phrases to write a document wins.

Training. Each language gets the suffix automaton of about SAMPLE_BYTES of its labelled text: whole texts of at most ROW_BYTES,
drawn by a hash of doc_id (a language that has only longer ones is learned from its shortest), so the
model's size is bounded by the number of languages, not by the corpus. The automaton is laid out as
a table of its longest-match steps: from a state and a byte to the next state, or, where the match
ends, to the state of a new phrase that begins with this byte.

Scoring. A document is cut greedily into phrases, each the longest that the language's sample holds
(a byte that it doesn't hold at all is a phrase). c phrases against a sample of n bytes cost c * log2(n);
the smallest cost wins, the smaller code on a tie. Documents are parsed whole. So that all of a batch steps
side by side, segments of SEGMENT bytes are parsed as if each began a phrase; then segments whose true
first state is another are parsed again, until they meet the state that they had before, so that the phrases are
those of one pass from the text's first byte to its last.

Texts are lower-cased, and all but letters become single spaces.

Defined results
- null texts and texts without a letter: `und`, score 0. An empty training set: all `und`.
- score: 1 - best cost / second-best cost, 1 where only one language is learned.
- null doc_id: not held out. Rows are scored one by one, so repeats get equal results.
- a long text is parsed in parts of GROUP bytes, the state carried from one to the next.
- empty tables: an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.columns import bounded_batches
from pagewright.sources.session import prepare_workers, table

#: Bytes of text learned of a language, in whole texts of at most so many bytes, of about so many fetched.
SAMPLE_BYTES, ROW_BYTES, SAMPLE_DOCS = 24_000, 8_000, 200
SEGMENT = 256
#: Bytes parsed side by side.
GROUP = 2 << 20
UNKNOWN = "und"
_GAPS = re.compile(r"[\W\d_]+")


def cleaned(text: str | None) -> bytes:
    """Letters in lower case, single spaces between words; empty without a letter."""
    out = _GAPS.sub(" ", (text or "").lower()).strip()
    if not out.isascii() and not any(map(str.isalpha, out)):
        return b""
    return out.encode()


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton's states; state 0 is the start.

    >>> [sorted(t) for t in automaton(b"ab")]
    [[97, 98], [98], []]
    """
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = new
    return moves


class Model:
    """Languages with their samples, and the step tables of all of them end to end."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.languages = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        self.symbol = np.zeros(256, np.int32)  # 0: in no sample
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.rest = len(seen) + 1  # stands behind a segment's end: no step
        self.width = len(seen) + 2
        tables, self.start = [], []
        for language in self.languages:
            moves = automaton(samples[language])
            base = sum(len(t) for t in tables)
            lone = len(moves)  # the state behind a byte that the sample doesn't hold: the next begins a phrase
            steps = np.full((lone + 1, self.width), -1, np.int32)
            for s, t in enumerate(moves):
                if t:
                    steps[s, self.symbol[list(t)]] = list(t.values())
            anew = np.where(steps[0] >= 0, steps[0], lone)
            lost = steps < 0
            steps += base
            steps *= 2
            np.copyto(steps, (2 * (anew + base) + 1)[None, :], where=lost)
            steps[0, lost[0]] = 2 * (lone + base)
            steps[:, self.rest] = 2 * (np.arange(lone + 1) + base)
            # a state is kept as its row's first cell, so that a step is one addition and one look-up
            flags = steps & 1
            steps >>= 1
            steps *= 2 * self.width
            steps |= flags
            tables.append(steps)
            self.start.append(base)
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(self.width, np.int32)
        self.cost = np.array([math.log2(len(samples[x]) + 1) for x in self.languages])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): phrases that each text needs; texts aren't empty."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP):
                size += len(texts[end])
                end += 1
            group, start = texts[at:end], [None] * len(self.start)
            for a in range(0, max(size, 1), GROUP):  # more than one turn: a single long text
                more, start = self._parsed([group[0][a : a + GROUP]] if end - at == 1 else group, start)
                out[at:end] += more
                if end - at > 1:
                    break
            at = end
        return out

    def _parsed(self, texts: list[bytes], before: list[int | None]) -> tuple[np.ndarray, list[int]]:
        """Phrases of each text by language, and the last text's last states; before: the states that a single text begins in."""
        sizes = np.array([len(t) for t in texts])
        parts = -(-sizes // SEGMENT)
        lanes = int(parts.sum())
        cells = np.full(lanes * SEGMENT, self.rest, np.int32)
        first = (np.cumsum(parts) - parts) * SEGMENT
        data = np.frombuffer(b"".join(texts), np.uint8)
        cells[np.arange(len(data)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)] = self.symbol[data]
        steps = np.ascontiguousarray(cells.reshape(lanes, SEGMENT).T)
        out, last = np.empty((len(texts), len(self.languages)), np.int64), []
        heads = first // SEGMENT
        inner = np.ones(lanes, bool)
        inner[heads] = False
        for k, start in enumerate(self.start):
            begin = np.full(lanes, start * self.width, np.int32)
            if before[k] is not None:
                begin[0] = before[k]
            moves = np.empty((SEGMENT, lanes), np.int32)
            state = begin
            for i, symbols in enumerate(steps):
                moves[i] = move = self.table[state + symbols]
                state = move >> 1
            # lanes whose true first state isn't the one they were parsed from
            todo = np.flatnonzero(inner)
            todo = todo[(moves[-1, todo - 1] >> 1) != begin[todo]]
            while len(todo):
                begin[todo] = state = moves[-1, todo - 1] >> 1
                lane = todo
                for i in range(SEGMENT):
                    move = self.table[state + steps[i, lane]]
                    differ = (move >> 1) != (moves[i, lane] >> 1)
                    moves[i, lane] = move
                    lane, state = lane[differ], (move >> 1)[differ]
                    if not len(lane):
                        break
                todo = lane + 1  # the lanes behind those that end in another state than before
                todo = todo[todo < lanes]
                todo = todo[inner[todo]]
            out[:, k] = np.add.reduceat((moves & 1).sum(0), heads)
            if before[k] is None:
                out[:, k] += 1
            last.append(int(moves[-1, -1] >> 1))
        return out, last


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame) -> dict[str, bytes]:
    """(doc_id, text, lang) -> each language's sample: whole texts in the order of a hash of doc_id, up to SAMPLE_BYTES and at least one.

    Texts without a letter teach nothing. A language whose texts of at most ROW_BYTES don't come to ROW_BYTES together starts with its
    shortest longer one, if it has any.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("size", F.octet_length("text"))
    short = F.col("size") <= ROW_BYTES
    sums = [F.count_if(short).alias("short"), F.coalesce(F.sum(F.when(short, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(~short).alias("long")]
    sizes = rows.groupBy("lang").agg(*sums).collect()  # one row for each language
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)
    found: list[tuple] = []
    if some := {r["lang"]: max(SAMPLE_DOCS / r["short"], 2 * SAMPLE_BYTES / r["bytes"]) for r in sizes if r["short"]}:
        share = F.create_map(*[F.lit(v) for pair in some.items() for v in pair])
        drawn = rows.where(short).withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])
        found += drawn.select("lang", "draw", "text").collect()
    if long := [r["lang"] for r in sizes if r["long"] and r["bytes"] < ROW_BYTES]:
        found += rows.where(~short & F.col("lang").isin(long)).groupBy("lang").agg(F.lit(-1.0), F.min_by("text", F.struct("size", F.xxhash64("text")))).collect()
    samples: dict[str, bytes] = {}
    for lang, _, text in sorted(map(tuple, found)):
        have, more = samples.get(lang, b""), cleaned(text)
        if more and (not have or len(have) + 1 + len(more) <= SAMPLE_BYTES):
            samples[lang] = have + b" " * bool(have) + more
    return samples


SCORED = "lang_pred string, score double, n_letters long, phrases long"


def identify(rows: DataFrame, samples: dict[str, bytes], keep: list[str]) -> DataFrame:
    """The rows' columns `keep`, and lang_pred, score, bytes parsed, and phrases in the predicted language."""
    prepare_workers(rows.sparkSession)
    bounded_batches(rows)
    source = rows.select(*keep, F.col("text").cast("string").alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]

    m = Model(samples)  # built once, a few MB for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, size, count = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            texts = [cleaned(t) if m.languages else b"" for t in batch.column(n_keep).to_pylist()]
            some = [i for i, t in enumerate(texts) if t]
            if some:
                found = m.phrases([texts[i] for i in some])
                cost = found * m.cost
                best, at = cost.argmin(1), np.arange(len(some))
                second = np.partition(cost, 1, 1)[:, 1] if cost.shape[1] > 1 else np.full(len(some), np.inf)
                score[some] = np.clip(1 - cost[at, best] / second, 0, 1)
                size[some] = [len(texts[i]) for i in some]
                count[some] = found[at, best]
                for i, b in zip(some, best.tolist(), strict=True):
                    lang[i] = m.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(lang), pa.array(score), pa.array(size), pa.array(count)], [*batch.schema.names[:n_keep], "lang_pred", "score", "n_letters", "phrases"])

    n_keep = len(fields)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [SCORED])
    return source.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = train(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(rows, samples, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
