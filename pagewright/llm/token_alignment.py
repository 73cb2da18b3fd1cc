"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A is byte-level BPE (tokenizers), B a piece model with byte fallback (sentencepiece); both read the text behind a space.

1. A slice's texts are cut into chunks before white space that follows something else. No token of either reaches over such
   a cut (checked on B's pieces when it is loaded), so each different chunk is encoded once and its tokens are those that it
   has in every text; a text without such cuts is one chunk.
2. B's token ends over all different chunks of a slice are a static interval index. For each A token two bisections stab it
   at the token's start and end and give the run of B tokens that it overlaps: the links. An offset behind an A
   token that no B token spans ends a group.
3. A slice is written with its documents' chunks, the links of its chunks as numbers of its different id pairs, and how many
   of its documents hold each pair. Spark sums these counts over all slices and finds each A id's highest.
4. Each slice gets the counts of its own pairs back, so what is shuffled is a slice's different pairs and not the documents' links.

Defined results
- null or empty text, or one whose joined token bytes differ from space and text in A or B (a text with U+2581): zeros and ''.
- strings of special tokens in a text are plain text.
- equal or null doc_ids: every row counts as a document.
- a document's links and chunks are held whole by one task (about 60 bytes for each byte of text).
- an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import columns as C
from pagewright.llm.token_files import _OTHER, Encoder
from pagewright.sources.session import checkpoint, prepare_workers, shared_path, table

SPACE = "▁"
#: Different chunks that a worker remembers.
REMEMBERED = 250_000
#: What can begin a chunk, if B's pieces allow it.
_CUTS = b" \t\n"

SLICES = "slice long, doc_ids array<long>, numbers binary, digests array<string>, groups array<string>, docs binary, chunks binary, times binary, sizes binary, links binary, a array<int>, b array<int>, n array<int>"
STATS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of() -> dict[str, int]:
    """Byte-level BPE shows bytes as characters: printable ones as themselves, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of tokens that cover the same bytes, A's and B's -> links (places in A, in B); whether each A and B token ends a group.

    >>> [x.tolist() for x in overlaps(np.array([2, 3]), np.array([2, 1, 2]))]
    [[0, 1, 1], [0, 1, 2], [True, True], [True, False, True]]
    """
    a_end, b_end = np.cumsum(a), np.cumsum(b)
    first = np.searchsorted(b_end, a_end - a, "right")
    last = np.searchsorted(b_end - b, a_end, "left")
    count = last - first
    begin = np.cumsum(count) - count
    at_a = np.repeat(np.arange(len(a)), count)
    at_b = np.arange(len(at_a)) - begin[at_a] + first[at_a]
    return at_a, at_b, b_end[last - 1] == a_end, a_end[np.minimum(np.searchsorted(a_end, b_end), len(a_end) - 1)] == b_end


class Tokenizers:
    """Both tokenizers, and the chunks that they have encoded."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.encoder = Encoder(a_path)
        self.encoder.tokenizer.encode_special_tokens = True
        table_ = byte_of()
        tokens = [self.encoder.tokenizer.id_to_token(i) or "" for i in range(self.encoder.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(table_[c] for c in t) if all(c in table_ for c in t) else t.encode() for t in tokens]
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lone = self.model.piece_to_id(SPACE)
        plain = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        crossed = any(SPACE in p.lstrip(SPACE) for p in plain) or self.model.piece_to_id(SPACE) == self.model.unk_id()
        same = self.model.normalize("a  b\n ﬁ") == f"{SPACE}a{SPACE * 2}b\n{SPACE}ﬁ"
        self.cuts = np.zeros(256, bool)
        if not crossed and same and self.encoder.cuts:
            self.cuts[[c for c in _CUTS if c == 32 or not any(chr(c) in p for p in plain)]] = True
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.known: dict[bytes, tuple[bytes, bytes, str | None]] = {}

    def _b(self, chunks: list[str]) -> list[list[int]]:
        """B puts a space in front, which a chunk that begins with one has already."""
        found = self.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [([self.lone] if c == " " else ids) if c[0] == " " else ids[1:] for c, ids in zip(chunks, found, strict=True)]

    def encoded(self, chunks: list[bytes]) -> list[tuple[bytes, bytes, str | None]]:
        """Each chunk's A and B ids as 32-bit integers, and its groups as text; no ids and None if their bytes aren't the chunk."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > max(REMEMBERED, len(chunks)):
            self.known.clear()
            new = chunks
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            texts = [c.decode() for c in some]
            added = self.encoder.added
            a = [np.frombuffer(self.encoder._by_piece(t), "<u4") if self.encoder.cuts and not _OTHER.search(t) and not any(x in t for x in added) else self.encoder._library(t) for t in texts]
            b = self._b(texts)
            good = [b"".join(map(self.a_bytes.__getitem__, x.tolist())) == c and b"".join(map(self.b_bytes.__getitem__, y)) == c for x, y, c in zip(a, b, some, strict=True)]
            self.known.update((c, (b"", b"", None)) for c, ok in zip(some, good, strict=True) if not ok)
            kept = [k for k, ok in enumerate(good) if ok]
            if not kept:
                continue
            x, y = np.concatenate([a[k] for k in kept]), np.array([t for k in kept for t in b[k]], "<u4")
            _, _, a_ends, b_ends = overlaps(self.a_len[x], self.b_len[y])
            groups = self._shown(x, a_ends), self._shown(y, b_ends)
            to_a, to_b = np.cumsum(a_ends), np.cumsum([len(b[k]) for k in kept])
            done = to_a[np.cumsum([len(a[k]) for k in kept]) - 1].tolist()  # groups up to each chunk's end
            at = 0
            for k, end in zip(kept, done, strict=True):
                self.known[some[k]] = (a[k].tobytes(), np.array(b[k], "<u4").tobytes(), ";".join([f"{p}|{q}" for p, q in zip(groups[0][at:end], groups[1][at:end], strict=True)]))
                at = end
        return [self.known[c] for c in chunks]

    @staticmethod
    def _shown(ids: np.ndarray, ends: np.ndarray) -> list[str]:
        text = list(map(str, ids.tolist()))
        last = np.flatnonzero(ends) + 1
        return [",".join(text[i:j]) for i, j in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = C.remembered()


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _TOKENIZERS:
        _TOKENIZERS[a_path, b_path] = Tokenizers(a_path, b_path)
    return _TOKENIZERS[a_path, b_path]


def chunk_starts(data: np.ndarray, begins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where chunks begin: at texts, and at white space in `cuts` behind a character that no version of Unicode has as white space."""
    at = np.flatnonzero(cuts[data])
    at = at[at > 3]
    one, two, three, four = (data[at - k] for k in (1, 2, 3, 4))
    solid = ((one > 0x20) & (one < 0x7F)) | ((one >= 0x80) & (((two >= 0xC3) & (two <= 0xDF)) | ((three >= 0xE4) & (three <= 0xEF)) | (four >= 0xF0)))
    mark = np.zeros(len(data), bool)
    mark[at[solid]] = True
    mark[begins] = True
    return np.flatnonzero(mark)


def _slice(number: int, ids: list, data: np.ndarray, offsets: np.ndarray, t: Tokenizers, groups: bool) -> tuple:
    n = len(ids)
    lengths = np.diff(offsets)
    full = np.flatnonzero(lengths)  # the others have no tokens
    lengths = lengths[full]
    begins = np.cumsum(lengths + 1) - lengths - 1
    behind = np.full(len(data) + len(full), 32, np.uint8)
    behind[np.arange(len(data)) + np.repeat(np.arange(1, len(full) + 1), lengths)] = data
    starts = chunk_starts(behind, begins, t.cuts)
    bounds = np.append(starts, len(behind)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(behind)]).dictionary_encode()
    code, made = coded.indices.to_numpy(zero_copy_only=False), t.encoded(coded.dictionary.to_pylist())
    doc = np.searchsorted(begins, starts, "right") - 1
    bad = np.array([m[2] is None for m in made], bool)
    wrong = np.bincount(doc, bad[code], len(full)) > 0
    a, b = np.frombuffer(b"".join(m[0] for m in made), "<u4"), np.frombuffer(b"".join(m[1] for m in made), "<u4")
    n_a, n_b = np.array([len(m[0]) // 4 for m in made], np.int64), np.array([len(m[1]) // 4 for m in made], np.int64)
    at_a, at_b, ends, _ = overlaps(t.a_len[a], t.b_len[b])
    of = np.repeat(np.arange(len(made)), n_a)
    n_links, n_groups = np.bincount(of[at_a], minlength=len(made)), np.bincount(of[ends], minlength=len(made))
    numbers = np.zeros((4, n), np.int64)
    for row, per in zip(numbers, (n_a, n_b, n_groups, n_links), strict=True):
        row[full] = np.where(wrong, 0, np.bincount(doc, per[code], len(full)))
    shown = [m[2] for m in made]
    cut = np.append(np.searchsorted(doc, np.arange(len(full))), len(doc)).tolist()
    codes = code.tolist()
    digests, texts = [""] * n, [""] * n
    for k, i in enumerate(full.tolist()):
        if not wrong[k]:
            text = ";".join([shown[c] for c in codes[cut[k] : cut[k + 1]]])
            digests[i] = hashlib.sha256(text.encode()).hexdigest()
            if groups:
                texts[i] = text
    # a document's different chunks, and the different id pairs that link in them
    held = ~wrong[doc]
    key, times = np.unique(full[doc[held]] * len(made) + code[held], return_counts=True) if held.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    docs, chunks = key // max(1, len(made)), key % max(1, len(made))
    pair, links = np.unique(a[at_a].astype(np.int64) << 32 | b[at_b], return_inverse=True)
    begin = np.cumsum(n_links) - n_links
    each = n_links[chunks]
    held_links = links[np.repeat(begin[chunks] - np.cumsum(each) + each, each) + np.arange(each.sum())]
    seen = np.unique(np.repeat(docs, each) * max(1, len(pair)) + held_links)
    in_docs = np.bincount(seen % max(1, len(pair)), minlength=len(pair)).astype(np.int32)
    blobs = [numbers.tobytes(), digests, texts if groups else None, *map(C.narrow, (docs, chunks, times, n_links, links))]
    return number, ids, *blobs, (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), in_docs


def _slices(a_path: str, b_path: str, groups: bool):
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 5, *[pa.list_(pa.int32())] * 3]
    names = [x.split()[0] for x in SLICES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        waiting: list = []

        def numbered() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                waiting.extend(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(1)], ["rid", "text"])

        for rids, data, offsets in C.slices(numbered()):
            ids = waiting[: len(rids)]
            del waiting[: len(rids)]
            row = _slice(base + made, ids, data, offsets, tokenizers(a_path, b_path), groups)
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    return run


def write_alignments(docs: DataFrame, path: str, a_path: str, b_path: str, groups: bool = False) -> None:
    """Align (doc_id, text) and write the slices to path; groups: with every document's groups as text."""
    prepare_workers(docs.sparkSession)
    C.bounded_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_slices(a_path, b_path, groups), SLICES).write.option("compression", "zstd").parquet(path)


def _pairs(slices: DataFrame) -> DataFrame:
    return slices.select("slice", F.posexplode(F.arrays_zip("a", "b", "n")).alias("k", "x")).select("slice", "k", "x.a", "x.b", "x.n")


def pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, count, best): how many documents hold each id pair linked, and whether no pair of its A id is in more."""
    counts = _pairs(spark.read.schema(SLICES).parquet(path)).groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))  # at most B's vocabulary for each


def groups_of(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, groups) of slices that were written with them: `a1,a2|b1;a3|b2,b3` by ids."""
    slices = spark.read.schema(SLICES).parquet(path)
    return slices.select(F.explode(F.arrays_zip("doc_ids", "groups")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), "x.groups")


def _scored(key: tuple, row: pa.Table, answers: pa.Table) -> pa.Table:
    own = {c: row.column(c)[0].as_py() for c in ("doc_ids", "numbers", "digests", "docs", "chunks", "times", "sizes", "links")}
    n = len(own["doc_ids"])
    at = answers.column("k").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = answers.column("count").to_numpy(), answers.column("best").to_numpy().astype(np.int64)
    docs, chunks, times, sizes, links = (C.widened(own[c]) for c in ("docs", "chunks", "times", "sizes", "links"))
    ends = np.cumsum(sizes)
    sums = []
    for value in (best, count):
        total = np.concatenate([[0], np.cumsum(value[links])])
        of_chunk = total[ends] - total[ends - sizes]
        out = np.zeros(n, np.int64)
        np.add.at(out, docs, of_chunk[chunks] * times)
        sums.append(out)
    names = [x.split()[0] for x in STATS.split(", ")]
    return pa.table([pa.array(own["doc_ids"], pa.int64()), *np.frombuffer(own["numbers"], np.int64).reshape(4, n), *sums, pa.array(own["digests"], pa.string())], names)


def alignment_stats(spark: SparkSession, path: str) -> DataFrame:
    """Every document's numbers of tokens, groups and links, and how common its links are in all documents."""
    prepare_workers(spark)
    slices = spark.read.schema(SLICES).parquet(path)
    counts = checkpoint(pair_counts(spark, path))
    asked = _pairs(slices).drop("n")
    answers = asked.join(counts, ["a", "b"]).select("slice", "k", "count", "best")
    rows = spark.read.schema(SLICES).parquet(path).select("slice", "doc_ids", "numbers", "digests", "docs", "chunks", "times", "sizes", "links")
    return rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_scored, STATS)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "alignments")
    write_alignments(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment_stats(spark, path)
