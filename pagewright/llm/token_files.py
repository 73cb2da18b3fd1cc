"""Token-ID files: every document's ids, Simple-8b coded, in ascending doc_id order.

Layout. The documents are cut into shards of ascending doc_id ranges. A shard is a run of segments,
one row of the Parquet container each: whole documents of together about SEGMENT_IDS ids, with
their ids' Simple-8b words, the word count of every block, the escapes, and the documents' lengths.
`first` is the number of ids before the segment in its shard, so that a reader needs no other row.
Executors write through Spark's own writer, so any store that Spark writes will do.

Range bounds are quantiles of doc_id alone, unless ids repeat: the text isn't read to find them, and it is shuffled
once, to its shard.

Defined results
- null or empty text: only the end id. null doc_id: before all others.
- equal doc_ids: ordered by the hash of their text; equal rows are interchangeable.
- a long text is encoded in parts, cut where no piece reaches over; a segment holds its ids.
- an empty table gives an empty file set and an empty result.
- further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import simple8b
from pagewright.llm.columns import bounded_batches, remembered
from pagewright.sources.session import prepare_workers, shared_path, shuffle_partitions, table

SEGMENT_IDS = 1 << 18
#: Up to so many shards are cut by quantiles that stand in the plan; beyond, Spark samples the bounds itself.
MAX_BOUNDS = 2_048
#: Characters encoded at a time, about.
CHARS = 1 << 20
SCHEMA = "shard int, segment int, first long, n_ids long, words binary, block_words binary, escapes binary, doc_ids array<long>, lengths array<int>"
DECODED = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"

# Byte-level BPE cuts a text into pieces and merges inside each alone. The settings under which it cuts by
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# and that pattern for the characters that are not _OTHER, whose classes are the same in every version of Unicode.
_MODEL = ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")  # unset
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")
_OTHER = re.compile(r"[^\n\r\t\x20-\x7eÀ-ÖØ-öø-ɏ]")
#: Marks that are a piece of their own behind letters and before a space.
_MARKS = frozenset(".,;:!?")
#: White space before a space.
_RUN = re.compile(r"[\n\r\t ] ")
#: No piece reaches over the end of what isn't white space.
_EDGE = re.compile(r"[!-~](?=[ \n])")


def parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of about `size` characters, cut before white space, where pieces end too."""
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, at + size)
        end = edge.end() if edge else len(text)
        yield text[at:end]
        at = end


class Remembered(dict):
    """String -> its ids as little-endian 32-bit integers, made once as long as the string is remembered.

    When `most` are held they become the older ones, of which those asked for again are kept: at most twice as many stand in memory.
    """

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class Encoder:
    """The tokenizers library, asked once for each piece of byte-level BPE, which is remembered by its own text.

    A batch's texts are split at spaces, their different chunks found by Arrow, and a chunk's ids made of its pieces'. A text
    with other characters, or with the string of an added token, and every text of another kind of tokenizer goes
    through the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.cuts = model["type"] == "BPE" and not spec.get("normalizer") and all(pre.get(k) == v for k, v in _BYTE_LEVEL.items()) and not any(model.get(k) for k in _MODEL)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x250) if not _OTHER.match(chr(c))}
        self.pieces = Remembered(self._piece, 300_000)
        self.chunks = Remembered(self._chunk, 400_000)

    def _piece(self, piece: str) -> bytes:
        return self._ids(piece.translate(self.shown))

    def _ids(self, shown: str) -> bytes:
        return struct.pack(f"<{len(found := self.model.tokenize(shown))}I", *[t.id for t in found])

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _by_piece(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def _chunk(self, rest: str) -> bytes:
        """The ids of a space and what stands behind it, up to the next space: mostly a word, or a word and a mark, which are pieces."""
        if rest.isalpha():
            return self._ids(self.shown[32] + rest) if rest.isascii() else self._piece(" " + rest)
        if rest[-1:] in _MARKS and rest[:-1].isalpha():
            return self.chunks[rest[:-1]] + self.pieces[rest[-1]]
        return self._by_piece(" " + rest)

    def _by_chunk(self, texts: list[str]) -> list[np.ndarray]:
        """For texts in which each space stands behind what isn't white space: a piece ends there, and the next begins with the space."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        found = lists.flatten().dictionary_encode()
        chunks = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        made = [self.chunks[c] for c in chunks] + [self._by_piece(t[: len(t) if (k := t.find(" ")) < 0 else k]) for t in texts]
        code = found.indices.to_numpy().astype(np.int64)
        code[offsets[:-1]] = len(chunks) + np.arange(len(texts))  # no space before a text's first
        count = np.fromiter(map(len, made), np.int64, len(made)) // 4
        pool, begin, count_of = np.frombuffer(b"".join(made), "<u4"), (np.cumsum(count) - count)[code], count[code]
        ends = np.concatenate([[0], np.cumsum(count_of)])
        ids = pool[np.repeat(begin - ends[:-1], count_of) + np.arange(ends[-1])]
        at = ends[offsets].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; long ones in parts of about CHARS characters where they can be cut."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(group, self._by_chunk([t for _, t in group]), strict=True):
                out[i].append(ids)

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuts or any(t in text for t in self.added):
                out[i].append(self._library(text))
                continue
            plain = not _OTHER.search(text)
            for part in parts(text, CHARS) if len(text) > CHARS else (text,):
                if not plain or _RUN.search(part):
                    flush()
                    group, size = [], 0
                    out[i].append(np.frombuffer(self._by_piece(part), "<u4") if plain else self._library(part))
                    continue
                group.append((i, part))
                size += len(part)
                if size >= 8 * CHARS:
                    flush()
                    group, size = [], 0
        flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.empty(0, np.uint32) for x in out]


_ENCODERS: dict[str, Encoder] = remembered()


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _segments(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        shard, number, first, ids, docs, lengths, held = 0, 0, 0, [], [], [], 0

        def out() -> pa.RecordBatch:
            words, blocks, escapes = simple8b.encode(np.concatenate(ids))
            cols = ([shard], [number], [first], [held], [words], [blocks], [escapes], [docs], [lengths])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for s, doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encode(batch.column(2).to_pylist()), strict=True):
                shard = s
                got = np.append(own, np.uint32(end_id))
                ids.append(got)
                docs.append(doc_id)
                lengths.append(len(got))
                held += len(got)
                if held >= SEGMENT_IDS:
                    yield out()
                    number, first, ids, docs, lengths, held = number + 1, first + held, [], [], [], 0
        if docs:
            yield out()

    return run


def shards(docs: DataFrame, n: int) -> DataFrame:
    """(shard, doc_id, text), each shard an ascending range of doc_id and sorted.

    Where ids repeat so often, or are null so often, that one of them would fill a shard, the ranges are cut by
    (doc_id, hash of the text, row) instead, so that rows of one id spread over shards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"]
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000) if 1 < n <= MAX_BOUNDS else F.lit(None).alias("x"), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    bounds, nulls, total = found
    if n > 1 and (n > MAX_BOUNDS or nulls > total / n or len(set(bounds or [])) < len(bounds or [])):
        ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *keys[:2], "row").sortWithinPartitions(*keys)
        return ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    bounds = sorted(bounds or [])
    shard = F.coalesce(F.size(F.filter(F.array(*[F.lit(int(b)).cast("long") for b in bounds]), lambda b: b < F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    rows = rows.withColumn("shard", F.when(F.col("doc_id").isNull(), 0).otherwise(shard).cast("int"))
    return rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(*keys).select("shard", "doc_id", "text")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, n_shards: int | None = None) -> None:
    """Encode the documents and write the file set to path."""
    spark = docs.sparkSession
    prepare_workers(spark)
    bounded_batches(docs)
    cut = shards(docs, n_shards or shuffle_partitions(spark))
    cut.mapInArrow(_segments(tokenizer_path, end_id), SCHEMA).write.option("compression", "zstd").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(row["words"], row["block_words"], row["escapes"], row["n_ids"]).astype("<u4")
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - lengths, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64())],
                [x.split()[0] for x in DECODED.split(", ")],
            )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, segment, doc_id, ids array<long>): the documents' ids, read from the files."""
    prepare_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(row["words"], row["block_words"], row["escapes"], row["n_ids"]).astype(np.int64)
                at = np.cumsum([0, *row["lengths"]]).astype(np.int32)
                n = len(row["lengths"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))],
                    ["shard", "segment", "doc_id", "ids"],
                )

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(run, "shard int, segment int, doc_id long, ids array<long>")


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    prepare_workers(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    totals = files.groupBy(F.col("shard").alias("of")).agg(F.sum("n_ids").alias("ids")).select("of", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    decoded = files.mapInArrow(_decoded, DECODED)
    return decoded.join(totals, decoded["shard"] == totals["of"]).select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_index(spark, path)
