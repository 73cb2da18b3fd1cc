"""The corpus pipeline: from raw documents to token-ID files.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. run() writes each
stage's rows as Parquet in the shared folder and rereads them for the next, so a stage that is lost
with its executors starts from files. Rows with null ids or repeated ids are documents of their own (see
pagewright.llm.columns.numbered); equal rows are one document, and stages 2 to 4 keep it once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.columns import lacking, numbered
from pagewright.llm.decontamination import contaminated
from pagewright.llm.language import UNKNOWN, identify, train
from pagewright.llm.mixing import WORD, mix, sized
from pagewright.llm.near_copies import near_copies
from pagewright.llm.token_files import read_token_index, write_token_files
from pagewright.sources.session import shared_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Of texts of this many letters or more go those whose phrases are on average shorter than PHRASE, which no learned language
#: explains, and those whose score is below MARGIN, which two explain alike. Held-out at sf0.1 the phrases of 99.9 % of the
#: texts are longer than 3.3 letters, and the scores of 99.9 % above 0.14.
LETTERS, PHRASE, MARGIN = 100, 3.0, 0.01
TOKENIZER = "byte_bpe_50k.json"

#: The chain ends in a tokenizer's ids, which SQL can't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _one_of_each(docs: DataFrame) -> DataFrame:
    """The rows with __rid, equal rows once."""
    rows, unique = numbered(docs.select(*COLUMNS), rid="__rid")
    return rows if unique else rows.dropDuplicates(["__rid"])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter go, and longer ones that no learned language explains, or two explain alike.

    lang becomes the language predicted, where the score is MARGIN or more or there was none.
    """
    scored = identify(docs, train(docs), COLUMNS)
    strange = (F.col("n_letters") >= LETTERS) & ((F.col("n_letters") < PHRASE * F.col("phrases")) | (F.col("score") < MARGIN))
    said = F.when(F.col("score") >= MARGIN, F.col("lang_pred")).otherwise(F.coalesce("lang", "lang_pred"))
    return scored.where((F.col("lang_pred") != UNKNOWN) & ~strange).withColumn("lang", said).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup on five-word shingles of similarity 0.8 or more: of each group the document of the smallest id stays."""
    rows = _one_of_each(docs)
    groups = near_copies(rows, "__rid")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone"))
    return lacking(rows, "__rid", gone).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    rows = _one_of_each(docs)
    found = contaminated(rows.select(F.col("__rid").alias("rid"), "doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("rid").alias("__gone")).distinct()
    return lacking(rows, "__rid", found).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document is there once for each epoch that takes it; the one at which its
    source's budget ends is cut to the words that the budget leaves, joined by spaces; a document of which
    nothing is taken goes. Documents without words have nothing to take, and go too."""
    rows = _one_of_each(docs)
    taken = mix(sized(rows, doc_id="__rid")).where("taken > 0").select(F.col("doc_id").alias("__of"), "size", "taken")
    rows = rows.join(taken, rows["__rid"] == taken["__of"])
    rows = rows.select(*COLUMNS, "size", "taken", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))).alias("epoch"))
    left = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    rows = rows.withColumn("part", left < F.col("size")).withColumn("text", F.when(F.col("part"), cut).otherwise(F.col("text")))
    return rows.select("doc_id", "text", "lang", "source", F.when(F.col("part"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output: files in the shared folder; returns their index: doc_id, start, n_tokens, ids_crc32."""
    path = shared_path(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path(TOKENIZER))
    return read_token_index(spark, path)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
