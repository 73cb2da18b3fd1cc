"""Stores: profiles, the cost ledger, the trace, the dead-letter queue, prompt templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import short_hash

LEDGER = "seq long, stage string, url string, skill string, model string, input_tokens long, output_tokens long, cost_usd double, at timestamp"
TRACE = "kind string, timestamp string, url string, skill string, payload string"
# Kinds of trace events.
KINDS = (
    "warmup_complete consolidation_fired smart_trigger_detected discovery_ranked tier_attempted tier_won llm_called profile_updated drift_detected "
    "cluster_matched crawl_started crawl_completed carry_forward dlq_push merge_invoked external_rank_invoked discovery_llm_invoked"
).split()
DLQ_SIZE = 1000
#: What stands between the documents of a JSON text sequence (RFC 7464), and in no JSON document.
DOCUMENT = "\x1e"


def with_profile_key(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("key", short_hash(F.col("url_pattern")))


def save_profiles(stored: DataFrame | None, changed: DataFrame, path: str) -> None:
    """Write a new version of the store at path: changed profiles in place of stored ones of the same url."""
    kept = changed if stored is None else stored.join(changed.select("url_pattern"), "url_pattern", "left_anti").unionByName(changed, allowMissingColumns=True)
    with_profile_key(kept).write.mode("errorifexists").parquet(path)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def import_profiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Profiles as JSON documents, which may have many lines: one in a file, or any number as written by export_documents(). Unreadable ones are left out."""
    return spark.read.schema(schema).option("lineSep", DOCUMENT).option("mode", "DROPMALFORMED").json(path)


def export_documents(documents: DataFrame, path: str) -> None:
    """Write a column of JSON documents as JSON text sequences: a file for each task, however many documents there are."""
    documents.write.option("lineSep", DOCUMENT).text(path)


def lookup_profiles(inputs: DataFrame, profiles: DataFrame) -> DataFrame:
    """inputs (url, own_profile) with the profile that came with the input, else the stored one."""
    stored = profiles.select(F.col("url_pattern").alias("p_url"), F.col("profile").alias("stored_profile"))
    return inputs.join(stored, F.col("url") == F.col("p_url"), "left").withColumn("profile", F.coalesce("own_profile", "stored_profile")).drop("p_url", "stored_profile")


def delete_profiles(stored: DataFrame, urls: DataFrame) -> DataFrame:
    return stored.join(urls.select(F.col("url").alias("url_pattern")), "url_pattern", "left_anti")


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy("skill").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


#: What a ledger is looked up by.
LEDGER_KEYS = ("url", "stage", "skill")


def cluster_ledger(spark: SparkSession, path: str, out: str, by: str = "url", files: int | None = None) -> None:
    """Write the ledger at path to out, clustered by one of LEDGER_KEYS: files of its ranges, sorted, with a Bloom filter for each key, and a
    list of the files with the least and the greatest of each key.

    Ranges end in seq, so that one url or stage may fill many files. The ledger at path stays; append to it and cluster again.
    """
    rows = read_ledger(spark, path)
    order = [by, "seq"]
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    writer = ranged.sortWithinPartitions(*order).write
    for key in LEDGER_KEYS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(f"{out}/entries")
    held = spark.read.schema(LEDGER).parquet(f"{out}/entries")
    ends = [f(key).alias(f"{name}_{key}") for key in LEDGER_KEYS for name, f in (("least", F.min), ("most", F.max))]
    held.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("entries"), *ends).coalesce(1).write.parquet(f"{out}/files")  # one row for each file


def ledger_entries_of(spark: SparkSession, clustered: str, **keys: str) -> tuple[DataFrame, int]:
    """Entries of a clustered ledger by url, stage and skill, and how many files are opened for them.

    The list of files leaves those that can hold the keys; in these, Bloom filters and page statistics leave out row groups.
    """
    files, entries = spark.read.parquet(f"{clustered}/files"), spark.read.schema(LEDGER).parquet(f"{clustered}/entries")
    for key, value in keys.items():
        if key not in LEDGER_KEYS:
            raise ValueError(f"a ledger is looked up by {', '.join(LEDGER_KEYS)}, not by {key}")
        files = files.where((F.col(f"least_{key}") <= value) & (F.col(f"most_{key}") >= value))
    opened = [r["file"] for r in files.select("file").collect()]
    found = spark.read.schema(LEDGER).parquet(*opened) if opened else entries.limit(0)
    for key, value in keys.items():
        found = found.where(F.col(key) == value)
    return found, len(opened)


def trace_rows(events: DataFrame) -> DataFrame:
    """Rows of the trace; a kind that isn't known counts as a model call."""
    return events.select(F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("llm_called").alias("kind"), "timestamp", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("skill", F.lit("")).alias("skill"), "payload")


def append_trace(events: DataFrame, path: str) -> None:
    trace_rows(events).write.mode("append").json(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path)


def clear_trace(spark: SparkSession, path: str) -> None:
    """Empty the trace at path."""
    spark.createDataFrame([], TRACE).write.mode("overwrite").json(path)


def bounded_queue(entries: DataFrame, size: int = DLQ_SIZE, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The first entries in order, as many as the queue holds: later ones are dropped. A top-k, not a full sort."""
    return entries.orderBy(*order).limit(size)


def first_success(attempts: DataFrame) -> DataFrame:
    """(url, attempt, status, error, ...) -> each url's first success, else its last attempt as status 0."""
    good = F.col("error").isNull() & F.col("status").between(200, 299)
    w = Window.partitionBy("url").orderBy(F.desc(good), F.when(good, F.col("attempt")).otherwise(-F.col("attempt")))
    rows = attempts.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return rows.withColumn("error", F.when(good, F.col("error")).otherwise(F.coalesce(F.when(F.col("status") > 0, F.concat(F.lit("HTTP "), F.col("status").cast("string"))), F.col("error")))).withColumn("status", F.when(good, F.col("status")).otherwise(0))


# Our own wording; the names in the answers' JSON are those that the parsers read.
TEMPLATES = {
    "warmup": "Site task: {general_instructions}\nAbout: {metadata}\nFields: {output_fields}\nAvoid: {negative_keywords}\nAnswer with JSON: high_confidence_api_patterns, high_confidence_link_keywords, field_extraction_hints, platform_fingerprints, confirmed_field_synonyms, known_noise_patterns, navigation_wisdom, prompt1_context, prompt2_context, prompt4_context.",
    "discovery": "Task: {general_instructions}\nKnown: {prompt1_context}\nAvoid: {negative_keywords}\nNoise: {noise}\nPage: {url}\nEndpoints: {apis}\nLinks: {links}\nAnswer with JSON: ranked_apis, ranked_links, platform_guess, navigation_hint, improvement_signal.",
    "extraction": "Task: {general_instructions}\nKnown: {prompt2_context}\nAbout: {metadata}\nFields: {output_fields}\nAvoid: {negative_keywords}\nPage: {url}\nPage text:\n{markdown}\nAnswer with JSON: records, confidence, field_mappings, field_mapping_notes, platform, improvement_signal.",
    "merge": "Key: {primary_key}\nStored: {existing}\nNew: {new}\nAnswer with JSON: merge_decisions, a list of objects with new_record_index, existing_record_id, merge.",
    "external_rank": "Known: {prompt4_context}\nAvoid: {negative_keywords}\nPage: {url}\nMissing: {missing}\nRecords: {records}\nOutside links: {links}\nAnswer with JSON: ranked_external_links, improvement_signal.",
    "consolidation": "Memory: {current_memory}\nSignals ({signal_count}, {success_count} good): {signals}\nPlatforms: {platforms_seen}\nAnswer with JSON: the memory's parts that change, by their names, and summary.",
}
