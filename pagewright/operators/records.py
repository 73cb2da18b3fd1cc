"""Records: clean, name, identify, gate, compare with the run before, merge.

A record is a row (url, rec_idx, record_json). Fixed columns are used where the caller has them; what needs
a record's own key order goes through Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import json_records as J
from pagewright.functions.predicates import contains_any
from pagewright.functions.text import normalize_key
from pagewright.operators.scans import places
from pagewright.sources.session import checkpoint, prepare_workers


def _mapped(fn: Callable[[str | None], object], kind: str) -> Callable[[Column], Column]:
    prepare_workers(SparkSession.active())

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn).astype(object)

    return run


def text_of(value_json: Column, show: Callable[[object], str]) -> Column:
    """How a JSON value is shown in a prompt."""
    return _mapped(lambda r: show(J.parse(r) if isinstance(r, str) else None), "string")(value_json)


def rename_keys(record_json: Column, aliases: dict[str, list[str]]) -> Column:
    """Through the alias map; with no alternative names the record stays as it is."""
    if not any(aliases.values()):
        return record_json
    return _mapped(lambda r: J.dumps(J.rename(v, aliases)) if isinstance(v := J.parse(r), dict) else r, "string")(record_json)


def rename_map(record: Column, aliases: dict[str, list[str]]) -> Column:
    """The same for a map column without equal keys after renaming, inside codegen."""
    known: dict[str, str] = {}
    for name, others in aliases.items():
        known[J.normalize_key(name)] = name
        known.update((J.normalize_key(o), name) for o in others)
    if not known:
        return F.transform_keys(record, lambda k, _: normalize_key(k))
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.transform_keys(record, lambda k, _: F.coalesce(names[normalize_key(k)], normalize_key(k)))


def keep_fields(record: Column, fields: Sequence[str]) -> Column:
    return F.map_filter(record, lambda k, _: k.isin(*fields))


def matches_negative(record_json: Column, keywords: Sequence[str]) -> Column:
    words = tuple(keywords)
    return F.coalesce(_mapped(lambda r: J.matches_negative(J.parse(r), words), "boolean")(record_json), F.lit(False))


def drop_negative(records: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Records without a negative keyword in any string value. A plain substring test on the text comes
    first: only records that pass it are parsed."""
    words = [k for k in keywords if k]
    if not words:
        return records
    plain = contains_any(F.col("record_json"), [w for w in words if w.isascii() and w.isalnum()], ignore_case=False)
    all_plain = all(w.isascii() and w.isalnum() for w in words)
    hit = matches_negative(F.when(plain, F.col("record_json")) if all_plain else F.col("record_json"), words)
    return records.where(~hit)


def drop_negative_flat(rows: DataFrame, columns: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """The same for fixed string columns, inside codegen."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(contains_any(F.col(c), keywords, ignore_case=False), F.lit(False))
    return rows.where(~hit)


def assign_identity(record_json: Column, primary_key: str = "") -> Column:
    """A record whose key field has a value that counts (no 0, "", false, null) stays; others get _id, the first 16
    hex digits of the SHA-256 of the record's canonical JSON."""

    def one(text: str | None) -> str | None:
        record = J.parse(text)
        if not isinstance(record, dict) or primary_key and record.get(primary_key):
            return text
        return J.dumps({**record, "_id": hashlib.sha256(J.canonical(record).encode()).hexdigest()[:16]})

    return _mapped(one, "string")(record_json)


def identity_of(record_json: Column) -> Column:
    return F.left(F.sha2(_mapped(lambda r: J.canonical(v) if isinstance(v := J.parse(r), dict) else None, "string")(record_json), 256), F.lit(16))


def record_id(fields: dict[str, Column], primary_key: str, merge_keys: Sequence[str]) -> Column:
    """The key's value, else the merge keys' values joined by ::, else empty."""
    own = fields.get(primary_key, F.lit(None).cast("string")).cast("string")
    parts = [F.coalesce(fields[k].cast("string"), F.lit("")) for k in merge_keys if k in fields]
    joined = F.when(F.concat(*parts) != "", F.concat_ws("::", *parts)).otherwise("") if parts else F.lit("")
    return F.when(own.isNotNull() & (own != ""), own).otherwise(joined)


def missing_fields(records: DataFrame, fields: Sequence[str], inputs: DataFrame | None = None) -> DataFrame:
    """(url, columns) -> (url, missing): fields that are null or empty in all of a url's records; all fields for a url of inputs without records."""
    agg = records.groupBy("url").agg(F.count("*").alias("__n"), *[F.bool_and(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f"__{i}") for i, f in enumerate(fields)])
    names = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"__{i}"), F.lit(True)), F.lit(f)) for i, f in enumerate(fields)]).cast("array<string>"))
    if inputs is not None:
        agg = inputs.select("url").distinct().join(agg, "url", "left")
    return agg.select("url", names.alias("missing"))


def schema_gate(records: DataFrame, minimum: Sequence[str], schema: dict | None = None, least: float = 0.5, inputs: DataFrame | None = None) -> DataFrame:
    """(url, record_json) -> (url, n_records, passed, reason): enough records with all minimum keys, then enough that fit the JSON Schema."""
    item = (schema.get("items") if schema and schema.get("type") == "array" else schema) or None
    wanted = list(minimum)
    keys = F.coalesce(F.json_object_keys("record_json"), F.array().cast("array<string>"))
    complete = F.forall(F.array(*map(F.lit, wanted)), lambda f: F.array_contains(keys, f)) if wanted else F.lit(True)
    fits = F.coalesce(_mapped(lambda r: J.conforms(J.parse(r), item), "boolean")(F.col("record_json")), F.lit(False)) if item else F.lit(True)
    rows = records.where("record_json is not null").select("url", complete.alias("complete"), fits.alias("fits"))
    agg = rows.groupBy("url").agg(F.count("*").alias("n_records"), F.avg(F.col("complete").cast("int")).alias("share"), F.avg(F.col("fits").cast("int")).alias("fitting"))
    if inputs is not None:
        agg = inputs.select("url").distinct().join(agg, "url", "left").na.fill(0, ["n_records"])
    percent = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    reason = (
        F.when(F.col("n_records") == 0, "no_records")
        .when(F.col("share") < least, F.concat(F.lit("insufficient_fields: "), percent(F.col("share"))))
        .when(F.col("fitting") < least, F.concat(F.lit("insufficient_json_schema_pass: "), percent(F.col("fitting"))))
    )
    return agg.select("url", "n_records", reason.isNull().alias("passed"), reason.alias("reason"))


def repeated_keys(rows: DataFrame, key: str, by: str = "url", order: str = "rec_idx") -> DataFrame:
    """(by, key, order) -> the first repeat of a non-null key in each group: (by, duplicate, place); unique groups have no row."""
    again = rows.where(F.col(key).isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy(by, key).orderBy(order))).where("nth = 2")
    return again.groupBy(by).agg(F.min_by(F.col(key), order).alias("duplicate"), F.min(order).alias("place"))


def sanity_check(new: DataFrame, previous: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts (url, n) of two runs -> (url, n_new, n_previous, passed, reason)."""
    both = new.select("url", F.col("n").alias("n_new")).join(previous.select("url", F.col("n").alias("n_previous")), "url", "full_outer").na.fill(0, ["n_new", "n_previous"])
    reason = F.when(F.col("n_previous") == 0, None).when(F.col("n_new") == 0, "empty").when(F.col("n_new") / F.col("n_previous") < least, "record_count_drop")
    return both.select("url", "n_new", "n_previous", reason.isNull().alias("passed"), reason.alias("reason"))


FIELDS = "map<string,variant>"


def fields_of(record_json: Column) -> Column:
    """A record's (key, value) pairs in their own order, repeated keys included; none of what isn't an object."""
    return F.map_entries(F.coalesce(F.from_json(record_json, FIELDS), F.from_json(F.lit("{}"), FIELDS)))


def shown(value: Column) -> Column:
    """A JSON value as text: strings as they are, the rest as Python shows it."""
    kind = F.schema_of_variant(value)
    text = F.variant_get(value, "$", "string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def record_key(fields: Column, primary_key: str, merge_keys: Sequence[str]) -> Column:
    """record_id() of fields_of(): absent merge keys are empty, explicit nulls are shown."""
    last = lambda name: F.try_element_at(F.filter(fields, lambda x: x["key"] == name), F.lit(-1))["value"]
    parts = [F.coalesce(shown(last(k)), F.lit("")) for k in merge_keys]
    joined = F.when(F.concat(*parts) != "", F.concat_ws("::", *parts)).otherwise("") if parts else F.lit("")
    if not primary_key:
        return joined
    own = F.when(F.schema_of_variant(last(primary_key)) != "VOID", shown(last(primary_key)))
    return F.when(own != "", own).otherwise(joined)


def _settled(ops: DataFrame) -> DataFrame:
    """Operations (url, at, kind, key, target, ...) with none of kind `open` left: it merges if its target was inserted before it, else it inserts.

    An open operation can be told once all that might insert its target earlier are; the first open one of a url always can, so this ends.
    In practice one round is enough: more are needed only where a target is the id of another operation without a target.
    """
    while True:
        sure = ops.where("kind = 'insert'").groupBy(F.col("url").alias("s_url"), F.col("key").alias("s_key")).agg(F.min("at").alias("sure"))
        maybe = ops.where("kind = 'open'").groupBy(F.col("url").alias("m_url"), F.col("key").alias("m_key")).agg(F.min("at").alias("maybe"))
        asked = ops.where("kind = 'open'")
        asked = asked.join(sure, (F.col("url") == F.col("s_url")) & (F.col("target") == F.col("s_key")), "left").join(maybe, (F.col("url") == F.col("m_url")) & (F.col("target") == F.col("m_key")), "left")
        told = F.when(F.col("sure") < F.col("at"), "merge").when(F.col("maybe").isNull() | (F.col("maybe") >= F.col("at")), "insert").otherwise("open")
        ops = checkpoint(ops.where("kind <> 'open'").unionByName(asked.withColumn("kind", told).select(*ops.columns)))
        if ops.where("kind = 'open'").isEmpty():
            return ops


def _merged(existing: DataFrame, new: DataFrame, decisions: DataFrame, primary_key: str, merge_keys: Sequence[str]) -> DataFrame:
    """merge_records(), not numbered: (url, at, record_json, added, updated); records of a url are in the order of at."""
    place = lambda side, seq: F.struct(F.lit(side).alias("side"), seq.cast("long").alias("seq"), F.xxhash64("record_json").alias("tie"))
    key = record_key(fields_of(F.col("record_json")), primary_key, merge_keys)
    old = existing.select("url", place(0, F.col("rec_idx")).alias("at"), F.lit("insert").alias("kind"), key.alias("key"), F.lit(None).cast("string").alias("target"), "record_json")
    chosen = decisions.select(F.col("url").alias("u"), "seq", "new_index", "merge", F.nullif("target_id", F.lit("")).alias("target"))
    picked = new.join(chosen, (new["url"] == chosen["u"]) & (new["rec_idx"] == chosen["new_index"]))
    own = F.when(key != "", key).otherwise(F.concat(F.lit("_new_"), F.col("new_index")))
    kind = F.when(F.coalesce("merge", F.lit(False)) & F.col("target").isNotNull(), "open").otherwise("insert")
    ops = _settled(old.unionByName(picked.select("url", place(1, F.col("seq")).alias("at"), kind.alias("kind"), own.alias("key"), "target", "record_json")))

    # a record is its last insert and the merges behind it; it stands where its key was first inserted
    ops = ops.withColumn("of", F.when(F.col("kind") == "merge", F.col("target")).otherwise(F.col("key")))
    inserted, merged = F.col("kind") == "insert", F.col("kind") == "merge"
    found = ops.groupBy("url", "of").agg(
        F.min(F.when(inserted, F.col("at"))).alias("first"), F.max(F.when(inserted, F.col("at"))).alias("last"), F.max(F.when(merged, F.col("at"))).alias("merged"), F.max_by("record_json", F.when(inserted, F.col("at"))).alias("record_json"),
    )
    found = found.withColumn("chain", F.coalesce(F.col("merged") > F.col("last"), F.lit(False)))
    whole = F.when(F.from_json("record_json", FIELDS).isNotNull(), F.col("record_json")).otherwise("{}")
    single = found.where("not chain").select("url", F.col("first").alias("at"), whole.alias("record_json"))
    heads = found.where("chain").select(F.col("url").alias("h_url"), F.col("of").alias("h_of"), "first", "last")
    chain = ops.join(heads, (ops["url"] == heads["h_url"]) & (ops["of"] == heads["h_of"]) & (ops["at"] >= heads["last"]))
    parts = chain.select("url", "first", "at", F.posexplode(fields_of(F.col("record_json"))).alias("pos", "x")).withColumn("nth", F.struct("at", "pos"))
    fields = parts.groupBy("url", "first", F.col("x.key").alias("name")).agg(F.min("nth").alias("nth"), F.max_by(F.coalesce(F.to_json("x.value"), F.lit("null")), "nth").alias("value"))
    said = F.concat(F.expr("substring(to_json(array(name)), 2, length(to_json(array(name))) - 2)"), F.lit(": "), F.col("value"))
    several = fields.groupBy("url", "first").agg(F.array_sort(F.collect_list(F.struct("nth", said.alias("text")))).alias("fields"))  # a record's fields
    several = several.select("url", F.col("first").alias("at"), F.concat(F.lit("{"), F.array_join(F.transform("fields", lambda x: x["text"]), ", "), F.lit("}")).alias("record_json"))
    counts = ops.groupBy(F.col("url").alias("c_url")).agg(F.count_if(inserted & (F.col("at.side") == 1)).cast("int").alias("added"), F.count_if(merged).cast("int").alias("updated"))
    records = single.unionByName(several)
    return records.join(counts, records["url"] == counts["c_url"]).select("url", "at", "record_json", "added", "updated")


def _numbered(records: DataFrame) -> DataFrame:
    return places(records, "url", ["at"]).select("url", F.col("place").cast("int").alias("rec_idx"), "record_json", "added", "updated")


def merge_records(existing: DataFrame, new: DataFrame, decisions: DataFrame, primary_key: str = "", merge_keys: Sequence[str] = ()) -> DataFrame:
    """Upsert new records into existing ones by decisions, each url by itself and in order.

    existing, new: (url, rec_idx, record_json); decisions: (url, seq, new_index, merge, target_id).
    A merge into a target that is known by then overwrites its keys; all else inserts, over a record of the same id; new records without
    an id stand apart. New records without a decision are dropped; existing ones of equal id, or of none, collapse to the last.
    -> (url, rec_idx, record_json, added, updated); the counts are the url's.

    No url is gathered: operations are keyed by (url, id), a record's merges are a last writer for each field, and places are counted in ranges.
    """
    return _numbered(_merged(existing, new, decisions, primary_key, merge_keys))


def merge_snapshots(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert of fixed columns, every new row a decision to merge: one join, no Python. A new row's nulls overwrite too;
    columns that only existing rows have stay."""
    both = existing.alias("a").join(new.withColumn("__new", F.lit(True)).alias("b"), key, "full_outer")
    cols = [F.when(F.col("__new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}") if c in existing.columns else None).alias(c) for c in new.columns if c != key]
    return both.select(key, *cols, *[F.col(f"a.{c}") for c in existing.columns if c not in new.columns])


DECISIONS = "merge_decisions array<struct<new_record_index:int,existing_record_id:string,merge:boolean>>"


def merge_answers(existing: DataFrame, new: DataFrame, answers: DataFrame, primary_key: str = "", merge_keys: Sequence[str] = ()) -> DataFrame:
    """Merge by a model's answers (url, content, error): -> (url, rec_idx, record_json, added, updated).

    A url without new records keeps its own; one without existing records gets all new ones, whatever was answered;
    one whose answer is an error, isn't JSON or is missing gets its new records behind the existing ones.
    """
    sides = existing.select("url", F.lit(0).alias("side")).union(new.select("url", F.lit(1).alias("side"))).groupBy("url").agg(F.max((F.col("side") == 0).cast("int")).alias("had"), F.max("side").alias("got"), F.sum("side").alias("n_new"))
    good = answers.where(F.col("error").isNull() & F.try_parse_json("content").isNotNull()).select("url", F.from_json("content", DECISIONS)["merge_decisions"].alias("d"), F.lit(True).alias("answered"))
    plan = sides.join(good, "url", "left").withColumn("by", (F.col("had") == 1) & (F.col("got") == 1) & F.coalesce("answered", F.lit(False)))
    decided, rest = plan.where("by").select("url", "d"), plan.where("not by").select("url", F.when((F.col("had") == 0) & (F.col("got") == 1), True).otherwise(False).alias("fresh"), "n_new")
    picks = decided.select("url", F.posexplode("d").alias("seq", "x")).select("url", "seq", F.col("x.new_record_index").alias("new_index"), F.coalesce("x.merge", F.lit(False)).alias("merge"), F.col("x.existing_record_id").alias("target_id"))
    urls = decided.select("url")
    merged = _merged(existing.join(urls, "url", "left_semi"), new.join(urls, "url", "left_semi"), picks, primary_key, merge_keys)
    place = lambda side: F.struct(F.lit(side).alias("side"), F.col("rec_idx").cast("long").alias("seq"), F.xxhash64("record_json").alias("tie"))
    both = existing.select("url", place(0).alias("at"), "record_json").union(new.select("url", place(1).alias("at"), "record_json"))
    plain = both.join(rest, "url").select("url", "at", "record_json", F.when(F.col("fresh"), F.col("n_new")).otherwise(0).cast("int").alias("added"), F.lit(0).alias("updated"))
    return _numbered(merged.unionByName(plain))
