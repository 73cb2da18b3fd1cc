"""JSON payloads as Variant: paths, envelopes and field maps inside the JVM, with paths that may be data.

The same rules as functions.json_records has for Python values: a path's parts are keys of objects or places in lists; what leads nowhere,
and a JSON null, is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.records import fields_of


def parsed(text: Column) -> Column:
    """JSON text as a variant; null of what isn't JSON."""
    return F.try_parse_json(text)


def _named(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _listed(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def is_a(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def known(value: Column) -> Column:
    """The value, but null for a JSON null."""
    return F.when(F.schema_of_variant(value) != "VOID", value)


def walk(value: Column, path: Column) -> Column:
    """Follow a path (a.b, a/b, a[0]) from a variant; an empty or null path leads to the value itself."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\[(\d+)\]", ".$1."), "[./]"), lambda p: p != "")
    at = lambda v, p: F.when(p.rlike(r"^\d{1,9}$"), F.try_element_at(_listed(v), F.when(p.rlike(r"^\d{1,9}$"), p.cast("int") + 1)))
    return known(F.aggregate(parts, value, lambda v, p: F.coalesce(F.try_element_at(_named(v), p), at(v, p))))


def items(body: Column, envelope: Column) -> Column:
    """The items of a response's JSON text as an array of variants: at the envelope's path (a list, or one object), or where there is none the list
    itself, the first list of objects among the fields in their order, or the one object."""
    whole, none = parsed(body), F.array().cast("array<string>")
    empty = F.transform(none, lambda x: F.try_parse_json(x))
    found = walk(whole, envelope)
    inside = F.when(is_a(found, "ARRAY"), _listed(found)).when(is_a(found, "OBJECT"), F.array(found)).otherwise(empty)
    records = F.filter(fields_of(body), lambda x: is_a(x["value"], "ARRAY") & is_a(F.try_element_at(_listed(x["value"]), F.lit(1)), "OBJECT"))
    own = F.when(is_a(whole, "ARRAY"), _listed(whole)).when(F.size(records) > 0, _listed(F.element_at(records, 1)["value"])).when(is_a(whole, "OBJECT"), F.array(whole)).otherwise(empty)
    return F.coalesce(F.when(F.coalesce(envelope, F.lit("")) != "", inside).otherwise(own), empty)


def endpoint_records(payloads: DataFrame, mappings: DataFrame) -> DataFrame:
    """(url, pattern, body), (url, pattern, field, path, envelope) -> (url, pattern, item, record): the mapped fields of each payload's items.

    An endpoint's envelope is the first of its fields' by name. record: a map of field to JSON; items without any mapped value are left out, as are
    endpoints without a payload or a path. A field that is mapped twice takes the greatest path.
    """
    paths = mappings.where(F.coalesce("path", F.lit("")) != "").groupBy("url", "pattern", "field").agg(F.max("path").alias("path"))
    named = paths.groupBy(F.col("url").alias("m_url"), F.col("pattern").alias("m_pattern")).agg(F.map_from_entries(F.collect_list(F.struct("field", "path"))).alias("paths"))  # an endpoint's fields
    envelopes = mappings.where(F.coalesce("envelope", F.lit("")) != "").groupBy(F.col("url").alias("e_url"), F.col("pattern").alias("e_pattern")).agg(F.min_by("envelope", "field").alias("envelope"))
    rows = payloads.join(named, (F.col("url") == F.col("m_url")) & (F.col("pattern") == F.col("m_pattern"))).join(envelopes, (F.col("url") == F.col("e_url")) & (F.col("pattern") == F.col("e_pattern")), "left")
    each = rows.select("url", "pattern", "paths", F.posexplode(items(F.col("body"), F.col("envelope"))).alias("item", "value"))
    record = F.map_filter(F.transform_values("paths", lambda _, path: F.to_json(walk(F.col("value"), path))), lambda _, v: v.isNotNull())
    return each.withColumn("record", record).where(F.size("record") > 0).select("url", "pattern", "item", "record")
