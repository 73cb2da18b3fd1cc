"""A skill's memory: JSON with lists, maps and texts, made by a warm-up and replaced part by part as batches of signals are consolidated.

Parts are Variant columns inside the JVM. A part of another kind than its own counts as empty. Keys that aren't parts stay as
they are; new parts follow the old ones in the order in which they came.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators import learning, scans
from pagewright.operators.records import fields_of

#: The parts in the order in which one answer adds them.
KINDS = dict.fromkeys(learning.MEMORY_LISTS, "list") | dict.fromkeys(learning.MEMORY_MAPS, "map") | dict.fromkeys(learning.MEMORY_TEXTS, "text")
NOISE = "known_noise_patterns"
EMPTY = {"list": "[]", "map": "{}", "text": '""'}


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")


def _text(value: Column, kind: str) -> Column:
    """A part's JSON from a variant."""
    is_a = lambda name: F.schema_of_variant(value).startswith(name)
    if kind == "list":
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))
        return F.when(is_a("ARRAY"), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))).otherwise("[]")
    if kind == "map":
        items = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda x: F.concat(_quoted(x["key"]), F.lit(": "), F.coalesce(F.to_json(x["value"]), F.lit("null"))))
        return F.when(is_a("OBJECT"), F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))).otherwise("{}")
    return F.when(F.schema_of_variant(value) == "VOID", '""').otherwise(_quoted(F.variant_get(value, "$", "string")))


def _last(fields: Column, name: str) -> Column:
    """The last field of a name: struct(key, value), null if there is none."""
    return F.try_element_at(F.filter(fields, lambda x: x["key"] == name), F.lit(-1))


def with_noise(noise_json: Column, negative: Sequence[str]) -> Column:
    """A list's JSON with the negative keywords that it lacks behind its own."""
    held = F.from_json(noise_json, "array<string>")
    out = noise_json
    for word in dict.fromkeys(w for w in negative if w):
        more = F.when(out == "[]", F.concat(F.lit("["), _quoted(F.lit(word)), F.lit("]"))).otherwise(F.concat(F.left(out, F.length(out) - 1), F.lit(", "), _quoted(F.lit(word)), F.lit("]")))
        out = F.when(F.coalesce(F.array_contains(held, word), F.lit(False)), out).otherwise(more)
    return out


def consolidate(memories: DataFrame, signals: DataFrame, responses: DataFrame, negative: Sequence[str] = (), batch_size: int = learning.BATCH_SIZE) -> DataFrame:
    """Fold batches of signals, in order, into each skill's memory.

    memories: (skill, version, memory JSON); signals: (skill, seq, ...); responses: (skill, batch, content JSON or null,
    cost_usd, error). A batch adds one version and its cost even if its response is an error. Batches are what they
    are at their start: signals that arrive later are the next batch's.
    -> (skill, batch, version_before, version_after, signal_count, cost_usd, summary, memory), one row for each batch.

    A part is what the last answer that has it said: a running last value over ranges of (skill, batch), so a skill with all
    signals fills many tasks.
    """
    counts = learning.batches(signals, batch_size).groupBy("skill", "batch").agg(F.count("*").alias("signal_count"))
    good = F.coalesce(F.col("error"), F.lit("")) == ""
    steps = counts.join(responses.select("skill", "batch", "content", "cost_usd", "error"), ["skill", "batch"], "left").withColumn("__said", fields_of(F.when(good, F.col("content"))))
    parts = {name: f"__p{i}" for i, name in enumerate(KINDS)}
    found = {c: F.when(_last(F.col("__said"), name).isNotNull(), F.struct(_text(_last(F.col("__said"), name)["value"], KINDS[name]).alias("text"), F.col("batch"))) for name, c in parts.items()}
    summary = F.coalesce(F.when(_last(F.col("__said"), "summary").isNotNull(), F.variant_get(_last(F.col("__said"), "summary")["value"], "$", "string")), F.lit(""))
    rows = scans.ranged(steps.select("skill", "batch", "signal_count", F.coalesce("cost_usd", F.lit(0.0)).cast("double").alias("cost_usd"), summary.alias("summary"), *[v.alias(c) for c, v in found.items()]), "skill", ["batch"])
    of_range = rows.groupBy("skill", "__part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(f"{c}l") for c in found], *[F.min(f"{c}.batch").alias(f"{c}f") for c in found])
    ahead = scans.before(of_range, "skill", **{f"{c}l": F.last(f"{c}l", ignorenulls=True) for c in found}, **{f"{c}f": F.min(f"{c}f") for c in found})
    so_far = scans.inside("skill", ["batch"])
    rows = rows.select("*", *[F.last(c, ignorenulls=True).over(so_far).alias(f"{c}n") for c in found], *[F.min(f"{c}.batch").over(so_far).alias(f"{c}g") for c in found])
    rows = scans.with_before(rows, ahead, "skill")
    state = {name: (F.coalesce(f"{c}n", f"{c}l")["text"], F.least(f"{c}f", f"{c}g")) for name, c in parts.items()}

    rows = rows.join(memories.select(F.col("skill").alias("__skill"), "version", fields_of(F.col("memory")).alias("__own")), F.col("skill") == F.col("__skill"))
    own_noise = _last(F.col("__own"), NOISE)
    noise = with_noise(F.coalesce(state[NOISE][0], F.when(own_noise.isNotNull(), _text(own_noise["value"], "list")), F.lit("[]")), negative)
    values = {name: noise if name == NOISE else value for name, (value, _) in state.items()}
    line = lambda name, value: F.concat(_quoted(name), F.lit(": "), value)
    told = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    rows = rows.withColumn("__told", told)
    own = F.transform("__own", lambda x, i: F.struct(F.lit(-1).cast("long").alias("batch"), i.alias("nth"), line(x["key"], F.coalesce(F.element_at(F.col("__told"), x["key"]), F.to_json(x["value"]), F.lit("null"))).alias("text")))
    known = F.transform("__own", lambda x: x["key"])
    new = F.array(*[
        F.when(~F.array_contains(known, name) & F.element_at(F.col("__told"), F.lit(name)).isNotNull(), F.struct(F.coalesce(first, F.lit(0)).cast("long").alias("batch"), F.when(first.isNull(), 100).otherwise(i).cast("int").alias("nth"), line(F.lit(name), F.element_at(F.col("__told"), F.lit(name))).alias("text")))
        for i, (name, (_, first)) in enumerate(state.items())
    ])
    memory = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.concat(own, F.array_compact(new))), lambda x: x["text"]), ", "), F.lit("}"))
    before = (F.col("version") + F.col("batch")).cast("int")
    return rows.select("skill", F.col("batch").cast("long").alias("batch"), before.alias("version_before"), (before + 1).alias("version_after"), "signal_count", "cost_usd", "summary", memory.alias("memory"))


def skill_hash(name: Column, version: Column) -> Column:
    return F.left(F.sha2(F.concat(name, F.lit("::"), version), 256), F.lit(16))


def is_stale(memory_json: Column, name: Column, version: Column) -> Column:
    """A memory is of a skill's name and version; other changes of the skill don't count."""
    return ~F.coalesce(F.get_json_object(memory_json, "$.skill_hash") == skill_hash(name, version), F.lit(False))


def warm(memories: DataFrame, answers: DataFrame, negative: Sequence[str] = ()) -> DataFrame:
    """(skill, version, memory JSON or null), (skill, content, cost_usd, error) -> (skill, version, memory, warmed).

    A fresh memory stays. Else a new one is made from the answer, whose parts may have either name (learning.WARMUP_NAMES); an error, an
    answer that isn't an object or none leaves it empty. The negative keywords are among its noise patterns. An answer's cost counts either way.
    """
    said = answers.select(F.col("skill").alias("__skill"), fields_of(F.when(F.coalesce("error", F.lit("")) == "", F.col("content"))).alias("__said"), F.coalesce("cost_usd", F.lit(0.0)).cast("double").alias("__cost"))
    rows = memories.join(said, F.col("skill") == F.col("__skill"), "left")
    stale = is_stale(F.col("memory"), F.col("skill"), F.col("version"))

    def part(name: str, kind: str) -> Column:
        out = None
        for alias in (name, learning.WARMUP_NAMES.get(name)):
            if alias:
                field = _last(F.col("__said"), alias)
                text = F.nullif(F.when(field.isNotNull(), _text(field["value"], kind)), F.lit(EMPTY[kind]))
                out = text if out is None else F.coalesce(out, text)
        return F.coalesce(out, F.lit(EMPTY[kind]))

    line = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    head = [line("skill_name", _quoted(F.col("skill"))), line("skill_version", _quoted(F.col("version"))), line("skill_hash", _quoted(skill_hash(F.col("skill"), F.col("version")))), line("memory_version", F.lit("1")), line("warmup_cost_usd", F.coalesce("__cost", F.lit(0.0)).cast("string"))]
    body = [line(name, with_noise(part(name, kind), negative) if name == NOISE else part(name, kind)) for name, kind in KINDS.items()]
    made = F.concat(F.lit("{"), F.array_join(F.array(*head, *body), ", "), F.lit("}"))
    return rows.select("skill", "version", F.when(stale, made).otherwise(F.col("memory")).alias("memory"), stale.alias("warmed"))


def schema_parts(memories: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """(skill, memory JSON) -> (skill, field, synonyms array, hint): what a memory knows of the schema's fields; of all of its fields if none are named."""
    parsed = F.from_json("memory", "confirmed_field_synonyms map<string,array<string>>, field_extraction_hints map<string,string>")
    rows = memories.select("skill", parsed.alias("m"))
    named = rows.select("skill", "m", F.explode(F.array_union(F.coalesce(F.map_keys("m.confirmed_field_synonyms"), F.array().cast("array<string>")), F.coalesce(F.map_keys("m.field_extraction_hints"), F.array().cast("array<string>")))).alias("field"))
    wanted = named.where(F.col("field").isin(*fields)) if fields else named
    return wanted.select("skill", "field", F.coalesce(F.try_element_at("m.confirmed_field_synonyms", F.col("field")), F.array().cast("array<string>")).alias("synonyms"), F.coalesce(F.try_element_at("m.field_extraction_hints", F.col("field")), F.lit("")).alias("hint"))

