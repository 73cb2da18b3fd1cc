"""Reports over finished runs: costs, metrics, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import fixed


def total_cost(ledger: DataFrame, skill: str | None = None) -> DataFrame:
    rows = ledger if skill is None else ledger.where(F.col("skill") == skill)
    return rows.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"))


def cost_by(ledger: DataFrame, key: str, skill: str | None = None) -> DataFrame:
    """Costs by stage, url or model."""
    rows = ledger if skill is None else ledger.where(F.col("skill") == skill)
    return rows.groupBy(key).agg(F.sum("cost_usd").alias("cost_usd"))


def entry_count(ledger: DataFrame, skill: str | None = None) -> DataFrame:
    rows = ledger if skill is None else ledger.where(F.col("skill") == skill)
    return rows.agg(F.count("*").alias("entries"))


def top_costs(ledger: DataFrame, key: str = "url", n: int = 10) -> DataFrame:
    return cost_by(ledger, key).orderBy(F.desc("cost_usd"), key).limit(n)


def crawl_metrics(results: DataFrame) -> DataFrame:
    """(status, n_records, confidence, llm_cost_usd) -> one row; whatever isn't a success or carried forward failed."""
    ok, carried = F.col("status") == "SUCCESS", F.col("status") == "CARRY_FORWARD"
    return results.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(carried).alias("carried_forward"), F.count_if(~ok & ~carried).alias("failed"),
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("records"), F.coalesce(F.sum("llm_cost_usd"), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    )


def metrics_line(metrics: DataFrame) -> DataFrame:
    text = F.format_string("%d/%d succeeded, %d carried forward, %d failed; %d records; $%s; mean confidence %s", "succeeded", "total", "carried_forward", "failed", "records", fixed(F.col("cost_usd"), 4), fixed(F.col("mean_confidence"), 2))
    return metrics.select(text.alias("summary"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def tier_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce(F.nullif("tier_used", F.lit("")), F.lit("(none)")).alias("tier")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tier")


def report_rows(results: DataFrame) -> DataFrame:
    """One line of a Markdown table for each result, with its first three errors."""
    cells = (F.col("url"), F.col("status"), F.coalesce("tier_used", F.lit("")), F.col("n_records").cast("string"), fixed(F.col("confidence"), 2), F.array_join(F.slice(F.coalesce("errors", F.array().cast("array<string>")), 1, 3), "; "))
    return results.select("url", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def report_totals(results: DataFrame) -> DataFrame:
    """One row under report_rows(): all records, the cost, and how many results have errors."""
    return results.agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("records"), F.coalesce(F.sum("llm_cost_usd"), F.lit(0.0)).alias("cost_usd"), F.count_if(F.size("errors") > 0).alias("with_errors"))


def result_fields(results: DataFrame) -> DataFrame:
    """What a result is exported as."""
    return results.select("url", "status", "tier_used", "confidence", "llm_cost_usd", "n_records", "errors")


def run_costs(results: DataFrame, log: DataFrame, warmup_cost: float = 0.0) -> DataFrame:
    """One row: the costs of results, of consolidations (log: cost_usd) and of the warm-up, and their sum."""
    own, folded = results.agg(F.coalesce(F.sum("llm_cost_usd"), F.lit(0.0)).alias("results_usd")), log.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("consolidation_usd"))
    both = own.join(F.broadcast(folded))  # one row each
    return both.withColumn("warmup_usd", F.lit(float(warmup_cost))).withColumn("total_usd", F.col("results_usd") + F.col("consolidation_usd") + F.col("warmup_usd"))


def cost_sections(ledger: DataFrame, skill: str | None = None) -> DataFrame:
    """(section, name, cost_usd): the total with the number of calls, each stage, each model, the ten dearest urls."""
    rows = ledger if skill is None else ledger.where(F.col("skill") == skill)
    total = rows.agg(F.concat(F.lit("calls: "), F.count("*")).alias("name"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd")).select(F.lit("total").alias("section"), "name", "cost_usd")
    part = lambda df, key: df.select(F.lit(key).alias("section"), F.col(key).alias("name"), "cost_usd")
    return total.union(part(cost_by(rows, "stage"), "stage")).union(part(cost_by(rows, "model"), "model")).union(part(top_costs(rows), "url"))


def run_report(results: DataFrame, ledger: DataFrame, log: DataFrame | None = None, warmup_cost: float = 0.0) -> str:
    """A Markdown report. What comes to the driver is one row for each status, tier, stage and model."""
    m = crawl_metrics(results).first()
    lines = ["# Run", "", metrics_line(crawl_metrics(results)).first()["summary"], "", "## Statuses", *[f"- {r['status']}: {r['n']}" for r in status_counts(results).orderBy("status").collect()]]
    lines += ["", "## Tiers", *[f"- {r['tier']}: {r['n']}" for r in tier_histogram(results).collect()], "", f"Cost of results: ${m['cost_usd']:.4f}"]
    lines += [cost_report(ledger)]
    if log is not None:
        last = log.orderBy(F.desc("seq")).limit(5).collect()
        if "cost_usd" in log.columns:
            c = run_costs(results, log, warmup_cost).first()
            lines += ["", f"Costs: results ${c['results_usd']:.4f}, consolidations ${c['consolidation_usd']:.4f}, warm-up ${c['warmup_usd']:.4f}, together ${c['total_usd']:.4f}"]
        lines += ["", "## Last consolidations", *[f"- {r['triggered_by']}: {r['signal_count']} signals, version {r['version_after']}" for r in reversed(last)]]
    return "\n".join(lines)


def cost_report(ledger: DataFrame, skill: str | None = None) -> str:
    lines = ["", "## Costs", f"Total: ${total_cost(ledger, skill).first()['total_cost']:.4f} in {entry_count(ledger, skill).first()['entries']} calls"]
    for key in ("stage", "model"):
        lines += [f"### By {key}", *[f"- {r[key]}: ${r['cost_usd']:.4f}" for r in cost_by(ledger, key, skill).orderBy(F.desc("cost_usd"), key).collect()]]
    lines += ["### Dearest urls", *[f"- {r['url']}: ${r['cost_usd']:.4f}" for r in top_costs(ledger if skill is None else ledger.where(F.col("skill") == skill)).collect()]]
    return "\n".join(lines)


def url_report(results: DataFrame) -> DataFrame:
    """(url, report): a text for each result, with its first five errors."""
    none = F.array().cast("array<string>")
    text = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.col("url")), F.concat(F.lit("status: "), F.col("status")), F.concat(F.lit("tier: "), F.coalesce("tier_used", F.lit("(none)"))),
        F.concat(F.lit("confidence: "), fixed(F.col("confidence"), 2)), F.concat(F.lit("cost: $"), fixed(F.col("llm_cost_usd"), 4)), F.concat(F.lit("records: "), F.col("n_records").cast("string")),
        F.when(F.size(F.coalesce("errors", none)) > 0, F.concat(F.lit("errors: "), F.array_join(F.slice("errors", 1, 5), "; "))),
    )
    return results.select("url", text.alias("report"))


def last_of(column: Column, n: int) -> Column:
    return F.slice(column, F.greatest(F.size(column) - n + 1, F.lit(1)), F.lit(n))
