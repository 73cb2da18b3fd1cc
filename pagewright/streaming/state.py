"""The same folds over streams: throttling, proxy health, consolidation triggers, the trace."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagewright.operators.proxies import QUARANTINE, RELEASE, throttle_state
from pagewright.sources.stores import trace_rows


def rate_limit_stream(requests: DataFrame, rate: float = 1.0, burst: int = 3) -> DataFrame:
    """Stream of (domain, seq, at seconds) -> waits; the bucket of each domain is kept as state between micro-batches."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        held, waits = throttle_state(state.get if state.exists else None, iter(rows["at"]), rate, burst)
        state.update(held)
        yield pd.DataFrame({"domain": key[0], "seq": rows["seq"], "at": rows["at"], "wait": waits})

    out = "domain string, seq long, at double, wait double"
    return requests.select("domain", "seq", F.col("at").cast("double").alias("at")).groupBy("domain").applyInPandasWithState(fold, out, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def trigger_stream(signals: DataFrame, batch_size: int = 50, smart: int = 3) -> DataFrame:
    """Stream of (skill, seq, platform, known) signals -> a row for each consolidation that they fire.

    State: pending signals and counts of platforms that the memory doesn't know; both start anew when one fires.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, names, counts = state.get if state.exists else (0, [], [])
        seen = dict(zip(names, counts, strict=True))
        fired = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            pending += 1
            if r.platform and not r.known:
                seen[r.platform] = seen.get(r.platform, 0) + 1
            why = "batch" if pending >= batch_size else "smart" if max(seen.values(), default=0) >= smart else None
            if why:
                fired.append((key[0], r.seq, why, pending))
                pending, seen = 0, {}
        state.update((pending, list(seen), list(seen.values())))
        yield pd.DataFrame(fired, columns=["skill", "seq", "trigger", "signals"])

    return signals.groupBy("skill").applyInPandasWithState(fold, "skill string, seq long, trigger string, signals int", "pending int, names array<string>, counts array<int>", "append", GroupStateTimeout.NoTimeout)


HEALTH = "proxy string, seq long, health double, quarantined boolean"
_UNIT = 10**9  # health is kept in whole billionths, so that sums are exact


class HealthProcessor(StatefulProcessor):
    """A proxy's health and quarantine as state; it is dropped if no outcome comes for the given time."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("health", "units long, quarantined boolean", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N803
        row = initialState.iloc[0]
        self.held.update((round(float(row["health"]) * _UNIT), bool(row["quarantined"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        units, quarantined = self.held.get() if self.held.exists() else (_UNIT, False)
        last = None
        for outcome in pd.concat(list(rows)).sort_values("seq").itertuples():
            change = 0 if pd.isna(outcome.delta) else round(outcome.delta * _UNIT)
            units = min(_UNIT, max(0, int(units) + change))
            quarantined = True if units < QUARANTINE * _UNIT else False if units >= RELEASE * _UNIT else quarantined
            last = outcome.seq
        self.held.update((int(units), bool(quarantined)))
        yield pd.DataFrame({"proxy": [key[0]], "seq": [last], "health": [units / _UNIT], "quarantined": [quarantined]})

    def close(self) -> None:
        pass


def health_stream(outcomes: DataFrame, stored: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Stream of (proxy, seq, delta) -> (proxy, seq, health, quarantined) after each micro-batch's last outcome of each proxy.

    stored: (proxy, health, quarantined) to start from, one row for each proxy, as proxies.proxy_health() returns it. A batch's outcomes are taken in the
    order of seq; those that come in a later batch come later. A null change is none. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = outcomes.select("proxy", F.col("seq").cast("long").alias("seq"), F.col("delta").cast("double").alias("delta")).groupBy("proxy")
    initial = None if stored is None else stored.select("proxy", F.col("health").cast("double").alias("health"), F.coalesce("quarantined", F.lit(False)).alias("quarantined")).groupBy("proxy")
    return rows.transformWithStateInPandas(HealthProcessor(ttl_ms), HEALTH, "Append", "ProcessingTime" if ttl_ms else "None", initialState=initial)


def costs_by_window(ledger: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Stream of ledger entries (at, stage, cost_usd) -> costs by stage and window; late entries count up to the watermark."""
    return ledger.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "stage").agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "stage", "cost_usd", "n")


def write_trace(events: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Append a stream of events to a JSON-lines trace, exactly once."""
    return trace_rows(events).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
