"""Proxy health, choice and throttling: folds in order, as scans that split a key over tasks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import identity_bucket, proxy_parts, proxy_url, session_user
from pagewright.operators import scans

QUARANTINE, RELEASE = 0.25, 0.5
#: Sums of changes of health.
NUMBER = "decimal(38,9)"


def clamped(change: Column) -> Column:
    """The step x -> min(high, max(low, x + by)) of a change of health, as a struct. Sums are of decimals, and so exact."""
    number = lambda c: c.cast(NUMBER)
    return F.struct(number(F.lit(0)).alias("low"), number(F.lit(1)).alias("high"), number(F.coalesce(change, F.lit(0))).alias("by"))


def then(f: Column, g: Column) -> Column:
    """g after f: clamped additions are closed under composition."""
    at = lambda x: F.least(g["high"], F.greatest(g["low"], (x + g["by"]).cast(NUMBER)))
    return F.struct(at(f["low"]).alias("low"), at(f["high"]).alias("high"), (f["by"] + g["by"]).cast(NUMBER).alias("by"))


def health_after(step: Column) -> Column:
    """A composed step applied to full health."""
    return F.least(step["high"], F.greatest(step["low"], (F.lit(1).cast(NUMBER) + step["by"]).cast(NUMBER)))


def crossing(health: Column) -> Column:
    """What a value of health says of quarantine: true below QUARANTINE, false from RELEASE on, null between."""
    return F.when(health < F.lit(QUARANTINE).cast(NUMBER), True).when(health >= F.lit(RELEASE).cast(NUMBER), False)


def running_health(outcomes: DataFrame) -> DataFrame:
    """(proxy, seq, delta, ...) -> with place, each outcome's place among its proxy's, and health after it (exact)."""
    return scans.running(outcomes, "proxy", ["seq"], clamped(F.col("delta")), then).withColumn("health", health_after(F.col("scan"))).drop("scan")


def proxy_health(outcomes: DataFrame) -> DataFrame:
    """(proxy, seq, delta) -> (proxy, health, quarantined) after all outcomes, in order.

    Health is clamped to [0, 1] at each; quarantine is what its last crossing said, none is no quarantine. A null change is none.
    """
    rows = running_health(outcomes.select("proxy", "seq", "delta")).withColumn("crossed", crossing(F.col("health")))
    said = F.max_by("crossed", F.when(F.col("crossed").isNotNull(), F.col("place")))
    return rows.groupBy("proxy").agg(F.max_by("health", "place").cast("double").alias("health"), F.coalesce(said, F.lit(False)).alias("quarantined"))


def best_proxy(health: DataFrame, pool: DataFrame) -> DataFrame:
    """(proxy, health, quarantined), (proxy, pos) -> the healthiest that isn't quarantined, the first of equals."""
    rows = pool.join(health, "proxy", "left").where(~F.coalesce("quarantined", F.lit(False)))
    return rows.select("proxy", "pos", F.coalesce("health", F.lit(1.0)).alias("health")).orderBy(F.desc("health"), "pos").limit(1)


def round_robin(requests: DataFrame, pool: list[str]) -> DataFrame:
    """(shard, seq, ...) -> proxy for each request, in turn within each shard."""
    if not pool:
        return requests.withColumn("proxy", F.lit(None).cast("string"))
    chosen = F.element_at(F.array(*map(F.lit, pool)), (F.col("place") % len(pool) + 1).cast("int"))
    return scans.places(requests, "shard", ["seq"]).withColumn("proxy", chosen).drop("place")


def throttle_state(state: tuple[float, float] | None, times: Iterator[float], rate: float, burst: int) -> tuple[tuple[float, float], list[float]]:
    """Token bucket: (tokens, time) and arrivals -> the state after them and each arrival's wait."""
    rate, burst = max(rate, 0.01), max(burst, 1)
    waits = []
    for t in times:
        tokens, last = state or (float(burst), t)
        now = max(t, last)
        tokens = min(float(burst), tokens + (now - last) * rate)
        wait = 0.0
        if tokens < 1:
            wait = (1 - tokens) / rate
            now, tokens = now + wait, 0.0
        else:
            tokens -= 1
        waits.append(now - t)
        state = (tokens, now)
    return state or (float(burst), 0.0), waits


def rate_limit(requests: DataFrame, rate: float = 1.0, burst: int = 3) -> DataFrame:
    """(domain, seq, at seconds) -> with each request's wait under its domain's token bucket; null for one without a time.

    The time at which a bucket is full again moves to max(it, at) + 1 / rate with each request, in the order of (at, seq). That is a
    product over (max, +): after the n-th request it is the greatest of at[k] - k / rate up to n, plus (n + 1) / rate. So it
    is a running maximum, of a range's rows and of the ranges before.
    """
    gap, full = 1 / max(rate, 0.01), max(burst, 1) / max(rate, 0.01)
    order = ["at", "seq"]
    rows = scans.ranged(requests.select("domain", F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at")), "domain", order)
    so_far = scans.inside("domain", order)
    rows = rows.withColumn("nth", F.count("at").over(so_far) - 1).withColumn("free", F.col("at") - F.col("nth") * gap)
    parts = rows.groupBy("domain", "__part").agg(F.count("at").alias("n"), F.max("free").alias("most"))
    ahead = scans.before(parts, "domain", earlier=F.sum("n"))
    parts = scans.with_before(parts, ahead, "domain").na.fill(0, ["earlier"]).withColumn("most", F.col("most") - F.col("earlier") * gap)
    reached = scans.before(parts, "domain", earlier=F.sum("n"), most=F.max("most"))
    rows = scans.with_before(rows.withColumn("own", F.max("free").over(so_far)), reached, "domain").na.fill(0, ["earlier"])
    free = F.greatest("most", F.col("own") - F.col("earlier") * gap) + (F.col("earlier") + F.col("nth") + 1) * gap
    wait = F.when(F.col("at").isNotNull(), F.greatest(F.lit(0.0), free - full - F.col("at")))
    return rows.select("domain", "seq", "at", wait.alias("wait"))


# Identities are these user agents, each with the language at its place modulo three.
USER_AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/123.0.0.0 Safari/537.36 Edg/123.0.0.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.4.1 Safari/605.1.15",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:125.0) Gecko/20100101 Firefox/125.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14.4; rv:125.0) Gecko/20100101 Firefox/125.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/122.0.0.0 Safari/537.36 OPR/108.0.0.0",
)
LANGUAGES = ("en-US,en;q=0.9", "en-US,en;q=0.8,en-GB;q=0.6", "en-GB,en;q=0.9,en-US;q=0.8")
ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,*/*;q=0.8"


def request_headers(url: Column, extra: dict[str, str] | None = None) -> Column:
    """map of headers: the url's identity over the extra ones."""
    k = identity_bucket(url, len(USER_AGENTS))
    own = {
        "User-Agent": F.element_at(F.array(*map(F.lit, USER_AGENTS)), k + 1),
        "Accept-Language": F.element_at(F.array(*map(F.lit, LANGUAGES)), k % len(LANGUAGES) + 1),
        "Accept": F.lit(ACCEPT),
    }
    rest = {name: F.lit(v) for name, v in (extra or {}).items() if name not in own}
    return F.create_map(*[x for name, v in {**rest, **own}.items() for x in (F.lit(name), v)])


# The name under which the environment asks for session proxies; its host, port and users' prefix are in settings_from().
SESSION_PROVIDER = "brightdata"


def proxy_kind(settings: dict) -> str:
    """Which kind of proxies settings ask for: session (customer, zone and password), rotating, static or none, in this order."""
    if not settings or not settings.get("enabled", True):
        return "none"
    if settings.get("customer_id") and settings.get("zone") and settings.get("password"):
        return "session"
    return "rotating" if settings.get("servers") else "static" if settings.get("server") else "none"


def settings_from(environment: Mapping[str, str]) -> dict:
    """Settings of assign_proxies() from environment variables: PROXY_PROVIDER is rotating (PROXY_POOL_URLS, by commas), the session
    provider's name, or static (PROXY_SERVER, PROXY_USERNAME, PROXY_PASSWORD); nothing usable is no proxy."""
    kind = (environment.get("PROXY_PROVIDER") or "").strip().lower()
    if kind == "rotating":
        return {"servers": [s.strip() for s in environment.get("PROXY_POOL_URLS", "").split(",") if s.strip()]}
    if kind == SESSION_PROVIDER:
        get = lambda name: environment.get(f"PROXY_{SESSION_PROVIDER.upper()}_{name}")
        customer = get("CUSTOMER_ID") or environment.get("PROXY_USERNAME")
        found = {"customer_id": customer and f"brd-customer-{customer}", "zone": get("ZONE"), "password": environment.get("PROXY_PASSWORD"), "country": get("COUNTRY"), "host": environment.get("PROXY_HOST", "brd.superproxy.io"), "port": environment.get("PROXY_PORT", "22225")}
        return {k: v for k, v in found.items() if v} | {"sticky": (get("STICKY_PER_URL") or "1").strip() != "0"}
    server = environment.get("PROXY_SERVER")
    return {"server": server, "username": environment.get("PROXY_USERNAME"), "password": environment.get("PROXY_PASSWORD")} if server else {}


def assign_proxies(requests: DataFrame, settings: dict) -> DataFrame:
    """(url, shard, seq) -> with the proxy's url by the settings' kind, null for none."""
    kind, text = proxy_kind(settings), F.lit(None).cast("string")
    if kind == "rotating":
        chosen = round_robin(requests, list(settings["servers"])).withColumn("__p", proxy_parts(F.col("proxy")))
        return chosen.withColumn("proxy", F.coalesce(proxy_url(F.col("__p.server"), F.col("__p.username"), F.col("__p.password")), "proxy")).drop("__p")
    if kind == "static":
        text = proxy_url(F.lit(settings["server"]), F.lit(settings.get("username")).cast("string"), F.lit(settings.get("password")).cast("string"))
    if kind == "session":
        user = session_user(settings["customer_id"], F.col("url"), settings["zone"], settings.get("country") or "", settings.get("sticky", True))
        text = proxy_url(F.lit(f"http://{settings.get('host', 'localhost')}:{settings.get('port', 22225)}"), user, F.lit(settings["password"]))
    return requests.withColumn("proxy", text)
