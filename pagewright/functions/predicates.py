"""Predicates over pages, urls and responses, as Column builders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.patterns import needles_in

# Tokens of challenge pages.
CAPTCHA_TOKENS = ("recaptcha", "hcaptcha", "cf-challenge", "cf_chl_opt", "challenge-running", "distil_identify", "px-captcha", "__ddg", "datadome", "arkoselabs")
# Url shapes and content types of data endpoints.
API_PATTERNS = (r"/api/", r"/v\d+/", r"\.json(\?|$)", r"/graphql", r"/feed(\b|/|\?)", r"/rss(\b|/|\?)", r"/sitemap", r"/data/", r"/search\?", r"/listings\?", r"\.xml(\?|$)")
API_CONTENT_TYPES = ("application/json", "application/ld+json", "application/xml", "text/xml", "application/atom+xml", "application/rss+xml", "application/x-ndjson", "application/vnd.api+json")
#: More needles than these are matched by an automaton, fewer by a test each in generated code.
MANY = 32
HARD_CODES = (403, 407, 451)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def contains_any(text: Column, needles: Iterable[str], ignore_case: bool = True, skip_empty: bool = True) -> Column:
    """Whether a text holds any of the needles. An empty needle is in every text unless skipped. Beyond MANY needles an automaton looks for all at once."""
    needles = list(needles)
    text = F.lower(text) if ignore_case else text
    if len(needles) > MANY and (skip_empty or all(needles)):
        return F.size(needles_in(text, [n.lower() for n in needles] if ignore_case else needles)) > 0
    return any_of(text.contains(n.lower() if ignore_case else n) for n in needles if n or not skip_empty)


def fetch_success(status: Column, error: Column) -> Column:
    return F.coalesce(error.isNull() & status.between(200, 299), F.lit(False))


def is_captcha(html: Column) -> Column:
    return F.coalesce(contains_any(html, CAPTCHA_TOKENS), F.lit(False))


def media_type(content_type: Column) -> Column:
    return F.trim(F.split_part(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(";"), F.lit(1)))


def is_api_endpoint(url: Column, content_type: Column | None = None) -> Column:
    """A data endpoint by the shape of its url or by its content type."""
    shaped = F.coalesce(url.rlike("(?i)" + "|".join(API_PATTERNS)), F.lit(False))
    return shaped if content_type is None else shaped | media_type(content_type).isin(*API_CONTENT_TYPES)


def is_data_api(url: Column, content_type: Column | None = None, learned: Iterable[str] = (), noise: Iterable[str] = ()) -> Column:
    """Noise patterns win, then learned patterns, then the general shape."""
    return F.when(contains_any(url, noise), False).when(contains_any(url, learned), True).otherwise(is_api_endpoint(url, content_type))


def not_blocked(url: Column, blocked: Column) -> Column:
    """No entry of the array is part of the url; case counts, empty entries don't."""
    return ~F.exists(F.coalesce(blocked, F.array().cast("array<string>")), lambda b: (b != "") & url.contains(b))


def failure_severity(status: Column, error: Column) -> Column:
    hard = status.isin(*HARD_CODES) | F.lower(F.coalesce(error, F.lit(""))).rlike("captcha|auth")
    return F.when(F.coalesce(hard, F.lit(False)), "hard").otherwise("soft")


def outcome_delta(status: Column, error: Column) -> Column:
    """What a response does to its proxy's health: 2xx and 3xx without an error help, the rest hurts by severity."""
    good = error.isNull() & status.between(200, 399)
    return F.when(F.coalesce(good, F.lit(False)), 0.05).when(failure_severity(status, error) == "hard", -0.25).otherwise(-0.05)


def schema_drift(stored: Column, current: Column) -> Column:
    return F.coalesce(stored != current, F.lit(False))
