"""Extraction tiers: a page to its records, first tier that finds any.

All tiers of a page run inside one Arrow-batched pass, in order, and stop at the first that yields,
which a union of tiers in the plan could not do. Cheap substring tests come before any parsing.
Payloads of endpoints are columns of the input: nothing is fetched.
"""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions import html_tree
from pagewright.functions import json_records as J
from pagewright.functions.predicates import API_CONTENT_TYPES, API_PATTERNS
from pagewright.functions.selectors import Found, Query, answers
from pagewright.sources.session import prepare_workers, small_batches

# Where pages embed their state, in the order in which they are tried.
BLOBS = (
    ("next_data", re.compile(r'<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', re.S)),
    ("nuxt", re.compile(r"window\.__NUXT__\s*=\s*(\{.*?\});", re.S)),
    ("apollo", re.compile(r"window\.__APOLLO_STATE__\s*=\s*(\{.*?\});", re.S)),
    ("initial_state", re.compile(r"window\.__INITIAL_STATE__\s*=\s*(\{.*?\});", re.S)),
    ("preloaded_state", re.compile(r"window\.__PRELOADED_STATE__\s*=\s*(\{.*?\});", re.S)),
)
#: What the built-in tiers look for in a page's markup, and the text without which it can't be there.
_QUERIES = {
    "next_data": ("__NEXT_DATA__", Query(("script#__NEXT_DATA__",), raw=True)),
    "json_ld": ("application/ld+json", Query(('script[type="application/ld+json"]',), every=True, raw=True)),
    "microdata": ("itemscope", Query(("[itemprop]",), ("[itemscope]",), every=True, fallback=False)),
}
_API = re.compile("(?i)" + "|".join(API_PATTERNS))


@dataclass
class Page:
    """What a tier sees of a page."""

    url: str
    html: str
    content_type: str = ""
    #: {"selectors": {field: css}, "containers": [css], "mappings": [{field, pattern, paths, envelope, hint}], "endpoints": [url], "blocked": [text]}
    profile: dict = field(default_factory=dict)
    #: endpoint -> body, of the responses at hand
    payloads: dict[str, str] = field(default_factory=dict)
    _tree: html_tree.Node | None = None
    _found: dict[str, list[list[Found]]] | None = None

    @property
    def tree(self) -> html_tree.Node:
        if self._tree is None:
            self._tree = html_tree.parse(self.html)
        return self._tree

    def found(self, what: str) -> list[list[Found]]:
        """What the built-in tiers look for in the markup: "profile", "next_data", "json_ld" or "microdata", all from one pass."""
        if self._found is None:
            queries = {k: q for k, (mark, q) in _QUERIES.items() if mark in self.html}
            with contextlib.suppress(Exception):  # then the profile's tier raises, and only that
                queries["profile"] = Query(tuple((self.profile.get("selectors") or {}).values()), tuple(self.profile.get("containers") or ()))
            self._found = answers(self.html, queries)
        if what == "profile" and what not in self._found:
            raise ValueError("the profile's selectors can't be read")
        return self._found.get(what, [])

    @property
    def is_json(self) -> bool:
        return "json" in self.content_type.lower()


@dataclass(frozen=True)
class Options:
    """What all pages of a run share."""

    fields: tuple[str, ...] = ()
    learned: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tier:
    """A plug-in: its rank among the tiers, and what it finds: (records, the tier's full name, error)."""

    name: str
    rank: float
    confidence: float
    handles: Callable[[Page, Options], bool]
    extract: Callable[[Page, Options], tuple[list[Any], str]]


def _record(names: Sequence[str], hits: list[Found]) -> dict[str, str]:
    values = {h.selector: h.value for h in hits}
    return {name: v for i, name in enumerate(names) if (v := values.get(i))}


def _from_dom(page: Page) -> list[dict]:
    selectors = page.profile.get("selectors") or {}
    if not selectors:
        return []
    return [r for hits in page.found("profile") if (r := _record(list(selectors), hits))]


def _from_endpoints(page: Page, options: Options) -> list[dict]:
    groups: dict[str, list[dict]] = {}
    for m in page.profile.get("mappings") or []:
        if m.get("pattern"):
            groups.setdefault(m["pattern"], []).append(m)
    found: list[dict] = []
    for pattern, mappings in groups.items():
        payload = J.parse(page.payloads.get(pattern))
        if payload is None:
            continue
        paths: dict[str, str] = {}
        for m in mappings:
            own = (m.get("paths") or {}).get(m["field"]) or m.get("hint")
            if own:
                paths[m["field"]] = own
        found += J.project(J.unwrap(payload, next((m["envelope"] for m in mappings if m.get("envelope")), None)), paths)
    return found


def _replay(page: Page, options: Options) -> tuple[list[Any], str]:
    records = _from_dom(page) or _from_endpoints(page, options)
    if not records and page.is_json:
        records = J.find_records(J.parse(page.html), options.fields)
    return records, "profile_replay"


def _has_profile(page: Page, options: Options) -> bool:
    p = page.profile
    return bool(p.get("selectors") or p.get("endpoints") or any(m.get("pattern") or m.get("selector") or m.get("paths") for m in p.get("mappings") or []))


def _is_known_api(page: Page, options: Options) -> bool:
    url = page.url.lower()
    if any(b and b in page.url for b in page.profile.get("blocked") or []) or not page.html:
        return False
    if any(n and n.lower() in url for n in options.noise):
        return False
    return any(x and x.lower() in url for x in options.learned) or page.content_type.lower().split(";")[0].strip() in API_CONTENT_TYPES or bool(_API.search(page.url))


def _known_api(page: Page, options: Options) -> tuple[list[Any], str]:
    return J.find_records(J.parse(page.html), options.fields) if J.has_records(page.html, options.fields) else [], "known_api"


def _embedded(page: Page, options: Options) -> tuple[list[Any], str]:
    for label, pattern in BLOBS:
        m = pattern.search(page.html)
        if not m:
            continue
        data = J.parse(m[1].strip())
        if data is None and label == "next_data":
            hits = page.found("next_data")
            data = J.parse(hits[0][0].value) if hits and hits[0] else None
        if data is not None and (found := J.find_records(data, options.fields)):
            return found, f"embedded_blob:{label}"
    return [], "embedded_blob"


def _json_ld(page: Page, options: Options) -> tuple[list[Any], str]:
    found: list[Any] = []
    for hit in (h for hits in page.found("json_ld") for h in hits):
        data = J.parse(hit.value)
        found += data if isinstance(data, list) else [data] if isinstance(data, dict) else []
    return found, "json_ld"


def _api_json(page: Page, options: Options) -> tuple[list[Any], str]:
    data = J.parse(page.html)
    if isinstance(data, list):
        return [x for x in data if isinstance(x, dict)], "api_json"
    if isinstance(data, dict):
        return next((v for v in data.values() if isinstance(v, list) and v and isinstance(v[0], dict)), [data]), "api_json"
    return [], "api_json"


def _microdata(page: Page, options: Options) -> tuple[list[Any], str]:
    records = ({h.attrs["itemprop"]: h.value for h in hits if h.attrs["itemprop"]} for hits in page.found("microdata"))
    return [r for r in records if r], "microdata"


def dom_css(selectors: dict[str, str], rank: float = 4) -> Tier:
    """A tier of one record for each page from a fixed selector map; not part of the cascade unless added."""
    query = Query(tuple(selectors.values()))

    def extract(page: Page, options: Options) -> tuple[list[Any], str]:
        record = _record(list(selectors), answers(page.html, {"page": query})["page"][0])
        return [record] if record else [], "dom_css"

    return Tier("dom_css", rank, 0.6, lambda page, options: bool(selectors), extract)


#: A tier for records that a model returned: there is none to call here, so it finds nothing.
MODEL_TIER = Tier("llm", 5, 0.0, lambda page, options: True, lambda page, options: ([], "llm"))

CASCADE = (
    Tier("profile_replay", 1.0, 0.85, _has_profile, _replay),
    Tier("known_api", 1.1, 0.9, _is_known_api, _known_api),
    Tier("embedded_blob", 1.2, 0.8, lambda p, o: "__NEXT_DATA__" in p.html or "window.__" in p.html, _embedded),
    Tier("json_ld", 1.3, 0.9, lambda p, o: "application/ld+json" in p.html, _json_ld),
    Tier("api_json", 2.0, 0.85, lambda p, o: p.is_json, _api_json),
    Tier("microdata", 3.0, 0.75, lambda p, o: "itemscope" in p.html, _microdata),
)


class Registry:
    """Plug-in tiers, kept in the order of their ranks; they come before the built-in cascade."""

    def __init__(self) -> None:
        self.tiers: list[Tier] = []

    def register(self, tier: Tier) -> None:
        self.tiers = sorted([*self.tiers, tier], key=lambda t: t.rank)

    def by_rank(self, rank: float) -> list[Tier]:
        return [t for t in self.tiers if t.rank == rank]

    def resolved(self) -> tuple[Tier, ...]:
        return (*self.tiers, *CASCADE)


def first_records(page: Page, options: Options, tiers: Sequence[Tier] = CASCADE) -> tuple[list[Any], str | None, float]:
    """The records of the first tier that has any, its name and confidence. A tier that fails is skipped."""
    for tier in tiers:
        try:
            if tier.handles(page, options):
                records, name = tier.extract(page, options)
                if records:
                    return records, name, tier.confidence
        except Exception:  # noqa: BLE001 - one tier's trouble with one page must not end the run
            continue
    return [], None, 0.0


RESULT = "url string, tier_used string, confidence double, rec_idx int, record_json string"


def extract(pages: DataFrame, fields: Sequence[str] = (), learned: Sequence[str] = (), noise: Sequence[str] = (), tiers: Sequence[Tier] = CASCADE) -> DataFrame:
    """(url, html[, content_type, profile_json, payloads]) -> one row for each record; a page without has one with nulls.

    profile_json: Page.profile as JSON; payloads: map of endpoint pattern to body.
    """
    prepare_workers(pages.sparkSession)
    have = set(pages.columns)
    optional = {"content_type": F.lit(""), "profile_json": F.lit(None).cast("string"), "payloads": F.lit(None).cast("map<string,string>")}
    source = pages.select("url", F.coalesce("html", F.lit("")).alias("html"), *[(F.col(c) if c in have else d).alias(c) for c, d in optional.items()])
    options, tiers = Options(tuple(fields), tuple(learned), tuple(noise)), tuple(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                page = Page(r["url"] or "", r["html"], r["content_type"] or "", J.parse(r["profile_json"]) or {}, dict(r["payloads"] or {}))
                records, name, confidence = first_records(page, options, tiers)
                rows += [(r["url"], name, confidence, i, json.dumps(x, default=str)) for i, x in enumerate(records)] or [(r["url"], None, 0.0, None, None)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return source.mapInArrow(run, RESULT)


_NOISE = re.compile(r"(?is)<!--.*?-->|<(script|style|nav|footer|header|aside|iframe|noscript)(?:\s[^>]*)?>.*?</\1>")
MARKDOWN_CHARS = 12_000


def page_markdown(page: str | None, most: int = MARKDOWN_CHARS) -> str | None:
    """Markdown without noise elements, cut with a mark; of a page that can't be read as a tree, the text between its tags."""
    if page is None:
        return None
    try:
        text = html_tree.markdown(_NOISE.sub("", page))
        return text if len(text) <= most else text[:most] + "\n...[truncated]"
    except Exception:  # noqa: BLE001 - one page's markup must not end the run
        return re.sub(r" {2,}", " ", re.sub(r"<[^>]+>", " ", page)).strip()[:most]


def fit_markdown(html: Column) -> Column:
    """page_markdown() of a column."""
    prepare_workers(SparkSession.active())
    small_batches(SparkSession.active())

    @F.arrow_udf(StringType())
    def run(pages: pa.Array) -> pa.Array:
        return pa.array((page_markdown(page.as_py()) for page in pages), pa.string())

    return run(html)
