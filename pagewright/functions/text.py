"""Urls, names, hashes and small renderings, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a platform, in the order in which they are tried.
PLATFORMS = {
    "wordpress": ["wp-content", "wp-json", "wp-includes", "/wp/"],
    "shopify": ["cdn.shopify.com", "shopify.com/s/files", "Shopify.theme"],
    "wix": ["static.wixstatic.com", "wix-warmup-data"],
    "squarespace": ["squarespace.com", "squarespace-cdn"],
    "webflow": ["webflow.io", "webflow.com"],
    "nextjs": ["__NEXT_DATA__", "/_next/static"],
    "nuxtjs": ["__NUXT__", "/_nuxt/"],
    "drupal": ["drupal.org", "drupal.js", "/sites/default/files"],
    "joomla": ["/media/jui/", "joomla"],
    "magento": ["Mage.Cookies", "mage/", "/pub/static/"],
    "react": ["react-root", "__reactFiber", "__reactInternalInstance"],
    "angular": ["ng-version", "ng-app", "angular.json"],
    "vue": ["__vue_app__", "data-v-app"],
}
NOISE_TAGS = ("script", "style", "nav", "footer", "header", "aside", "iframe", "noscript")
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def netloc(url: Column) -> Column:
    """Authority with user and port; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), F.lit(""))


def domain(url: Column) -> Column:
    """The authority, or the whole url where it has none."""
    return F.coalesce(F.nullif(netloc(url), F.lit("")), url)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a reference against an http(s) page: absolute, //host, /path, ?query, #fragment, relative with dots."""
    scheme = F.regexp_extract(base, SCHEME, 1)
    root = F.concat(scheme, F.lit("://"), netloc(base))
    path = url_path(base)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    own = F.regexp_replace(ref, r"[?#].*$", "")
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(ref == "", base)
        .when(ref.rlike(SCHEME), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(root, path, ref))
        .otherwise(F.concat(root, without_dots(merged), tail))
    )


def without_dots(path: Column) -> Column:
    """Drop `.` and resolve `..` segments; untouched if there are none."""
    parts = F.split(path, "/")
    dots = F.element_at(parts, -1).isin(".", "..")
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(p))),
    )
    clean = F.concat(F.array_join(fold, "/"), F.when(dots, "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), clean).otherwise(path)


def resolve_endpoint(pattern: Column, base: Column) -> Column:
    """An endpoint pattern without its {placeholders} and trailing separators, resolved against the page."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\{[^}]*\}", ""), r"[/?&]+$", "")
    return F.when(plain.rlike("^https?://"), plain).otherwise(url_join(base, plain))


def normalize_key(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9_]", "_"), "^_+|_+$", "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def strip_noise(html: Column) -> Column:
    """Drop comments and the elements of a page that hold no content."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<(" + "|".join(NOISE_TAGS) + r")(\s[^>]*)?>.*?</\1>", "")


def fingerprint(html: Column) -> Column:
    return F.left(F.sha2(html, 256), F.lit(32))


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def skill_hash(name: Column, version: Column) -> Column:
    return short_hash(F.concat(name, F.lit("::"), version))


def identity_bucket(url: Column, n: int) -> Column:
    """A number below n by the first four bytes of the url's SHA-256."""
    return (F.conv(F.left(F.sha2(url, 256), F.lit(8)), 16, 10).cast("long") % n).cast("int")


def session_user(user: str, url: Column, zone: str = "", country: str = "", sticky: bool = True) -> Column:
    """A proxy's user name; sticky: with a session for each url."""
    parts = [F.lit(user)]
    if zone:
        parts.append(F.lit(f"zone-{zone}"))
    if country:
        parts.append(F.lit(f"country-{country.lower()}"))
    if sticky:
        parts.append(F.concat(F.lit("session-"), short_hash(url)))
    return F.concat_ws("-", *parts)


def page_text(html: Column, url: Column) -> Column:
    """What platforms are told by. Make it a column of its own before platform_of() or platform_shares(), which use it often."""
    return F.lower(F.concat(html, url))


def platform_of(text: Column) -> Column:
    """The first platform with a mark in the text."""
    out = None
    for name, marks in PLATFORMS.items():
        hit = text.contains(marks[0].lower())
        for m in marks[1:]:
            hit = hit | text.contains(m.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def platform_shares(text: Column) -> Column:
    """map(platform, share of its marks that are there), without those of none."""
    share = lambda marks: sum((text.contains(m.lower()).cast("int") for m in marks[1:]), text.contains(marks[0].lower()).cast("int")) / F.lit(len(marks))
    return F.map_filter(F.create_map(*[x for name, marks in PLATFORMS.items() for x in (F.lit(name), share(marks))]), lambda _, v: v > 0)


def detect_platform(html: Column, url: Column) -> Column:
    return platform_of(page_text(html, url))


def platform_scores(html: Column, url: Column) -> Column:
    return platform_shares(page_text(html, url))


def api_signature(patterns: Column) -> Column:
    return F.array_join(F.array_sort(patterns), "|")


def fixed(number: Column, digits: int) -> Column:
    """A number with that many decimals, as C's printf writes it: its exact binary value rounded, ties to even. format_string() rounds its
    shortest decimal form, half up. Whole and rest are told apart, so that all decimals are exact."""
    size = F.abs(number)
    whole = F.floor(size)
    rest = F.call_function("format_number", size - whole, F.lit("0." + "0" * digits))  # 1.00 where it rounds up
    exact = F.concat(F.when(number < 0, "-").otherwise(""), (whole + F.substring(rest, 1, 1).cast("long")).cast("string"), F.substring(rest, 2, digits + 1))
    return F.when(size < 1e15, exact).otherwise(F.format_string(f"%.{digits}f", number))


def render_keywords(keywords: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(keywords, ", "), F.lit("")), F.lit("(none)"))


def proxy_parts(url: Column) -> Column:
    """scheme://user:password@host:port -> struct(server, username, password), credentials decoded."""
    take = lambda k: F.nullif(F.regexp_extract(url, r"^([a-z0-9]+)://(?:([^:@/]*)(?::([^@/]*))?@)?([^/@]+)", k), F.lit(""))
    return F.struct(F.concat(take(1), F.lit("://"), take(4)).alias("server"), F.url_decode(take(2)).alias("username"), F.url_decode(take(3)).alias("password"))


def proxy_url(server: Column, username: Column, password: Column) -> Column:
    """The parts in one url; credentials percent-encoded."""
    code = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    login = F.when(F.coalesce(username, F.lit("")) == "", "").otherwise(F.concat(code(username), F.coalesce(F.concat(F.lit(":"), code(password)), F.lit("")), F.lit("@")))
    return F.concat(F.regexp_extract(server, r"^([a-z0-9]+://)", 1), login, F.regexp_replace(server, r"^[a-z0-9]+://", ""))


def fill_template(template: str, values: dict[str, Column | str]) -> Column:
    """Fill {name} places; names without a value stay as they stand."""
    parts = [p for p in re.split(r"(\{[A-Za-z_][A-Za-z0-9_]*\})", template) if p]
    filled = [values.get(p[1:-1], p) if p.startswith("{") and p.endswith("}") else p for p in parts]
    return F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in filled]) if filled else F.lit("")
