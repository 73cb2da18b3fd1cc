"""Profiles of alike sites, by classes instead of pairs.

A class holds the profiles of one domain, platform and API signature; where platform or signature is missing it fits any. So
classes link with themselves, and beyond that only across what is missing: by equi-joins whose one side has one class for
each key (but for platform-less against signature-less classes, whose links are as many as platforms times signatures of a
domain). Links of classes and each profile's class say what all pairs say, in space that grows with the profiles.

A profile without a url has no domain and no class. Repeated urls are members each; a url never links with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import api_signature, domain

CLASS = ("domain", "platform", "sig")


def members(profiles: DataFrame) -> DataFrame:
    """(url_pattern, platform, confirmed_patterns, ...) -> with domain and sig: a class is (domain, platform, sig)."""
    return profiles.withColumn("domain", domain(F.col("url_pattern"))).withColumn("sig", F.nullif(api_signature(F.col("confirmed_patterns")), F.lit(""))).where("domain is not null")


def class_links(classes: DataFrame) -> DataFrame:
    """(domain, platform, sig) without repeats -> (domain, platform, sig, to_platform, to_sig): each class with those it fits, itself included."""
    to = classes.select(F.col("domain").alias("to_domain"), F.col("platform").alias("to_platform"), F.col("sig").alias("to_sig"))
    mine = (F.col("platform"), F.col("sig"))
    theirs = (F.col("to_platform"), F.col("to_sig"))
    wild = lambda c, p, s: c.where((F.col(p).isNull() if p else F.lit(True)) & (F.col(s).isNull() if s else F.lit(True)))
    both = lambda a, b, on, keep: a.join(b, (F.col("domain") == F.col("to_domain")) & on).where(keep).select("domain", *mine, *theirs)
    # the side that lacks something, against all that have it
    platform = both(wild(classes, "", "sig"), to.where("to_sig is not null"), F.col("platform") == F.col("to_platform"), F.lit(True))
    signature = both(wild(classes, "platform", ""), to.where("to_platform is not null"), F.col("sig") == F.col("to_sig"), F.lit(True))
    free = both(wild(classes, "platform", "sig"), to, F.lit(True), theirs[0].isNotNull() | theirs[1].isNotNull())
    crossed = both(classes.where("platform is null and sig is not null"), to.where("to_platform is not null and to_sig is null"), F.lit(True), F.lit(True))
    found = platform.union(signature).union(free).union(crossed)
    back = found.select("domain", F.col("to_platform"), F.col("to_sig"), *mine)
    return classes.select("domain", *mine, F.col("platform").alias("to_platform"), F.col("sig").alias("to_sig")).union(found).union(back)


def _of(rows: DataFrame) -> DataFrame:
    """The rows with their class under names of its own: c_domain, c_platform, c_sig."""
    return rows.withColumnsRenamed({c: f"c_{c}" for c in CLASS})


def _is(platform: str = "platform", sig: str = "sig") -> Column:
    """Whether a class is that of _of() rows."""
    return (F.col("domain") == F.col("c_domain")) & F.col(platform).eqNullSafe(F.col("c_platform")) & F.col(sig).eqNullSafe(F.col("c_sig"))


_FITS = ("to_platform", "to_sig")


def cluster_membership(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every profile with its class and n_links, how many profiles of other urls it fits; the links of classes."""
    rows = members(profiles)
    sizes = rows.groupBy(*CLASS).agg(F.count("*").alias("n"))
    links = class_links(sizes.select(*CLASS))
    reached = links.join(_of(sizes), _is(*_FITS)).groupBy(*CLASS).agg(F.sum("n").alias("n_links"))
    own = rows.groupBy("url_pattern", *CLASS).agg(F.count("*").alias("n_own"))
    # a url's rows of other classes that fit aren't links of it either
    named = own.alias("a").join(own.alias("b"), F.expr("a.url_pattern = b.url_pattern and (a.platform is null or b.platform is null or a.platform = b.platform) and (a.sig is null or b.sig is null or a.sig = b.sig)"))
    named = named.groupBy("a.url_pattern", "a.domain", "a.platform", "a.sig").agg(F.sum("b.n_own").alias("n_same"))
    counted = named.join(_of(reached), _is()).select("url_pattern", *CLASS, (F.col("n_links") - F.col("n_same")).alias("n_links"))
    return counted, links


def matched(profiles: DataFrame) -> DataFrame:
    """(target, cluster, n_links): each profile that fits others, the smallest url of its class and how many they are; no pair is expanded.
    With class_links(), every pair of find_clusters() follows."""
    first = members(profiles).groupBy(*CLASS).agg(F.min("url_pattern").alias("cluster"))
    counted = cluster_membership(profiles)[0].where("n_links > 0")
    return counted.join(_of(first), _is()).select(F.col("url_pattern").alias("target"), "cluster", "n_links")


def find_clusters(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(url_pattern, platform, confirmed_patterns) twice -> (target, member): same domain, another url, platforms and API
    signatures equal where both sides have one. All pairs, expanded from links of classes: for reports on few targets."""
    t, c = members(targets), members(candidates)
    links = class_links(t.select(*CLASS).union(c.select(*CLASS)).distinct())
    near = t.select(F.col("url_pattern").alias("target"), *CLASS).join(links.withColumnsRenamed({"domain": "l_domain", "platform": "l_platform", "sig": "l_sig"}), F.expr("domain = l_domain and platform <=> l_platform and sig <=> l_sig"))
    near = near.select("target", "domain", *_FITS)
    return near.join(_of(c.select(F.col("url_pattern").alias("member"), *CLASS)), _is(*_FITS)).where("target <> member").select("target", "member")


def find_similar(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target, member) of equal, non-null platform and another url. All pairs; similar_counts() has their numbers."""
    t = targets.select(F.col("url_pattern").alias("target"), "platform")
    c = candidates.select(F.col("url_pattern").alias("member"), "platform")
    return t.join(c, "platform").where("target <> member").select("target", "member")


def similar_counts(profiles: DataFrame) -> DataFrame:
    """(platform, n_members, n): of each platform its profiles, and how many ordered pairs of different urls they are."""
    of_url = profiles.where("platform is not null and url_pattern is not null").groupBy("platform", "url_pattern").agg(F.count("*").alias("k"))
    return of_url.groupBy("platform").agg(F.sum("k").alias("n_members"), (F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("n"))


def donors(clusters: DataFrame, profiles: DataFrame, rank: Column) -> DataFrame:
    """(target, member) pairs -> (target, donor): the member of the greatest rank, the first by pos of equals."""
    rows = clusters.join(profiles.select(F.col("url_pattern").alias("member"), rank.alias("rank"), "pos"), "member")
    best = Window.partitionBy("target").orderBy(F.desc("rank"), "pos")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("target", F.col("member").alias("donor"))


def class_donors(profiles: DataFrame, rank: Column) -> DataFrame:
    """donors() of all profiles among themselves, by classes: the best two urls of the classes that a class fits, of which a profile takes the first that isn't its own."""
    rows = members(profiles).withColumn("rank", rank)
    top = lambda df, by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rank"), "pos", "url_pattern"))).where("n <= 2").drop("n")
    urls = rows.groupBy("url_pattern", *CLASS).agg(F.max_by(F.struct("rank", "pos"), F.struct("rank", -F.col("pos"))).alias("best")).select("url_pattern", *CLASS, "best.rank", "best.pos")
    two = top(urls, CLASS)  # Spark prunes to two of a class before it shuffles
    links = class_links(rows.select(*CLASS).distinct())
    near = links.join(_of(two), _is(*_FITS)).groupBy(*CLASS, "url_pattern").agg(F.max_by(F.struct("rank", "pos"), F.struct("rank", -F.col("pos"))).alias("best")).select(*CLASS, "url_pattern", "best.rank", "best.pos")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy(*CLASS).orderBy(F.desc("rank"), "pos", "url_pattern"))).where("n <= 2")
    pair = near.groupBy(*CLASS).agg(F.max(F.when(F.col("n") == 1, F.col("url_pattern"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("url_pattern"))).alias("second"))
    mine = rows.select("url_pattern", *CLASS).distinct()
    chosen = mine.join(_of(pair), _is())
    donor = F.when(F.col("first") != F.col("url_pattern"), F.col("first")).otherwise(F.col("second"))
    return chosen.select(F.col("url_pattern").alias("target"), donor.alias("donor")).where("donor is not null")
