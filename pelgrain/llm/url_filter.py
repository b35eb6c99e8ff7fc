"""URL filtering against dated lists: a temporal join of captures with entries active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAST_DAY = 2_932_896  # 9999-12-31, as days since 1970-01-01


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dots; empty where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]*)", 1)
    return F.coalesce(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains; none for an empty host."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (domain, day, action add|remove, category) -> intervals (domain, category, from_day, to_day), to_day exclusive.

    An entry holds until the next one of its domain and category. Of several on one day a removal
    wins; repeated entries count once. Rows with null domain, day or an unknown action are void.
    """
    good = entries.where(F.col("domain").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    one = good.groupBy("domain", F.coalesce("category", F.lit("")).alias("category"), "day").agg(F.max("action").alias("action"))
    nxt = F.lead("day").over(W.partitionBy("domain", "category").orderBy("day"))
    spans = one.select("domain", "category", "action", F.col("day").alias("from_day"), F.coalesce(nxt, F.lit(LAST_DAY)).cast("int").alias("to_day"))
    return spans.where("action = 'add'").drop("action")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, host, day) -> page_id, host, day, n_active, domain, category, blocked.

    A capture is blocked if an entry for its host or a parent domain is active on its day;
    domain and category are those of the longest domain, then the first category. Hosts repeat, a
    hot one in a third of all captures, so the join runs on distinct (host, day) pairs and its
    verdicts are joined back; AQE splits hot pairs. Null or odd URLs have the host '' and pass; a
    null day matches nothing.
    """
    pairs = captures.select("host", "day").where("host <> '' and day is not null").distinct()
    keys = pairs.select("host", "day", F.explode(suffixes(F.col("host"))).alias("domain"))
    live = keys.join(validity(entries), "domain").where("from_day <= day and day < to_day")
    best = F.min(F.struct((-F.length("domain")).alias("l"), "domain", "category"))
    verdicts = live.groupBy("host", "day").agg(F.count("*").alias("n_active"), best.alias("b")).select("host", "day", "n_active", "b.domain", "b.category")
    out = captures.join(verdicts, ["host", "day"], "left")
    return out.select("page_id", "host", "day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "domain", "category", F.col("n_active").isNotNull().alias("blocked"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch time; it is set by rule: day page_id mod 366 of 2024 (null id: null)."""
    return pages.select("page_id", host_of(F.col("url")).alias("host"), (F.pmod(F.col("page_id"), F.lit(366)) + 19723).cast("int").alias("day"))


def entries_of(captures: DataFrame) -> DataFrame:
    """Dated list for the table at hand, by rule from its hosts: an MD5 decides who is listed, when, and when no more.

    One host in four by its own name, one parent domain in eight; each is added, may be removed and
    added again.
    """
    hosts = captures.select("host").where("host <> ''").distinct()
    named = hosts.select(F.col("host").alias("domain"), F.lit(4).alias("odds"), F.lit("host").alias("category"))
    parents = hosts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("domain"), F.lit(8).alias("odds"), F.lit("domain").alias("category")).distinct()
    digit = lambda i, n: F.conv(F.substring("m", i, n), 16, 10).cast("int")
    m = named.unionAll(parents).withColumn("m", F.md5(F.concat("category", F.lit(":"), "domain").cast("binary"))).where(F.pmod(digit(1, 4), F.col("odds")) == 0)
    start, kept, gap = F.pmod(digit(5, 4), F.lit(300)) + 19723, F.pmod(digit(9, 4), F.lit(90)) + 1, F.pmod(digit(13, 4), F.lit(60)) + 1
    steps = F.array(
        F.struct(start.alias("day"), F.lit("add").alias("action")),
        F.struct((start + kept).alias("day"), F.lit("remove").alias("action")),
        F.struct((start + kept + gap).alias("day"), F.lit("add").alias("action")),
    )
    return m.select("domain", "category", F.inline(steps))


ORACLE = """
WITH c AS (
  SELECT page_id, coalesce(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]*)', 1), '\\.+$', ''), '') AS host,
         CAST(page_id % 366 + 19723 AS INT) AS day FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host <> ''),
named AS (SELECT host AS domain, 4 AS odds, 'host' AS category FROM h
          UNION ALL SELECT DISTINCT regexp_replace(host, '^[^.]*\\.', ''), 8, 'domain' FROM h),
m AS (SELECT *, md5(category || ':' || domain) AS m FROM named),
d AS (SELECT *, CAST('0x' || m[1:4] AS INT) AS d1, CAST('0x' || m[5:8] AS INT) % 300 + 19723 AS s, CAST('0x' || m[9:12] AS INT) % 90 + 1 AS k, CAST('0x' || m[13:16] AS INT) % 60 + 1 AS g FROM m),
iv AS (SELECT domain, category, s AS from_day, s + k AS to_day FROM d WHERE d1 % odds = 0
       UNION ALL SELECT domain, category, s + k + g, 2932896 FROM d WHERE d1 % odds = 0),
p AS (SELECT DISTINCT host, day FROM c WHERE host <> '' AND day IS NOT NULL),
live AS (SELECT p.host, p.day, iv.domain, iv.category, row_number() OVER (PARTITION BY p.host, p.day ORDER BY length(iv.domain) DESC, iv.domain, iv.category) AS rn,
         count(*) OVER (PARTITION BY p.host, p.day) AS n FROM p JOIN iv ON (p.host = iv.domain OR ends_with(p.host, '.' || iv.domain)) AND from_day <= day AND day < to_day)
SELECT c.page_id, c.host, c.day, CAST(coalesce(l.n, 0) AS BIGINT) AS n_active, l.domain, l.category, l.n IS NOT NULL AS blocked
FROM c LEFT JOIN live l ON l.host = c.host AND l.day = c.day AND l.rn = 1
"""
