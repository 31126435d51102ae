"""URL filters as a temporal list join (DataFrame functions only).

Dated list entries (pattern, action, date) become validity intervals: an entry holds from its date
until the next entry of its pattern. Every capture is then joined, as of its fetch time, with the
entries of its host and parent domains; the most specific active entry decides.

Defined edge cases
  * null, blank or host-less URLs, null fetch times: no entry applies, the capture is kept
  * entries of one pattern and date: block outranks allow, allow outranks remove
  * a ``remove`` entry ends the listing; null patterns, dates and other actions are no entries
  * repeated rows are judged each; an empty table gives an empty result; extra columns are carried
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefeat.llm.storage import bounded_broadcast, cut

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)"
#: Intervals are broadcast up to this count (about 60 bytes each).
MAX_BROADCAST_INTERVALS = 200_000
RANKS = {"remove": 0, "allow": 1, "block": 2}


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 2)), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains, down to two labels (or the host alone)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, valid_from, valid_to`` (null: still open) of entries that list something."""
    rank = F.coalesce(*[F.when(F.col("action") == a, F.lit(r)) for a, r in RANKS.items()])
    dated = entries.select(F.lower("pattern").alias("pattern"), rank.alias("rank"), F.col("entry_date").cast("timestamp").alias("valid_from"))
    daily = dated.where(F.col("pattern").isNotNull() & F.col("rank").isNotNull() & F.col("valid_from").isNotNull()).groupBy("pattern", "valid_from").agg(F.max("rank").alias("rank"))
    ends = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    return daily.withColumn("valid_to", ends).where(F.col("rank") > 0).select("pattern", F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"), "valid_from", "valid_to")


def judge_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (``url``, ``fetched_at`` and any other columns, as struct ``row``) with ``host,
    matched_pattern, matched_action`` and ``kept``."""
    intervals = bounded_broadcast(cut(validity_intervals(entries), "intervals"), MAX_BROADCAST_INTERVALS)
    asked = captures.select(F.monotonically_increasing_id().alias("capture"), host_of(F.col("url")).alias("host"), F.col("fetched_at").cast("timestamp").alias("at"), F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"))
    asked = asked.withColumn("domain", F.explode_outer(domains_of(F.col("host"))))
    active = (F.col("domain") == F.col("pattern")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    matched = asked.join(intervals, active, "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), "pattern", "action")))
    judged = matched.groupBy("capture").agg(F.first("row").alias("row"), F.first("host").alias("host"), best.alias("best"))
    return judged.select("row", "host", F.col("best.pattern").alias("matched_pattern"), F.col("best.action").alias("matched_action"), F.coalesce(F.col("best.action") != "block", F.lit(True)).alias("kept"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures that no entry active at their fetch time blocks."""
    return judge_urls(captures, entries).where("kept").select("row.*")


def demo_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times: they are taken from page_id, over 2024 and 2025."""
    at = F.lit(1704067200) + F.pmod(F.col("page_id") * 3607, F.lit(63158400))
    return pages.select("page_id", "url", F.timestamp_seconds(at).alias("fetched_at"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """Three dated entries for every host and parent domain of the pages, from digits of an md5."""
    domains = pages.select(F.explode(domains_of(host_of(F.col("url")))).alias("pattern")).distinct()
    rounds = domains.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    code = F.md5(F.concat("pattern", F.lit(":"), F.col("k").cast("string")))
    days = F.conv(F.substring(code, 1, 2), 16, 10).cast("int") * 3
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), F.conv(F.substring(code, 3, 2), 16, 10).cast("int") % 3 + 1)
    return rounds.select("pattern", action.alias("action"), F.date_add(F.lit("2023-10-01").cast("date"), days).alias("entry_date"))


ORACLE_SQL = r"""
WITH c AS (
  SELECT page_id, url, 1704067200 + (page_id * 3607) % 63158400 AS fetched,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)', 2)), '') AS host
  FROM pages
), d AS (
  SELECT page_id, url, fetched, host, unnest(list_transform(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1)),
         lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS domain
  FROM c WHERE host IS NOT NULL
), e AS (
  SELECT pattern, md5(pattern || ':' || k) AS code FROM (SELECT DISTINCT domain AS pattern FROM d), (VALUES ('0'), ('1'), ('2')) t(k)
), n AS (
  SELECT pattern, epoch(DATE '2023-10-01') + ('0x' || substr(code, 1, 2))::BIGINT * 3 * 86400 AS valid_from,
         2 - ('0x' || substr(code, 3, 2))::BIGINT % 3 AS rank
  FROM e
), g AS (
  SELECT pattern, valid_from, max(rank) AS rank FROM n GROUP BY ALL
), v AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM g
), m AS (
  SELECT d.page_id, v.pattern, v.rank, row_number() OVER (PARTITION BY d.page_id ORDER BY length(v.pattern) DESC, v.pattern DESC) AS place
  FROM d JOIN v ON d.domain = v.pattern AND v.rank > 0 AND d.fetched >= v.valid_from AND (v.valid_to IS NULL OR d.fetched < v.valid_to)
)
SELECT c.page_id, c.host, m.pattern AS matched_pattern, CASE m.rank WHEN 2 THEN 'block' WHEN 1 THEN 'allow' END AS matched_action,
       coalesce(m.rank <> 2, true) AS kept
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.place = 1
"""
