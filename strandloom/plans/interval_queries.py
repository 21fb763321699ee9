"""Interval queries over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..sources.readers import coding_exons
from ..sources.writers import track_rows
from .inputs import DAY, SECONDS, day, seconds, table

HOUR = 3600


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour from each event of a user, merged where they touch or overlap."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", seconds("ts").alias("start"), (seconds("ts") + HOUR).alias("stop"))
    return I.merge(rows, ["user_id"], label="event_id", tie="event_id", width=30 * 24 * HOUR)


INTERVAL_MERGE = f"""
WITH iv AS (SELECT user_id, event_id, {SECONDS.format("ts")} AS start, {SECONDS.format("ts")} + {HOUR} AS stop FROM events),
a AS (SELECT *, max(stop) OVER w AS reach, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS place FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT user_id, min(start) AS start, max(stop) AS stop, count(*) AS n_merged, arg_max(event_id, place) AS event_id FROM b GROUP BY user_id, island
"""


def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive days on which a supplier ships."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", day("l_shipdate").alias("pos"))
    return I.islands(rows, ["l_suppkey"], width=366)


INTERVAL_ISLANDS = f"""
WITH d AS (SELECT DISTINCT l_suppkey, {DAY.format("l_shipdate")} AS pos FROM lineitem),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY l_suppkey ORDER BY pos) AS run FROM d)
SELECT l_suppkey, min(pos) AS start, max(pos) AS stop, count(*) AS length FROM r GROUP BY l_suppkey, run
"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from an order's first to its last shipment, with its items."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), day("l_shipdate").alias("d"))
    return items.groupBy("o_orderkey").agg(F.min("d").alias("start"), F.max("d").alias("stop"), F.count(F.lit(1)).alias("items"))


SPANS = f"SELECT l_orderkey AS o_orderkey, min({DAY.format('l_shipdate')}) AS start, max({DAY.format('l_shipdate')}) AS stop, count(*) AS items FROM lineitem GROUP BY l_orderkey"


def coverage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of orders in shipment on every day of the targets (the quarters' first weeks), by status, 0 where none."""
    spans = _spans(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sample")), "o_orderkey").withColumn("k", F.lit(0))
    bounds = table(spark, sf_dir, "orders").select(day("o_orderdate").alias("d"))
    targets = bounds.select((F.floor(F.col("d") / 91) * 91).cast("int").alias("start")).distinct().withColumn("stop", F.col("start") + 6).withColumn("k", F.lit(0))
    return I.coverage(spans, targets, spans, "items", ["k"], "sample", width=91).select("sample", "pos", "covered")


COVERAGE_BY_DAY = f"""
WITH s AS ({SPANS}), t AS (SELECT s.*, o.o_orderstatus AS sample FROM s JOIN orders o ON s.o_orderkey = o.o_orderkey),
g AS (SELECT DISTINCT CAST(floor({DAY.format("o_orderdate")} / 91.0) * 91 AS INTEGER) AS start FROM orders),
p AS (SELECT DISTINCT unnest(range(start, start + 7)) AS pos FROM g),
c AS (SELECT sample, pos, sum(items) AS covered FROM (SELECT sample, items, unnest(range(start, stop + 1)) AS pos FROM t) GROUP BY sample, pos)
SELECT x.sample, p.pos, coalesce(c.covered, 0) AS covered FROM (SELECT DISTINCT sample FROM t) x CROSS JOIN p LEFT JOIN c ON c.sample = x.sample AND c.pos = p.pos
"""


def point_in_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the hours after that user's purchases: how many of each kind, in intervals of six hours."""
    events = table(spark, sf_dir, "events")
    points = events.select("user_id", "event_type", seconds("ts").alias("pos"))
    intervals = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("of"), seconds("ts").alias("start"), (seconds("ts") + 6 * HOUR).alias("stop"))
    return I.point_join(points, intervals, ["user_id"], 6 * HOUR).groupBy("of", "event_type").agg(F.count(F.lit(1)).alias("n"))


POINT_JOIN = f"""
WITH p AS (SELECT user_id, event_id, event_type, {SECONDS.format("ts")} AS pos FROM events)
SELECT i.event_id AS of, p.event_type, count(*) AS n FROM p JOIN p i ON i.event_type = 'purchase' AND i.user_id = p.user_id AND p.pos BETWEEN i.pos AND i.pos + {6 * HOUR} GROUP BY i.event_id, p.event_type
"""


def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day from each view or click of a user, less the hours around that user's other events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds("ts").alias("at"))
    whole = events.filter("event_type IN ('view', 'click')").select("user_id", "event_id", F.col("at").alias("start"), (F.col("at") + 24 * HOUR).alias("stop"))
    holes = events.filter("event_type NOT IN ('view', 'click')").select("user_id", (F.col("at") - HOUR).alias("start"), (F.col("at") + HOUR).alias("stop"))
    return I.subtract(whole, holes, ["user_id"], 24 * HOUR)


INTERVAL_SUBTRACT = f"""
WITH e AS (SELECT user_id, event_id, event_type, {SECONDS.format("ts")} AS tm FROM events),
w AS (SELECT user_id, event_id, tm AS s, tm + {24 * HOUR} AS e FROM e WHERE event_type IN ('view', 'click')),
h AS (SELECT w.*, x.tm - {HOUR} AS hs, x.tm + {HOUR} AS he FROM w JOIN e x ON x.user_id = w.user_id AND x.event_type NOT IN ('view', 'click') AND x.tm - {HOUR} <= w.e AND x.tm + {HOUR} >= w.s),
a AS (SELECT *, max(he) OVER (PARTITION BY event_id ORDER BY hs, he ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR hs > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY hs, he ROWS UNBOUNDED PRECEDING) AS island FROM a),
m AS (SELECT user_id, event_id, s, e, min(hs) AS hs, max(he) AS he FROM b GROUP BY user_id, event_id, s, e, island),
l AS (SELECT *, lead(hs) OVER (PARTITION BY event_id ORDER BY hs) AS next, row_number() OVER (PARTITION BY event_id ORDER BY hs) AS place FROM m),
parts AS (SELECT user_id, event_id, s AS start, hs - 1 AS stop FROM l WHERE place = 1 UNION ALL SELECT user_id, event_id, he + 1, coalesce(next - 1, e) FROM l
  UNION ALL SELECT user_id, event_id, s, e FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.event_id = w.event_id))
SELECT * FROM parts WHERE start <= stop
"""


def track_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer and inner bounds of four arm ends, from the dates of an order's first two items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(day("l_shipdate")).alias("a"), F.max(day("l_shipdate")).alias("b"), F.min("l_partkey").cast("int").alias("c"), F.max("l_partkey").cast("int").alias("d"))
    ends = items.select(F.col("l_orderkey").alias("mip_key"), F.lit("1").alias("chr"), F.lit("+").alias("probe_strand"), *[F.col(x).alias(c) for x, c in zip("abcd", ("ext_probe_start", "ext_probe_stop", "lig_probe_start", "lig_probe_stop"))])
    return track_rows(ends).select(F.col("name").alias("l_orderkey"), "start", "thick_start", "thick_end", F.col("end").alias("end_"))


TRACK = f"""
WITH i AS (SELECT l_orderkey, min({DAY.format("l_shipdate")}) AS a, max({DAY.format("l_shipdate")}) AS b, min(l_partkey) AS c, max(l_partkey) AS d FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, list_sort([CAST(a AS BIGINT), CAST(b AS BIGINT), CAST(c AS BIGINT), CAST(d AS BIGINT)]) AS e FROM i)
SELECT l_orderkey, CAST(e[1] - 1 AS INTEGER) AS start, CAST(e[2] AS INTEGER) AS thick_start, CAST(e[3] - 1 AS INTEGER) AS thick_end, CAST(e[4] AS INTEGER) AS end_ FROM s
"""


def exon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of items per order as exons, clipped to the ninety days from the order's date."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", day("l_shipdate").alias("s"), F.col("l_quantity").cast("int").alias("q"))
    arrays = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "s", "q"))).alias("x"))
    genes = arrays.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("cds_start")), "l_orderkey").withColumn("cds_end", F.col("cds_start") + 90)
    named = genes.select("cds_start", "cds_end", F.transform("x", lambda v: v["s"]).alias("starts"), F.transform("x", lambda v: v["s"] + v["q"]).alias("ends"), F.col("l_orderkey").alias("chrom"), F.col("l_orderkey").alias("symbol"), F.lit("").alias("name"))
    return coding_exons(named, named.select("symbol")).select(F.col("chrom").alias("l_orderkey"), "start", "stop")


EXON_CLIP = f"""
WITH x AS (SELECT l_orderkey, {DAY.format("l_shipdate")} AS s, {DAY.format("l_shipdate")} + CAST(l_quantity AS INTEGER) AS e, {DAY.format("o_orderdate")} AS cs FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, CAST(greatest(s, cs) AS INTEGER) AS start, CAST(least(e, cs + 90) AS INTEGER) AS stop FROM x WHERE s > 0 AND cs <= e AND cs + 90 >= s
"""

QUERIES = {f.__name__: f for f in (interval_merge, interval_islands, coverage_by_day, point_in_interval_join, interval_subtract, track_coordinates, exon_clip)}
ORACLES = {"interval_merge": INTERVAL_MERGE, "interval_islands": INTERVAL_ISLANDS, "coverage_by_day": COVERAGE_BY_DAY, "point_in_interval_join": POINT_JOIN, "interval_subtract": INTERVAL_SUBTRACT, "track_coordinates": TRACK, "exon_clip": EXON_CLIP}
