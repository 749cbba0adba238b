"""The test tables read as an investigated world: accounts, transfers, contacts, shipments, assessments.

Each view is a function of (spark, folder) and, in CTES, the same in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.sources.tables import table

#: Order within an order's lines, which aren't unique by number.
LINES = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*LINES)
    lines = table(spark, folder, "lineitem").select("l_orderkey", *LINES, "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return lines.withColumn("r", F.row_number().over(order)).withColumn("dst", F.lead("l_suppkey").over(order)).withColumn("edge_id", F.col("l_orderkey") * 1000 + F.col("r"))


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """Money moved between accounts: ``edge_id, src, dst, amount, ts``; parallel edges and self-transfers stay."""
    return numbered_lines(spark, folder).where("dst is not null").select("edge_id", F.col("l_suppkey").alias("src"), "dst", F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("ts"))


def nations(spark: SparkSession, folder: str) -> DataFrame:
    region = table(spark, folder, "region")
    nation = table(spark, folder, "nation")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """``ref, name, nation, country, region, balance, lat, lng, band``; the band is null (unassessed) for a few."""
    rows = table(spark, folder, "supplier").join(nations(spark, folder), F.col("s_nationkey") == F.col("nation"))
    band = F.when(F.col("s_suppkey") % 7 == 3, None).when(F.col("s_acctbal") >= 8000, "elevated").when(F.col("s_acctbal") >= 5000, "notable").otherwise("routine")
    return rows.select(
        F.col("s_suppkey").alias("ref"), F.col("s_name").alias("name"), "nation", "country", "region", F.col("s_acctbal").alias("balance"),
        ((F.col("s_suppkey") * 37) % 120 - 60).cast("double").alias("lat"), ((F.col("s_suppkey") * 91) % 340 - 170).cast("double").alias("lng"), band.alias("band"),
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id, ref, lane, ts, value``: what each user did and when."""
    return table(spark, folder, "events").select("event_id", F.col("user_id").alias("ref"), F.col("event_type").alias("lane"), "ts", "value", "props")


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """``contact_id, a, b, ts``: users that follow each other in a lane within an hour."""
    order = Window.partitionBy("lane", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return activity(spark, folder).withColumn("b", F.lead("ref").over(order)).where("b is not null").select(F.col("event_id").alias("contact_id"), F.col("ref").alias("a"), "b", "ts")


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """``shipment_id, origin, destination, detour, flagged, ts``; regions, a ratio, and a flag that may be null."""
    lines = numbered_lines(spark, folder)
    where = nations(spark, folder)
    supplier = table(spark, folder, "supplier").join(where, F.col("s_nationkey") == F.col("nation")).select("s_suppkey", F.col("region").alias("origin"))
    customer = table(spark, folder, "customer").join(where, F.col("c_nationkey") == F.col("nation")).select("c_custkey", F.col("region").alias("destination"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    flagged = F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_returnflag") == "R")
    return rows.select(F.col("edge_id").alias("shipment_id"), "origin", "destination", (1 + F.col("l_tax") * 20).alias("detour"), flagged.alias("flagged"), F.col("l_shipdate").alias("ts"))


def assessments(spark: SparkSession, folder: str) -> DataFrame:
    """An append-only ledger: ``id, subject, run, computed_at, score, coverage, band, state``."""
    score = (F.col("o_totalprice") % 100).alias("score")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.col("o_orderdate").alias("computed_at"),
        F.round(score, 2).alias("score"), ((F.col("o_orderkey") % 20) / 20).alias("coverage"), F.col("o_orderstatus").alias("state"),
    )
    band = F.when(F.col("coverage") < 0.25, "insufficient").when((F.col("score") >= 60) & (F.col("coverage") >= 0.4), "elevated").when(F.col("score") >= 30, "notable").otherwise("routine")
    return rows.withColumn("band", band)


CTES = {
    "numbered": """numbered AS (SELECT l_orderkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus,
  row_number() OVER w AS r, lead(l_suppkey) OVER w AS dst, l_orderkey * 1000 + row_number() OVER w AS edge_id FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate))""",
    "transfers": "transfers AS (SELECT edge_id, l_suppkey AS src, dst, l_extendedprice AS amount, l_shipdate AS ts FROM numbered WHERE dst IS NOT NULL)",
    "nations": "nations AS (SELECT n_nationkey AS nation, n_name AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "accounts": """accounts AS (SELECT s_suppkey AS ref, s_name AS name, nation, country, region, s_acctbal AS balance,
  CAST((s_suppkey * 37) % 120 - 60 AS DOUBLE) AS lat, CAST((s_suppkey * 91) % 340 - 170 AS DOUBLE) AS lng,
  CASE WHEN s_suppkey % 7 = 3 THEN NULL WHEN s_acctbal >= 8000 THEN 'elevated' WHEN s_acctbal >= 5000 THEN 'notable' ELSE 'routine' END AS band
  FROM supplier JOIN nations ON s_nationkey = nation)""",
    "activity": "activity AS (SELECT event_id, user_id AS ref, event_type AS lane, ts, value, props FROM events)",
    "contacts": """contacts AS (SELECT event_id AS contact_id, ref AS a, b, ts FROM (SELECT *, lead(ref) OVER (PARTITION BY lane, date_trunc('hour', ts) ORDER BY ts, event_id) AS b FROM activity)
  WHERE b IS NOT NULL)""",
    "shipments": """shipments AS (SELECT edge_id AS shipment_id, a.region AS origin, b.region AS destination, 1 + l_tax * 20 AS detour,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'R' END AS flagged, l_shipdate AS ts
  FROM numbered JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nations b ON c_nationkey = b.nation
  JOIN supplier ON l_suppkey = s_suppkey JOIN nations a ON s_nationkey = a.nation)""",
    "assessments": """assessments AS (SELECT *, CASE WHEN coverage < 0.25 THEN 'insufficient' WHEN score >= 60 AND coverage >= 0.4 THEN 'elevated' WHEN score >= 30 THEN 'notable' ELSE 'routine' END AS band
  FROM (SELECT o_orderkey AS id, o_custkey AS subject, strftime(o_orderdate, '%Y-%m') AS run, o_orderdate AS computed_at, round(o_totalprice % 100, 2) AS score,
  (o_orderkey % 20) / 20 AS coverage, o_orderstatus AS state FROM orders))""",
}
NEEDS = {"transfers": ("numbered",), "accounts": ("nations",), "contacts": ("activity",), "shipments": ("numbered", "nations")}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views (and those they need) in front; it may begin with CTEs of its own after ``WITH``."""
    names: list[str] = []
    for view in views.split():
        names += [n for n in (*NEEDS.get(view, ()), view) if n not in names]
    head = ",\n".join(CTES[n] for n in names)
    body = body.strip()
    rest = f",\n{body[4:].lstrip()}" if body.upper().startswith("WITH") else f"\n{body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{rest}"
