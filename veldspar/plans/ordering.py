"""Queries on places in an order, positions and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, metrics, order
from .registry import Tables, query


def _padded(prefix: str, place: str, digits: int):
    """A sequential id; as in the SQL, places of more digits lose their first ones."""
    return F.concat(F.lit(prefix), F.right(F.concat(F.lit("0" * digits), F.col(place).cast("string")), F.lit(digits)))


@query("""SELECT concat('TXT-', right(concat('0000', CAST(k AS VARCHAR)), 4)) AS cluster_id, first_id, size FROM (SELECT row_number() OVER (ORDER BY first_id) AS k, first_id, size FROM (SELECT min(doc_id) AS first_id, count(*) AS size FROM documents GROUP BY sha256(text) HAVING count(*) > 1) x) y""")
def numbered_clusters(t: Tables) -> DataFrame:
    """Groups of equal texts, numbered by their first id."""
    groups = t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size")).where("size > 1")
    return order.numbered(groups.select("first_id", "size"), "first_id").select(_padded("TXT-", "k", 4).alias("cluster_id"), "first_id", "size")


@query("SELECT concat('NAT-', right(concat('000', CAST(row_number() OVER (ORDER BY n_name) AS VARCHAR)), 3)) AS id, n_name FROM nation")
def sequential_ids(t: Tables) -> DataFrame:
    return order.numbered(t.nation.select("n_name"), "n_name").select(_padded("NAT-", "k", 3).alias("id"), "n_name")


@query("SELECT n_name, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) % 4 AS INT) AS slot FROM nation")
def cyclic_assignment(t: Tables) -> DataFrame:
    return order.numbered(t.nation.select("n_name", "n_nationkey"), "n_nationkey").select("n_name", ((F.col("k") - 1) % 4).cast("int").alias("slot"))


@query("""SELECT a.r_name, b.n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) a JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation) b ON a.k = b.k""")
def join_positional(t: Tables) -> DataFrame:
    return order.joined_by_place(t.region.select("r_name", "r_regionkey"), t.nation.select("n_name"), ["r_regionkey"], ["n_name"]).select("r_name", "n_name")


@query("""SELECT o_orderkey, concat('ORD-', right(concat('0000000000', CAST(k AS VARCHAR)), 10)) AS id, CAST((k - 1) % 7 AS INT) AS slot FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) x""")
def order_places(t: Tables) -> DataFrame:
    """All orders, latest first, with a sequential id and a reviewer in turn; most of them are ties of the date."""
    own = order.numbered(t.orders.select("o_orderkey", "o_orderdate"), F.desc("o_orderdate"), "o_orderkey")
    return own.select("o_orderkey", _padded("ORD-", "k", 10).alias("id"), ((F.col("k") - 1) % 7).cast("int").alias("slot"))


@query("""SELECT a.doc_id, b.o_orderkey FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS k FROM documents) a LEFT JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM orders) b ON a.k = b.k""")
def documents_beside_orders(t: Tables) -> DataFrame:
    """The shortest document beside the cheapest order, and so on; documents beyond the last order stand alone."""
    return order.joined_by_place(t.documents.select("doc_id", "n_chars"), t.orders.select("o_orderkey", "o_totalprice"), ["n_chars", "doc_id"], ["o_totalprice", "o_orderkey"], "left").select("doc_id", "o_orderkey")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN value >= 50.0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END), 6) AS exceeds FROM events GROUP BY event_type")
def distribution(t: Tables) -> DataFrame:
    """Mean, deviation and exact percentiles of each kind of event; few kinds, so many rows a kind."""
    own = t.events.select("event_type", "value")
    sums = own.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.avg(F.when(F.col("value") >= 50.0, 1.0).otherwise(0.0)).alias("exceeds"))
    ends = order.percentiles(own, "event_type", "value", {"p05": 0.05, "p95": 0.95})
    return sums.join(ends, "event_type", "left").select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "p05", "p95", "exceeds")))


@query("SELECT l_suppkey % 10 AS bin, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY 1")
def price_percentiles(t: Tables) -> DataFrame:
    """Medians and extremes of prices; ranges of more than 2,000 values are cut further."""
    got = order.percentiles(t.lineitem.select((F.col("l_suppkey") % 10).alias("bin"), F.col("l_extendedprice").cast("double").alias("v")), "bin", "v", {"median": 0.5, "p999": 0.999}, at_once=2_000)
    return got.select("bin", F.round("median", 6).alias("median"), F.round("p999", 6).alias("p999"))


@query("""SELECT source, n_chars AS longest, doc_id FROM (SELECT source, n_chars, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) x WHERE rn = 1""")
def longest_of_each(t: Tables) -> DataFrame:
    """Each source's longest document, of equally long ones that of the smallest id."""
    return dedup.canonical(t.documents.select("source", "n_chars", "doc_id"), "source", -F.col("n_chars"), "doc_id").select("source", F.col("n_chars").alias("longest"), "doc_id")


@query("SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS mean_discount FROM lineitem GROUP BY l_returnflag")
def weighted_mean(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(metrics.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 8).alias("mean_discount"))


@query("SELECT d.source, count(*) AS n, round(avg(CAST(l.toxic AS DOUBLE)), 8) AS share FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source HAVING count(*) >= 5")
def share_having(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "toxic"), "doc_id")
    return metrics.shares(own, "source", F.col("toxic") == 1, 5).select("source", "n", F.round("share", 8).alias("share"))


@query("""SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS place FROM orders) x WHERE place <= 100""")
def priority_queue(t: Tables) -> DataFrame:
    """The first hundred orders by priority and date: each task keeps a hundred, and those are numbered."""
    first = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    top = t.orders.select("o_orderkey", "o_orderdate", first.alias("p")).orderBy("p", "o_orderdate", "o_orderkey").limit(100)
    return order.numbered(top, "p", "o_orderdate", "o_orderkey", name="place").select("o_orderkey", "place")
