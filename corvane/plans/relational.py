"""Scope joins, filtered outer joins, semi and anti joins, dashboards and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import geometry
from corvane.operators import joins
from corvane.plans.registry import query, table


@query("scope_join", """
SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, sum(l_extendedprice::DECIMAL(12, 2) * (1 - l_discount::DECIMAL(4, 2)))::DOUBLE AS revenue
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1""")
def scope_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations, their documents and blocks, as customers, orders and lines.

    Lines are summed by order before the joins: one shuffle of the large table by its own key.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("r"))
    people = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(people, F.col("o_custkey") == F.col("c_custkey"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("c_custkey").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"), F.sum("r").cast("double").alias("revenue"))


@query("anti_scope", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def anti_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("semi_scope", """
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')""")
def semi_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "lineitem").where("l_quantity >= 49 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(hit, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("left_filtered", """
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'""")
def left_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition stands in the join, so customers without such orders stay."""
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(held, "c_custkey", "left")


@query("pending_embeddings", """
SELECT doc_id, text = '' AS blank FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL""")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without a vector yet."""
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(have, "doc_id", "left_anti").select("doc_id", (F.col("text") == "").alias("blank"))


@query("dashboard_agg", """
SELECT n_name, count(c_custkey) AS customers, string_agg(c_name, ' | ' ORDER BY c_acctbal, c_name) FILTER (c_acctbal > 8000) AS rich, list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal > 0)) AS segments, max(c_acctbal) AS top
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def dashboard_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, an ordered list of names under a filter, and a set of structures, by group."""
    people = table(spark, sf_dir, "customer")
    joined = table(spark, sf_dir, "nation").join(people, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rich = F.array_sort(F.collect_list(F.when(F.col("c_acctbal") > 8000, F.struct("c_acctbal", "c_name"))))
    names = F.nullif(F.array_join(F.transform(rich, lambda x: x["c_name"]), " | "), F.lit(""))
    sets = F.array_sort(F.collect_set(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))))
    return joined.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), names.alias("rich"), F.when(F.size(sets) > 0, sets).alias("segments"), F.max("c_acctbal").alias("top"))


@query("filtered_counts", """
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 200000) AS large, greatest(0, count(*) - count(*) FILTER (o_orderstatus = 'F')) AS open FROM orders GROUP BY 1""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), done.alias("finished"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.greatest(F.lit(0), F.count("*") - done).alias("open"))


@query("full_outer_merge", """
SELECT coalesce(l.doc_id, e.vec_id) AS id, l.toxic, e.label, list_sort([x FOR x IN [CASE WHEN l.doc_id IS NOT NULL THEN 'labels' END, CASE WHEN e.vec_id IS NOT NULL THEN 'vectors' END] IF x IS NOT NULL]) AS sources
FROM labels l FULL OUTER JOIN embeddings e ON l.doc_id = e.vec_id""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic", F.lit("labels").alias("a"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.lit("vectors").alias("b"))
    return labels.join(vectors, "id", "full_outer").select("id", "toxic", "label", F.array_sort(F.array_compact(F.array("a", "b"))).alias("sources"))


@query("set_difference", """
SELECT text FROM (SELECT DISTINCT text FROM conversations WHERE role = 'user') EXCEPT SELECT text FROM conversations WHERE role = 'assistant'""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return said.where("role = 'user'").select("text").subtract(said.where("role = 'assistant'").select("text"))


@query("ordered_union", """
SELECT conv_id, list_sort(list_distinct(list_concat(a, b))) AS ids, len(list_distinct(list_concat(a, b)))::INTEGER AS n FROM (
  SELECT conv_id, coalesce(list(turn) FILTER (role = 'user'), []) AS a, coalesce(list(turn + 1) FILTER (role <> 'system'), []) AS b FROM conversations GROUP BY 1)""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two id lists of a group, each id once."""
    of = lambda role, value: F.collect_set(F.when(role, value))
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of(F.col("role") == "user", F.col("turn")).alias("a"), of(F.col("role") != "system", F.col("turn") + 1).alias("b"))
    ids = F.array_sort(F.array_union("a", "b"))
    return said.select("conv_id", ids.alias("ids"), F.size(ids).alias("n"))


@query("range_containment", """
SELECT o_orderkey, count(*) AS events_inside FROM orders JOIN events ON events.event_id BETWEEN o_orderkey * 3 AND o_orderkey * 3 + 5 GROUP BY 1""")
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in intervals by buckets of an interval's width: an equi join instead of all pairs."""
    spans = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 3).alias("low"), (F.col("o_orderkey") * 3 + 5).alias("high"))
    points = table(spark, sf_dir, "events").select(F.col("event_id").alias("point"))
    return joins.points_in_intervals(points, spans, "point", "low", "high", 8).groupBy("o_orderkey").agg(F.count("*").alias("events_inside"))


@query("interval_overlap", """
SELECT a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM orders a JOIN orders b ON a.o_orderkey < b.o_orderkey AND a.o_custkey = b.o_custkey AND NOT (a.o_orderkey + 200 < b.o_orderkey OR a.o_orderkey > b.o_orderkey + 200)""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans of one owner, by shared buckets; each pair once."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("low"), (F.col("o_orderkey") + 200).alias("high"))
    return joins.overlapping_pairs(o, ["o_custkey"], "o_orderkey", "low", "high", 256)


_BOXES = "SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, l_quantity * 7.0 AS x0, l_discount * 3000.0 AS y0, l_quantity * 7.0 + 12 + l_linenumber AS x1, l_discount * 3000.0 + 8 + l_tax * 100 AS y1, l_returnflag AS f FROM lineitem"


@query("box_overlap_join", f"""
WITH b AS ({_BOXES}),
p AS (SELECT l.page, l.id AS left_id, r.id AS right_id, round((least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)), 6) AS overlap FROM b l JOIN b r ON l.page = r.page AND l.f = 'R' AND r.f = 'A' AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1)
SELECT page, left_id, arg_min(right_id, (-overlap, right_id)) AS best, count(*) AS n, round(max(overlap), 4) AS overlap FROM p GROUP BY 1, 2""")
def box_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and the regions of their page that they overlap most: lines that came back against those accepted."""
    q, d = F.col("l_quantity") * 7.0, F.col("l_discount") * 3000.0
    box = F.array(q, d, q + 12 + F.col("l_linenumber"), d + 8 + F.col("l_tax") * 100)
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), box.alias("box"), "l_returnflag")
    pairs = joins.overlapping_boxes(boxes.where("l_returnflag = 'R'"), boxes.where("l_returnflag = 'A'"), ["page"], 20.0).withColumn("overlap", F.round("overlap", 6))
    counts = pairs.groupBy("page", "left_id").agg(F.count("*").alias("n"))
    return joins.best_overlap(pairs, ["page"]).join(counts, ["page", "left_id"]).select("page", "left_id", F.col("right_id").alias("best"), "n", F.round("overlap", 4).alias("overlap"))


@query("nearest_box_join", """
WITH a AS (SELECT l_orderkey AS page, l_linenumber AS n, l_quantity AS x, l_discount * 100 AS y FROM lineitem),
p AS (SELECT a.page, a.n, b.n AS near, abs(a.x - b.x) + abs(a.y - b.y) AS d FROM a JOIN a b ON a.page = b.page AND a.n <> b.n)
SELECT page, n, min_by(near, (round(d, 6), near)) AS nearest FROM p GROUP BY page, n""")
def nearest_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other box of a page by L1 distance of centres; the first of equals."""
    n, q, d = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_discount") * 100
    # Numbers, not arrays, are what the join sorts and holds.
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("n"), q.alias("x"), d.alias("y"))
    pairs = boxes.join(boxes.toDF("page", "near", "x2", "y2"), "page").where("n <> near")
    box = lambda x, y: F.array(x, y, x, y)
    distance = F.round(geometry.center_distance(box("x", "y"), box("x2", "y2")), 6)
    return pairs.select("page", "n", "near", distance.alias("d")).groupBy("page", "n").agg(F.min_by("near", F.struct("d", "near")).alias("nearest"))


@query("prefix_match_join", """
SELECT n.n_nationkey, min(c.c_custkey) AS first_customer FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND starts_with(lower(c.c_name), lower('CUSTOMER#00000' || n.n_nationkey % 2)) GROUP BY 1""")
def prefix_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions by label: equal unit, text starts with the label, the first in order."""
    labels = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("CUSTOMER#00000"), (F.col("n_nationkey") % 2).cast("string")).alias("label"))
    people = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    met = labels.join(people, (F.col("n_nationkey") == F.col("c_nationkey")) & F.startswith(F.lower("c_name"), F.lower("label")), "left")
    return met.groupBy("n_nationkey").agg(F.min("c_custkey").alias("first_customer"))


@query("path_or_name_join", """
SELECT p_partkey, coalesce(a.s_suppkey, b.s_suppkey) AS linked FROM part LEFT JOIN supplier a ON a.s_suppkey = p_partkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) b ON b.s_nationkey = p_size""")
def path_or_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Either key links: two equi joins and coalesce instead of an OR in the condition."""
    s = table(spark, sf_dir, "supplier")
    by_path = s.select(F.col("s_suppkey").cast("long").alias("p_partkey"), F.col("s_suppkey").alias("x"))
    by_name = s.groupBy(F.col("s_nationkey").alias("p_size")).agg(F.min("s_suppkey").alias("y"))
    return table(spark, sf_dir, "part").join(by_path, "p_partkey", "left").join(by_name, "p_size", "left").select("p_partkey", F.coalesce("x", "y").alias("linked"))


@query("null_order_sort", """
SELECT doc_id, (row_number() OVER (ORDER BY t ASC NULLS LAST, doc_id))::INTEGER AS pos FROM (SELECT d.doc_id, l.quality AS t FROM documents d LEFT JOIN labels l USING (doc_id))""")
def null_order_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions under an order that says where nulls go, without one task for all rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("t")), "doc_id", "left")
    return joins.positions(rows, [F.asc_nulls_last("t"), F.asc("doc_id")], "pos").select("doc_id", "pos")


@query("region_rollup", """
SELECT r_name, n_name, count(*) AS suppliers, round(avg(s_acctbal), 4) AS mean, round(median(s_acctbal), 4) AS median, round(stddev_samp(s_acctbal), 4) AS spread
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    b = F.col("s_acctbal")
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.avg(b), 4).alias("mean"), F.round(F.percentile(b, 0.5), 4).alias("median"), F.round(F.stddev_samp(b), 4).alias("spread"))
