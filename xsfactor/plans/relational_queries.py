"""Filters, joins, aggregates, set operations and universe construction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import shared_folder
from ..operators import portfolio as P
from ..operators import universe as U
from ..sources import files
from ..sources.panels import BD, SM, UE, brand_day, supplier_month, table, user_day
from ..streaming import bars as streams
from .catalog import query, r6, rounded
from .factor_queries import KEY, PRED, R, panel, predictions
from .portfolio_queries import SCORES, SERIES, N, bands, book

count = lambda: F.count(F.lit(1))
q_part = lambda s, d: table(s, d, "part")
RULES = [("steel", "metal"), ("copper", "metal"), ("brass", "metal"), ("small", "small"), ("large", "large"), ("1", "one"), ("2", "two")]

# Scans, projections, filters -----------------------------------------------------------------------------------------
query("s2_projection", "SELECT p_partkey, p_size FROM part WHERE p_size > 40")(lambda s, d: q_part(s, d).where("p_size > 40").select("p_partkey", "p_size"))
query("s4_head", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3")(lambda s, d: table(s, d, "region").orderBy("r_regionkey").limit(3))
query("s5_chunked_counts", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(count().alias("n"), F.sum("l_quantity").alias("q")))


@query("s7_newest", "SELECT o_orderpriority AS kind, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS path FROM orders GROUP BY 1")
def s7(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("path"), F.struct("o_orderdate", "o_orderkey").alias("modified"))
    return files.newest(f).select("kind", "path")


@query("s19_retention", "SELECT kind, path FROM (SELECT o_orderpriority AS kind, o_orderkey AS path, o_orderdate AS t, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n > 100 AND date_diff('day', CAST(t AS DATE), DATE '2001-12-31') > 365")
def s19(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    return files.to_archive(f, 100, 365, F.lit("2001-12-31").cast("date")).select("kind", "path")


query("s11_json_source", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")))
@query("s21_settings", "SELECT 'default' AS run, 'hysteresis' AS policy, count(DISTINCT l_suppkey) AS entities, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first, count(DISTINCT l_suppkey) // 5 AS top_n FROM lineitem", dates=())
def s21(s: SparkSession, d: str) -> DataFrame:
    """Settings that follow the panel are saved as a run's snapshot, and read back."""
    seen = table(s, d, "lineitem").agg(F.countDistinct("l_suppkey").alias("n"), F.min(F.to_date("l_shipdate")).cast("string").alias("first")).first()
    path = f"{shared_folder(s)}/settings-{uuid.uuid4().hex}"
    files.save(files.snapshot(s, {"policy": "hysteresis", "entities": seen["n"], "first": seen["first"], "top_n": seen["n"] // 5}, "default"), path, "json")
    back = s.read.schema("run string, settings string").json(path)
    return back.select("run", F.from_json("settings", "policy string, entities long, first string, top_n long").alias("x")).select("run", "x.*")


query("p2_coerce", "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS num, TRY_CAST(p_brand AS DOUBLE) AS none FROM part")(
    lambda s, d: q_part(s, d).select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("double").alias("num"), F.col("p_brand").try_cast("double").alias("none")))
query("p4_range", "SELECT p_partkey FROM part WHERE p_retailprice >= 950 AND p_size BETWEEN 10 AND 20")(lambda s, d: U.screen(q_part(s, d), {"p_retailprice": 950}, {"p_size": (10, 20)}).select("p_partkey"))
query("p5_name_exclude", "SELECT p_partkey FROM part WHERE NOT coalesce(p_type ILIKE '%EEL%', false)")(lambda s, d: U.screen(q_part(s, d), {}, without={"p_type": "eel"}).select("p_partkey"))
query("p7_last_days", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 90")(
    lambda s, d: table(s, d, "orders").where(F.to_date("o_orderdate") >= F.date_sub(F.lit(table(s, d, "orders").agg(F.max(F.to_date("o_orderdate")).alias("m")).first()["m"]), 90)).select("o_orderkey"))
query("p8_null_rows", f"WITH {R} SELECT entity, date FROM p1 WHERE r IS NULL OR r_1 IS NULL")(lambda s, d: panel(s, d).where("r is null or r_1 is null").select(*KEY))
query("p9_enough_rows", f"WITH {R} SELECT date, count(r) AS n FROM p GROUP BY date HAVING count(r) >= 50")(lambda s, d: panel(s, d).groupBy("date").agg(F.count("r").alias("n")).where("n >= 50"))
query("p10_filter_fallback", "SELECT p_partkey FROM part WHERE p_size > 1000 OR NOT (SELECT bool_or(p_size > 1000) FROM part)")(lambda s, d: U.or_all(q_part(s, d), F.col("p_size") > 1000).select("p_partkey"))
query("p11_threshold", "SELECT greatest(5.0::DOUBLE, least(60.0::DOUBLE, round(avg(abs(c_acctbal)) / 100, 6) + 2)) AS threshold FROM customer")(
    lambda s, d: table(s, d, "customer").select(F.greatest(F.lit(5.0), F.least(F.lit(60.0), F.round(F.avg(F.abs("c_acctbal")) / 100, 6) + 2)).alias("threshold")))
query("p13_position", f"WITH {PRED} SELECT entity, date, CASE WHEN y_pred > 1 THEN 1 WHEN y_pred < -1 THEN -1 ELSE 0 END AS position FROM pd")(lambda s, d: predictions(s, d).select(*KEY, F.when(F.col("y_pred") > 1, 1).when(F.col("y_pred") < -1, -1).otherwise(0).alias("position")))
query("p14_stars", "SELECT p_size, CASE WHEN p_size / 100.0 < 0.01 THEN '***' WHEN p_size / 100.0 < 0.05 THEN '**' WHEN p_size / 100.0 < 0.1 THEN '*' ELSE '' END AS stars, count(*) AS n FROM part GROUP BY 1, 2")(
    lambda s, d: q_part(s, d).groupBy("p_size", F.when(F.col("p_size") / 100.0 < 0.01, "***").when(F.col("p_size") / 100.0 < 0.05, "**").when(F.col("p_size") / 100.0 < 0.1, "*").otherwise("").alias("stars")).agg(count().alias("n")))
query("p15_keyword_category", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_type || ' ' || p_brand), '{w}') THEN '{c}'" for w, c in RULES) + " END AS category FROM part")(
    lambda s, d: q_part(s, d).select("p_partkey", U.by_keyword(F.concat_ws(" ", "p_type", "p_brand"), RULES).alias("category")))


@query("p16_resolution", "SELECT s_suppkey, coalesce(CASE WHEN n_regionkey = 0 THEN n_name END, CASE WHEN s_suppkey % 3 = 0 THEN r_name END, 'UNCLASSIFIED') AS category FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def p16(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("s_suppkey", U.resolved(F.when(F.col("n_regionkey") == 0, F.col("n_name")).otherwise("nan"), F.when(F.col("s_suppkey") % 3 == 0, F.col("r_name")).otherwise("")).alias("category"))


query("p18_overwrite", f"WITH {R}, q AS (SELECT close, CASE WHEN r > 0 THEN r END AS new FROM p) SELECT count(*) FILTER (new IS NOT NULL) AS replaced, count(*) FILTER (new IS NULL) AS missing, round(avg(coalesce(new, close)), 4) AS mean FROM q")(
    lambda s, d: rounded(panel(s, d).withColumn("new", F.when(F.col("r") > 0, F.col("r"))).agg(F.count_if(F.col("new").isNotNull()).alias("replaced"), F.count_if(F.col("new").isNull()).alias("missing"), F.avg(F.coalesce("new", "close")).alias("mean")), mean=4))


@query("p19_quality_gate", f"""
WITH {R}, q AS (SELECT entity, count(*) AS rows, min(date) AS first, max(date) AS last, avg((r IS NULL)::INT) AS null_share, count(*) FILTER (date >= DATE '2001-01-01') AS recent FROM p GROUP BY entity)
SELECT s_suppkey AS entity, rows, first, last, {r6('null_share', 'null_share')}, recent, CASE WHEN rows IS NULL THEN 'missing' WHEN rows < 82 THEN 'short' WHEN null_share > 0.05 THEN 'gaps' WHEN recent < 11 THEN 'stale' ELSE 'ok' END AS status FROM supplier LEFT JOIN q ON q.entity = s_suppkey""", dates=("first", "last"))
def p19(s: SparkSession, d: str) -> DataFrame:
    return rounded(U.gates(panel(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("entity")), 82, 0.05, 11, F.lit("2001-01-01").cast("date")))


# Joins -------------------------------------------------------------------------------------------------------------------
query("j5_left_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")(
    lambda s, d: table(s, d, "customer").join(table(s, d, "nation").where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name"))
query("j2_distinct_lookup", f"WITH {PRED}, k AS (SELECT DISTINCT entity, industry FROM b) SELECT pd.entity, pd.date, k.industry FROM pd LEFT JOIN k USING (entity)", dates=("date",))(
    lambda s, d: predictions(s, d).drop("industry").join(supplier_month(s, d).select("entity", "industry").distinct(), "entity", "left").select(*KEY, "industry"))
query("j9_asof_latest", f"WITH {SM} SELECT entity, round(arg_max(close, date), 7) AS close, max(date) AS as_of FROM b WHERE date <= DATE '1999-06-15' GROUP BY entity", dates=("as_of",))(lambda s, d: rounded(U.as_of(supplier_month(s, d), F.lit("1999-06-15").cast("date"), "close"), close=7))


@query("j9_asof_join", f"WITH {SM}, l AS (SELECT DISTINCT l_suppkey AS entity, CAST(o_orderdate AS DATE) AS date FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT l.entity, l.date, b.ticks FROM l ASOF LEFT JOIN b ON l.entity = b.entity AND l.date >= b.date", dates=("date",))
def j9(s: SparkSession, d: str) -> DataFrame:
    """All suppliers: each day on which one was ordered from, with its last bar at that day."""
    lines, orders = table(s, d, "lineitem").select("l_orderkey", "l_suppkey"), table(s, d, "orders").select("o_orderkey", "o_orderdate")
    left = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("entity"), F.to_date("o_orderdate").alias("date")).distinct()
    return U.as_of_join(left, supplier_month(s, d).select(*KEY, "ticks"), "ticks")


@query("j11_range_window_join", f"WITH {PRED}, g AS (SELECT date, count(*) AS n, sum(y_true) AS s FROM pd GROUP BY date) SELECT a.date, sum(b.n)::BIGINT AS n, round(sum(b.s) / sum(b.n), 6) AS mean FROM g a JOIN g b ON b.date >= a.date - 365 AND b.date < a.date GROUP BY a.date", dates=("date",))
def j11(s: SparkSession, d: str) -> DataFrame:
    g = predictions(s, d).groupBy("date").agg(count().alias("n"), F.sum("y_true").alias("s"))
    w = Window.orderBy(F.unix_date("date")).rangeBetween(-365, -1)
    return rounded(g.select("date", F.sum("n").over(w).alias("n"), (F.sum("s").over(w) / F.sum("n").over(w)).alias("mean")).where("n is not null"))


query("j12_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"))
query("j13_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"))

# Aggregates --------------------------------------------------------------------------------------------------------------
query("a2_deviations", f"WITH {SM} SELECT industry, {r6('stddev_samp(turnover)', 'sd1')}, {r6('stddev_pop(turnover)', 'sd0')}, {r6('var_samp(turnover)', 'var1')} FROM b GROUP BY industry")(
    lambda s, d: rounded(supplier_month(s, d).groupBy("industry").agg(F.stddev_samp("turnover").alias("sd1"), F.stddev_pop("turnover").alias("sd0"), F.var_samp("turnover").alias("var1"))))
query("a4_median", f"WITH {SM} SELECT industry, {r6('median(turnover)', 'med')} FROM b GROUP BY industry")(lambda s, d: rounded(supplier_month(s, d).groupBy("industry").agg(F.median("turnover").alias("med"))))
query("a5_quantiles", f"WITH {SM} SELECT industry, " + ", ".join(r6(f"quantile_cont(turnover, {p})", f"q{int(p * 100)}") for p in (0.25, 0.33, 0.67, 0.75, 0.9)) + " FROM b GROUP BY industry")(
    lambda s, d: rounded(supplier_month(s, d).groupBy("industry").agg(*(F.percentile("turnover", F.lit(p)).alias(f"q{int(p * 100)}") for p in (0.25, 0.33, 0.67, 0.75, 0.9)))))
query("a6_win_rate", f"WITH {R} SELECT entity, {r6('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)', 'win')} FROM p GROUP BY entity")(lambda s, d: rounded(panel(s, d).groupBy("entity").agg(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win"))))
query("a8_distinct", f"WITH {SM} SELECT industry, count(DISTINCT entity) AS n, count(DISTINCT date) AS dates FROM b GROUP BY industry")(lambda s, d: supplier_month(s, d).groupBy("industry").agg(F.countDistinct("entity").alias("n"), F.countDistinct("date").alias("dates")))
query("a9_value_share", f"SELECT event_type, count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()', 'share')} FROM events GROUP BY event_type")(
    lambda s, d: rounded(table(s, d, "events").groupBy("event_type").agg(count().alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))))
query("a10_describe", f"WITH {SM} SELECT count(turnover) AS n, {r6('avg(turnover)', 'mean')}, {r6('stddev_samp(turnover)', 'sd')}, {r6('min(turnover)', 'low')}, {r6('max(turnover)', 'high')} FROM b")(
    lambda s, d: rounded(supplier_month(s, d).agg(F.count("turnover").alias("n"), F.avg("turnover").alias("mean"), F.stddev_samp("turnover").alias("sd"), F.min("turnover").alias("low"), F.max("turnover").alias("high"))))
query("a11_mean_count", f"WITH {SM} SELECT industry, {r6('avg(n)', 'mean_n')} FROM (SELECT industry, date, count(*) AS n FROM b GROUP BY ALL) GROUP BY industry")(
    lambda s, d: rounded(supplier_month(s, d).groupBy("industry", "date").agg(count().alias("n")).groupBy("industry").agg(F.avg("n").alias("mean_n"))))
query("a12_multi_agg", f"WITH {SM} SELECT industry, {r6('avg(turnover)', 'mean')}, {r6('max(turnover)', 'high')}, {r6('min(turnover)', 'low')} FROM b GROUP BY industry")(
    lambda s, d: rounded(supplier_month(s, d).groupBy("industry").agg(F.avg("turnover").alias("mean"), F.max("turnover").alias("high"), F.min("turnover").alias("low"))))
query("a13_pivot_max", "SELECT p_brand, " + ", ".join(f"round(max(CASE WHEN p_size % 5 = {k} THEN p_retailprice END), 4) AS s{k}" for k in range(5)) + " FROM part GROUP BY p_brand")(
    lambda s, d: rounded(q_part(s, d).withColumn("k", F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string"))).groupBy("p_brand").pivot("k", [f"s{k}" for k in range(5)]).agg(F.max("p_retailprice")), **{f"s{k}": 4 for k in range(5)}))
query("a14_mode", "SELECT p_brand, mode_ AS mode FROM (SELECT p_brand, p_size AS mode_, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY p_brand, p_size) WHERE k = 1")(lambda s, d: U.mode(q_part(s, d), "p_size", "p_brand"))
query("a15_category_stability", f"""WITH {PRED}, x AS (SELECT entity, CASE WHEN y_pred > 0.5 THEN 'up' WHEN y_pred < -0.5 THEN 'down' ELSE 'flat' END AS c FROM pd),
md AS (SELECT entity, c AS mode FROM (SELECT entity, c, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, c) AS k FROM x GROUP BY entity, c) WHERE k = 1)
SELECT {r6('avg((c = mode)::INT)', 'stability')}, count(DISTINCT c) AS categories FROM x JOIN md USING (entity)""")(
    lambda s, d: (lambda x: rounded(x.join(U.mode(x, "c", "entity"), "entity").agg(F.avg((F.col("c") == F.col("mode")).cast("double")).alias("stability"), F.countDistinct("c").alias("categories"))))(
        predictions(s, d).select("entity", F.when(F.col("y_pred") > 0.5, "up").when(F.col("y_pred") < -0.5, "down").otherwise("flat").alias("c"))))
query("a17_arg_max", f"WITH {SM} SELECT entity, arg_max(date, (turnover, date)) AS best, arg_min(date, (turnover, date)) AS worst FROM b GROUP BY entity", dates=("best", "worst"))(
    lambda s, d: supplier_month(s, d).groupBy("entity").agg(F.max_by("date", F.struct("turnover", "date")).alias("best"), F.min_by("date", F.struct("turnover", "date")).alias("worst")))


NET5 = "ls_gross - 5.0 / 10000 * turnover AS ls_net"


@query("a21_best_setting", f"""WITH RECURSIVE {PRED}, {book('pd', N, N, '_b')}, {bands(SCORES, 2)}, {SERIES.format(index='hy', held='hy')}, bo AS (SELECT 'baseline' AS strategy, date, {NET5} FROM se_b UNION ALL SELECT 'hysteresis', date, {NET5} FROM se),
be AS (SELECT arg_max(strategy, ir) AS strategy FROM (SELECT strategy, avg(ls_net) / (stddev_samp(ls_net) + 1e-12) AS ir FROM bo GROUP BY strategy)), cu AS (SELECT date, ls_net, sum(ls_net) OVER (ORDER BY date) AS cum FROM bo JOIN be USING (strategy))
SELECT date, {r6('ls_net', 'ls_net')}, {r6('cum - max(cum) OVER (ORDER BY date)', 'drawdown')} FROM cu""")
def a21(s: SparkSession, d: str) -> DataFrame:
    p = predictions(s, d)
    g = P.grid(p, [("baseline", None, 5), ("hysteresis", 2, 5)], [5])
    best = g.groupBy("top_n", "cost_bps").agg(F.max_by(F.struct("strategy", "param"), "ls_ir").alias("v")).first()["v"]
    return rounded(P.run_policy(p, best["strategy"], 5, None if best["param"] == "None" else float(best["param"]), 5.0).select("date", "ls_net", "drawdown"))


# Order, limits, sets -----------------------------------------------------------------------------------------------------
query("o3_topk", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda s, d: rounded(table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"), o_totalprice=4))
query("o4_group_topk", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")(
    lambda s, d: table(s, d, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("k <= 2").select("o_custkey", "o_orderkey"))
query("o6_union", f"WITH {SM}, {BD} SELECT CAST(entity AS VARCHAR) AS entity, date, round(close, 7) AS close FROM b UNION ALL SELECT entity, date, round(close, 7) AS close FROM bd", dates=("date",))(
    lambda s, d: rounded(supplier_month(s, d).select(F.col("entity").cast("string").alias("entity"), "date", "close").unionByName(brand_day(s, d).select("entity", "date", "close")), close=7))
query("o7_keep_first", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")(
    lambda s, d: table(s, d, "customer").withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("k = 1").select("c_nationkey", "c_custkey"))


@query("o8_set_ops", "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT k, 'both' AS kind FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'first' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'any' FROM (SELECT k FROM a UNION SELECT k FROM b)")
def o8(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    kind = lambda df, x: df.withColumn("kind", F.lit(x))
    return kind(a.intersect(b), "both").unionByName(kind(a.subtract(b), "first")).unionByName(kind(a.union(b).distinct(), "any"))


# Universe ------------------------------------------------------------------------------------------------------------------
query("u1_screen", "SELECT c_custkey FROM customer WHERE c_acctbal >= 100 AND NOT coalesce(upper(c_mktsegment) LIKE '%BUILD%', false)")(lambda s, d: U.screen(table(s, d, "customer"), {"c_acctbal": 100}, without={"c_mktsegment": "build"}).select("c_custkey"))
query("u2_capped_topk", "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 40")(
    lambda s, d: U.capped_top(table(s, d, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], "c_nationkey", 3, 40).select("c_custkey", "c_nationkey"))
query("u3_candidates", f"WITH {SM} SELECT entity, count(*) AS days, round(median(amount), 6) AS median_amount FROM b GROUP BY entity")(lambda s, d: rounded(U.candidates(supplier_month(s, d))))


@query("u4_rank_topup", "WITH f AS (SELECT c_nationkey AS k, c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9900 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1), a AS (SELECT k, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS p FROM f), m AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) + 1000000000 AS p FROM nation WHERE n_nationkey NOT IN (SELECT k FROM a)) SELECT k FROM (SELECT * FROM a UNION ALL SELECT * FROM m) ORDER BY p LIMIT 20")
def u4(s: SparkSession, d: str) -> DataFrame:
    ranked = table(s, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_acctbal")
    return U.topped_up(ranked, table(s, d, "nation").select(F.col("n_nationkey").alias("k")), "k", [F.desc_nulls_last("c_acctbal"), F.asc("c_custkey")], 20).select("k")


query("u5_snapshot", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")(
    lambda s, d: table(s, d, "supplier").join(table(s, d, "lineitem").where("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name"))
query("event_bars", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ALL", dates=())(
    lambda s, d: rounded(streams.tumbling(table(s, d, "events")), total=4))
query("x4_users_rank", f"WITH {UE} SELECT date, entity, (rank() OVER (PARTITION BY date ORDER BY n DESC))::INT AS place FROM ue")(lambda s, d: user_day(s, d).select("date", "entity", F.rank().over(Window.partitionBy("date").orderBy(F.desc("n"))).alias("place")))
