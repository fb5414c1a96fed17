"""Remaining projections, joins, orders and sets of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import indexed
from ..operators import cross as X
from ..operators import portfolio as P
from ..schemas import REGIME_LABELS, rename_known
from ..sources.panels import SM, supplier_month, table
from .catalog import query, r6, rounded
from .factor_queries import KEY, MOM, PRED, Z, momenta, predictions
from .ic_queries import MK, regimes
from .portfolio_queries import LEGS, SCORES

query("p1_rename", f"WITH {SM} SELECT entity, date, turnover FROM (SELECT entity, date, {r6('turnover', 'turnover')} FROM b)")(
    lambda s, d: rounded(rename_known(supplier_month(s, d).withColumnRenamed("turnover", "turnover_rate")).select(*KEY, "turnover")))
query("p3_fixed_columns", "SELECT s_suppkey, s_name, CAST(NULL AS DOUBLE) AS pe FROM supplier")(lambda s, d: table(s, d, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("double").alias("pe")))
query("p6_membership", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (3, 8)")(lambda s, d: table(s, d, "nation").where(F.col("n_regionkey").isin(1, 3) & ~F.col("n_nationkey").isin(3, 8)).select("n_name"))
query("p17_labels", f"WITH {MK} SELECT date, CASE regime WHEN 'NORMAL' THEN '正常' WHEN 'HIGH' THEN '高波动' WHEN 'EXTREME' THEN '极高波动' END AS label FROM rg")(
    lambda s, d: regimes(s, d).select("date", F.element_at(F.create_map(*(F.lit(x) for k, v in REGIME_LABELS.items() for x in (v, k))), F.col("regime")).alias("label")))
query("p20_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 30 AS before, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::INT AS days, TRY_CAST(o_orderpriority AS DATE) AS none FROM orders", dates=("before", "none"))(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_sub(F.to_date("o_orderdate"), 30).alias("before"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("days"), F.col("o_orderpriority").try_cast("date").alias("none")))
query("p22_normalised", f"WITH {SM} SELECT CASE WHEN length(CAST(entity AS VARCHAR)) < 6 THEN lpad(CAST(entity AS VARCHAR), 6, '0') ELSE CAST(entity AS VARCHAR) END AS code, count(*) AS n FROM b GROUP BY 1")(
    lambda s, d: supplier_month(s, d).groupBy(F.lpad(F.col("entity").cast("string"), 6, "0").alias("code")).agg(F.count(F.lit(1)).alias("n")))
query("p24_time_range", f"WITH {SM} SELECT entity, date, ticks FROM b WHERE date >= (SELECT max(date) FROM b) - 180", dates=("date",))(
    lambda s, d: (lambda b: b.where(F.col("date") >= F.date_sub(F.lit(b.agg(F.max("date").alias("m")).first()["m"]), 180)).select(*KEY, "ticks"))(supplier_month(s, d)))
query("j3_regime_of_date", f"WITH {MK}, pe AS (SELECT entity, date FROM f0 WHERE mom3 IS NOT NULL) SELECT pe.entity, pe.date, regime FROM pe LEFT JOIN (SELECT DISTINCT date, regime FROM rg) USING (date)", dates=("date",))(
    lambda s, d: momenta(s, d).where("mom is not null").select(*KEY).join(regimes(s, d).select("date", "regime").distinct(), "date", "left").select(*KEY, "regime"))
query("j4_suffix_join", f"WITH {MOM}, z AS (SELECT entity, date, {Z.format(x='mom')} AS v FROM m), k AS (SELECT entity, date, mom - avg(mom) OVER (PARTITION BY date) AS v FROM m) SELECT entity, date, {r6('z.v', 'v')}, {r6('k.v', 'v_centred')} FROM z LEFT JOIN k USING (entity, date)", dates=("date",))(
    lambda s, d: rounded(X.standardised(momenta(s, d), "mom").select(*KEY, F.col("mom_std").alias("v")).join(
        momenta(s, d).select(*KEY, (F.col("mom") - F.avg("mom").over(Window.partitionBy("date"))).alias("v")).withColumnsRenamed({"v": "v_centred"}), [*KEY], "left")))
query("j6_signal_price", f"WITH {PRED} SELECT pd.entity, pd.date, {r6('y_pred', 'y_pred')}, round(close, 7) AS close FROM pd JOIN b ON b.entity = pd.entity AND b.date = pd.date", dates=("date",))(
    lambda s, d: rounded(predictions(s, d).join(supplier_month(s, d).select(*KEY, "close"), [*KEY]).select(*KEY, "y_pred", "close"), close=7))


@query("j14_overlap", f"WITH {PRED}, {LEGS.format(scores=SCORES)}, dx AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM lg)), h AS (SELECT lg.*, i FROM lg JOIN dx USING (date)) SELECT a.date, a.side, count(*) AS n, count(b.entity) AS kept FROM h a LEFT JOIN h b ON a.side = b.side AND a.entity = b.entity AND a.i = b.i + 1 GROUP BY a.date, a.side", dates=("date",))
def j14(s: SparkSession, d: str) -> DataFrame:
    held = P.legs(predictions(s, d), 5, 5)
    h = held.join(indexed(held), "date")
    was = h.select("side", "entity", (F.col("idx") + 1).alias("idx"), F.lit(1).alias("kept"))
    return h.join(was, ["side", "entity", "idx"], "left").groupBy("date", "side").agg(F.count(F.lit(1)).alias("n"), F.count("kept").alias("kept"))


query("a19_price_statistics", f"WITH {SM} SELECT {r6('avg(turnover)', 'mean')}, {r6('median(turnover)', 'med')}, {r6('stddev_samp(turnover)', 'sd')}, count(DISTINCT entity) AS entities FROM b")(
    lambda s, d: rounded(supplier_month(s, d).agg(F.avg("turnover").alias("mean"), F.median("turnover").alias("med"), F.stddev_samp("turnover").alias("sd"), F.countDistinct("entity").alias("entities"))))
query("o2_by_size", f"WITH {PRED} SELECT entity, date, {r6('y_pred', 'y_pred')} FROM (SELECT * FROM pd ORDER BY abs(y_pred) DESC, entity, date LIMIT 50)", dates=("date",))(
    lambda s, d: rounded(predictions(s, d).orderBy(F.abs("y_pred").desc(), "entity", "date").limit(50).select(*KEY, "y_pred")))
query("o5_head_tail", f"WITH {SM} SELECT entity, date FROM b QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date) <= 2 OR row_number() OVER (PARTITION BY entity ORDER BY date DESC) <= 2", dates=("date",))(
    lambda s, d: supplier_month(s, d).withColumn("a", F.row_number().over(Window.partitionBy("entity").orderBy("date"))).withColumn("z", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date")))).where("a <= 2 or z <= 2").select(*KEY))
query("o9_overlap", "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")(
    lambda s, d: table(s, d, "customer").select("c_nationkey").intersect(table(s, d, "supplier").select("s_nationkey")).agg(F.count(F.lit(1)).alias("n")))
