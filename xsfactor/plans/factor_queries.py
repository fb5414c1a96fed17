"""Factors and cross-sections on suppliers by month (windows scaled to months) and brands by day (windows as in the defaults)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.windows import average_rank, lag
from ..operators import cross as X
from ..operators import factors as T
from ..sources.panels import BD, SM, brand_day, supplier_month
from .catalog import E_, over, query, r6, rounded
from .sql_models import normal_quantile

R = f"{SM}, p AS (SELECT *, close / nullif(lag(close) {E_}, 0) - 1 AS r FROM b), p1 AS (SELECT *, lag(r) {E_} AS r_1 FROM p)"
KEY = ("entity", "date")


def panel(spark: SparkSession, sf_dir: str, bars: Callable[[SparkSession, str], DataFrame] = supplier_month) -> DataFrame:
    return T.with_return(bars(spark, sf_dir))


def factor(name: str, column: str, sql: str, base: str = R, source: str = "p1", extra: str = "") -> callable:
    """A query that shows one factor: (entity, date, column)."""
    text = f"WITH {base}{extra} SELECT entity, date, {r6(sql, column)} FROM {source}"

    def register(f: callable) -> callable:
        return query(name, text)(lambda spark, sf_dir: rounded(f(panel(spark, sf_dir)).select(*KEY, column)))

    return register


query("s6_panel_bars", f"WITH {SM} SELECT entity, date, {', '.join(f'round({c}, 7) AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume, amount, {r6('turnover', 'turnover')}, ticks, industry FROM b")(
    lambda s, d: rounded(supplier_month(s, d), open=7, high=7, low=7, close=7).select("entity", "date", "open", "high", "low", "close", "volume", "amount", "turnover", "ticks", "industry")
)
factor("t1_return", "r", "r")(lambda p: p)
factor("t2_momentum", "m", f"lag(close, 2) {E_} / nullif(lag(close, 7) {E_}, 0) - 1")(lambda p: p.withColumn("m", T.momentum(6)))
factor("t3_vol", "v", f"({over('stddev_samp', 'r', 6, 4)}) * sqrt(12.0)")(lambda p: p.withColumn("v", T.volatility(6, 4, 12.0**0.5)))
factor("t4_vol_ratio", "v", f"({over('stddev_samp', 'r', 6, 4, 1)}) / (({over('stddev_samp', 'r', 12, 8, 1)}) + 1e-12) - 1")(lambda p: p.withColumn("v", T.vol_ratio(6, 12, 4, 8)))
factor("t5_atr", "a", f"({over('avg', 'tr', 6, 4)}) / nullif(close, 0)", source="q",
       extra=f", q AS (SELECT *, greatest(abs(high - low), abs(high - lag(close) {E_}), abs(low - lag(close) {E_})) AS tr FROM p1)")(
    lambda p: p.withColumn("tr", T.true_range()).withColumn("a", T.atr(6, 4)))
factor("t6_gk_vol", "g", f"sqrt(CASE WHEN ({over('avg', 'gk', 6, 4)}) IS NOT NULL THEN greatest({over('avg', 'gk', 6, 4)}, 0.0) END) * sqrt(12.0)", source="q",
       extra=", q AS (SELECT *, 0.5 * ln(high / nullif(low, 0)) * ln(high / nullif(low, 0)) - (2 * ln(2.0::DOUBLE) - 1) * ln(close / nullif(open, 0)) * ln(close / nullif(open, 0)) AS gk FROM p1)")(
    lambda p: p.withColumn("gk", T.garman_klass_term()).withColumn("g", T.garman_klass(6, 4, 12.0**0.5)))
factor("t7_amplitude", "a", "(high - low) / nullif(close, 0)")(lambda p: p.withColumn("a", T.amplitude()))
query("t8_breakout", f"WITH {SM} SELECT entity, date, coalesce(close > ({over('max', 'close', 6, 3, 1)}), false)::DOUBLE AS up, coalesce(close < ({over('min', 'close', 6, 3, 1)}), false)::DOUBLE AS down FROM b")(
    lambda s, d: supplier_month(s, d).select(*KEY, T.breakout_high(6).alias("up"), T.breakout_low(6).alias("down")))
query("t9_dist_extrema", f"WITH {BD} SELECT entity, date, {r6('close / ((' + over('max', 'close', 252, 151, 1) + ') + 1e-12) - 1', 'high')}, {r6('close / ((' + over('min', 'close', 252, 151, 1) + ') + 1e-12) - 1', 'low')} FROM bd")(
    lambda s, d: rounded(brand_day(s, d).select(*KEY, T.distance_high().alias("high"), T.distance_low().alias("low"))))
factor("t10_vol_trend", "v", f"({over('avg', 'volume', 3, 2, 1)}) / (({over('avg', 'volume', 12, 6, 1)}) + 1e-12) - 1")(lambda p: p.withColumn("v", T.volume_trend(3, 12, 2, 6)))
factor("t11_obv", "o", f"sum(sv) {E_}", source="q", extra=f", q AS (SELECT *, coalesce(sign(close - lag(close) {E_}) * volume, 0.0) AS sv FROM p1)")(
    lambda p: p.withColumn("sv", T.signed_volume()).withColumn("o", T.on_balance_volume()))
factor("t12_zero_ret", "z", over("avg", "z", 6, 3), source="q", extra=", q AS (SELECT *, (abs(coalesce(r_1, 0)) < 1e-10)::INT::DOUBLE AS z FROM p1)")(lambda p: p.withColumn("z", T.zero_return_share(6, 3)))
_w = "OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
factor("t13_roll_spread", "s", f"CASE WHEN count(r_1) {_w.format(11)} >= 8 AND covar_pop(r_1, r_2) {_w.format(10)} IS NOT NULL THEN 2 * sqrt(greatest(-(covar_pop(r_1, r_2) {_w.format(10)}), 0.0)) END",
       source="q", extra=f", q AS (SELECT *, lag(r_1) {E_} AS r_2 FROM p1)")(lambda p: p.withColumn("r_2", lag("r_1")).withColumn("s", T.roll_spread(12, 8)))
factor("t14_volume_ratio", "v", f"volume / nullif({over('avg', 'volume', 6, 4)}, 0)")(lambda p: p.withColumn("v", T.volume_ratio(6, 4)))
factor("t15_turnover_rate", "turnover", "turnover")(lambda p: p)
factor("t16_illiq", "i", f"abs(r_1) / (lag(amount) {E_} + 1) * 1e9")(lambda p: p.withColumn("i", T.illiquidity()))
query("t17_forward", f"WITH {R} SELECT entity, date, {r6(f'lead(r) {E_}', 'f1')}, {r6(f'lead(close, 5) {E_} / nullif(close, 0) - 1', 'f5')}, {r6(f'lead(close, 10) {E_} / nullif(close, 0) - 1', 'f10')} FROM p")(
    lambda s, d: rounded(panel(s, d).select(*KEY, *(T.forward(n).alias(f"f{n}") for n in (1, 5, 10)))))
query("t18_trim", f"WITH {BD} SELECT entity, date, round(close, 7) AS close FROM bd QUALIFY row_number() {E_} > 260")(lambda s, d: rounded(T.trimmed(brand_day(s, d)).select(*KEY, "close"), close=7))
query("t19_eligible", f"WITH {BD} SELECT entity, count(*) AS bars FROM bd GROUP BY entity HAVING count(*) >= 40")(
    lambda s, d: T.eligible(brand_day(s, d)).groupBy("entity").agg(F.count(F.lit(1)).alias("bars")))


@query("t22_ewma", f"""
WITH RECURSIVE {R}, q AS (SELECT entity, date, close, row_number() {E_} AS i FROM b),
e AS (SELECT entity, date, i, close AS s FROM q WHERE i = 1
      UNION ALL SELECT q.entity, q.date, q.i, 2.0 / 6 * q.close + (1 - 2.0 / 6) * e.s FROM e JOIN q ON q.entity = e.entity AND q.i = e.i + 1)
SELECT entity, date, {r6('s', 's')} FROM e""")
def t22(s: SparkSession, d: str) -> DataFrame:
    return rounded(T.ewma(supplier_month(s, d).select(*KEY, "close"), "close", 5, "s").select(*KEY, "s"))


@query("t24_events", f"""
WITH {R}, q AS (SELECT entity, date, coalesce(r > 0, false) AS up FROM p),
c AS (SELECT *, coalesce(lag(up) {E_}, false) AS was FROM q)
SELECT entity, date, CASE WHEN up THEN 'open' ELSE 'close' END AS event FROM c WHERE up <> was""")
def t24(s: SparkSession, d: str) -> DataFrame:
    flags = panel(s, d).select(*KEY, F.coalesce(F.col("r") > 0, F.lit(False)).alias("up"))
    return flags.withColumn("was", F.coalesce(lag("up"), F.lit(False))).where("up != was").select(*KEY, F.when(F.col("up"), "open").otherwise("close").alias("event"))


@query("t25_ffill", f"""
WITH {R}, q AS (SELECT entity, date, CASE WHEN r > 0 THEN close END AS x FROM p)
SELECT entity, date, round(last_value(x IGNORE NULLS) {E_}, 7) AS x FROM q""")
def t25(s: SparkSession, d: str) -> DataFrame:
    return rounded(panel(s, d).withColumn("x", F.when(F.col("r") > 0, F.col("close"))).select(*KEY, T.filled("x").alias("x")), x=7)


@query("t26_last_rows", f"WITH {SM} SELECT entity, date, round(close, 7) AS close FROM b QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date DESC) <= 5")
def t26(s: SparkSession, d: str) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date")))
    return rounded(supplier_month(s, d).withColumn("n", last).where("n <= 5").select(*KEY, "close"), close=7)


@query("t27_islands", f"""
WITH {R}, q AS (SELECT entity, date, coalesce(r > 0, false) AS up FROM p),
c AS (SELECT *, CASE WHEN lag(up) {E_} IS NOT DISTINCT FROM up THEN 0 ELSE 1 END AS new FROM q), g AS (SELECT *, sum(new) {E_} AS run FROM c)
SELECT entity, up, min(date) AS start, max(date) AS "end", count(*) AS n FROM g GROUP BY entity, run, up""", dates=("start", "end"))
def t27(s: SparkSession, d: str) -> DataFrame:
    return T.islands(panel(s, d).select(*KEY, F.coalesce(F.col("r") > 0, F.lit(False)).alias("up")), "up", ["entity"])


# Cross-sections ------------------------------------------------------------------------------------------------------

MOM = f"{R}, m AS (SELECT *, lag(close, 2) {E_} / nullif(lag(close, 4) {E_}, 0) - 1 AS mom, lead(r) {E_} AS fwd FROM p1)"
Z = "CASE WHEN stddev_samp({x}) OVER (PARTITION BY date) > 1e-12 THEN ({x} - avg({x}) OVER (PARTITION BY date)) / stddev_samp({x}) OVER (PARTITION BY date) END"


def momenta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).withColumn("mom", T.momentum(3)).withColumn("fwd", T.forward(1))


query("x1_zscore", f"WITH {MOM} SELECT entity, date, {r6(Z.format(x='mom'), 'z')}, {r6(Z.format(x='amount'), 'za')} FROM m")(
    lambda s, d: rounded(X.standardised(momenta(s, d), "mom", "amount").select(*KEY, F.col("mom_std").alias("z"), F.col("amount_std").alias("za"))))


GAUSS = f"""{MOM}, gk AS (SELECT entity, date, mom, fwd, (rank() OVER (PARTITION BY date, mom IS NULL ORDER BY mom) + (count(*) OVER (PARTITION BY date, mom) - 1) / 2.0::DOUBLE - 0.5) / count(mom) OVER (PARTITION BY date) AS k, count(mom) OVER (PARTITION BY date) AS n FROM m),
gp AS (SELECT *, greatest(least(k, 1 - 1e-6), 1e-6)::DOUBLE AS p FROM gk), gg AS (SELECT entity, date, fwd, CASE WHEN mom IS NOT NULL AND n >= 5 THEN {normal_quantile('p')} END AS g FROM gp)"""


@query("x2_rank_gauss", f"WITH {GAUSS} SELECT entity, date, {r6('g', 'g')} FROM gg")
def x2(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.rank_gauss(momenta(s, d), "mom", "g").select(*KEY, "g"))


@query("x3_avg_rank", f"WITH {MOM} SELECT entity, date, rank() OVER (PARTITION BY date ORDER BY ticks) + (count(*) OVER (PARTITION BY date, ticks) - 1) / 2.0::DOUBLE AS k FROM m")
def x3(s: SparkSession, d: str) -> DataFrame:
    return momenta(s, d).select(*KEY, average_rank("ticks", "date").alias("k"))


@query("x4_industry_rank_pct", f"""
WITH {MOM}, q AS (SELECT entity, date, industry, ticks FROM m)
SELECT entity, date, count(entity) OVER w AS ind_count, (rank() OVER (w ORDER BY ticks DESC))::INT AS ind_rank,
  {r6('1 - (rank() OVER (w ORDER BY ticks DESC) - 1) / (count(entity) OVER w)::DOUBLE', 'ind_rank_pct')} FROM q WINDOW w AS (PARTITION BY date, industry)""")
def x4(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.category_rank(momenta(s, d), "ticks").select(*KEY, "ind_count", "ind_rank", "ind_rank_pct"))


PRED = f"{MOM}, pr AS (SELECT entity, date, industry, round({Z.format(x='mom')}, 9) AS y_pred, fwd AS y_true FROM m WHERE mom IS NOT NULL), pd AS (SELECT * FROM pr WHERE y_pred IS NOT NULL AND y_true IS NOT NULL)"


def predictions(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Scores without a model: standardised momentum against the next return; made once, as legs and their returns read them."""
    z = X.standardised((momenta(spark, sf_dir) if base is None else base).where("mom is not null"), "mom")
    both = z.select(*KEY, "industry", F.round("mom_std", 9).alias("y_pred"), F.col("fwd").alias("y_true"))
    return durable(both.where("y_pred is not null and y_true is not null"), "predictions")


@query("x5_membership", f"""
WITH {PRED} SELECT entity, date, (row_number() OVER (PARTITION BY date ORDER BY y_pred DESC, entity))::INT AS place,
  row_number() OVER (PARTITION BY date ORDER BY y_pred DESC, entity) <= 5 AS in_long, row_number() OVER (PARTITION BY date ORDER BY y_pred, entity DESC) <= 5 AS in_short FROM pd""")
def x5(s: SparkSession, d: str) -> DataFrame:
    return X.membership(predictions(s, d), "y_pred", 5, 5).select(*KEY, "place", "in_long", "in_short")


query("x6_neutral", f"WITH {MOM} SELECT entity, date, {r6('mom - avg(mom) OVER (PARTITION BY date, industry)', 'mom')}, {r6('fwd - avg(fwd) OVER (PARTITION BY date, industry)', 'fwd')} FROM m")(
    lambda s, d: rounded(X.neutralised(momenta(s, d), ["mom", "fwd"], drop=False).select(*KEY, "mom", "fwd")))
query("x7_neutral_shrink", f"WITH {MOM} SELECT entity, date, {r6('''CASE WHEN industry IN ('NATION_1', 'NATION_2', 'NATION_3') THEN mom - 0.5 * avg(mom) OVER (PARTITION BY date, industry) ELSE mom END''', 'mom')} FROM m WHERE industry IS NOT NULL")(
    lambda s, d: rounded(X.neutralised(momenta(s, d), ["mom"], 0.5, ["NATION_1", "NATION_2", "NATION_3"]).select(*KEY, "mom")))
query("x8_interactions", f"WITH {MOM}, q AS (SELECT entity, date, mom * turnover AS x FROM m) SELECT entity, date, {r6('(x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-9)', 'mom_x_turnover')} FROM q WINDOW w AS (PARTITION BY date)")(
    lambda s, d: rounded(X.interactions(momenta(s, d), [("mom", "turnover")]).select(*KEY, "mom_x_turnover")))
