"""Correlations, tests and regimes on suppliers by month; factors of regimes are chosen on suppliers by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import special
from ..operators import cross as X
from ..operators import factors as T
from ..operators import regimes as R
from ..operators import stats as S
from ..sources.panels import supplier_day, supplier_month, table
from .catalog import E_, over, query, r6, rounded
from .factor_queries import KEY, MOM, PRED, panel, predictions
from .factor_queries import R as RET
from .sql_models import normal_cdf, shapiro_wilk, t_two_sided

FACTORS = ["mom3", "mom6", "vol6", "vr", "amp"]
YEAR = 12.0**0.5
F0 = f"""{RET}, f0 AS (SELECT entity, date, industry, r, round(lead(r) {E_}, 9) AS fwd, round(lead(close, 3) {E_} / nullif(close, 0) - 1, 9) AS fwd3,
  round(lag(close, 2) {E_} / nullif(lag(close, 4) {E_}, 0) - 1, 9) AS mom3, round(lag(close, 2) {E_} / nullif(lag(close, 7) {E_}, 0) - 1, 9) AS mom6,
  round(({over('stddev_samp', 'r', 6, 4)}) * sqrt(12.0), 9) AS vol6, round(volume / nullif({over('avg', 'volume', 6, 4)}, 0), 9) AS vr, round((high - low) / nullif(close, 0), 9) AS amp FROM p1)"""
FL = f"{F0}, fl AS (SELECT entity, date, fwd, unnest(['mom3', 'mom6', 'vol6', 'vr', 'amp']) AS factor, unnest([mom3, mom6, vol6, vr, amp]) AS x FROM f0)"


def ic_sql(source: str, keys: str, y: str = "fwd", least: int = 5, name: str = "ic", more: str = "") -> str:
    return f"""{name}_k AS (SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2.0 AS ry FROM {source} WHERE x IS NOT NULL AND {y} IS NOT NULL{more}),
{name}_g AS (SELECT {keys}, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 12) AS ic, count(*) AS n FROM {name}_k GROUP BY ALL),
{name} AS (SELECT * FROM {name}_g WHERE n >= {least} AND ic IS NOT NULL)"""


IC = f"{FL}, {ic_sql('fl', 'factor, date')}"
SUMMARY = "avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, median(ic) AS ic_median, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS ic_ir, avg((ic > 0)::INT) AS win_rate, avg(abs(ic)) AS abs_ic, count(ic) AS n, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) AS t"
SUMMED = ", ".join(r6(c, c) for c in ("ic_mean", "ic_std", "ic_median", "ic_ir", "win_rate", "abs_ic")) + ", n, " + r6("t", "t")


def factor_panel(spark: SparkSession, sf_dir: str, bars: Callable[[SparkSession, str], DataFrame] = supplier_month, year: float = YEAR) -> DataFrame:
    nine = {
        "fwd": T.forward(1), "fwd3": T.forward(3), "mom3": T.momentum(3), "mom6": T.momentum(6), "vol6": T.volatility(6, 4, year),
        "vr": T.volume_ratio(6, 4), "amp": T.amplitude(),
    }
    return panel(spark, sf_dir, bars).select(*KEY, "industry", "r", *(F.round(x, 9).alias(n) for n, x in nine.items()))


def long_panel(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(entity, date, fwd, factor, x): one grouping serves all factors."""
    wide = factor_panel(spark, sf_dir)
    return wide.unpivot([*KEY, "fwd", *more], FACTORS, "factor", "x")


def ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.daily_ic(long_panel(spark, sf_dir), "x", "fwd", ("factor", "date"))


query("i1_spearman_ic", f"WITH {IC} SELECT date, factor, {r6('ic', 'ic')}, n FROM ic")(lambda s, d: rounded(ics(s, d).select("date", "factor", "ic", "n")))
query("i2_prediction_ic", f"WITH {PRED}, q AS (SELECT date, y_pred AS x, round(y_true, 9) AS fwd FROM pd), {ic_sql('q', 'date', least=1)} SELECT date, {r6('ic', 'ic')}, n FROM ic")(
    lambda s, d: rounded(X.daily_ic(predictions(s, d).withColumn("y", F.round("y_true", 9)), "y_pred", "y", least=1).select("date", "ic", "n")))
query("i3_ic_summary", f"WITH {IC}, z AS (SELECT factor, {SUMMARY} FROM ic GROUP BY factor) SELECT factor, {SUMMED} FROM z")(lambda s, d: rounded(S.ic_summary(ics(s, d), "factor")))
query("i4_ttest", f"WITH {IC}, z AS (SELECT factor, {SUMMARY} FROM ic GROUP BY factor) SELECT factor, n, {r6('t', 't')} FROM z")(lambda s, d: rounded(S.ic_summary(ics(s, d), "factor").select("factor", "n", "t")))
WITH_P = f"WITH {IC}, z AS (SELECT factor, {SUMMARY} FROM ic GROUP BY factor), zp AS (SELECT *, CASE WHEN n > 1 THEN {t_two_sided('t', '(n - 1)')} ELSE 1 END AS p FROM z)"
STARS = "CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars"
query("i4_p_values", f"{WITH_P} SELECT factor, {SUMMED}, {r6('p', 'p')}, {STARS} FROM zp")(lambda s, d: rounded(S.with_p(S.ic_summary(ics(s, d), "factor"))))
query("i18_multi_horizon", f"WITH {F0}, fh AS (SELECT date, unnest(['1', '3']) AS horizon, mom3 AS x, unnest([fwd, fwd3]) AS y FROM f0), {ic_sql('fh', 'horizon, date', 'y')}, z AS (SELECT horizon, {SUMMARY} FROM ic GROUP BY horizon) SELECT horizon, {SUMMED} FROM z")(
    lambda s, d: rounded(S.ic_summary(X.daily_ic(factor_panel(s, d).select("date", F.col("mom3").alias("x"), F.col("fwd").alias("1"), F.col("fwd3").alias("3")).unpivot(["date", "x"], ["1", "3"], "horizon", "y"), "x", "y", ("horizon", "date")), "horizon")))
query("i19_ranking", f"WITH {IC}, z AS (SELECT factor, {SUMMARY} FROM ic GROUP BY factor) SELECT factor, {r6('ic_ir', 'ic_ir')}, (rank() OVER (ORDER BY round(abs(ic_ir), 9) DESC))::INT AS place FROM z")(
    lambda s, d: rounded(S.ic_summary(ics(s, d), "factor").select("factor", "ic_ir", F.rank().over(Window.orderBy(F.round(F.abs("ic_ir"), 9).desc())).alias("place"))))


# Regimes ---------------------------------------------------------------------------------------------------------------

MK = f"""{F0}, mk AS (SELECT date, avg(r) AS market_return, stddev_samp(r) AS xsec_vol, count(*) AS n FROM f0 GROUP BY date),
mv AS (SELECT *, CASE WHEN count(market_return) OVER w6 >= 3 THEN stddev_samp(market_return) OVER w6 END * sqrt(12.0) AS vol_ts, CASE WHEN count(xsec_vol) OVER w5 >= 3 THEN avg(xsec_vol) OVER w5 END AS vol_xsec
  FROM mk WINDOW w6 AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w5 AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
mc AS (SELECT *, 0.5 * (vol_ts - avg(vol_ts) OVER ()) / (stddev_samp(vol_ts) OVER () + 1e-9) + 0.5 * (vol_xsec - avg(vol_xsec) OVER ()) / (stddev_samp(vol_xsec) OVER () + 1e-9) AS volatility FROM mv),
rg AS (SELECT *, CASE WHEN volatility <= (SELECT quantile_cont(volatility, 0.5) FROM mc) THEN 'NORMAL' WHEN volatility <= (SELECT quantile_cont(volatility, 0.9) FROM mc) THEN 'HIGH' ELSE 'EXTREME' END AS regime FROM mc WHERE volatility IS NOT NULL),
rp AS (SELECT f0.*, regime, volatility, market_return FROM f0 JOIN rg USING (date))"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_volatility(R.market(factor_panel(spark, sf_dir)), 6, 12.0)


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_regime(market(spark, sf_dir).withColumn("volatility", F.col("volatility")))


def regime_panel(spark: SparkSession, sf_dir: str, *xs: str, bars: Callable[[SparkSession, str], DataFrame] = supplier_day, n: int = 21, year: float = 252.0) -> DataFrame:
    """The panel is made once, for the market and for the rows that get its regimes. xs: only these columns beside key and return."""
    wide = factor_panel(spark, sf_dir, bars, year**0.5)
    base = durable(wide.select(*KEY, "r", *xs) if xs else wide, "panel")
    return R.with_market(base, R.with_regime(R.with_volatility(R.market(base), n, year)))


def month_regime_panel(spark: SparkSession, sf_dir: str, *xs: str) -> DataFrame:
    return regime_panel(spark, sf_dir, *xs, bars=supplier_month, n=6, year=12.0)


query("a1_market_index", f"WITH {MK} SELECT date, {r6('market_return', 'market_return')}, {r6('xsec_vol', 'xsec_vol')}, n FROM mk")(lambda s, d: rounded(R.market(factor_panel(s, d))))
query("t20_market_vol", f"WITH {MK} SELECT date, {r6('vol_ts', 'vol_ts')}, {r6('vol_xsec', 'vol_xsec')} FROM mv")(lambda s, d: rounded(market(s, d).select("date", "vol_ts", "vol_xsec")))
query("x10_composite_vol", f"WITH {MK} SELECT date, {r6('volatility', 'volatility')} FROM mc")(lambda s, d: rounded(market(s, d).select("date", "volatility")))
query("x11_regimes", f"WITH {MK} SELECT date, regime, {r6('volatility', 'volatility')} FROM rg")(lambda s, d: rounded(regimes(s, d).select("date", "regime", "volatility")))
query("j1_market_join", f"WITH {MK} SELECT entity, date, regime, {r6('volatility', 'volatility')}, {r6('market_return', 'market_return')} FROM rp")(lambda s, d: rounded(month_regime_panel(s, d).select(*KEY, "regime", "volatility", "market_return")))
query("p12_bucket", f"WITH {MK} SELECT regime, count(*) AS n FROM rg GROUP BY regime")(lambda s, d: regimes(s, d).groupBy("regime").agg(F.count(F.lit(1)).alias("n")))
query("r2_regime_profile", f"""
WITH {MK}, q AS (SELECT regime, date, count(*) AS names, any_value(volatility) AS v, any_value(market_return) AS m, sum(mom3) AS s, count(mom3) AS k FROM rp GROUP BY regime, date)
SELECT regime, count(*) AS days, {r6('avg(names)', 'names_a_day')}, {r6('avg(v)', 'mean_vol')}, {r6('avg(m)', 'mean_return')}, {r6('sum(s) / sum(k)', 'mean_x')}, sum(k)::BIGINT AS n_x FROM q GROUP BY regime""")(
    lambda s, d: rounded(R.profile(month_regime_panel(s, d, "mom3"), "mom3")))
query("r4_transitions", f"""
WITH {MK}, q AS (SELECT regime, lag(regime) OVER (ORDER BY date) AS was FROM rg), n AS (SELECT was || '->' || regime AS move, count(*) AS n FROM q WHERE was <> regime GROUP BY 1)
SELECT move, n, {r6('n / (SELECT sum(n) FROM n)', 'share')} FROM n""")(lambda s, d: rounded(R.transitions(regimes(s, d))))
query("r5_around_transitions", f"""
WITH {MK}, mo AS (SELECT * FROM (SELECT date AS since, regime AS now, lag(regime) OVER (ORDER BY date) AS was FROM rg) WHERE was <> now),
pre AS (SELECT since, was, now, mom3, row_number() OVER (PARTITION BY since ORDER BY date DESC, entity DESC) AS k FROM rp JOIN mo ON date < since AND regime = was WHERE mom3 IS NOT NULL),
post AS (SELECT since, was, now, mom3, row_number() OVER (PARTITION BY since ORDER BY date, entity) AS k FROM rp JOIN mo ON date >= since AND regime = now WHERE mom3 IS NOT NULL),
a AS (SELECT since, was, now, avg(mom3) AS pre, count(*) AS n_pre FROM pre WHERE k <= 50 GROUP BY ALL), z AS (SELECT since, avg(mom3) AS post, count(*) AS n_post FROM post WHERE k <= 50 GROUP BY ALL)
SELECT since, was, now, {r6('pre', 'pre')}, n_pre, {r6('post', 'post')}, n_post, {r6('post - pre', 'change')} FROM a JOIN z USING (since) WHERE n_pre > 10 AND n_post > 10""", dates=("since",))(
    lambda s, d: rounded(R.around_transitions(month_regime_panel(s, d, "mom3"), regimes(s, d), "mom3")))
RIC = f"{MK}, rl AS (SELECT regime, date, mom3 AS x, fwd FROM rp), {ic_sql('rl', 'regime, date')}"


def regime_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once, as tests of regimes read it several times."""
    return durable(X.daily_ic(month_regime_panel(spark, sf_dir, "mom3", "fwd"), "mom3", "fwd", ("regime", "date")), "regime-ics")  # a row a date


query("r6_ic_by_regime", f"WITH {RIC}, z AS (SELECT regime, {SUMMARY} FROM ic GROUP BY regime) SELECT regime, {SUMMED} FROM z")(lambda s, d: rounded(S.ic_summary(regime_ics(s, d), "regime")))

# Tests of the correlations between regimes -------------------------------------------------------------------------------

GM = f"{RIC}, gm AS (SELECT regime, count(*) AS n, avg(ic) AS mean, var_samp(ic) AS v, var_pop(ic) AS v0, sum(ic) AS s FROM ic GROUP BY regime)"
query("i5_welch", f"""
WITH {GM}, j AS (SELECT a.regime AS a, b.regime AS b, a.n AS na, b.n AS nb, a.mean - b.mean AS diff, a.v AS va, b.v AS vb, a.v0 AS wa, b.v0 AS wb,
  ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled, a.v / a.n + b.v / b.n AS se FROM gm a JOIN gm b ON a.regime < b.regime)
SELECT a, b, na AS n_a, nb AS n_b, {r6('diff', 'diff')}, {r6('diff / sqrt(pooled * (1 / na::DOUBLE + 1 / nb::DOUBLE))', 't')}, {r6('diff / sqrt(se)', 'welch')},
  round(se * se / (va * va / (na * na * (na - 1)) + vb * vb / (nb * nb * (nb - 1))), 4) AS welch_df, {r6('diff / sqrt(pooled)', 'cohen')}, {r6('diff / sqrt((wa + wb) / 2)', 'cohen0')} FROM j""")(
    lambda s, d: rounded(S.two_samples(regime_ics(s, d), "ic", "regime"), welch_df=4))
query("i8_anova", f"WITH {GM}, t AS (SELECT sum(n)::BIGINT AS n, count(*) AS k, sum(s) AS s, sum(s * s / n) AS b, sum(v0 * n) AS w FROM gm) SELECT n, k, {r6('((b - s * s / n) / (k - 1)) / (w / (n - k))', 'f')} FROM t")(
    lambda s, d: rounded(S.anova(regime_ics(s, d), "ic", "regime")))
RANKS = f"{RIC}, rr AS (SELECT regime, round(ic, 9) AS ic, rank() OVER (ORDER BY round(ic, 9)) + (count(*) OVER (PARTITION BY round(ic, 9)) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY round(ic, 9)) AS ties FROM ic), tt AS (SELECT sum(ties * ties - 1)::DOUBLE AS t FROM rr)"
query("i9_kruskal", f"""
WITH {RANKS}, g AS (SELECT regime, count(*)::DOUBLE AS n, sum(k) AS r FROM rr GROUP BY regime), z AS (SELECT sum(n) AS n, count(*) AS k, sum(r * r / n) AS q FROM g)
SELECT n::BIGINT AS n, k, {r6('(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - (SELECT t FROM tt) / (n * n * n - n))', 'h')} FROM z""")(
    lambda s, d: rounded(S.kruskal(regime_ics(s, d).withColumn("ic", F.round("ic", 9)), "ic", "regime")))


def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mann_whitney(regime_ics(spark, sf_dir).withColumn("ic", F.round("ic", 9)), "ic", "regime")


TWO = f"{RIC}, two AS (SELECT regime, round(ic, 9) AS ic FROM ic WHERE regime <> 'EXTREME'), rr AS (SELECT *, rank() OVER (ORDER BY ic) + (count(*) OVER (PARTITION BY ic) - 1) / 2.0::DOUBLE AS k FROM two)"
query("i7_mann_whitney", f"WITH {TWO}, z AS (SELECT count(*) FILTER (regime = 'HIGH') AS n_a, count(*) FILTER (regime <> 'HIGH') AS n_b, sum(k) FILTER (regime = 'HIGH') AS r FROM rr) SELECT n_a, n_b, r - n_a * (n_a + 1) / 2.0::DOUBLE AS u FROM z")(
    lambda s, d: pairwise(s, d).where("a = 'HIGH' AND b = 'NORMAL'").select("n_a", "n_b", "u"))
query("i7_mann_whitney_pairs", f"""
WITH {RIC}, vs AS (SELECT regime, round(ic, 9) AS ic FROM ic), gs AS (SELECT DISTINCT regime FROM vs), pa AS (SELECT a.regime AS a, b.regime AS b FROM gs a JOIN gs b ON a.regime < b.regime),
rr AS (SELECT a, b, regime, rank() OVER (PARTITION BY a, b ORDER BY ic) + (count(*) OVER (PARTITION BY a, b, ic) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY a, b, ic) AS ties FROM vs JOIN pa ON regime = a OR regime = b),
z AS (SELECT a, b, count(*) FILTER (regime = a) AS n_a, count(*) FILTER (regime = b) AS n_b, sum(k) FILTER (regime = a) AS r, sum(ties * ties - 1)::DOUBLE AS t, count(*)::DOUBLE AS n FROM rr GROUP BY a, b), y AS (SELECT *, r - n_a * (n_a + 1) / 2.0::DOUBLE AS u FROM z)
SELECT a, b, n_a, n_b, u, {r6('(u - n_a * n_b / 2.0::DOUBLE) / sqrt(n_a * n_b / 12.0::DOUBLE * (n + 1 - t / (n * (n - 1))))', 'z')} FROM y""")(lambda s, d: rounded(pairwise(s, d).drop("p")))
query("i7_p_values")(lambda s, d: rounded(pairwise(s, d)))
query("i10_levene", f"""
WITH {RIC}, md AS (SELECT regime, median(ic) AS m FROM ic GROUP BY regime), dv AS (SELECT regime, abs(ic - m) AS x FROM ic JOIN md USING (regime)),
gm AS (SELECT regime, count(*) AS n, var_pop(x) AS v0, sum(x) AS s FROM dv GROUP BY regime), t AS (SELECT sum(n)::BIGINT AS n, count(*) AS k, sum(s) AS s, sum(s * s / n) AS b, sum(v0 * n) AS w FROM gm)
SELECT n, k, {r6('((b - s * s / n) / (k - 1)) / (w / (n - k))', 'w')} FROM t""")(lambda s, d: rounded(S.levene(regime_ics(s, d), "ic", "regime")))
query("i10_bartlett", f"""
WITH {GM}, t AS (SELECT sum(n)::BIGINT AS n, count(*) AS k, sum((n - 1) * v) AS ss, sum((n - 1) * ln(v)) AS logs, sum(1 / (n - 1)::DOUBLE) AS inv FROM gm)
SELECT n, k, {r6('((n - k) * ln(ss / (n - k)) - logs) / (1 + (inv - 1 / (n - k)::DOUBLE) / (3 * (k - 1)))', 'chi2')} FROM t""")(lambda s, d: rounded(S.bartlett(regime_ics(s, d), "ic", "regime")))
query("i11_normality", f"""WITH {RIC}, mo AS (SELECT avg(ic) AS m, stddev_samp(ic) AS s, count(*) AS nn FROM ic), kk AS (SELECT nn AS n, row_number() OVER (ORDER BY ic) AS k, (ic - m) / s AS z FROM ic, mo), kf AS (SELECT *, {normal_cdf('z')} AS f FROM kk),
kd AS (SELECT any_value(n) AS n, max(greatest(abs(k / n - f), abs(f - (k - 1) / n))) AS d FROM kf)
SELECT n, {r6('d', 'd')}, {r6('CASE WHEN d * sqrt(n) < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * d * d * n) FOR k IN range(1, 101)]))) END', 'p')} FROM kd""")(lambda s, d: rounded(S.kolmogorov(regime_ics(s, d), "ic")))
query("i11_shapiro_wilk", f"WITH {RIC}, {shapiro_wilk('ic', 'ic', S)} SELECT n, {r6('w', 'w')}, {r6('p', 'p')} FROM sw")(lambda s, d: rounded(S.shapiro_wilk(regime_ics(s, d), "ic")))
query("i12_fdr", f"""
WITH {IC}, z AS (SELECT factor, round(exp(-abs(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))))), 9) AS p FROM ic GROUP BY factor),
k AS (SELECT *, row_number() OVER (ORDER BY p, factor) AS k, count(*) OVER () AS m FROM z)
SELECT factor, {r6('p', 'p')}, {r6('least(1.0, p * m)', 'bonferroni')}, {r6('least(1.0, min(p * m / k) OVER (ORDER BY k DESC))', 'fdr')} FROM k""")(
    lambda s, d: rounded(S.adjusted(S.ic_summary(ics(s, d), "factor").select("factor", F.round(F.exp(-F.abs("t")), 9).alias("p")), "p", "factor")))
TIMES = " + ".join(f"(u > {c})::INT" for c in S.POISSON)
query("i13_bootstrap", f"""WITH {RIC}, bk AS (SELECT regime, ic, concat_ws('|', regime, CAST(date AS VARCHAR), row_number() OVER (PARTITION BY regime, date ORDER BY ic)) AS id FROM ic),
bd AS (SELECT regime, ic, b, (CAST(concat('0x', substr(md5(concat_ws('|', id, b, '7')), 1, 7)) AS BIGINT) + 0.5) / 268435456 AS u FROM bk, range(1000) t(b)),
bm AS (SELECT regime, b, sum(({TIMES}) * ic) / nullif(sum({TIMES}), 0) AS m FROM bd GROUP BY regime, b), bc AS (SELECT regime, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY regime)
SELECT regime, n, {r6('mean', 'mean')}, {r6('low', 'low')}, {r6('high', 'high')}, low <= 0 AND high >= 0 AS contains_zero FROM (SELECT regime, count(*) AS n, avg(ic) AS mean FROM ic GROUP BY regime HAVING count(*) >= 30) JOIN bc USING (regime)""")(lambda s, d: rounded(S.bootstrap(regime_ics(s, d), "ic", "regime", 1000, least=30)))
query("i14_ljung_box", f"""
WITH {IC}, tl AS (SELECT factor, date, ic - avg(ic) OVER (PARTITION BY factor) AS c FROM (SELECT * FROM ic QUALIFY row_number() OVER (PARTITION BY factor ORDER BY date DESC) <= 100)),
l AS (SELECT factor, c, {', '.join(f'c * lag(c, {k}) OVER w AS l{k}' for k in range(1, 11))} FROM tl WINDOW w AS (PARTITION BY factor ORDER BY date)),
s AS (SELECT factor, count(*) AS n, sum(c * c) AS v, {', '.join(f'coalesce(sum(l{k}), 0) AS s{k}' for k in range(1, 11))} FROM l GROUP BY factor)
SELECT factor, n, {r6('n * (n + 2) * (' + ' + '.join(f'pow(s{k} / v, 2) / (n - {k})' for k in range(1, 11)) + ')', 'q')} FROM s WHERE n > 10""")(lambda s, d: rounded(S.ljung_box(ics(s, d), "ic", "factor")))
query("a16_corr_matrix", f"WITH {F0}, c AS (SELECT * FROM f0 WHERE mom3 IS NOT NULL AND mom6 IS NOT NULL AND vol6 IS NOT NULL AND vr IS NOT NULL AND amp IS NOT NULL) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'abs(corr({a}, {b}))', 'c')} FROM c" for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]))(lambda s, d: rounded(S.correlations(factor_panel(s, d), FACTORS)))
query("i15_screen", f"{WITH_P} SELECT factor, {SUMMED}, {r6('p', 'p')}, {STARS} FROM zp WHERE abs(ic_mean) >= 0.01 AND p < 0.05 AND n >= 60")(lambda s, d: rounded(S.screened(S.with_p(S.ic_summary(ics(s, d), "factor")))))


@query("i16_greedy", f"""
WITH RECURSIVE {IC}, z AS (SELECT factor, row_number() OVER (ORDER BY round(abs(avg(ic)), 9) DESC, factor) AS i FROM ic GROUP BY factor),
c AS (SELECT * FROM f0 WHERE mom3 IS NOT NULL AND mom6 IS NOT NULL AND vol6 IS NOT NULL AND vr IS NOT NULL AND amp IS NOT NULL),
m AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS c FROM c" for a in FACTORS for b in FACTORS if a != b)}),
g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept UNION ALL
  SELECT g.i + 1, CASE WHEN coalesce((SELECT max(m.c) FROM m WHERE m.a = z.factor AND list_contains(g.kept, m.b)), 0) < 0.3 THEN list_append(g.kept, z.factor) ELSE g.kept END FROM g JOIN z ON z.i = g.i + 1)
SELECT unnest(kept) AS factor, (generate_subscripts(kept, 1) - 1)::INT AS pos FROM g WHERE i = 5""")
def i16(s: SparkSession, d: str) -> DataFrame:
    order = [r["factor"] for r in S.ic_summary(ics(s, d), "factor").orderBy(F.round(F.abs("ic_mean"), 9).desc(), "factor").collect()]
    corr = {(r["a"], r["b"]): r["c"] for r in S.correlations(factor_panel(s, d), FACTORS).collect()}
    return s.createDataFrame(list(enumerate(S.decorrelated(order, corr, 0.3))), "pos int, factor string").select("factor", "pos")


@query("i17_regime_factors")
def i17(s: SparkSession, d: str) -> DataFrame:
    """By day: the screen asks for 60 dates of a regime, and no regime has as many months, however large the tables are."""
    wide = regime_panel(s, d)
    by = X.daily_ics(wide, FACTORS, "fwd", ("regime", "date"))
    return s.createDataFrame(S.selected(by, wide, "regime"), "regime string, pos int, factor string")


@query("x9_sign_align", f"""
WITH {IC}, sg AS (SELECT CASE WHEN avg(ic) < 0 AND count(*) >= 30 THEN -1.0 ELSE 1.0 END AS s FROM ic WHERE factor = 'vol6')
SELECT entity, date, {r6('vol6 * s', 'vol6')} FROM f0, sg""")
def x9(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.aligned(factor_panel(s, d), ics(s, d), ["vol6"], 30).select(*KEY, "vol6"))


Q_X = "SELECT l_quantity / 10 AS x, count(*) AS n FROM lineitem GROUP BY l_quantity"
query("special_functions", f"""SELECT x, n, {r6(t_two_sided('x', '10'), 't10')}, {r6('pow(1 + 2 * x / 30, -15)', 'f')}, {r6('exp(-x / 2) * (1 + x / 2)', 'chi2')}, round(2 * (1 - {normal_cdf('x')}), 4) + 0.0 AS z FROM ({Q_X})""")(
    lambda s, d: rounded(table(s, d, "lineitem").groupBy((F.col("l_quantity") / 10).alias("x")).agg(F.count(F.lit(1)).alias("n")).select(
        "x", "n", special.arrow(lambda x: special.t_two_sided(x, 10), "x").alias("t10"), special.arrow(lambda x: special.f_upper(x, 2, 30), "x").alias("f"),
        special.arrow(lambda x: special.chi2_upper(x, 4), "x").alias("chi2"), special.arrow(special.normal_two_sided, "x").alias("z")), z=4))
