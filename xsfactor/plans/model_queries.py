"""Models on suppliers by month; factors are standardised by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.windows import indexed
from ..operators import cross as X
from ..operators import models as M
from ..operators import portfolio as P
from ..operators import regimes as R
from ..operators import stats as S
from ..operators import walk as W
from ..operators.scan import Setting, holdings
from . import sql_models as Q
from .catalog import query, r6, rounded
from .factor_queries import GAUSS, KEY, PRED, Z, momenta, predictions
from .ic_queries import F0, MK, SUMMARY, SUMMED, factor_panel, ic_sql, month_regime_panel
from .portfolio_queries import SCORES, SERIES, bands, book, costed, tagged

DAYS, LEAST = 1095, 200
XS = ["mom3_std", "vr_std", "amp_std"]
FS = f"{F0}, fs AS (SELECT entity, date, fwd, {', '.join(f'{Z.format(x=x)} AS {x}_std' for x in ('mom3', 'vr', 'amp'))} FROM f0)"
CROSSED = ["mom3_std", "vr_std", "amp_std", "ab", "ac"]
FX = f"{FS}, fy AS (SELECT *, mom3_std * vr_std AS ab0, mom3_std * amp_std AS ac0 FROM fs), fx AS (SELECT *, (ab0 - avg(ab0) OVER w) / (stddev_samp(ab0) OVER w + 1e-9) AS ab, (ac0 - avg(ac0) OVER w) / (stddev_samp(ac0) OVER w + 1e-9) AS ac FROM fy WINDOW w AS (PARTITION BY date))"
RS = f"{MK}, fs AS (SELECT entity, date, regime, fwd, {', '.join(f'{Z.format(x=x)} AS {x}_std' for x in ('mom3', 'vr', 'amp'))} FROM rp)"


def standard(spark: SparkSession, sf_dir: str, regime: bool | str = False) -> DataFrame:
    """Standardised factors, made once however often they are read. regime: rows with one; "all": others too, with null."""
    base = durable(factor_panel(spark, sf_dir).select(*KEY, "fwd", "r", "mom3", "vr", "amp"), "panel")
    z = X.standardised_in_place(base, "mom3", "vr", "amp").select(*KEY, "fwd", "r", *XS)
    if not regime:
        return z.drop("r")
    m = R.with_regime(R.with_volatility(R.market(base), 6, 12.0)).select("date", "regime")
    return z.drop("r").join(m, "date", "left" if regime == "all" else "inner")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One factor x and the label y (missing at an entity's end)."""
    z = X.standardised(momenta(spark, sf_dir).where("mom is not null"), "mom")
    return z.select(*KEY, "industry", F.round("mom_std", 9).alias("x"), F.col("fwd").alias("y")).where("x is not null")


XY = f"{PRED}, xy AS (SELECT entity, date, industry, y_pred AS x, y_true AS y FROM pr WHERE y_pred IS NOT NULL), dg AS (SELECT date, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM xy WHERE y IS NOT NULL GROUP BY date)"


def ridge_sql(days: str, alpha: str, settings: str) -> str:
    return f"""{XY}, st AS ({settings}), wd AS (SELECT st.*, d.date, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM (SELECT DISTINCT date FROM xy) d, st, dg
  WHERE dg.date >= d.date - CAST({days} AS INTEGER) AND dg.date < d.date GROUP BY ALL HAVING sum(n) >= {LEAST}),
bt AS (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n + {alpha}) AS beta FROM wd), pp AS (SELECT xy.*, bt.* EXCLUDE (date, n, sx, sy, sxx, sxy), n AS n_train, sy / n - beta * sx / n + beta * x AS p FROM xy JOIN bt USING (date))"""


query("m1_ridge_walk_forward", f"WITH {ridge_sql(str(DAYS), '1.0', 'SELECT 1 AS one')} SELECT entity, date, {r6('p', 'y_pred')}, n_train FROM pp")(
    lambda s, d: rounded(M.walk_forward(scores(s, d), ["x"], "y", DAYS, 1.0, LEAST).select(*KEY, "y_pred", "n_train")))
query("m1_ridge_many", f"WITH {FS}, {Q.walk_forward('fs', XS, 'fwd', DAYS, 1.0, LEAST)} SELECT entity, date, {r6('p', 'y_pred')}, n_train FROM pp")(lambda s, d: rounded(M.walk_forward(standard(s, d), XS, "fwd", DAYS, 1.0, LEAST).select(*KEY, "y_pred", "n_train")))
OWN = {"NORMAL": XS[:2], "HIGH": XS[1:], "EXTREME": XS[:1]}
OWN_SQL = ", ".join(f"{g[:1]} AS (SELECT * FROM fs WHERE regime = '{g}'), {Q.walk_forward(g[:1], xs, 'fwd', DAYS, 1.0, 100, tag='_' + g)}" for g, xs in OWN.items())
query("m2_ridge_by_regime", f"WITH {RS}, {OWN_SQL} " + " UNION ALL ".join(f"SELECT entity, date, regime, {r6('fwd', 'y_true')}, {r6('p', 'y_pred')} FROM pp_{g}" for g in OWN), dates=("date",))(lambda s, d: rounded(M.walk_forward_by_regime(standard(s, d, True), OWN, "fwd", DAYS, 1.0, 100)))


@query("m3_ridge", f"WITH {XY}, t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM dg), be AS (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n + 2.0) AS beta FROM t) SELECT {r6('sy / n - beta * sx / n', 'intercept')}, {r6('beta', 'beta')}, n FROM be")
def m3(s: SparkSession, d: str) -> DataFrame:
    one = M.solved(M.sums(scores(s, d), ["x"], "y"), 2.0, 1)
    return rounded(one.select(F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("beta"), "n"))


query("m4_scaled_ridge", f"WITH {FS}, {Q.walk_forward('fs', XS, 'fwd', DAYS, 1.0, max(LEAST, 15 * len(XS)), scaled=True)} SELECT entity, date, {r6('p', 'y_pred')} FROM pp")(lambda s, d: rounded(M.walk_forward(standard(s, d), XS, "fwd", DAYS, 1.0, max(LEAST, 15 * len(XS)), scaled=True).select(*KEY, "y_pred")))
#: The same model by a factory, fitted on rows: the SQL is that of m4_scaled_ridge.
query("m4_any_model", f"WITH {FS}, {Q.walk_forward('fs', XS, 'fwd', DAYS, 1.0, max(LEAST, 15 * len(XS)), scaled=True)} SELECT entity, date, {r6('p', 'y_pred')} FROM pp")(lambda s, d: rounded(W.walk_forward(standard(s, d), XS, "fwd", DAYS, W.Ridge, LEAST).select(*KEY, "y_pred")))
query("m4_robust")(lambda s, d: rounded(W.walk_forward(standard(s, d), XS, "fwd", DAYS, W.Huber, LEAST)))
query("m4_robust_by_regime")(lambda s, d: rounded(W.walk_forward(standard(s, d, True), OWN, "fwd", DAYS, W.Huber, 100, by="regime")))
query("m5_elastic_net")(lambda s, d: rounded(M.walk_forward(standard(s, d), XS, "fwd", DAYS, 0.01, LEAST, l1=0.5).select(*KEY, "y_pred")))
query("m6_ridge_interactions", f"WITH {FX}, {Q.walk_forward('fx', CROSSED, 'fwd', DAYS, 1.0, LEAST)} SELECT entity, date, {r6('p', 'y_pred')} FROM pp")(lambda s, d: rounded(M.walk_forward(X.interactions(standard(s, d), [("mom3_std", "vr_std"), ("mom3_std", "amp_std")]), [*XS, "mom3_std_x_vr_std", "mom3_std_x_amp_std"], "fwd", DAYS, 1.0, LEAST).select(*KEY, "y_pred")))


@query("m5_elastic_grid")
def m5(s: SparkSession, d: str) -> DataFrame:
    """Penalties x l1 shares, graded as portfolios."""
    return rounded(M.graded_grid(standard(s, d), XS, "fwd", [DAYS], [0.001, 0.01, 0.1], LEAST, [0.1, 0.3, 0.5, 0.7], cost_bps=5.0, year=12.0).drop("days"))


@query("m7_boosting")
def m7(s: SparkSession, d: str) -> DataFrame:
    return rounded(W.boosted_walk_forward(standard(s, d), XS, "fwd", DAYS, LEAST))


SLOPES = f"{XY}, sl AS (SELECT date, count(*) AS n, covar_pop(x, y) / var_pop(x) AS beta, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS alpha, covar_pop(x, y) * covar_pop(x, y) / nullif(var_pop(x) * var_pop(y), 0) AS r2 FROM xy WHERE y IS NOT NULL GROUP BY date HAVING count(*) >= 10 AND var_pop(x) > 0)"
FMB = "avg(beta) AS b, stddev_samp(beta) AS sd, avg(beta) / nullif(stddev_samp(beta) / sqrt(count(beta)), 0) AS t, count(beta) AS n, avg(r2) AS r2, median(r2) AS r2_median"
FMB_OUT = f"{r6('b', 'beta')}, {r6('sd', 'sd')}, {r6('t', 't')}, n, {r6('r2', 'r2')}, {r6('r2_median', 'r2_median')}"
query("m8_daily_ols", f"WITH {SLOPES} SELECT date, n, {r6('beta', 'beta')}, {r6('alpha', 'alpha')}, {r6('r2', 'r2')} FROM sl")(lambda s, d: rounded(M.slopes(scores(s, d), "x", "y")))
query("m8_daily_ols_many", f"WITH {FS}, {Q.daily('fs', XS, 'fwd', 10)} SELECT date, n, {', '.join(r6(f'c_{k}', f'c_{k}') for k in range(4))}, {r6('r2', 'r2')}, {r6('adj_r2', 'adj_r2')} FROM ols")(
    lambda s, d: rounded(M.daily_ols(standard(s, d), XS, "fwd").select("date", "n", *(F.col("coef")[k].alias(f"c_{k}") for k in range(4)), "r2", "adj_r2")))
query("m9_fama_macbeth", f"WITH {SLOPES}, z AS (SELECT {FMB} FROM sl) SELECT {FMB_OUT} FROM z")(lambda s, d: rounded(M.fama_macbeth(M.slopes(scores(s, d), "x", "y"))))
query("m10_diagnostics", f"""WITH {SLOPES} SELECT {r6('min(r2)', 'r2_min')}, {r6('quantile_cont(r2, 0.25)', 'r2_q25')}, {r6('quantile_cont(r2, 0.75)', 'r2_q75')}, {r6('max(r2)', 'r2_max')}, count(*) FILTER (r2 < 0.05) AS low_r2, count(*) FILTER (r2 > 0.3) AS high_r2,
  {r6('stddev_samp(beta) / abs(avg(beta))', 'cv')}, {r6('greatest(count(*) FILTER (beta > 0), count(*) FILTER (beta < 0)) / count(beta)', 'same_sign')}, count(*) FILTER (n < 15) AS thin_days FROM sl""")(lambda s, d: rounded(M.diagnostics(M.slopes(scores(s, d), "x", "y"))))
RSL = f"{MK}, rs AS (SELECT regime, date, count(*) AS n, covar_pop(mom3, fwd) / var_pop(mom3) AS beta, covar_pop(mom3, fwd) * covar_pop(mom3, fwd) / nullif(var_pop(mom3) * var_pop(fwd), 0) AS r2 FROM rp WHERE mom3 IS NOT NULL AND fwd IS NOT NULL GROUP BY regime, date HAVING count(*) >= 5 AND var_pop(mom3) > 0)"


def regime_slopes(s: SparkSession, d: str) -> DataFrame:
    return M.slopes(month_regime_panel(s, d, "mom3", "fwd"), "mom3", "fwd", 5, "regime")


query("m11_conditional_fmb", f"WITH {RSL}, z AS (SELECT regime, {FMB} FROM rs GROUP BY regime HAVING count(beta) >= 6) SELECT regime, {FMB_OUT} FROM z")(lambda s, d: rounded(M.fama_macbeth(regime_slopes(s, d), "regime", least=6)))
query("m12_pairwise", f"""WITH {RSL}, g AS (SELECT regime, count(beta) AS n, avg(beta) AS m, var_samp(beta) AS v FROM rs GROUP BY regime), j AS (SELECT a.regime AS a, b.regime AS b, a.m - b.m AS diff, a.v AS va, b.v AS vb, a.n AS na, b.n AS nb, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled FROM g a JOIN g b ON a.regime < b.regime)
SELECT a, b, {r6('diff', 'diff')}, {r6('diff / sqrt(pooled * (1 / na::DOUBLE + 1 / nb::DOUBLE))', 't')}, {r6('diff / sqrt(pooled)', 'cohen')} FROM j""")(lambda s, d: rounded(S.two_samples(regime_slopes(s, d), "beta", "regime").select("a", "b", "diff", "t", "cohen")))
query("m13_effects", f"WITH {RSL}, z AS (SELECT regime, avg(beta) / nullif(stddev_samp(beta) / sqrt(count(beta)), 0) AS t FROM rs GROUP BY regime) SELECT regime, CASE WHEN abs(t) > 2.576 THEN 'strong' WHEN abs(t) > 1.96 THEN 'medium' ELSE 'weak' END AS effect, (rank() OVER (ORDER BY round(abs(t), 9) DESC))::INT AS place FROM z")(
    lambda s, d: M.fama_macbeth(regime_slopes(s, d), "regime").select("regime", F.when(F.abs("t") > 2.576, "strong").when(F.abs("t") > 1.96, "medium").otherwise("weak").alias("effect"), F.rank().over(Window.orderBy(F.round(F.abs("t"), 9).desc())).alias("place")))
GRID = "SELECT * FROM (VALUES (730), (1095)) a(days), (VALUES (0.5::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)) b(alpha)"
query("m14_grid", f"WITH {ridge_sql('days', 'alpha', GRID)} SELECT days, alpha, count(*) AS n, {r6('avg(p)', 'mean_pred')}, round(avg((p - y) * (p - y)), 4) AS mse FROM pp GROUP BY days, alpha")(
    lambda s, d: rounded(M.model_grid(scores(s, d), ["x"], "y", [730, 1095], [0.5, 2.0, 5.0], LEAST).groupBy("days", "alpha").agg(F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_pred"), F.avg((F.col("y_pred") - F.col("y")) * (F.col("y_pred") - F.col("y"))).alias("mse")), mse=4))
WINDOWS, PENALTIES = [504, 756, 1008], [0.2, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0]


@query("m15_regime_grid", f"""WITH {MK}, xy AS (SELECT entity, date, regime, mom3 AS x, fwd AS y FROM rp WHERE mom3 IS NOT NULL), dg AS (SELECT regime, date, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM xy WHERE y IS NOT NULL GROUP BY regime, date),
wd AS (SELECT days, d.regime, d.date, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM (SELECT DISTINCT regime, date FROM rp) d, (SELECT unnest({WINDOWS}) AS days), dg
  WHERE dg.regime = d.regime AND dg.date >= d.date - CAST(days AS INTEGER) AND dg.date < d.date GROUP BY ALL HAVING sum(n) >= {LEAST}),
bt AS (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n + alpha) AS beta FROM wd, (SELECT unnest({PENALTIES})::DOUBLE AS alpha)), pp AS (SELECT xy.*, days, alpha, sy / n - beta * sx / n + beta * x AS p FROM xy JOIN bt USING (regime, date))
SELECT days, alpha, regime, count(*) AS n, {r6('avg(p)', 'mean_pred')}, round(avg((p - y) * (p - y)), 4) AS mse FROM pp GROUP BY ALL""")
def m15_one(s: SparkSession, d: str) -> DataFrame:
    """Each regime with its own training rows, one factor: all windows and penalties."""
    p = M.model_grid_by_regime(month_regime_panel(s, d, "mom3", "fwd"), dict.fromkeys(OWN, ["mom3"]), "fwd", WINDOWS, PENALTIES, LEAST)
    off = F.col("y_pred") - F.col("y_true")
    return rounded(p.groupBy("days", "alpha", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("y_pred").alias("mean_pred"), F.avg(off * off).alias("mse")), mse=4)


@query("m14_grid_use_regime")
def m14(s: SparkSession, d: str) -> DataFrame:
    """With training rows of the date's regime only, and with all: windows x penalties each."""
    base, windows, alphas = standard(s, d, "all"), [504, 756], [0.5, 1.0, 2.0, 5.0]
    own = M.graded_grid(base, dict.fromkeys(OWN, XS), "fwd", windows, alphas, 1000, year=12.0).select(F.lit(True).alias("use_regime"), "*")
    pooled = M.graded_grid(base.drop("regime"), XS, "fwd", windows, alphas, 1000, year=12.0).select(F.lit(False).alias("use_regime"), "*")
    return rounded(own.unionByName(pooled))


@query("m15_regime_specific_grid")
def m15(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.graded_grid(standard(s, d, True), OWN, "fwd", WINDOWS, PENALTIES, 800, cost_bps=5.0, year=12.0))


def modelled(s: SparkSession, d: str, days: int = DAYS, alpha: float = 1.0) -> DataFrame:
    return M.walk_forward(scores(s, d), ["x"], "y", days, alpha, LEAST).select(*KEY, F.round("y_pred", 9).alias("y_pred"), F.col("y").alias("y_true")).where("y_true is not null")


MODELLED = f"""{ridge_sql(str(DAYS), '1.0', 'SELECT 1 AS one')}, mo AS (SELECT entity, date, round(p, 9) AS y_pred, y AS y_true FROM pp WHERE y IS NOT NULL)"""
query("m16_cost_breadth", f"WITH {MODELLED}, {', '.join(book('mo', n, n, f'_{n}') for n in (5, 10))} " + " UNION ALL ".join(f"SELECT 'baseline' AS strategy, 'None' AS param, {n} AS top_n, * FROM ({costed(f'_{n}', [3, 5, 10])})" for n in (5, 10)))(
    lambda s, d: rounded(P.grid(modelled(s, d), [("baseline", None, 5), ("baseline", None, 10)], [3, 5, 10])))
#: The short leg is a share of the long one, rounded half to even, one name at least.
LEGS17 = [(days, alpha, n, max(1, round(n * share))) for days in (730, 1095) for alpha in (1.0, 5.0) for n, share in ((5, 1.0), (5, 0.5), (10, 0.7))]
GRID17 = "SELECT * FROM (VALUES (730), (1095)) a(days), (VALUES (1.0::DOUBLE), (5.0::DOUBLE)) b(alpha)"


@query("m17_cost_grid", f"WITH {ridge_sql('days', 'alpha', GRID17)}, " + ", ".join(f"mo_{k} AS (SELECT entity, date, round(p, 9) AS y_pred, y AS y_true FROM pp WHERE y IS NOT NULL AND days = {days} AND alpha = {alpha}), {book(f'mo_{k}', n, m, f'_{k}')}" for k, (days, alpha, n, m) in enumerate(LEGS17)) + " " + " UNION ALL ".join(
    f"SELECT {days} AS days, {alpha}::DOUBLE AS alpha, {n} AS top_n, {m} AS bottom_n, * FROM ({costed(f'_{k}', [3, 5])})" for k, (days, alpha, n, m) in enumerate(LEGS17)))
def m17(s: SparkSession, d: str) -> DataFrame:
    """Models are fitted once for a window and penalty; the breadths of both legs and the costs come after."""
    all_ = M.model_grid(scores(s, d), ["x"], "y", [730, 1095], [1.0, 5.0], LEAST).select(*KEY, "days", "alpha", F.round("y_pred", 9).alias("y_pred"), F.col("y").alias("y_true")).where("y_true is not null")
    cases = s.createDataFrame([(k, *x) for k, x in enumerate(LEGS17)], "id int, days int, alpha double, top_n int, bottom_n int")
    w = Window.partitionBy("days", "alpha", "date")
    placed = all_.withColumns({"up": F.row_number().over(w.orderBy(*X.order("y_pred"))), "down": F.row_number().over(w.orderBy(*X.order("y_pred", False)))})
    sides = F.array_compact(F.array(F.when(F.col("up") <= F.col("top_n"), F.lit("long")), F.when(F.col("down") <= F.col("bottom_n"), F.lit("short"))))
    held = placed.join(F.broadcast(cases), ["days", "alpha"]).select("id", "date", "entity", F.explode(sides).alias("side"))
    returns = all_.select("date", "entity", "y_true").distinct()  # a name's return hangs on no model
    day = P.series(held, returns, 0.0, "id").withColumn("cost_bps", F.explode(F.array(F.lit(3.0), F.lit(5.0))))
    found = P.metrics(P.with_drawdown(P.with_cost(day, F.col("cost_bps")), "id", "cost_bps"), "id", "cost_bps")
    return rounded(found.join(F.broadcast(cases), "id").drop("id"))


STARTS, SPANS = ("1998-01-01", "1999-01-01", "2000-01-01"), (756, 900, 1008)
CASES = [(days, start) for days in SPANS for start in STARTS]


@query("m18_robustness", f"WITH RECURSIVE {ridge_sql('days', '1.0', 'SELECT unnest([756, 900, 1008]) AS days')}, " + ", ".join(
    f"mo_{k} AS (SELECT entity, date, round(p, 9) AS y_pred, y AS y_true FROM pp WHERE y IS NOT NULL AND days = {days} AND date >= DATE '{start}'), " + tagged(f"{bands(SCORES, 2)}, {SERIES.format(index='hy', held='hy')}", f"mo_{k}", f"_{k}") for k, (days, start) in enumerate(CASES)
) + " " + " UNION ALL ".join(f"SELECT '{start}' AS start, {days} AS days, * EXCLUDE (cost_bps) FROM ({costed(f'_{k}', [5])})" for k, (days, start) in enumerate(CASES)))
def m18(s: SparkSession, d: str) -> DataFrame:
    """Models are fitted once for all windows, and all cases' bands are one scan."""
    p = M.model_grid(scores(s, d), ["x"], "y", list(SPANS), [1.0], LEAST).where("y is not null").select(*KEY, "days", F.round("y_pred", 9).alias("s"), F.col("y").alias("y_true"))
    p = durable(p.withColumn("start", F.explode(F.array(*map(F.lit, STARTS)))).where(F.col("date") >= F.col("start").cast("date")), "cases")
    variant = lambda days, start: F.concat_ws("|", F.col(days).cast("string"), F.col(start))
    held = holdings(p.select(variant("days", "start").alias("variant"), "date", "entity", "s"), [Setting(i, f"{days}|{start}", P.banded(5, 2), 7) for i, (days, start) in enumerate(CASES)])
    day = P.series(held, p.select("date", "entity", "y_true").distinct(), 5.0, "id", index=indexed(p))
    cases = s.createDataFrame([(i, days, start) for i, (days, start) in enumerate(CASES)], "id int, days int, start string")
    return rounded(P.metrics(P.with_drawdown(day, "id"), "id").join(F.broadcast(cases), "id").drop("id"))


FIGURES = ["ic_mean", "ic_std", "ic_median", "ic_ir", "win_rate", "abs_ic", "n", "t", "n_days", "long_mean", "short_mean", "ls_mean", "ls_ann", "ls_ir", "ls_win_rate", "avg_turnover", "max_drawdown"]


def compared(kinds: dict[str, DataFrame], n: int = 5, cost_bps: float = 5.0, year: float = 12.0) -> DataFrame:
    """For two kinds of scores (entity, date, y_pred, y_true) correlations and portfolio figures, and the second less the first."""
    out = None
    for kind, p in kinds.items():
        ic = S.ic_summary(X.daily_ic(p, "y_pred", "y_true")).withColumn("kind", F.lit(kind))
        day = P.with_drawdown(P.series(P.legs(p, n, n), p, cost_bps))
        part = rounded(ic.join(P.metrics(day, year=year).withColumn("kind", F.lit(kind)), "kind"))
        out = part if out is None else out.unionByName(part)
    a, b = kinds
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    less = out.agg(F.lit(f"{b} - {a}").alias("kind"), *((of(b, c) - of(a, c)).alias(c) for c in FIGURES))
    return rounded(out.unionByName(less))


def compared_sql(tables: str, a: tuple[str, str], b: tuple[str, str]) -> str:
    """(kind, its table of scores) twice; tables ends with both."""
    ic = ", ".join(f"qi{k} AS (SELECT date, y_pred AS x, y_true AS y FROM {t}), {ic_sql(f'qi{k}', 'date', 'y', name=f'ic{k}')}" for k, (_, t) in enumerate((a, b)))
    books = ", ".join(book(t, 5, 5, f"_{k}") for k, (_, t) in enumerate((a, b)))
    each = ", ".join(f"z{k} AS (SELECT '{kind}' AS kind, i.*, m.* EXCLUDE (cost_bps) FROM (SELECT {SUMMED} FROM (SELECT {SUMMARY} FROM ic{k})) i, ({costed(f'_{k}', [5], 12)}) m)" for k, (kind, _) in enumerate((a, b)))
    less = ", ".join(f"round(z1.{c} - z0.{c}, 6) + 0.0 AS {c}" if c not in ("n", "n_days") else f"z1.{c} - z0.{c} AS {c}" for c in FIGURES)
    return f"WITH {tables}, {ic}, {books}, {each} SELECT kind, {', '.join(FIGURES)} FROM z0 UNION ALL SELECT kind, {', '.join(FIGURES)} FROM z1 UNION ALL SELECT z1.kind || ' - ' || z0.kind AS kind, {less} FROM z0, z1"


@query("m19_zscore_vs_rank", compared_sql(f"""{GAUSS}, kz AS (SELECT entity, date, round({Z.format(x='mom')}, 9) AS y_pred, fwd AS y_true FROM m WHERE mom IS NOT NULL),
sz AS (SELECT * FROM kz WHERE y_pred IS NOT NULL AND y_true IS NOT NULL), sr AS (SELECT entity, date, round(g, 9) AS y_pred, fwd AS y_true FROM gg WHERE g IS NOT NULL AND fwd IS NOT NULL), pd AS (SELECT * FROM sz)""", ("zscore", "sz"), ("rank", "sr")))
def m19(s: SparkSession, d: str) -> DataFrame:
    base = durable(momenta(s, d), "momenta")
    g = X.rank_gauss(base, "mom", "y_pred").select(*KEY, F.round("y_pred", 9).alias("y_pred"), F.col("fwd").alias("y_true")).where("y_pred is not null and y_true is not null")
    return compared({"zscore": predictions(s, d, base), "rank": durable(g, "rank")})


@query("m20_neutral_vs_baseline", compared_sql(f"{PRED}, nq AS (SELECT entity, date, round(y_pred - avg(y_pred) OVER (PARTITION BY date, industry), 9) AS y_pred, y_true FROM pd WHERE industry IS NOT NULL)", ("baseline", "pd"), ("neutral", "nq")))
def m20(s: SparkSession, d: str) -> DataFrame:
    z = predictions(s, d)
    return compared({"baseline": z, "neutral": durable(X.neutralised(z, ["y_pred"]).withColumn("y_pred", F.round("y_pred", 9)), "neutral")})


@query("m21_scenarios")
def m21(s: SparkSession, d: str) -> DataFrame:
    """Rank correlations and portfolio figures of each scenario, and how far its information ratio is from plain ridge."""
    base = standard(s, d)
    crossed = X.interactions(base, [("mom3_std", "vr_std"), ("mom3_std", "amp_std")])
    more = [*XS, "mom3_std_x_vr_std", "mom3_std_x_amp_std"]
    kinds = {"ridge": (base, XS, {}), "scaled": (base, XS, {"scaled": True}), "net": (base, XS, {"l1": 0.5}), "interactions": (crossed, more, {})}
    found = {name: M.walk_forward(rows, xs, "fwd", DAYS, 0.1, LEAST, **extra).withColumn("y_true", F.col("fwd")) for name, (rows, xs, extra) in kinds.items()}
    found |= {"boosting": W.boosted_walk_forward(base, XS, "fwd", DAYS, LEAST), "robust": W.walk_forward(base, XS, "fwd", DAYS, W.Huber, LEAST)}
    out = None
    for name, p in found.items():
        p = p.select(*KEY, F.round("y_pred", 9).alias("y_pred"), "y_true", F.lit(name).alias("scenario"))
        out = p if out is None else out.unionByName(p)
    found = M.graded(out, "scenario", year=12.0)
    plain = F.max(F.when(F.col("scenario") == "ridge", F.col("ic_ir"))).over(Window.partitionBy(F.lit(0)))  # a row a scenario
    return rounded(found.withColumn("ic_ir_diff", F.col("ic_ir") - plain))


@query("m22_empty_safe", f"""WITH {PRED}, w AS (SELECT unnest(['all', 'none']) AS scenario), q AS (SELECT 'all' AS scenario, count(DISTINCT date) AS n_days, avg(y_true) AS m FROM pd)
SELECT scenario, coalesce(n_days, 0) AS n_days, {r6('m', 'm')} FROM w LEFT JOIN q USING (scenario)""")
def m22(s: SparkSession, d: str) -> DataFrame:
    p = predictions(s, d)
    found = p.agg(F.countDistinct("date").alias("n_days"), F.avg("y_true").alias("m")).select(F.lit("all").alias("scenario"), "n_days", "m")
    return rounded(M.scenario_rows(s.createDataFrame([("all",), ("none",)], "scenario string"), found, ["scenario"]))
