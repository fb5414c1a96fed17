"""Portfolios on suppliers by month: scores are standardised momenta."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cross as X
from ..operators import portfolio as P
from .catalog import query, r6, rounded
from .factor_queries import PRED, predictions
from .ic_queries import MK, regimes

N = 5
LEGS = """sc AS ({scores}), mb AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, entity) AS place, row_number() OVER (PARTITION BY date ORDER BY s, entity DESC) AS ends FROM sc),
lg AS (SELECT date, 'long' AS side, entity FROM mb WHERE place <= 5 UNION ALL SELECT date, 'short', entity FROM mb WHERE ends <= 5)"""
SCORES = "SELECT date, entity, y_pred AS s, y_true FROM pd"
SERIES = """dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM {index})),
hh AS (SELECT a.*, idx FROM {held} a JOIN dx USING (date)),
hk AS (SELECT a.date, a.idx, a.side, a.entity, b.entity IS NOT NULL AS kept, y_true FROM hh a LEFT JOIN hh b ON a.side = b.side AND a.entity = b.entity AND a.idx = b.idx + 1 LEFT JOIN pd ON pd.date = a.date AND pd.entity = a.entity),
dy AS (SELECT date, idx, avg(y_true) FILTER (side = 'long') AS long, avg(y_true) FILTER (side = 'short') AS short,
  count(*) FILTER (side = 'long') AS nl, count(*) FILTER (side = 'short') AS ns, count(*) FILTER (side = 'long' AND kept) AS kl, count(*) FILTER (side = 'short' AND kept) AS ks FROM hk GROUP BY date, idx),
se AS (SELECT date, idx, long, short, round(long - short, 12) AS ls_gross, kl / greatest(1, nl) AS overlap_long, ks / greatest(1, ns) AS overlap_short, (1 - kl / greatest(1, nl)) + (1 - ks / greatest(1, ns)) AS turnover,
  nl - kl AS added_long, ns - ks AS added_short, coalesce(lag(nl) OVER (ORDER BY idx), 0) - kl AS removed_long, coalesce(lag(ns) OVER (ORDER BY idx), 0) - ks AS removed_short FROM dy WHERE long - short IS NOT NULL)"""
OUT = ", ".join(r6(c, c) for c in ("long", "short", "ls_gross", "turnover", "overlap_long", "overlap_short"))
NET = "round(ls_gross - 5.0 / 10000 * turnover, 6) + 0.0 AS ls_net"
BASE = f"{PRED}, {LEGS.format(scores=SCORES)}, {SERIES.format(index='lg', held='lg')}"
SHOWN = ["date", "long", "short", "ls_gross", "turnover", "overlap_long", "overlap_short", "ls_net"]
DRAW = "cu AS (SELECT *, ls_gross - 5.0 / 10000 * turnover AS ls_net, sum(ls_gross - 5.0 / 10000 * turnover) OVER (ORDER BY date) AS cum FROM se), dr AS (SELECT *, cum - max(cum) OVER (ORDER BY date) AS drawdown FROM cu)"
METRICS = "count(*) AS n_days, avg(long) AS long_mean, avg(short) AS short_mean, avg(ls_net) AS ls_mean, avg(ls_net) * 12 AS ls_ann, avg(ls_net) / (stddev_samp(ls_net) + 1e-12) * sqrt(12.0) AS ls_ir, avg((ls_net > 0)::INT) AS ls_win_rate, avg(turnover) AS avg_turnover, min(drawdown) AS max_drawdown"
METRIC_OUT = "n_days, " + ", ".join(r6(c, c) for c in ("long_mean", "short_mean", "ls_mean", "ls_ann", "ls_ir", "ls_win_rate", "avg_turnover", "max_drawdown"))


def baseline(spark: SparkSession, sf_dir: str, cost: float = 5.0) -> DataFrame:
    p = predictions(spark, sf_dir)
    return P.series(P.legs(p, N, N), p, cost)


query("e1_baseline", f"WITH {BASE} SELECT date, {OUT}, {NET}, added_long, added_short, removed_long, removed_short FROM se")(
    lambda s, d: rounded(baseline(s, d).select(*SHOWN, "added_long", "added_short", "removed_long", "removed_short")))
query("e2_evaluate", f"WITH {BASE} SELECT date, {OUT}, {NET} FROM se WHERE date IN (SELECT date FROM sc GROUP BY date HAVING count(*) >= 2)", dates=("date",))(lambda s, d: rounded(P.evaluated(predictions(s, d), N, N, 5.0).select(*SHOWN)))
query("e3_low_freq", f"""
WITH {PRED}, {LEGS.format(scores=SCORES)}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM sc)),
lf AS (SELECT a.date, lg.side, lg.entity FROM dd a JOIN dd f ON f.i = a.i - a.i % 3 JOIN lg ON lg.date = f.date), {SERIES.format(index='sc', held='lf')},
fr AS (SELECT date, long, short, ls_gross, CASE WHEN idx % 3 = 0 THEN overlap_long ELSE 1 END AS overlap_long, CASE WHEN idx % 3 = 0 THEN overlap_short ELSE 1 END AS overlap_short, CASE WHEN idx % 3 = 0 THEN turnover ELSE 0 END AS turnover FROM se)
SELECT date, {OUT}, {NET} FROM fr""")(lambda s, d: rounded(P.low_frequency(predictions(s, d), N, N, 3, 5.0).select(*SHOWN)))


def bands(scores: str, delta: int) -> str:
    """SQL of the hysteresis holdings (table hy) over the scores."""
    hold = lambda x, r: f"list_concat(list_filter({r}, lambda e: list_contains({x}, e)), list_slice(list_filter(list_slice({r}, 1, {N}), lambda e: NOT list_contains({x}, e)), 1, {N} - len(list_filter({r}, lambda e: list_contains({x}, e)))))"
    return f"""{LEGS.format(scores=scores)}, rl AS (SELECT date, list(entity ORDER BY place) FILTER (place <= {N + delta}) AS top, list(entity ORDER BY ends) FILTER (ends <= {N + delta}) AS low FROM mb GROUP BY date),
ri AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM rl),
fo AS (SELECT 0::BIGINT AS i, NULL::DATE AS date, []::BIGINT[] AS l, []::BIGINT[] AS s UNION ALL SELECT ri.i, ri.date, {hold('fo.l', 'ri.top')}, {hold('fo.s', 'ri.low')} FROM fo JOIN ri ON ri.i = fo.i + 1),
hy AS (SELECT date, 'long' AS side, unnest(l) AS entity FROM fo WHERE i > 0 UNION ALL SELECT date, 'short', unnest(s) FROM fo WHERE i > 0)"""


def gone(held: str, ranked: str) -> str:
    """SQL of the two names that go first: the worst outside the target, those not quoted last."""
    return f"list_slice(list_concat(list_reverse(list_filter(list_slice({ranked}, {N + 1}, len({ranked})), lambda e: list_contains({held}, e))), list_sort(list_filter({held}, lambda e: NOT list_contains({ranked}, e)))), 1, 2)"


def tagged(sql: str, source: str, tag: str) -> str:
    """The tables of a policy under names of their own, on a table (date, entity, y_pred, y_true)."""
    return re.sub(r"\bpd\b", source, re.sub(r"\b(sc|mb|lg|rl|ri|fo|hy|dx|hh|hk|dy|se)\b", rf"\1{tag}", sql))


def book(source: str, top: int, bottom: int, tag: str) -> str:
    """Tables that end in se{tag}: the daily policy's series."""
    legs = LEGS.format(scores=SCORES).replace("place <= 5", f"place <= {top}").replace("ends <= 5", f"ends <= {bottom}")
    return tagged(f"{legs}, {SERIES.format(index='lg', held='lg')}", source, tag)


def costed(tag: str, costs: list[float], year: int = 252) -> str:
    """SQL of the metrics of se{tag} at each cost."""
    figures = METRICS.replace("* 12 AS", f"* {year} AS").replace("sqrt(12.0)", f"sqrt({year}.0)")
    return f"""SELECT cost_bps, {METRIC_OUT} FROM (SELECT cost_bps, {figures} FROM (SELECT *, cum - max(cum) OVER (PARTITION BY cost_bps ORDER BY date) AS drawdown FROM (SELECT *, sum(ls_net) OVER (PARTITION BY cost_bps ORDER BY date) AS cum FROM
  (SELECT *, ls_gross - cost_bps / 10000 * turnover AS ls_net FROM se{tag}, (SELECT unnest({[float(c) for c in costs]})::DOUBLE AS cost_bps)))) GROUP BY cost_bps)"""


EMA = """qi AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM pd),
em AS (SELECT entity, date, i, y_pred AS y, y_true FROM qi WHERE i = 1 UNION ALL SELECT qi.entity, qi.date, qi.i, 2.0 / 4 * qi.y_pred + (1 - 2.0 / 4) * em.y, qi.y_true FROM em JOIN qi ON qi.entity = em.entity AND qi.i = em.i + 1)"""
SMOOTH = "SELECT date, entity, round(y, 9) AS s, y_true FROM em"


def smooth(p: DataFrame) -> DataFrame:
    return P.smoothed(p, 3).withColumn("y_score", F.round("y_score", 9))


def of_predictions(held: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The series of what is held on predictions, which are made once for holdings and returns."""

    def run(s: SparkSession, d: str) -> DataFrame:
        p = predictions(s, d)
        return rounded(P.series(held(p), p, 5.0).select(*SHOWN))

    return run


query("e4_hysteresis", f"WITH RECURSIVE {PRED}, {bands(SCORES, 2)}, {SERIES.format(index='hy', held='hy')} SELECT date, {OUT}, {NET} FROM se")(
    of_predictions(lambda p: P.hysteresis(p, N, 2)))
query("e5_ema", f"WITH RECURSIVE {PRED}, {EMA}, {LEGS.format(scores=SMOOTH)}, {SERIES.format(index='lg', held='lg')} SELECT date, {OUT}, {NET} FROM se")(
    of_predictions(lambda p: P.legs(smooth(p), N, N, "y_score")))
SWAP = f"""rl AS (SELECT date, list(entity ORDER BY place) AS top, list(entity ORDER BY ends) AS low FROM mb GROUP BY date), ri AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM rl),
fo AS (SELECT 0::BIGINT AS i, NULL::DATE AS date, []::BIGINT[] AS l, []::BIGINT[] AS s UNION ALL
  SELECT i, date, list_concat(nl, list_slice(list_filter(list_slice(top, 1, {N}), lambda e: NOT list_contains(nl, e)), 1, {N} - len(nl))), list_concat(ns, list_slice(list_filter(list_slice(low, 1, {N}), lambda e: NOT list_contains(ns, e)), 1, {N} - len(ns))) FROM
  (SELECT *, list_concat(sl, list_slice(list_slice(list_filter(list_slice(top, 1, {N}), lambda e: NOT list_contains(hl, e)), 1, 2), 1, greatest(0, {N} - len(sl)))) AS nl, list_concat(ss, list_slice(list_slice(list_filter(list_slice(low, 1, {N}), lambda e: NOT list_contains(hs, e)), 1, 2), 1, greatest(0, {N} - len(ss)))) AS ns FROM
  (SELECT *, list_filter(hl, lambda e: NOT list_contains(gl, e)) AS sl, list_filter(hs, lambda e: NOT list_contains(gs, e)) AS ss FROM
  (SELECT ri.i, ri.date, ri.top, ri.low, fo.l AS hl, fo.s AS hs, {gone('fo.l', 'ri.top')} AS gl, {gone('fo.s', 'ri.low')} AS gs FROM fo JOIN ri ON ri.i = fo.i + 1)))),
hy AS (SELECT date, 'long' AS side, unnest(l) AS entity FROM fo WHERE i > 0 UNION ALL SELECT date, 'short', unnest(s) FROM fo WHERE i > 0)"""
query("e6_swap_cap", f"WITH RECURSIVE {PRED}, {LEGS.format(scores=SCORES)}, {SWAP}, {SERIES.format(index='hy', held='hy')}, {DRAW} SELECT date, {OUT}, {NET}, {r6('drawdown', 'drawdown')} FROM dr")(lambda s, d: rounded(P.run_policy(predictions(s, d), "swap_cap", N, 0.4, 5.0).select(*SHOWN, "drawdown")))
query("e7_combo", f"WITH RECURSIVE {PRED}, {EMA}, {bands(SMOOTH, 2)}, {SERIES.format(index='hy', held='hy')} SELECT date, {OUT}, {NET} FROM se")(
    of_predictions(lambda p: P.hysteresis(smooth(p), N, 2, "y_score")))
SPELL = f"{PRED}, {LEGS.format(scores=SCORES)}, dx AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM lg)), sp AS (SELECT side, entity, idx - row_number() OVER (PARTITION BY side, entity ORDER BY idx) AS run FROM lg JOIN dx USING (date)), sl AS (SELECT side, entity, count(*) AS days FROM sp GROUP BY side, entity, run)"
query("t28_half_life", f"WITH {SPELL} SELECT side, median(days) AS half_life FROM sl GROUP BY side")(lambda s, d: P.half_life(P.legs(predictions(s, d), N, N)))
query("e8_spells", f"WITH {SPELL} SELECT side, entity, days, count(*) AS n FROM sl GROUP BY ALL")(lambda s, d: P.spells(P.legs(predictions(s, d), N, N)).groupBy("side", "entity", "days").agg(F.count(F.lit(1)).alias("n")))
query("e9_estimated", f"""WITH {BASE}, o AS (SELECT date, turnover, greatest(0, 1 - turnover / 2) AS o FROM se)
SELECT date, {r6('o', 'overlap')}, {r6('turnover * 5', 'trades')}, {r6('CASE WHEN o > 0 AND o < 1 THEN ln(0.5) / ln(o) END', 'half_life')} FROM o""")(lambda s, d: rounded(P.estimated(baseline(s, d), 5.0)))
query("t23_drawdown", f"WITH {BASE}, {DRAW} SELECT date, {r6('cum', 'cum')}, {r6('drawdown', 'drawdown')} FROM dr")(
    lambda s, d: rounded(P.with_drawdown(baseline(s, d)).select("date", F.col("cum_ls_net").alias("cum"), "drawdown")))
query("a18_summary_metrics", f"WITH {BASE}, {DRAW}, z AS (SELECT {METRICS} FROM dr) SELECT {METRIC_OUT} FROM z")(lambda s, d: rounded(P.metrics(P.with_drawdown(baseline(s, d)), year=12.0)))
query("a20_profile", f"WITH {BASE} SELECT {', '.join(r6(f'avg({c})', f'avg_{c}') for c in ('turnover', 'overlap_long', 'overlap_short', 'added_long', 'added_short'))} FROM se")(lambda s, d: rounded(P.profile(baseline(s, d))))
query("e10_dispatch", f"WITH RECURSIVE {PRED}, {EMA}, {bands(SMOOTH, 2)}, {SERIES.format(index='hy', held='hy')}, {DRAW} SELECT date, {OUT}, {NET}, {r6('drawdown', 'drawdown')} FROM dr")(lambda s, d: rounded(P.run_policy(predictions(s, d), "combo", N, (3, 2), 5.0).select(*SHOWN, "drawdown")))
#: All six policies, three parameters (nine of the combination) and three breadths each.
PARAMETERS = {"baseline": [None], "low_freq": [3, 6, 12], "hysteresis": [0, 2, 4], "ema": [3, 5, 10], "swap_cap": [0.2, 0.4, 0.6], "combo": [(a, b) for a in (3, 4, 6) for b in (1, 2, 3)]}
SETTINGS = [(policy, x, n) for policy, xs in PARAMETERS.items() for x in xs for n in (N, 2 * N, 4 * N)]
query("e11_policy_grid")(lambda s, d: rounded(P.grid(predictions(s, d), SETTINGS, [0, 5, 10])))
REGIME_DAYS = f"""WITH {MK}, pr AS (SELECT entity, date, CASE WHEN stddev_samp(mo) OVER w > 1e-12 THEN round((mo - avg(mo) OVER w) / stddev_samp(mo) OVER w, 9) END AS y_pred, fw AS y_true
  FROM (SELECT entity, date, lag(close, 2) OVER e / nullif(lag(close, 4) OVER e, 0) - 1 AS mo, lead(r) OVER e AS fw FROM p1 WINDOW e AS (PARTITION BY entity ORDER BY date)) WHERE mo IS NOT NULL WINDOW w AS (PARTITION BY date)),
pd AS (SELECT * FROM pr WHERE y_pred IS NOT NULL AND y_true IS NOT NULL), {LEGS.format(scores=SCORES)},
dx AS (SELECT date, regime, row_number() OVER (PARTITION BY regime ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM sc) JOIN rg USING (date)),
hh AS (SELECT lg.*, regime, idx FROM lg JOIN dx USING (date)),
hk AS (SELECT a.*, b.entity IS NOT NULL AS kept, y_true FROM hh a LEFT JOIN hh b ON a.regime = b.regime AND a.side = b.side AND a.entity = b.entity AND a.idx = b.idx + 1 LEFT JOIN pd ON pd.date = a.date AND pd.entity = a.entity),
dy AS (SELECT regime, date, avg(y_true) FILTER (side = 'long') - avg(y_true) FILTER (side = 'short') AS ls_gross, 2 - count(*) FILTER (side = 'long' AND kept) / greatest(1, count(*) FILTER (side = 'long')) - count(*) FILTER (side = 'short' AND kept) / greatest(1, count(*) FILTER (side = 'short')) AS turnover FROM hk GROUP BY regime, date)"""
query("e12_regime_attribution", f"{REGIME_DAYS} SELECT regime, count(*) AS n, {r6('avg(ls_gross)', 'ls_gross')}, {r6('avg(turnover)', 'turnover')} FROM dy WHERE ls_gross IS NOT NULL GROUP BY regime")(
    lambda s, d: rounded(P.by_regime(predictions(s, d), regimes(s, d), N, N).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("ls_gross").alias("ls_gross"), F.avg("turnover").alias("turnover"))))


@query("a22_regime_contribution", f"""{REGIME_DAYS}, ne AS (SELECT regime, ls_gross - 5.0 / 10000 * turnover AS ls_net FROM dy WHERE ls_gross IS NOT NULL)
SELECT regime, count(*) AS days, {r6('count(*) / sum(count(*)) OVER ()', 'share_of_days')}, {r6('avg(ls_net)', 'ls_mean')}, {r6('avg(ls_net) * 12', 'ls_ann')}, {r6('avg((ls_net > 0)::INT)', 'win_rate')},
  {r6('sum(ls_net) / sum(count(*)) OVER ()', 'contribution')}, {r6('sum(ls_net) / nullif(sum(sum(ls_net)) OVER (), 0)', 'share_of_return')} FROM ne GROUP BY regime""")
def a22(s: SparkSession, d: str) -> DataFrame:
    return rounded(P.contributions(P.by_regime(predictions(s, d), regimes(s, d), N, N, 5.0), 12.0))


query("e13_entity_series", f"""
WITH {PRED}, m2 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY y_pred DESC, entity) <= 5 AS in_long, row_number() OVER (PARTITION BY date ORDER BY y_pred, entity DESC) <= 5 AS in_short,
  1 - (rank() OVER (PARTITION BY date, industry ORDER BY y_pred DESC) - 1) / (count(*) OVER (PARTITION BY date, industry))::DOUBLE AS pct FROM pd)
SELECT date, {r6('y_pred', 'y_pred')}, in_long, in_short, {r6('pct', 'ind_rank_pct')}, CASE WHEN in_long THEN 1 WHEN in_short THEN -1 ELSE 0 END AS position FROM m2 WHERE entity = 3""")(
    lambda s, d: rounded(X.category_rank(X.membership(predictions(s, d), "y_pred", N, N), "y_pred").where("entity = 3").select("date", "y_pred", "in_long", "in_short", "ind_rank_pct", F.when(F.col("in_long"), 1).when(F.col("in_short"), -1).otherwise(0).alias("position"))))


@query("e14_events", f"""
WITH {PRED}, m2 AS (SELECT entity, date, row_number() OVER (PARTITION BY date ORDER BY y_pred DESC, entity) <= 5 AS in_long FROM pd), c AS (SELECT *, coalesce(lag(in_long) OVER (PARTITION BY entity ORDER BY date), false) AS was FROM m2)
SELECT entity, date, CASE WHEN in_long THEN 'open_long' ELSE 'close_long' END AS event FROM c WHERE in_long <> was""")
def e14(s: SparkSession, d: str) -> DataFrame:
    m = X.membership(predictions(s, d), "y_pred", N, N).withColumn("was", F.coalesce(F.lag("in_long").over(Window.partitionBy("entity").orderBy("date")), F.lit(False)))
    return m.where("in_long != was").select("entity", "date", F.when(F.col("in_long"), "open_long").otherwise("close_long").alias("event"))


query("e15_peers", f"""
WITH {PRED}, q AS (SELECT date, industry, entity, (rank() OVER (PARTITION BY date, industry ORDER BY y_pred DESC))::INT AS place, row_number() OVER (PARTITION BY date, industry ORDER BY y_pred DESC, entity) <= 2 AS is_best,
  row_number() OVER (PARTITION BY date, industry ORDER BY y_pred, entity DESC) <= 2 AS is_worst FROM pd) SELECT date, industry, entity, place, is_best, is_worst FROM q WHERE is_best OR is_worst""")(lambda s, d: P.peers(predictions(s, d), 2))
