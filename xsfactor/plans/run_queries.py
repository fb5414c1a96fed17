"""Whole runs on suppliers by month, and the joins and tables around them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable, shared_folder
from ..operators import cross as X
from ..operators import models as M
from ..operators import portfolio as P
from ..operators import runs as U
from ..operators import stats as S
from ..sources import bundles, imports
from ..sources.bundles import Artefact, Stages
from ..sources.panels import SM, supplier_month, table
from .catalog import query, r6, rounded
from .factor_queries import KEY, predictions
from .ic_queries import FACTORS, MK, month_regime_panel
from .model_queries import FS, OWN, OWN_SQL, RS, XS, standard
from .portfolio_queries import BASE, DRAW, METRIC_OUT, METRICS, N, PRED, SCORES, SERIES, bands, baseline, costed, e14, tagged

EVENTS = f"""{PRED}, m2 AS (SELECT entity, date, row_number() OVER (PARTITION BY date ORDER BY y_pred DESC, entity) <= {N} AS in_long FROM pd), c AS (SELECT *, coalesce(lag(in_long) OVER (PARTITION BY entity ORDER BY date), false) AS was FROM m2),
ev AS (SELECT entity, date, CASE WHEN in_long THEN 'open_long' ELSE 'close_long' END AS event FROM c WHERE in_long <> was)"""
query("j7_event_prices", f"WITH {EVENTS} SELECT ev.entity, ev.date, event, round(close, 6) AS close FROM ev LEFT JOIN b ON b.entity = ev.entity AND b.date = ev.date", dates=("date",))(
    lambda s, d: rounded(U.priced(e14(s, d), supplier_month(s, d))))
query("j8_prediction_regimes", f"""WITH {MK}, m AS (SELECT *, lag(close, 2) OVER e / nullif(lag(close, 4) OVER e, 0) - 1 AS mom, lead(r) OVER e AS fwd FROM p1 WINDOW e AS (PARTITION BY entity ORDER BY date)),
pr AS (SELECT entity, date, CASE WHEN stddev_samp(mom) OVER w > 1e-12 THEN round((mom - avg(mom) OVER w) / stddev_samp(mom) OVER w, 9) END AS y_pred, fwd AS y_true FROM m WHERE mom IS NOT NULL WINDOW w AS (PARTITION BY date))
SELECT pr.entity, pr.date, {r6('y_pred', 'y_pred')}, regime, {r6('volatility', 'volatility')} FROM pr LEFT JOIN rp ON rp.entity = pr.entity AND rp.date = pr.date WHERE y_pred IS NOT NULL AND y_true IS NOT NULL""", dates=("date",))(
    lambda s, d: rounded(U.with_panel(predictions(s, d).select(*KEY, "y_pred"), month_regime_panel(s, d), "regime", "volatility")))
query("p21_discovered_factors", f"WITH {FS} " + " UNION ALL ".join(f"SELECT '{x}' AS factor, count({x}) AS n FROM fs" for x in XS if x != "amp_std"))(
    lambda s, d: (lambda z: z.unpivot(KEY, U.discovered(z, without=("amp_std",)), "factor", "x").groupBy("factor").agg(F.count("x").alias("n")))(standard(s, d)))
query("s18_to_fetch", """WITH done AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) || '_1995-01-01_1995-01-03' AS key FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '1995-01-04')
SELECT s_suppkey AS entity, CAST(s_suppkey AS VARCHAR) || '_1995-01-01_1995-01-03' AS key FROM supplier WHERE CAST(s_suppkey AS VARCHAR) || '_1995-01-01_1995-01-03' NOT IN (SELECT key FROM done)""")(
    lambda s, d: U.to_fetch(
        table(s, d, "supplier").select(F.col("s_suppkey").alias("entity")),
        table(s, d, "lineitem").where("l_shipdate >= '1995-01-01' AND l_shipdate < '1995-01-04'").select(U.cache_key(F.col("l_suppkey"), "1995-01-01", "1995-01-03").alias("key"), F.lit("done").alias("status")).distinct(),
        "1995-01-01", "1995-01-03").select("entity", "key"))


def two_runs(s: SparkSession, d: str) -> DataFrame:
    """Series of the daily policy at two costs, a run each."""
    day = baseline(s, d).withColumn("cost", F.explode(F.array(F.lit(5.0), F.lit(10.0))))
    day = P.with_cost(day, F.col("cost")).withColumn("run_id", F.when(F.col("cost") == 5, "20250101_000000").otherwise("20250102_000000"))
    return P.with_drawdown(day, "run_id")


RUN = f"{BASE}, {DRAW}, rx AS (SELECT '20250102_000000' AS run_id, date, turnover, ls_gross - 10.0 / 10000 * turnover AS ls_net, long, short FROM se), rd AS (SELECT *, sum(ls_net) OVER (ORDER BY date) AS cum FROM rx), r2 AS (SELECT *, cum - max(cum) OVER (ORDER BY date) AS drawdown FROM rd)"
@query("s22_newest_run", f"WITH {RUN}, z AS (SELECT {METRICS} FROM r2) SELECT run_id, date, {r6('r2.ls_net', 'ls_net')}, {r6('z.ls_ann', 'ls_ann')}, {r6('z.max_drawdown', 'max_drawdown')} FROM r2, z", dates=("date",))
def s22(s: SparkSession, d: str) -> DataFrame:
    day = two_runs(s, d)
    m = P.metrics(day, "run_id", year=12.0).select("run_id", "ls_ann", "max_drawdown")
    none = day.select("run_id", "date").withColumn("regime", F.lit(None).cast("string"))
    return rounded(U.loaded(m, day.select("run_id", "date", "ls_net"), none, "20240101_000000").select("run_id", "date", "ls_net", "ls_ann", "max_drawdown"))


query("s17_highlights", f"WITH {BASE}, {DRAW}, z AS (SELECT {METRICS} FROM dr), o AS (SELECT {METRIC_OUT} FROM z) SELECT '20250101_000000' AS run_id, metric, value FROM (SELECT unnest(['ls_ann', 'ls_ir', 'avg_turnover', 'max_drawdown']) AS metric, unnest([ls_ann, ls_ir, avg_turnover, max_drawdown]) AS value FROM o) WHERE value IS NOT NULL")(
    lambda s, d: rounded(U.highlights(P.metrics(two_runs(s, d), "run_id", year=12.0).where("run_id = '20250101_000000'"), ["ls_ann", "ls_ir", "avg_turnover", "max_drawdown"])))


def chosen(panel: DataFrame, factors: list[str], dates: int, p: float = 0.05) -> dict[str, list[str]]:
    """Factors screened and de-correlated in each regime; one without any takes the strongest two."""
    by = X.daily_ic(panel.unpivot(["regime", "date", "fwd"], factors, "factor", "x"), "x", "fwd", ("regime", "factor", "date")).cache()
    own: dict[str, list[str]] = {}
    for g, _, f in S.selected(by, panel, "regime", p=p, days=dates):
        own.setdefault(g, []).append(f)
    strong: dict[str, list[str]] = {}
    for r in S.ic_summary(by, "regime", "factor").orderBy("regime", F.round(F.abs("ic_mean"), 9).desc(), "factor").collect():
        strong.setdefault(r["regime"], []).append(r["factor"])  # a row a regime and factor
    by.unpersist()
    return {g: own.get(g, fs[:2]) for g, fs in strong.items()}


def scored(panel: DataFrame, own: dict[str, list[str]], days: int, alpha: float, least: int) -> DataFrame:
    """Models fitted walk-forward on the regime's own dates and factors: (entity, date, y_pred, y_true)."""
    names = sorted({f for fs in own.values() for f in fs})
    z = durable(X.standardised(panel, *names).select(*KEY, "regime", "fwd", *(f"{f}_std" for f in names)), "scored")  # sums and predictions of each regime read it
    told = M.walk_forward_by_regime(z, {g: [f"{f}_std" for f in fs] for g, fs in own.items()}, "fwd", days, alpha, least)
    return told.where("y_true is not null").select(*KEY, F.round("y_pred", 9).alias("y_pred"), "y_true")


def full_run(panel: DataFrame, factors: list[str], n: int, delta: int, cost_bps: float, days: int, least: int, dates: int, alpha: float = 1.0, p: float = 0.05, year: float = 252.0) -> DataFrame:
    """S24 in one plan: from a panel (entity, date, regime, fwd, factors) to the metrics of a portfolio that a band of `delta` holds."""
    scores = durable(scored(panel, chosen(panel, factors, dates, p), days, alpha, least), "scores")
    return P.metrics(P.with_drawdown(P.series(P.hysteresis(scores, n, delta), scores, cost_bps)), year=year)


@dataclass(frozen=True)
class Run:
    """The settings of a whole run. mapping: factors by regime; without one they are selected."""

    factors: tuple[str, ...]
    mapping: dict[str, list[str]] | None = None
    dates: int = 60
    p: float = 0.05
    days: int = 756
    alpha: float = 1.0
    least: int = 800
    n: int = 30
    delta: int = 15
    cost_bps: float = 5.0
    year: float = 252.0


def staged_run(stages: Stages, sources: list[str], panel: Callable[[], DataFrame], run: Run) -> dict[str, Artefact]:
    """S24 as stages, each written and read again: a second run reads them, a changed setting builds what depends on it.

    sources: fingerprints of what panel() reads.
    """
    spark = stages.spark
    a = stages.run("panel", {"factors": run.factors}, sources, lambda: panel().select(*KEY, "regime", "fwd", *run.factors))

    def mapping() -> DataFrame:
        own = run.mapping or chosen(a.table, list(run.factors), run.dates, run.p)
        return spark.createDataFrame([(g, k, f) for g, fs in sorted(own.items()) for k, f in enumerate(fs)], "regime string, pos int, factor string")

    m = stages.run("mapping", {"given": run.mapping} if run.mapping else {"dates": run.dates, "p": run.p}, [a], mapping)

    def predictions() -> DataFrame:
        own: dict[str, list[str]] = {}
        for r in m.table.orderBy("regime", "pos").collect():  # a row a regime and factor
            own.setdefault(r["regime"], []).append(r["factor"])
        return scored(a.table, own, run.days, run.alpha, run.least)

    b = stages.run("predictions", {"days": run.days, "alpha": run.alpha, "least": run.least}, [a, m], predictions)
    h = stages.run("holdings", {"n": run.n, "delta": run.delta}, [b], lambda: P.hysteresis(b.table, run.n, run.delta))
    day = stages.run("series", {"cost_bps": run.cost_bps}, [b, h], lambda: P.with_drawdown(P.series(h.table, b.table, run.cost_bps)))
    x = stages.run("metrics", {"year": run.year}, [day], lambda: P.metrics(day.table, year=run.year))
    return {"panel": a, "mapping": m, "predictions": b, "holdings": h, "series": day, "metrics": x}


MAPPING = {g: [x.removesuffix("_std") for x in xs] for g, xs in OWN.items()}


def run_of(s: SparkSession, d: str, root: str, run: Run) -> dict[str, Artefact]:
    prints = [bundles.fingerprint(s, *(f"{d}/{t}.parquet" for t in ("lineitem", "supplier", "nation")))]
    return staged_run(bundles.Stages(s, root), prints, lambda: month_regime_panel(s, d), run)


WHOLE = Run(("mom3", "vr", "amp"), MAPPING, days=1095, least=100, n=N, delta=2, year=12.0)
TOLD = " UNION ALL ".join(f"SELECT entity, date, round(p, 9) AS y_pred, fwd AS y_true FROM pp_{g} WHERE fwd IS NOT NULL" for g in OWN)


@query("s24_full_run", f"WITH RECURSIVE {RS}, {OWN_SQL}, mo AS ({TOLD}), " + tagged(f"{bands(SCORES, 2)}, {SERIES.format(index='hy', held='hy')}", "mo", "_w") + f" SELECT * EXCLUDE (cost_bps) FROM ({costed('_w', [5], 12)})")
def s24(s: SparkSession, d: str) -> DataFrame:
    """A run in stages, and a second one that has another cost at first and then reads everything."""
    root = f"{shared_folder(s)}/runs-{uuid.uuid4().hex}"
    run_of(s, d, root, replace(WHOLE, cost_bps=10.0))
    found = run_of(s, d, root, WHOLE)
    if [k for k, x in found.items() if not x.reused] != ["series", "metrics"]:
        raise RuntimeError("stages were built that were there")
    return rounded(found["metrics"].table)


query("s24_selected_run")(lambda s, d: rounded(full_run(month_regime_panel(s, d), FACTORS, N, 2, 5.0, 1095, 100, 6, year=12.0)))


@query("s25_bundled_runs", f"WITH {RUN}, z AS (SELECT {METRICS} FROM r2) SELECT run_id, date, {r6('r2.ls_net', 'ls_net')}, {r6('z.ls_ann', 'ls_ann')}, {r6('z.max_drawdown', 'max_drawdown')} FROM r2, z", dates=("date",))
def s25(s: SparkSession, d: str) -> DataFrame:
    """Two runs written as bundles; the newest whole one is loaded."""
    root, day = f"{shared_folder(s)}/bundles-{uuid.uuid4().hex}", durable(two_runs(s, d), "two-runs")
    for run in ("20250101_000000", "20250102_000000"):
        own = day.where(F.col("run_id") == run).drop("run_id")
        bundles.bundle(s, root, run, {"series": own, "metrics": P.metrics(own, year=12.0), "regimes": own.select("date", F.lit(None).cast("string").alias("regime"))}, {})
    newest = bundles.newest_run(s, root, "20240101_000000")
    series, metrics, regimes = (bundles.of_runs(s, root, t, [newest]) for t in ("series", "metrics", "regimes"))
    out = U.loaded(metrics.select("run_id", "ls_ann", "max_drawdown"), series.select("run_id", "date", "ls_net"), regimes)
    return rounded(out.select("run_id", "date", "ls_net", "ls_ann", "max_drawdown"))


@query("s18_statuses", """WITH a AS (SELECT l_suppkey, bool_or(l_shipdate < '1995-01-02') AS again FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '1995-01-04' GROUP BY l_suppkey)
SELECT s_suppkey AS entity, CASE WHEN again THEN 'failed' END AS status FROM supplier LEFT JOIN a ON l_suppkey = s_suppkey WHERE again IS NULL OR again""")
def s18(s: SparkSession, d: str) -> DataFrame:
    """Suppliers with lines in a window are recorded as done, those with lines on its first day as failed later on."""
    root = f"{shared_folder(s)}/statuses-{uuid.uuid4().hex}"
    lines = table(s, d, "lineitem").where("l_shipdate >= '1995-01-01' AND l_shipdate < '1995-01-04'")
    key = U.cache_key(F.col("l_suppkey"), "1995-01-01", "1995-01-03").alias("key")
    for status, rows, at in (("done", lines, "2024-01-01"), ("failed", lines.where("l_shipdate < '1995-01-02'"), "2024-01-02")):
        bundles.record_status(s, root, rows.select(key, F.lit(status).alias("status"), F.lit(at).alias("at")).distinct())
    now = bundles.statuses(s, root)
    wanted = table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return U.to_fetch(wanted, now, "1995-01-01", "1995-01-03").join(now, "key", "left").select("entity", "status")


@query("s20_import", f"""WITH {SM}, f AS (SELECT *, month(date) AS m FROM b) SELECT lpad(CAST(entity AS VARCHAR), 6, '0') AS entity, NULL AS reason, count(*) AS n, {r6('sum(close)', 'close')} FROM f WHERE m NOT IN (3, 7, 11) GROUP BY entity
UNION ALL SELECT NULL, CASE m WHEN 3 THEN 'close' WHEN 7 THEN 'date' ELSE 'volume' END, count(*), NULL FROM f WHERE m IN (3, 7, 11) GROUP BY m""")
def s20(s: SparkSession, d: str) -> DataFrame:
    """Bars written as files with faults in three months of each year, and imported: good ones by entity, bad ones by reason."""
    folder, month = f"{shared_folder(s)}/files-{uuid.uuid4().hex}", F.month("date")
    text = lambda c, bad, m: F.when(month == m, F.lit(bad)).otherwise(F.col(c).cast("string")).alias(c)
    bars = supplier_month(s, d).select(F.col("entity").cast("string").alias("code"), text("date", "soon", 7), "open", "high", "low", text("close", "n/a", 3), text("volume", "1 lot", 11))
    bars.write.csv(folder, header=True)
    # Lines are judged once, for both parts.
    good = F.col("reason").isNull()
    found = imports.judged(s, folder).select(F.when(good, F.col("row.entity")).alias("entity"), "reason", F.when(good, F.col("row.close")).alias("close"))
    return rounded(found.groupBy("entity", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("close")))
