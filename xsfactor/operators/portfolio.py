"""Long/short portfolios from scores (date, entity, y_pred, y_true): policies, their series, and metrics.

Holdings are rows (date, side, entity); sides 'long' and 'short'. Policies whose holdings hang on those of the day before
are scans over stretches of dates (see scan.py). All settings of a grid are scanned at once; costs come after.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.windows import indexed
from .cross import membership
from .factors import ewma
from .scan import Setting, holdings


def legs(scores: DataFrame, top: int, bottom: int, score: str = "y_pred") -> DataFrame:
    """The best and the worst names of each date: (date, side, entity)."""
    m = membership(scores, score, top, bottom)
    sides = F.array_compact(F.array(F.when(F.col("in_long"), F.lit("long")), F.when(F.col("in_short"), F.lit("short"))))
    return m.where("in_long or in_short").select("date", F.explode(sides).alias("side"), "entity")


def series(held: DataFrame, returns: DataFrame, cost_bps: float = 0.0, *by: str, index: DataFrame | None = None) -> DataFrame:
    """E outputs by date: leg returns, overlaps with the date before, turnover, net return, names added and removed.

    Days without a return on one side are left out. The names of a date meet those of the date before on (side, entity).
    """
    days = indexed(held) if index is None else index
    h = held.join(days, "date")
    was = h.select(*by, "side", "entity", (F.col("idx") + 1).alias("idx"), F.lit(1).alias("kept"))
    now = h.join(was, [*by, "side", "entity", "idx"], "left").join(returns.select("date", "entity", "y_true"), ["date", "entity"], "left")
    side = lambda x, c: F.when(F.col("side") == x, c)
    cols = {}
    for x in ("long", "short"):
        cols |= {x: F.avg(side(x, F.col("y_true"))), f"n_{x}": F.count_if(F.col("side") == x), f"k_{x}": F.coalesce(F.sum(side(x, F.col("kept"))), F.lit(0))}
    day = now.groupBy(*by, "date", "idx").agg(*(c.alias(n) for n, c in cols.items()))
    w = (Window.partitionBy(*by) if by else Window).orderBy("idx")
    for x in ("long", "short"):
        before = F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag(f"n_{x}").over(w))
        day = day.withColumn(f"overlap_{x}", F.col(f"k_{x}") / F.greatest(F.lit(1), F.col(f"n_{x}"))).withColumn(f"added_{x}", F.col(f"n_{x}") - F.col(f"k_{x}"))
        day = day.withColumn(f"removed_{x}", F.coalesce(before, F.lit(0)) - F.col(f"k_{x}"))
    # Rounded far below any return, so that equal legs differ by nothing, in whatever order their names are summed.
    day = day.withColumn("ls_gross", F.round(F.col("long") - F.col("short"), 12)).withColumn("turnover", (1 - F.col("overlap_long")) + (1 - F.col("overlap_short")))
    day = day.where("ls_gross is not null").drop("k_long", "k_short", "n_long", "n_short")
    return with_cost(day, cost_bps)


def with_cost(day: DataFrame, cost_bps: float | Column) -> DataFrame:
    cost = cost_bps if isinstance(cost_bps, Column) else F.lit(float(cost_bps))
    return day.withColumn("ls_net", F.col("ls_gross") - cost / 10000 * F.col("turnover"))


def with_drawdown(day: DataFrame, *by: str) -> DataFrame:
    """Running sums of net and gross returns, and the distance from the highest net sum. Additive."""
    w = (Window.partitionBy(*by) if by else Window).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = day.withColumn("cum_ls_net", F.sum("ls_net").over(w)).withColumn("cum_ls_gross", F.sum("ls_gross").over(w))
    return out.withColumn("drawdown", F.col("cum_ls_net") - F.max("cum_ls_net").over(w))


def metrics(day: DataFrame, *by: str, year: float = 252.0) -> DataFrame:
    """One row of summary figures (for each setting)."""
    m, sd = F.avg("ls_net"), F.stddev_samp("ls_net")
    return day.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("long").alias("long_mean"), F.avg("short").alias("short_mean"), m.alias("ls_mean"), (m * year).alias("ls_ann"),
        (m / (sd + 1e-12) * math.sqrt(year)).alias("ls_ir"), F.avg((F.col("ls_net") > 0).cast("double")).alias("ls_win_rate"),
        F.avg("turnover").alias("avg_turnover"), F.min("drawdown").alias("max_drawdown"),
    )


def profile(day: DataFrame, *by: str) -> DataFrame:
    """A20."""
    return day.groupBy(*by).agg(*(F.avg(c).alias(f"avg_{c}") for c in ("turnover", "overlap_long", "overlap_short", "added_long", "added_short")))


def estimated(day: DataFrame, names: float) -> DataFrame:
    """What turnover alone tells."""
    o = F.greatest(F.lit(0.0), 1 - F.col("turnover") / 2)
    half = F.when((o > 0) & (o < 1), F.ln(F.lit(0.5)) / F.ln(o))
    return day.select("date", o.alias("overlap"), (F.col("turnover") * names).alias("trades"), half.alias("half_life"))


def evaluated(scores: DataFrame, top: int, bottom: int, cost_bps: float = 0.0) -> DataFrame:
    """As the daily policy, on days with enough names only (half a leg at least, and one)."""
    least = max(1, top // 2, bottom // 2)
    n = scores.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("date"))).where(F.col("_n") >= least).drop("_n")
    return series(legs(n, top, bottom), scores, cost_bps)


def every(scores: DataFrame, top: int, bottom: int, k: int) -> DataFrame:
    """E3 holdings: legs of each k-th date, held until the next."""
    days = indexed(scores).withColumn("from", (F.floor(F.col("idx") / k) * k).cast("long"))
    picked = legs(scores, top, bottom).join(days.select("date", "idx"), "date").select(F.col("idx").alias("from"), "side", "entity")
    return days.join(picked, "from").select("date", "side", "entity")


def low_frequency(scores: DataFrame, top: int, bottom: int, k: int, cost_bps: float = 0.0) -> DataFrame:
    """Returns over names quoted that day; turnover only on refresh days, against the names before."""
    days = indexed(scores)
    held = every(scores, top, bottom, k)
    day = series(held, scores, 0.0, index=days).join(days, ["date", "idx"])
    fresh = F.col("idx") % k == 0
    for x in ("long", "short"):
        day = day.withColumn(f"overlap_{x}", F.when(fresh, F.col(f"overlap_{x}")).otherwise(1.0))
    return with_cost(day.withColumn("turnover", (1 - F.col("overlap_long")) + (1 - F.col("overlap_short"))), cost_bps)


def policy_rule(policy: str, n: int, x: object) -> Callable[[set, list, int], Iterable]:
    """rule(held, ranked names of the side, number of the date) -> names."""
    rules = {
        "low_freq": lambda: lambda held, ranked, at: held if at % int(x) else ranked[:n],
        "hysteresis": lambda: banded(n, int(x)),
        "combo": lambda: banded(n, int(x[1])),
        "swap_cap": lambda: swap_capped(n, x),
    }
    return rules.get(policy, lambda: lambda held, ranked, at: ranked[:n])()


def setting(at: int, policy: str, x: object, n: int) -> Setting:
    variant = {"ema": lambda: f"ema{int(x)}", "combo": lambda: f"ema{int(x[0])}", "swap_cap": lambda: "tracked"}.get(policy, lambda: "plain")()
    beyond = int(x[1]) if policy == "combo" else int(x) if policy == "hysteresis" else 0
    return Setting(at, variant, policy_rule(policy, n, x), n + beyond, policy == "swap_cap")


def ranking(scores: DataFrame, variant: str, score: str = "y_pred") -> DataFrame:
    return scores.select(F.lit(variant).alias("variant"), "date", "entity", F.col(score).alias("s"))


def hysteresis(scores: DataFrame, n: int, delta: int, score: str = "y_pred") -> DataFrame:
    """E4 holdings: names stay while they are within n + delta of their end; free places go to the best others."""
    return holdings(ranking(scores, "plain", score), [setting(0, "hysteresis", delta, n)]).drop("id")


def capped(scores: DataFrame, n: int, share: float) -> DataFrame:
    """E6 holdings."""
    return holdings(ranking(scores, "tracked"), [setting(0, "swap_cap", share, n)]).drop("id")


def swap_capped(n: int, share: float) -> Callable:
    """At most a share of the names go a day (those not quoted last, the worst first) and as many come, the best first;
    places still free are filled from the target."""

    def rule(held: set, ranked: list, at: int) -> set:
        cap = math.ceil(min(max(share, 0.0), 1.0) * n)
        place = {e: i for i, e in enumerate(ranked)}
        target = ranked[:n]
        out = sorted(held - set(target), key=lambda e: (e not in place, -place.get(e, 0), e))[:cap]
        stay = held - set(out)
        come = [e for e in target if e not in held][:cap]
        now = stay | set(come[: max(0, n - len(stay))])
        for e in target:
            if len(now) >= n:
                break
            now.add(e)
        return now

    return rule


def banded(n: int, delta: int) -> Callable:
    """E4."""

    def rule(held: set, ranked: list, at: int) -> set:
        stay = [e for e in ranked[: n + delta] if e in held]
        return set(stay + [e for e in ranked[:n] if e not in held][: n - len(stay)])

    return rule


def smoothed(scores: DataFrame, span: int) -> DataFrame:
    """E5: scores as moving averages of the entity."""
    return ewma(scores, "y_pred", span, "y_score")


def spells(held: DataFrame) -> DataFrame:
    """Runs of dates that a name is held: (side, entity, days)."""
    h = held.join(indexed(held), "date")
    run = F.col("idx") - F.row_number().over(Window.partitionBy("side", "entity").orderBy("idx"))
    return h.withColumn("_run", run).groupBy("side", "entity", "_run").agg(F.count(F.lit(1)).alias("days")).drop("_run")


def half_life(held: DataFrame) -> DataFrame:
    return spells(held).groupBy("side").agg(F.median("days").alias("half_life"))


POLICIES: dict[str, Callable] = {
    "baseline": lambda s, n, p: legs(s, n, n),
    "low_freq": lambda s, n, p: every(s, n, n, int(p)),
    "hysteresis": lambda s, n, p: hysteresis(s, n, int(p)),
    "ema": lambda s, n, p: legs(smoothed(s, int(p)), n, n, "y_score"),
    "swap_cap": lambda s, n, p: capped(s, n, p),
    "combo": lambda s, n, p: hysteresis(smoothed(s, int(p[0])), n, int(p[1]), "y_score"),
}


def run_policy(scores: DataFrame, policy: str, n: int, parameter: object = None, cost_bps: float = 0.0) -> DataFrame:
    """The series of a named policy, with drawdown."""
    if policy == "low_freq":
        return with_drawdown(low_frequency(scores, n, n, int(parameter), cost_bps))
    return with_drawdown(series(POLICIES[policy](scores, n, parameter), scores, cost_bps))


def grid_holdings(scores: DataFrame, settings: list[tuple[str, object, int]]) -> DataFrame:
    """Rows (id, date, side, entity) for the settings by their position: one scan for all of them.

    Scores are written once; each ranking (plain, with the places of held names, and a moving average a span) is made once.
    """
    scores = durable(scores.select("date", "entity", "y_pred"), "scores")
    own = [setting(i, *x) for i, x in enumerate(settings)]
    lists = None
    for v in dict.fromkeys(x.variant for x in own):
        part = ranking(smoothed(scores, int(v[3:])), v, "y_score") if v.startswith("ema") else ranking(scores, v)
        lists = part if lists is None else lists.unionByName(part)
    return holdings(lists, own)


def grid(scores: DataFrame, settings: list[tuple[str, object, int]], costs: list[float]) -> DataFrame:
    """Metrics for each (policy, parameter, n) and cost. Holdings of all settings are one fold, costs come after."""
    names = scores.sparkSession.createDataFrame([(i, p, str(x), n, int(x) if p == "low_freq" else 1) for i, (p, x, n) in enumerate(settings)], "id int, strategy string, param string, top_n int, k int")
    day = series(grid_holdings(scores, settings), scores, 0.0, "id", index=indexed(scores)).join(F.broadcast(names), "id")
    fresh = F.col("idx") % F.col("k") == 0
    day = day.withColumns({f"overlap_{x}": F.when(fresh, F.col(f"overlap_{x}")).otherwise(1.0) for x in ("long", "short")})
    day = day.withColumn("turnover", (1 - F.col("overlap_long")) + (1 - F.col("overlap_short")))
    by = ("strategy", "param", "top_n", "cost_bps")
    each = day.withColumn("cost_bps", F.explode(F.array(*map(F.lit, map(float, costs)))))
    return metrics(with_drawdown(with_cost(each, F.col("cost_bps")), *by), *by)


def by_regime(scores: DataFrame, regimes: DataFrame, top: int, bottom: int, cost_bps: float = 0.0) -> DataFrame:
    """The daily policy within each regime, a regime's day against its own day before. Regimes are one row a date."""
    days = regimes.select("date", "regime").distinct()
    index = scores.select("date").distinct().join(days, "date").withColumn("idx", F.row_number().over(Window.partitionBy("regime").orderBy("date")).cast("long") - 1)
    held = legs(scores, top, bottom).join(index.select("date", "regime"), "date")
    return series(held, scores, cost_bps, "regime", index=index.select("date", "idx"))


def contributions(day: DataFrame, year: float = 252.0) -> DataFrame:
    """What each regime adds to the mean return of a day, and its shares of days and of the whole return."""
    m = F.avg("ls_net")
    by = day.groupBy("regime").agg(F.count(F.lit(1)).alias("days"), m.alias("ls_mean"), (m * year).alias("ls_ann"), F.avg((F.col("ls_net") > 0).cast("double")).alias("win_rate"), F.sum("ls_net").alias("_sum"))
    w = Window.partitionBy(F.lit(0))  # a row a regime
    return by.select(
        "regime", "days", (F.col("days") / F.sum("days").over(w)).alias("share_of_days"), "ls_mean", "ls_ann", "win_rate",
        (F.col("_sum") / F.sum("days").over(w)).alias("contribution"), (F.col("_sum") / F.nullif(F.sum("_sum").over(w), F.lit(0.0))).alias("share_of_return"),
    )


def peers(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The best and the worst n names of each date and category."""
    w = Window.partitionBy("date", "industry")
    best = F.row_number().over(w.orderBy(F.desc("y_pred"), "entity"))
    worst = F.row_number().over(w.orderBy(F.asc("y_pred"), F.desc("entity")))
    both = ranked.withColumn("place", F.rank().over(w.orderBy(F.desc("y_pred")))).withColumn("best", best).withColumn("worst", worst)
    return both.where((F.col("best") <= n) | (F.col("worst") <= n)).select("date", "industry", "entity", "place", (F.col("best") <= n).alias("is_best"), (F.col("worst") <= n).alias("is_worst"))
