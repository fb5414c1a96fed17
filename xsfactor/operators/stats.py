"""Tests on grouped samples from moments and ranks; p-values by Arrow UDF on the summary rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special


#: The distribution of Poisson(1), P(k <= 0), P(k <= 1) ...
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def ic_summary(ics: DataFrame, *by: str) -> DataFrame:
    """Moments of correlations, information ratio, win rate and t statistic."""
    m, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    out = ics.groupBy(*by).agg(
        m.alias("ic_mean"), sd.alias("ic_std"), F.median("ic").alias("ic_median"), F.coalesce(m / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("ic_ir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"), F.avg(F.abs("ic")).alias("abs_ic"), n.alias("n"),
    )
    return out.withColumn("t", F.col("ic_mean") / F.nullif(F.col("ic_std") / F.sqrt("n"), F.lit(0.0)))


def with_p(df: DataFrame, t: str = "t", n: str = "n", out: str = "p") -> DataFrame:
    """Two-sided p of a t statistic with n - 1 degrees of freedom, and its stars."""
    p = special.arrow(lambda t, n: special.t_two_sided(t, n - 1) if n > 1 else 1.0, t, F.col(n).cast("double"))
    return df.withColumn(out, p).withColumn("stars", stars(F.col(out)))


def stars(p: Column) -> Column:
    """P14."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def moments(df: DataFrame, x: str, g: str, *by: str) -> DataFrame:
    return df.where(F.col(x).isNotNull()).groupBy(*by, g).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.var_pop(x).alias("var0"), F.sum(x).alias("s")
    )


def two_samples(df: DataFrame, x: str, g: str, *by: str) -> DataFrame:
    """For each two groups a < b: pooled t, Welch's t and its degrees of freedom, Cohen's d with either divisor."""
    m = moments(df, x, g, *by)
    side = lambda k: m.select(*by, *(F.col(c).alias(f"{c}_{k}") for c in (g, "n", "mean", "var", "var0")))
    j = side("a").join(side("b").withColumnsRenamed({c: f"{c}__" for c in by}), _pair(by, g))
    n, k, va, vb = F.col("n_a"), F.col("n_b"), F.col("var_a"), F.col("var_b")
    diff, pooled = F.col("mean_a") - F.col("mean_b"), ((n - 1) * va + (k - 1) * vb) / (n + k - 2)
    se = va / n + vb / k
    return j.select(
        *by, F.col(f"{g}_a").alias("a"), F.col(f"{g}_b").alias("b"), n.alias("n_a"), k.alias("n_b"), diff.alias("diff"),
        (diff / F.sqrt(pooled * (1 / n + 1 / k))).alias("t"), (diff / F.sqrt(se)).alias("welch"),
        (se * se / (va * va / (n * n * (n - 1)) + vb * vb / (k * k * (k - 1)))).alias("welch_df"),
        (diff / F.sqrt(pooled)).alias("cohen"), (diff / F.sqrt((F.col("var0_a") + F.col("var0_b")) / 2)).alias("cohen0"),
    )


def _pair(by: tuple[str, ...], g: str) -> Column:
    cond = F.col(f"{g}_a") < F.col(f"{g}_b")
    for c in by:
        cond = (F.col(c) == F.col(f"{c}__")) & cond
    return cond


def anova(df: DataFrame, x: str, g: str, *by: str) -> DataFrame:
    """I8: F of the group means."""
    total = moments(df, x, g, *by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("var0") * F.col("n")).alias("within")
    )
    f = ((F.col("between") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)) / F.nullif(F.col("within") / (F.col("n") - F.col("k")), F.lit(0.0))
    return total.where("k > 1").select(*by, "n", "k", f.alias("f"))


def levene(df: DataFrame, x: str, g: str) -> DataFrame:
    """The analysis of variance of distances from the group's median."""
    med = df.where(F.col(x).isNotNull()).groupBy(g).agg(F.median(x).alias("_m"))
    return anova(df.join(med, g).withColumn("_d", F.abs(F.col(x) - F.col("_m"))), "_d", g).withColumnRenamed("f", "w")


def bartlett(df: DataFrame, x: str, g: str) -> DataFrame:
    m = moments(df, x, g).where("n > 1")
    t = m.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum((F.col("n") - 1) * F.col("var")).alias("ss"), F.sum((F.col("n") - 1) * F.ln("var")).alias("logs"), F.sum(1 / (F.col("n") - 1)).alias("inv"))
    free = F.col("n") - F.col("k")
    top = free * F.ln(F.col("ss") / free) - F.col("logs")
    return t.select("n", "k", (top / (1 + (F.col("inv") - 1 / free) / (3 * (F.col("k") - 1)))).alias("chi2"))


def counted(df: DataFrame, x: str, cuts: int = 256) -> DataFrame:
    """Rows (x, ties, before): each value, how often it is there, and how many smaller ones there are.

    Values are dealt into stretches between approximate quantiles; only the stretches' totals (`cuts` rows) are summed in
    one order, and a stretch's values in its own.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("ties"))
    edges = sorted(set(values.approxQuantile(x, [k / cuts for k in range(1, cuts)], 0.001))) if cuts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(x))) if edges else F.lit(0)
    values = values.withColumn("_part", part)
    upto = lambda w: F.coalesce(F.sum("ties").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = values.groupBy("_part").agg(F.sum("ties").alias("ties")).select("_part", upto(Window.orderBy("_part")).alias("_start"))
    return values.join(totals, "_part").select(x, "ties", (F.col("_start") + upto(Window.partitionBy("_part").orderBy(x))).alias("before"))


def ranked(df: DataFrame, x: str) -> DataFrame:
    """Average ranks over all rows, built from counts of values: the rows of a value aren't put in one order."""
    return df.join(counted(df, x).select(x, "ties", (F.col("before") + (F.col("ties") + 1) / 2.0).alias("rank")), x)


def kruskal(df: DataFrame, x: str, g: str) -> DataFrame:
    """H with tie correction, and for two groups Mann-Whitney's U of the smaller label."""
    r = ranked(df, x)
    sums = r.groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r"))
    ties = r.select(x, "ties").distinct().agg(F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties")).alias("t")).first()["t"] or 0
    n = F.sum("n")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)
    return sums.agg(n.alias("n"), F.count(F.lit(1)).alias("k"), (h / (1 - F.lit(float(ties)) / (n * n * n - n))).alias("h"))


def mann_whitney(df: DataFrame, x: str, g: str) -> DataFrame:
    """I7, for each two groups a < b: U of a and its normal approximation with tie correction, both from ranks within the pair.

    p is two-sided: from z with continuity correction, or exact where a group has 8 values at most and none are tied.
    """
    values = df.where(F.col(x).isNotNull() & F.col(g).isNotNull()).groupBy(g, x).agg(F.count(F.lit(1)).alias("c"))
    groups = values.select(F.col(g).alias("a")).distinct()
    pairs = groups.join(groups.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    both = values.join(pairs, (F.col(g) == F.col("a")) | (F.col(g) == F.col("b"))).groupBy("a", "b", x).agg(
        F.sum("c").alias("ties"), F.coalesce(F.sum(F.when(F.col(g) == F.col("a"), F.col("c"))), F.lit(0)).alias("own")
    )
    before = F.coalesce(F.sum("ties").over(Window.partitionBy("a", "b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = both.withColumn("_r", before + (F.col("ties") + 1) / 2.0).groupBy("a", "b").agg(
        F.sum("own").alias("n_a"), F.sum(F.col("ties") - F.col("own")).alias("n_b"), F.sum(F.col("own") * F.col("_r")).alias("r"), F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties")).cast("double").alias("t")
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u, n = F.col("r") - na * (na + 1) / 2, na + nb
    sd = F.nullif(F.sqrt(na * nb / 12 * (n + 1 - F.col("t") / (n * (n - 1)))), F.lit(0.0))
    s = s.select("a", "b", "n_a", "n_b", u.alias("u"), ((u - na * nb / 2) / sd).alias("z"), "t", F.coalesce(F.greatest(F.abs(u - na * nb / 2) - 0.5, F.lit(0.0)) / sd, F.lit(0.0)).alias("_z"))
    p = special.arrow(lambda u, z, t, n, m: special.mann_whitney_exact(u, int(n), int(m)) if t == 0 and min(n, m) <= 8 else special.normal_two_sided(z), "u", "_z", "t", F.col("n_a").cast("double"), F.col("n_b").cast("double"))
    return s.withColumn("p", p).drop("t", "_z")


def adjusted(df: DataFrame, p: str, order: str) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg over all rows (a summary table)."""
    w = Window.partitionBy(F.lit(0))
    m, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(p, order))
    raw = df.withColumn("_k", k).withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * m)).withColumn("_q", F.col(p) * m / F.col("_k"))
    back = w.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("fdr", F.least(F.lit(1.0), F.min("_q").over(back))).drop("_k", "_q")


def bootstrap(df: DataFrame, x: str, g: str, samples: int = 1000, seed: int = 7, least: int = 30, key: tuple[str, ...] = ("date",)) -> DataFrame:
    """95 % interval of a group's mean by the Poisson bootstrap: each value counts a hashed Poisson(1) number of times.

    A value's draws hang on its group, its key and, among values that share these, its place by size: not on partitioning or
    the order of rows. Values meet their sample numbers in one pass; sums combine before the shuffle.
    """
    known = df.where(F.col(x).isNotNull())
    place = F.row_number().over(Window.partitionBy(g, *key).orderBy(x))
    known = known.select(g, x, F.concat_ws("|", *(F.col(c).cast("string") for c in (g, *key)), place.cast("string")).alias("_id"))
    drawn = known.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", "_id", F.col("_b").cast("string"), F.lit(str(seed))).cast("binary")), 1, 7), 16, 10).cast("long")
    u = (hashed + 0.5) / float(1 << 28)
    times = sum((F.when(u > c, 1).otherwise(0) for c in POISSON), F.lit(0))
    means = drawn.withColumn("_t", times).groupBy(g, "_b").agg((F.sum(F.col("_t") * F.col(x)) / F.nullif(F.sum("_t"), F.lit(0))).alias("m"))
    ci = means.groupBy(g).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    n = known.groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean")).where(F.col("n") >= least)
    return n.join(ci, g).withColumn("contains_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def ljung_box(df: DataFrame, x: str, g: str, lags: int = 10, last: int = 100) -> DataFrame:
    """Q of the last values' autocorrelations."""
    w = Window.partitionBy(g).orderBy("date")
    tail = df.where(F.col(x).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(g).orderBy(F.desc("date")))).where(F.col("_k") <= last)
    c = tail.withColumn("_c", F.col(x) - F.avg(x).over(Window.partitionBy(g)))
    c = c.withColumns({f"_l{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    sums = c.groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("v"), *(F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(1, lags + 1)))
    r2 = [F.pow(F.col(f"_s{k}") / F.nullif(F.col("v"), F.lit(0.0)), 2) / (F.col("n") - k) for k in range(1, lags + 1)]
    q = F.col("n") * (F.col("n") + 2) * sum(r2[1:], r2[0])
    return sums.where(F.col("n") > lags).select(g, "n", q.alias("q"))


def kolmogorov(df: DataFrame, x: str) -> DataFrame:
    """Distance of the distribution of x from the normal one with its mean and deviation."""
    m = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n")).first()
    n = F.lit(float(m["n"]))
    f = special.normal_cdf((F.col(x) - F.lit(m["m"])) / F.lit(m["s"]))
    # Among equal values the gap is widest at the first or the last.
    gap = F.greatest(F.abs((F.col("before") + F.col("ties")) / n - f), F.abs(f - F.col("before") / n))
    d = counted(df, x).agg(F.max(gap).alias("d"), F.sum("ties").alias("n"))
    return d.withColumn("p", special.arrow(special.ks_upper, "d", F.col("n").cast("double")))


#: Royston's polynomials for the Shapiro-Wilk weights of the two largest values, and for W's transformation.
LAST, NEXT = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157), (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
FEW_MEAN, FEW_SD, FEW_SHIFT = (-6.714e-4, 0.025054, -0.39978, 0.5440), (-0.0020322, 0.062767, -0.77857, 1.3822), (0.459, -2.273)
MANY_MEAN, MANY_SD = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)


def shapiro_wilk(df: DataFrame, x: str) -> DataFrame:
    """W and its p (for 4 values or more) from normal scores of the places; sums only, no list of values."""

    def poly(cs: tuple[float, ...], v: Column) -> Column:
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * v + c
        return out

    n = df.where(F.col(x).isNotNull()).count()
    values = counted(df, x).select(x, F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("ties"))).alias("k"))
    scores = values.withColumn("m", special.normal_quantile((F.col("k") - 0.375) / (n + 0.25)))
    top = lambda j: F.max(F.when(F.col("k") == n - j, F.col("m")))
    whole = scores.agg(F.sum(F.col("m") * F.col("m")).alias("mm"), top(0).alias("m1"), top(1).alias("m2"))
    u, root = F.lit(1 / max(n, 1) ** 0.5), F.sqrt("mm")
    a1, a2 = poly((*LAST, 0.0), u) + F.col("m1") / root, poly((*NEXT, 0.0), u) + F.col("m2") / root
    two = n > 5
    left = (F.col("mm") - 2 * F.col("m1") ** 2 - (2 * F.col("m2") ** 2 if two else 0)) / (1 - 2 * F.col("a1") ** 2 - (2 * F.col("a2") ** 2 if two else 0))
    whole = whole.withColumns({"a1": a1, "a2": a2}).withColumn("e", F.sqrt(left)).select("a1", "a2", "e")
    place, sign = F.least("k", n + 1 - F.col("k")), F.signum(F.col("k") - (n + 1) / 2)
    a = F.when(place == 1, sign * F.col("a1")).when((place == 2) & F.lit(two), sign * F.col("a2")).otherwise(F.col("m") / F.col("e"))
    r = scores.join(F.broadcast(whole)).agg(F.sum(a * F.col(x)).alias("b"), F.var_pop(x).alias("v"))
    w = F.least(F.col("b") ** 2 / F.nullif(F.col("v") * n, F.lit(0.0)), F.lit(1.0))
    log_n = F.lit(math.log(max(n, 1)))
    if n >= 12:
        z = (F.ln(1 - F.col("w")) - poly(MANY_MEAN, log_n)) / F.exp(poly(MANY_SD, log_n))
    else:
        z = (-F.ln(poly(FEW_SHIFT, F.lit(float(n))) - F.ln(1 - F.col("w"))) - poly(FEW_MEAN, F.lit(float(n)))) / F.exp(poly(FEW_SD, F.lit(float(n))))
    out = r.select(F.lit(n).cast("long").alias("n"), w.alias("w"))
    return out.withColumn("p", F.when(F.lit(n >= 4), 1 - special.normal_cdf(z)))


def correlations(df: DataFrame, factors: list[str]) -> DataFrame:
    """Absolute correlations of each two factors on complete rows: (a, b, c)."""
    rows = df.dropna(subset=factors)
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    one = rows.agg(*(F.abs(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))).alias(f"{a}|{b}") for a, b in pairs))
    flat = one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("c")) for a, b in pairs))).alias("v"))
    return flat.select("v.*")


def screened(summary: DataFrame, ic: float = 0.01, p: float = 0.05, days: int = 60) -> DataFrame:
    """Factors of some strength, significance and length, the strongest first."""
    return summary.where((F.abs("ic_mean") >= ic) & (F.col("p") < p) & (F.col("n") >= days)).orderBy(F.abs("ic_mean").desc(), "factor")


def decorrelated(ordered: list[str], corr: dict[tuple[str, str], float], limit: float = 0.8) -> list[str]:
    """I16: walks the factors in order and keeps one if it correlates below the limit with all kept before.

    The list and the matrix have as many entries as there are factors, so this runs on the driver.
    """
    kept: list[str] = []
    for f in ordered:
        if all((corr.get((f, g), corr.get((g, f))) or 0.0) < limit for g in kept):
            kept.append(f)
    return kept


def selected(ics: DataFrame, rows: DataFrame, g: str, limit: float = 0.8, ic: float = 0.01, p: float = 0.05, days: int = 60) -> list[tuple[str, int, str]]:
    """(group, place, factor) of the factors that pass the group's screen, de-correlated by the group's own complete rows."""
    passed: dict[str, list[str]] = {}
    for r in screened(with_p(ic_summary(ics, g, "factor")), ic, p, days).collect():
        passed.setdefault(r[g], []).append(r["factor"])
    out = []
    for k, names in sorted(passed.items()):
        corr = {(r["a"], r["b"]): r["c"] for r in correlations(rows.where(F.col(g) == k), names).collect()} if len(names) > 1 else {}
        out += [(k, i, f) for i, f in enumerate(decorrelated(names, corr, limit))]
    return out
