"""SQL of linear models with several factors: sums, their windows, and Cramer's rule."""

from __future__ import annotations

from ..functions import special


def det(m: list[list[str]]) -> str:
    """The determinant of a matrix of column names, along its first row."""
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if k % 2 else '+'} {m[0][k]} * ({det([r[:k] + r[k + 1 :] for r in m[1:]])})" for k in range(len(m)) if m[0][k] != "0"]
    return " ".join(parts)


def solution(p: int) -> list[str]:
    """x of A x = r, A being symmetric with the columns a_i_j (i <= j) and r the columns r_i."""
    a = [[f"a_{min(i, j)}_{max(i, j)}" for j in range(p)] for i in range(p)]
    return [f"({det([[f'r_{i}' if j == k else a[i][j] for j in range(p)] for i in range(p)])}) / ({det(a)})" for k in range(p)]


def sums(source: str, xs: list[str], y: str, by: str, name: str) -> str:
    """A table of the sums over complete rows."""
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    cols = [f"sum({x}) AS s_{i}" for i, x in enumerate(xs)] + [f"sum({xs[i]} * {xs[j]}) AS q_{i}_{j}" for i, j in pairs] + [f"sum({x} * {y}) AS w_{i}" for i, x in enumerate(xs)]
    full = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, y])
    return f"{name} AS (SELECT {by}, count(*)::DOUBLE AS n, sum({y}) AS sy, sum({y} * {y}) AS syy, {', '.join(cols)} FROM {source} WHERE {full} GROUP BY {by})"


def centred(p: int, source: str, name: str) -> str:
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    cols = [f"s_{i} / n AS m_{i}" for i in range(p)] + [f"q_{i}_{j} - s_{i} * s_{j} / n AS c_{i}_{j}" for i, j in pairs] + [f"w_{i} - s_{i} * sy / n AS v_{i}" for i in range(p)]
    return f"{name} AS (SELECT *, sy / n AS my, syy - sy * sy / n AS yy, {', '.join(cols)} FROM {source})"


def walk_forward(source: str, xs: list[str], y: str, days: int, alpha: float, least: int, scaled: bool = False, tag: str = "") -> str:
    """Tables that end in pp{tag}: rows of source complete in factors, with n_train and the prediction p."""
    p, t = len(xs), tag
    names = ["n", "sy", "syy", *(f"s_{i}" for i in range(p)), *(f"q_{i}_{j}" for i in range(p) for j in range(i, p)), *(f"w_{i}" for i in range(p))]
    scale = [f"CASE WHEN c_{i}_{i} > 0 THEN sqrt(c_{i}_{i} / n) ELSE 1 END AS d_{i}" if scaled else f"1.0::DOUBLE AS d_{i}" for i in range(p)]
    system = [f"c_{i}_{j} / (d_{i} * d_{j}){f' + {alpha}' if i == j else ''} AS a_{i}_{j}" for i in range(p) for j in range(i, p)] + [f"v_{i} / d_{i} AS r_{i}" for i in range(p)]
    whole = " AND ".join(f"{x} IS NOT NULL" for x in xs)
    return f"""{sums(source, xs, y, 'date', f'dg{t}')}, wd{t} AS (SELECT d.date, {', '.join(f'sum({c}) AS {c}' for c in names)} FROM (SELECT DISTINCT date FROM {source}) d JOIN dg{t} g ON g.date >= d.date - {days} AND g.date < d.date GROUP BY d.date HAVING sum(n) >= {least}),
{centred(p, f'wd{t}', f'ce{t}')}, sc{t} AS (SELECT *, {', '.join(scale)} FROM ce{t}), so{t} AS (SELECT *, {', '.join(system)} FROM sc{t}),
be{t} AS (SELECT date, n, my, {', '.join(f'm_{i}' for i in range(p))}, {', '.join(f'({x}) / d_{i} AS b_{i}' for i, x in enumerate(solution(p)))} FROM so{t}),
pp{t} AS (SELECT s.*, n AS n_train, my + {' + '.join(f'b_{i} * ({x} - m_{i})' for i, x in enumerate(xs))} AS p FROM {source} s JOIN be{t} USING (date) WHERE {whole})"""


def daily(source: str, xs: list[str], y: str, least: int) -> str:
    """Tables that end in ols: by date the coefficients c_0 (intercept) to c_p, R2 and adjusted R2."""
    p = len(xs)
    system = [f"c_{i}_{j} AS a_{i}_{j}" for i in range(p) for j in range(i, p)] + [f"v_{i} AS r_{i}" for i in range(p)]
    return f"""{sums(source, xs, y, 'date', 'dg')}, {centred(p, 'dg', 'ce')}, so AS (SELECT *, {', '.join(system)} FROM ce WHERE n >= {least}),
be AS (SELECT *, {', '.join(f'{x} AS b_{i}' for i, x in enumerate(solution(p)))} FROM so), rr AS (SELECT *, 1 - greatest(yy - ({' + '.join(f'b_{i} * v_{i}' for i in range(p))}), 0) / nullif(yy, 0) AS r2 FROM be),
ols AS (SELECT date, n, my - ({' + '.join(f'b_{i} * m_{i}' for i in range(p))}) AS c_0, {', '.join(f'b_{i} AS c_{i + 1}' for i in range(p))}, r2, CASE WHEN n > {p + 1} THEN 1 - (1 - r2) * (n - 1) / (n - {p + 1}) END AS adj_r2 FROM rr)"""


def t_two_sided(t: str, df: str) -> str:
    """Two-sided p of t with a whole number of degrees of freedom: the finite sums over powers of a cosine."""
    s, c = f"sin(atan(abs({t}) / sqrt({df})))", f"ln(cos(atan(abs({t}) / sqrt({df}))))"
    even = f"{s} * list_sum([exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0) + 2 * k * {c}) FOR k IN range(0, ({df}) // 2)])"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * coalesce(list_sum([exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5) + (2 * k + 1) * {c}) FOR k IN range(0, (({df}) - 1) // 2)]), 0))"
    return f"(1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def normal_quantile(p: str) -> str:
    """The rational approximation that the engine uses."""

    def poly(cs: tuple[float, ...], x: str) -> str:
        out = f"{cs[0]:.16e}"
        for c in cs[1:]:
            out = f"({out} * {x} + {c:.16e})"
        return out

    tail = lambda q: f"({poly(special.C, q)} / ({poly(special.D, q)} * {q} + 1))"
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    r = f"({q} * {q})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 1 - 0.02425 THEN -{tail(high)} ELSE {poly(special.A, r)} * {q} / ({poly(special.B, r)} * {r} + 1) END"


def normal_cdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 3.275911e-01 * {x}))"
    poly = "0e0"
    for c in special.ERF:
        poly = f"(({poly} + {c:.16e}) * {t})"
    return f"CASE WHEN {z} > 0 THEN 1 - 0.5e0 * {poly} * exp(-{x} * {x}) ELSE 0.5e0 * {poly} * exp(-{x} * {x}) END"


def horner(cs: tuple[float, ...], v: str) -> str:
    out = f"{cs[0]:.16e}"
    for c in cs[1:]:
        out = f"({out} * {v} + {c:.16e})"
    return out


def shapiro_wilk(source: str, x: str, stats: object) -> str:
    """Tables that end in sw (n, w, p), for 12 values or more."""
    return f"""sv AS (SELECT {x} AS x, row_number() OVER (ORDER BY {x}) AS k, count(*) OVER () AS n FROM {source} WHERE {x} IS NOT NULL), sp AS (SELECT *, (k - 0.375e0) / (n + 0.25e0) AS p FROM sv), sm AS (SELECT *, {normal_quantile('p')} AS m FROM sp),
s1 AS (SELECT n, 1 / sqrt(n) AS u, sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (k = n - 1) AS m2 FROM sm GROUP BY n), s2 AS (SELECT *, {horner((*stats.LAST, 0.0), 'u')} + m1 / sqrt(mm) AS a1, {horner((*stats.NEXT, 0.0), 'u')} + m2 / sqrt(mm) AS a2 FROM s1),
s3 AS (SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS e FROM s2),
s4 AS (SELECT s3.n, sum(x * CASE WHEN k = s3.n THEN a1 WHEN k = 1 THEN -a1 WHEN k = s3.n - 1 THEN a2 WHEN k = 2 THEN -a2 ELSE m / e END) AS b, var_pop(x) AS v FROM sm, s3 GROUP BY s3.n), s5 AS (SELECT n, b * b / (v * n) AS w, ln(n) AS l FROM s4),
s6 AS (SELECT n, w, (ln(1 - w) - {horner(stats.MANY_MEAN, 'l')}) / exp({horner(stats.MANY_SD, 'l')}) AS z FROM s5), sw AS (SELECT n, w, 1 - {normal_cdf('z')} AS p FROM s6)"""
