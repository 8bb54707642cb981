"""DuckDB SQL text for what has no SQL function: linear solves, Newton steps, and tails of distributions. Only the registered SQL uses it."""

from __future__ import annotations

from .functions import arrays


def solved(name: str, source: str, n: int, right: list[list[str]]) -> str:
    """CTEs that end in ``name``: x{e}_{i} is entry i of the solution for right side e of the symmetric system a{i}_{j} (i <= j) in the one row of source.

    Elimination without pivots, one column a step; each step is kept, so expressions don't grow.
    """
    wide = n + len(right)
    start = [f"a{min(i, j)}_{max(i, j)} AS m{i}_{j}" for i in range(n) for j in range(n)] + [f"({right[e][i]})::double AS m{i}_{n + e}" for i in range(n) for e in range(len(right))]
    out = [f"{name}_0 AS MATERIALIZED (SELECT {', '.join(start)} FROM {source})"]
    for k in range(n):
        cells = [f"m{k}_{c} / m{k}_{k} AS m{k}_{c}" if i == k else f"m{i}_{c} - m{i}_{k} / m{k}_{k} * m{k}_{c} AS m{i}_{c}" for i in range(n) for c in range(wide)]
        out.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {', '.join(cells)} FROM {name}_{k})")
    out.append(f"{name} AS MATERIALIZED (SELECT {', '.join(f'm{i}_{n + e} AS x{e}_{i}' for e in range(len(right)) for i in range(n))} FROM {name}_{n})")
    return ", ".join(out)


def unit(n: int, j: int) -> list[str]:
    """A right side: the unit vector j."""
    return ["1.0" if i == j else "0.0" for i in range(n)]


def gram(columns: list[str], weight: str = "1.0") -> str:
    """Sums a{i}_{j} of products of columns."""
    return ", ".join(f"sum({weight} * {x} * {columns[j]})::double AS a{i}_{j}" for i, x in enumerate(columns) for j in range(i, len(columns)))


def t_tail(t: str, df: str, steps: int = 2000) -> str:
    """P(|T| > |t|) as a correlated subquery: Simpson's rule after x = |t| + u / (1 - u)."""
    x = f"(abs({t}) + k / ({steps}.0 - k))"
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * pow(1 + {x} * {x} / ({df}), -({df} + 1) / 2.0)"
    return f"(SELECT 2 * sum((CASE WHEN k = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {density} * {steps}.0 * {steps}.0 / (({steps}.0 - k) * ({steps}.0 - k))) / (3 * {steps}.0) FROM range({steps}) AS r(k))"


def normal_tail(z: str, steps: int = 2000) -> str:
    """P(|Z| > |z|), the same way."""
    x = f"(abs({z}) + k / ({steps}.0 - k))"
    return f"(SELECT 2 * sum((CASE WHEN k = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {steps}.0 * {steps}.0 / (({steps}.0 - k) * ({steps}.0 - k))) / (3 * {steps}.0) FROM range({steps}) AS r(k))"


def normal_quantile(p: str) -> str:
    """The normal quantile by the rational approximations whose fixed values ``functions.arrays`` has."""
    def poly(x: str, c: tuple) -> str:
        return "(" + " + ".join(f"{v!r} * pow({x}, {i})" for i, v in enumerate(c)) + ")"

    ratio = lambda x, t: f"{poly(x, t[0])} / {poly(x, t[1])}"
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    far = f"(CASE WHEN {r} <= 5 THEN {ratio(f'({r} - 1.6)', arrays.MIDDLE)} ELSE {ratio(f'({r} - 5)', arrays.TAIL)} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(f'(0.180625 - {q} * {q})', arrays.CENTRE)} ELSE sign({q}) * {far} END)"


def t_quantile(z: float, df: str) -> str:
    """A t quantile for many degrees of freedom, by the expansion around the normal quantile z."""
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return f"({z!r} + " + " + ".join(f"{c!r} / pow({df}, {i + 1})" for i, c in enumerate(terms)) + ")"


def logistic_newton(rows: str, columns: list[str], steps: int, ridge: list[float] | None = None) -> str:
    """CTEs b0 .. b{steps}: Newton steps from 0 on rows (columns, y), each b{s} with x0_{i}; ridge: penalty of each coefficient."""
    p, ridge = len(columns), ridge or [0.0] * len(columns)
    out = [f"b0 AS MATERIALIZED (SELECT {', '.join(f'0.0::double AS x0_{i}' for i in range(p))})"]
    for s in range(steps):
        out.append(logistic_sums(f"s{s}", rows, columns, f"b{s}", ridge))
        step = solved(f"d{s}", f"s{s}", p, [[f"g{i}" for i in range(p)]])
        out.append(step)
        out.append(f"b{s + 1} AS MATERIALIZED (SELECT {', '.join(f'b{s}.x0_{i} + d{s}.x0_{i} AS x0_{i}' for i in range(p))} FROM b{s}, d{s})")
    return ", ".join(out)


def logistic_sums(name: str, rows: str, columns: list[str], at: str, ridge: list[float] | None = None) -> str:
    """A CTE with the gradient g{i} and minus the Hessian a{i}_{j} at x0_{i} of ``at``, and the log-likelihood l."""
    ridge = ridge or [0.0] * len(columns)
    eta = " + ".join(f"{c} * x0_{i}" for i, c in enumerate(columns))
    g = [f"sum((y - pi) * {c}) - {ridge[i]!r} * any_value(x0_{i}) AS g{i}" for i, c in enumerate(columns)]
    h = [f"sum(pi * (1 - pi) * {c} * {columns[j]}) + {ridge[i] if i == j else 0.0!r} AS a{i}_{j}" for i, c in enumerate(columns) for j in range(i, len(columns))]
    return f"{name} AS MATERIALIZED (SELECT {', '.join(g + h)}, sum(y * eta - ln(1 + exp(eta))) AS l FROM (SELECT *, 1 / (1 + exp(-eta)) AS pi FROM (SELECT *, {eta} AS eta FROM {rows}, {at})))"
