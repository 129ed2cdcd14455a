"""SQL texts that the oracles share: tails of distributions and least squares by the sweep operator."""

from __future__ import annotations


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom, by its finite sums."""
    s, c = f"(abs({t}) / sqrt({df} + ({t}) * ({t})))", f"sqrt({df} / ({df} + ({t}) * ({t})))"
    even = f"{s} * list_sum(list_transform(range(0, ({df})::BIGINT // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - 0.5 * ln(pi()) + 2 * j * ln({c}))))"
    odd = f"2 / pi() * (asin({s}) + {s} * coalesce(list_sum(list_transform(range(0, (({df})::BIGINT - 1) // 2), lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5) + 0.5 * ln(pi()) - ln(2.0) + (2 * j + 1) * ln({c})))), 0))"
    return f"(1 - CASE WHEN ({df})::BIGINT % 2 = 0 THEN {even} ELSE {odd} END)"


def gram_sql(name: str, rows: str, columns: list[str], keys: str = "") -> str:
    """CTE ``name``: keys, n, m, the cross products of ``columns`` as one list by rows."""
    n = len(columns)
    cells = ", ".join(f"sum({columns[i]} * {columns[j]})" for i in range(n) for j in range(n))
    return f"{name} AS MATERIALIZED (SELECT {keys + ', ' if keys else ''}count(*) AS n, [{cells}] AS m FROM {rows}{' GROUP BY ' + keys if keys else ''})"


def sweep_sql(name: str, gram: str, size: int, pivots: int, keys: str = "") -> str:
    """CTE ``name`` (needs WITH RECURSIVE): ``gram`` with the first ``pivots`` columns swept.

    Coefficients then stand above right, the residual cross products below right and
    the inverse, with its sign turned, above left.
    """
    k = keys + ", " if keys else ""
    at = lambda i, j: f"m[({i}) * {size} + ({j}) + 1]"
    i, j = f"(q // {size})", f"(q % {size})"
    cell = (
        f"CASE WHEN {i} = k AND {j} = k THEN -1 / {at('k', 'k')} WHEN {i} = k THEN {at('k', j)} / {at('k', 'k')} WHEN {j} = k THEN {at(i, 'k')} / {at('k', 'k')} "
        f"ELSE {at(i, j)} - {at(i, 'k')} * {at('k', j)} / {at('k', 'k')} END"
    )
    return f"""{name}_r AS (SELECT {k}n, 0 AS k, m FROM {gram} UNION ALL SELECT {k}n, k + 1, list_transform(range(0, {size * size}), lambda q: {cell}) FROM {name}_r WHERE k < {pivots}),
{name} AS MATERIALIZED (SELECT {k}n, m FROM {name}_r WHERE k = {pivots})"""


def influence_sql(name: str, rows: str, fit: str, columns: list[str], keys: str, more: str = "") -> str:
    """CTE ``name``: keys, t, n, beta, se_ols of the last column before y, and its influence v by step, from a swept ``fit`` of ``columns`` (y last)."""
    k = len(columns)
    fitted = " + ".join(f"{c} * m[{(i + 1) * k}]" for i, c in enumerate(columns[:-1]))
    part = " + ".join(f"{c} * m[{(k - 2) * k + i + 1}]" for i, c in enumerate(columns[:-1]))
    return f"{name} AS (SELECT {keys}, t, n, m[{(k - 1) * k}] AS beta, sqrt(m[{k * k}] / (n - {k - 1}) * -m[{(k - 1) * k - 1}]) AS se_ols{more}, -({part}) * (y - ({fitted})) * sqrt(n / (n - {k - 1}.0)) AS v FROM {rows} JOIN {fit} USING ({keys}))"
