"""SQL for functions of small symmetric matrices, as lists of rows: products, and roots and inverses by Newton's iterations."""

from __future__ import annotations


def product(a: str, b: str) -> str:
    """a b for a symmetric ``b`` (its rows are its columns)."""
    return f"list_transform({a}, lambda p: list_transform({b}, lambda q: list_inner_product(p, q)))"


def shifted(a: str, diagonal: str, times: str = "1.0") -> str:
    """diagonal I + times a."""
    return f"list_transform({a}, lambda row, i: list_transform(row, lambda v, j: (CASE WHEN i = j THEN {diagonal} ELSE 0.0 END) + ({times}) * v))"


def inverse(name: str, src: str, a: str) -> str:
    """Table ``name`` (ens, x): the inverse of the positive definite column ``a`` of ``src`` (ens, a)."""
    trace = f"list_sum(list_transform({a}, lambda row, i: row[i]))"
    return f"""{name}_i(ens, t, a, x) AS (SELECT ens, 0, {a}, {shifted(a, "1.0 / " + trace, "0.0")} FROM {src}
UNION ALL SELECT ens, t + 1, a, {product("x", "y")} FROM (SELECT ens, t, a, x, {shifted(product("a", "x"), "2.0", "-1.0")} AS y FROM {name}_i WHERE t < 25)),
{name} AS MATERIALIZED (SELECT ens, x FROM {name}_i WHERE t = 25)"""


def inverse_root(name: str, src: str, a: str) -> str:
    """Table ``name`` (ens, x): the symmetric inverse square root of the positive definite column ``a`` of ``src`` (ens, a)."""
    trace = f"list_sum(list_transform({a}, lambda row, i: row[i]))"
    return f"""{name}_i(ens, t, c, y, z) AS (SELECT ens, 0, {trace}, {shifted(a, "0.0", "1.0 / " + trace)}, {shifted(a, "1.0", "0.0")} FROM {src}
UNION ALL SELECT ens, t + 1, c, {product("y", "w")}, {product("w", "z")} FROM (SELECT ens, t, c, y, z, {shifted(product("z", "y"), "1.5", "-0.5")} AS w FROM {name}_i WHERE t < 30)),
{name} AS MATERIALIZED (SELECT ens, {shifted("z", "0.0", "1.0 / sqrt(c)")} AS x FROM {name}_i WHERE t = 30)"""
