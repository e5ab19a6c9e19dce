"""SQL for DuckDB that states what the registered queries compute, written apart from their plans.

Refinement is stated as a gather of four parents with weights 9, 3, 3 and 1 sixteenths,
box counts as a range join, and percentile ranks as a bracket join.
"""

from __future__ import annotations

from gridloom.functions.crs import E1, E2, K0, A


def cells(view: str, res: float, origin: str = "0") -> str:
    x0, y0 = ("0e0", "0e0") if origin == "0" else (f"(SELECT min(x) FROM {view})", f"(SELECT min(y) FROM {view})")
    return f"SELECT floor((x - {x0}) / {res:e})::BIGINT AS ix, floor((y - {y0}) / {res:e})::BIGINT AS iy, sum(v) AS s, count(*) AS c FROM {view} GROUP BY ALL"


def pull_push(source: str, res: float, levels: int, saturation: float = 1.0, nearest: bool = False, extent: str | None = None, at: str = "") -> str:
    """CTEs up to ``push`` (ix, iy, val, sup), from a CTE of cells.

    The grid covers the cells of ``extent`` (the source itself by default), padded to
    2 ** levels; ``at`` ends the names of all CTEs.
    """
    step, t = 1 << levels, at
    out = [f"c0{t} AS (SELECT * FROM {source})", f"dims{t} AS (SELECT (max(ix) + {step}) // {step} * {step} AS nx, (max(iy) + {step}) // {step} * {step} AS ny FROM {extent or source})"]
    for k in range(1, levels + 1):
        out.append(f"c{k}{t} AS (SELECT ix // 2 AS ix, iy // 2 AS iy, sum(s) AS s, sum(c) AS c FROM c{k - 1}{t} GROUP BY ALL)")
    for k in range(levels + 1):
        out.append(f"g{k}{t} AS (SELECT a.i AS ix, b.i AS iy FROM (SELECT unnest(range(0, nx // {1 << k})) AS i FROM dims{t}) a, (SELECT unnest(range(0, ny // {1 << k})) AS i FROM dims{t}) b)")
    out.append(f"v{levels}{t} AS (SELECT ix, iy, coalesce(s, 0) / greatest(coalesce(c, 0), 1e-9) AS val, CASE WHEN c > 0 THEN {res * step:e} ELSE 1e9 END AS sup FROM g{levels}{t} LEFT JOIN c{levels}{t} USING (ix, iy))")
    for k in range(levels - 1, -1, -1):
        n = 1 << (k + 1)
        v = f"v{k + 1}{t}"
        if nearest:
            up = f"SELECT g.ix, g.iy, p.val, p.sup FROM g{k}{t} g JOIN {v} p ON p.ix = g.ix // 2 AND p.iy = g.iy // 2"
        else:
            mix = lambda c: f"(9 * a.{c} + 3 * b.{c} + 3 * d.{c} + e.{c}) / 16 AS {c}"
            four = f"SELECT ix, iy, ix // 2 AS px, iy // 2 AS py, greatest(0, least(nx // {n} - 1, ix // 2 + 2 * (ix % 2) - 1)) AS qx, greatest(0, least(ny // {n} - 1, iy // 2 + 2 * (iy % 2) - 1)) AS qy FROM g{k}{t}, dims{t}"
            up = f"SELECT n.ix, n.iy, {mix('val')}, {mix('sup')} FROM ({four}) n JOIN {v} a ON a.ix = px AND a.iy = py JOIN {v} b ON b.ix = qx AND b.iy = py JOIN {v} d ON d.ix = px AND d.iy = qy JOIN {v} e ON e.ix = qx AND e.iy = qy"
        w = f"least(coalesce(c, 0) / {saturation:e}, 1e0)"
        out.append(f"v{k}{t} AS (SELECT u.ix, u.iy, {w} * coalesce(s, 0) / greatest(coalesce(c, 0), 1e-9) + (1 - {w}) * u.val AS val, {w} * {res * (1 << k):e} + (1 - {w}) * u.sup AS sup FROM ({up}) u LEFT JOIN c{k}{t} USING (ix, iy))")
    out.append(f"push{t} AS (SELECT v.* FROM v0{t} v, (SELECT max(ix) AS mx, max(iy) AS my FROM {extent or source}) WHERE ix <= mx AND iy <= my)")
    return ", ".join(out)


def near(radius: int, source: str = "c0") -> str:
    """Points within a square of each pushed cell."""
    return f"near AS (SELECT p.ix, p.iy, sum(c.c) AS n FROM push p JOIN {source} c ON c.ix BETWEEN p.ix - {radius} AND p.ix + {radius} AND c.iy BETWEEN p.iy - {radius} AND p.iy + {radius} GROUP BY ALL)"


def knots(view: str, n: int) -> str:
    """Table k(i, q, p): quantiles with a running maximum."""
    return f"qq AS (SELECT unnest(range({n})) AS i, unnest(quantile_cont(v, [{', '.join(repr(i / (n - 1)) for i in range(n))}])) AS q FROM {view}), k AS (SELECT i, max(q) OVER (ORDER BY i) AS q, i * {100 / (n - 1)!r} AS p FROM qq)"


def ranked(source: str, v: str, columns: str) -> str:
    """Percentile ranks of column v: between the last knot below and the next one."""
    return (
        f"SELECT {columns}, CASE WHEN a.i IS NULL THEN 0e0 WHEN b.i IS NULL THEN 1e2 ELSE a.p + (b.p - a.p) * (t.{v} - a.q) / (b.q - a.q) END AS pct "
        f"FROM {source} t ASOF LEFT JOIN k a ON t.{v} > a.q LEFT JOIN k b ON b.i = a.i + 1"
    )


Q_LAT = f"({1 - E2!r} * (sin(radians(lat)) / (1 - {E2!r} * sin(radians(lat)) ** 2) - ln((1 - {E1!r} * sin(radians(lat))) / (1 + {E1!r} * sin(radians(lat)))) / {2 * E1!r}))"
EQUAL_AREA = f"{A * K0!r} * radians(lon) AS x, {A!r} * {Q_LAT} / {2 * K0!r} AS y"
MERCATOR = f"{A!r} * radians(lon) AS x, {A!r} * ln(tan(pi() / 4 + radians(lat) / 2)) AS y"


def equal_area_of_mercator(source: str) -> str:
    """The rows of ``source`` (X, Y in EPSG:3857) with wx, wy in EPSG:6933."""
    return f"SELECT *, {A * K0!r} * radians(lon) AS wx, {A!r} * {Q_LAT} / {2 * K0!r} AS wy FROM (SELECT *, degrees(X / {A!r}) AS lon, degrees(2 * atan(exp(Y / {A!r})) - pi() / 2) AS lat FROM {source})"


def icc(scale: float, source: str = "p_li", v: str = "v") -> str:
    return f"SELECT {scale:e} AS scale, 1 - avg((v - m) * (v - m)) / var_pop(v) AS icc FROM (SELECT {v} AS v, avg({v}) OVER (PARTITION BY floor((x - (SELECT min(x) FROM {source})) / {scale:e}), floor((y - (SELECT min(y) FROM {source})) / {scale:e})) AS m FROM {source})"

