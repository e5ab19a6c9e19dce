"""Value transforms: column expressions with their inverses, and fitted percentile ranks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: knots of the percentile table.
KNOTS = 1001


@dataclass(frozen=True)
class Transform:
    """A named pair of column functions and the condition on the least value under which it applies."""

    name: str
    fwd: Callable[[Column], Column]
    inv: Callable[[Column], Column]
    valid: Callable[[float], bool] = field(default=lambda least: True)

    def fit(self, values: DataFrame, column: str) -> Transform:
        return self

    def state(self) -> dict:
        return {"name": self.name}


class PercentileTransform(Transform):
    """Empirical percentile ranks, 0 to 100, by a table of quantiles; ties take the low end of their run."""

    def __init__(self, quantiles: list[float] | np.ndarray | None = None) -> None:
        q = None if quantiles is None else np.asarray(quantiles, np.float64)
        object.__setattr__(self, "name", "percentile")
        object.__setattr__(self, "quantiles", q)
        object.__setattr__(self, "valid", lambda least: True)
        object.__setattr__(self, "fwd", self._fwd)
        object.__setattr__(self, "inv", self._inv)

    def fit(self, values: DataFrame, column: str, accuracy: int | None = None) -> PercentileTransform:
        """Exact quantiles, or approximate ones of the given accuracy where the exact sort is too much."""
        return PercentileTransform(rising(quantiles(values, column, KNOTS, accuracy)))

    @property
    def _knots(self) -> np.ndarray:
        if self.quantiles is None:
            raise ValueError("the percentile transform is not fitted")
        return self.quantiles

    def _fwd(self, v: Column) -> Column:
        """Linear interpolation between the last knot below a value and the next one, by binary search over Arrow batches."""
        q = self._knots
        p = np.linspace(0.0, 100.0, len(q))

        @F.pandas_udf("double")
        def rank(s: pd.Series) -> pd.Series:
            v = s.to_numpy()
            b = np.clip(np.searchsorted(q, v), 1, len(q) - 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside = p[b - 1] + (p[b] - p[b - 1]) * (v - q[b - 1]) / (q[b] - q[b - 1])
            return pd.Series(np.where(v > q[0], np.where(v > q[-1], 100.0, inside), 0.0), index=s.index).where(s.notna())

        return rank(v)

    def _inv(self, p: Column) -> Column:
        """Knots are evenly spaced in percent, so a look-up at a computed place is enough."""
        q = self._knots
        table = F.array(*(F.lit(float(x)) for x in q)) if len(q) < 64 else F.split(F.lit(",".join(map(repr, q.tolist()))), ",").cast("array<double>")
        at = F.least(F.greatest(p, F.lit(0.0)), F.lit(100.0)) * F.lit((len(q) - 1) / 100.0)
        low = F.least(F.floor(at), F.lit(len(q) - 2)).cast("int")
        return F.get(table, low) + (at - low) * (F.get(table, low + 1) - F.get(table, low))

    def state(self) -> dict:
        return {"name": self.name, "quantiles": None if self.quantiles is None else self.quantiles.tolist()}


#: Values that one task ranks.
FEW = 200_000


def quantiles(values: DataFrame, column: str, knots: int = KNOTS, accuracy: int | None = None) -> np.ndarray:
    """Evenly spaced quantiles of a column with linear interpolation, exact unless ``accuracy`` is given.

    Up to FEW values one aggregate ranks them all.  Beyond that approximate quantiles part the
    values into buckets.  Each bucket ranks its distinct values, offset by the counts of the
    buckets before, and a value tells by arithmetic which knots its ranks hold; so no task
    sees more than a bucket, and the driver gets the knots.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    if not accuracy and 0 < v.limit(FEW + 1).count() <= FEW:
        every = F.split(F.lit(",".join(repr(i / (knots - 1)) for i in range(knots))), ",").cast("array<double>")
        return np.array(v.agg(F.percentile("v", every)).first()[0], np.float64)
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (knots - 1) for i in range(knots)] if accuracy else [(i + 1) / parts for i in range(parts - 1)] or [0.5]
    table = F.split(F.lit(",".join(map(repr, shares))), ",").cast("array<double>")
    n, bounds = v.agg(F.count("v"), F.percentile_approx("v", table, accuracy or 10_000)).first()
    if not n:
        raise ValueError("No valid points to fit quantiles on")
    if accuracy:
        return np.array(bounds, np.float64)
    edges = np.array(sorted(set(bounds)))

    @F.pandas_udf("int")
    def bucket(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, s), dtype="int32")

    counted = v.groupBy("v").agg(F.count(F.lit(1)).alias("c")).withColumn("bucket", bucket("v"))
    sizes = {r["bucket"]: r["c"] for r in counted.groupBy("bucket").agg(F.sum("c").alias("c")).collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(len(edges) + 1)])])
    offset = F.split(F.lit(",".join(map(str, before.tolist()))), ",").cast("array<long>")
    ranked = counted.withColumn("hi", F.get(offset, "bucket") + F.sum("c").over(Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    last, k = n - 1, knots - 1
    if not last:
        return np.full(knots, v.first()[0])
    # ranks lo..hi-1 hold the lower end of knots from..to, and the upper end of others
    own = ranked.select("v", (F.col("hi") - F.col("c")).alias("lo"), "hi")
    ceil = f"(({{0}} * {k}L + {last - 1}L) div {last}L)"
    lower = own.select("v", F.expr(f"{ceil.format('lo')} as a"), F.expr(f"least({ceil.format('hi')} - 1, {k}L) as b"), F.lit(True).alias("low"))
    upper = own.select("v", F.expr(f"if(lo = 0, 0L, ((lo - 1) * {k}L) div {last}L + 1) as a"), F.expr(f"((hi - 1) * {k}L) div {last}L as b"), F.lit(False).alias("low"))
    ends = lower.unionAll(upper).where("a <= b").select("v", "low", F.explode(F.sequence("a", "b")).alias("knot"))
    rows = ends.groupBy("knot").agg(F.max(F.when(F.col("low"), F.col("v"))).alias("low"), F.max(F.when(~F.col("low"), F.col("v"))).alias("high")).collect()
    out = np.zeros(knots)
    for r in rows:
        share = r["knot"] * last % k / k
        out[r["knot"]] = r["low"] + (r["high"] - r["low"]) * share
    return out


def rising(q: np.ndarray) -> np.ndarray:
    """Running maximum.  Ties stay: a least step per knot would move ranks off exact halves."""
    return np.maximum.accumulate(np.asarray(q, np.float64))


def transforms() -> list[Transform]:
    """The candidates, new ones on each call, in the order in which ties are settled."""
    return [
        Transform("identity", lambda v: v, lambda t: t),
        Transform("log10", F.log10, lambda t: F.pow(F.lit(10.0), t), lambda least: least > 0),
        Transform("sqrt", F.sqrt, lambda t: t * t, lambda least: least >= 0),
        PercentileTransform(),
    ]


def make_transform(state: dict) -> Transform:
    """The transform that a saved state describes."""
    for t in transforms():
        if t.name == state.get("name"):
            return PercentileTransform(state.get("quantiles")) if t.name == "percentile" else t
    raise ValueError(f"Unknown transform: {state.get('name')!r}")
