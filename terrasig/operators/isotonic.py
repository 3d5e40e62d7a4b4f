"""Isotonic regression by pooling adjacent violators in ordered ranges.

The histogram of distinct scores is cut into ranges of bounded size and every range is pooled on its own, in parallel. Pooling
does not depend on its order, so what remains is to pool across the borders: only the first and last block of each range come
to the driver, ranges whose border violates the order are pooled together, two at a time, and cut again. The fit is
done when no border violates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasig.session import cut_lineage

#: Blocks (at first: distinct scores) of a range; two ranges are pooled in one task at most.
BLOCKS = 100_000

_BLOCK = "range bigint, lo double, hi double, n double, total double"


def pool(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ascending means from ordered blocks."""
    out: list[tuple[float, float, float, float]] = []
    for a, b, w, s in zip(lo.tolist(), hi.tolist(), n.tolist(), total.tolist(), strict=True):
        while out and out[-1][3] * w >= s * out[-1][2]:  # the mean before is not below
            p = out.pop()
            a, w, s = p[0], p[2] + w, p[3] + s
        out.append((a, b, w, s))
    cols = np.array(out, np.float64).reshape(-1, 4)
    return cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3]


def _pooler(blocks: int):
    """One group of ranges, pooled and cut into ranges again. Range ids keep the order: a group's first one is its base."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        lo, hi, n, total = pool(*(pdf[c].to_numpy() for c in ("lo", "hi", "n", "total")))
        ids = int(pdf["base"].iloc[0]) + np.arange(len(lo)) // blocks
        return pd.DataFrame({"range": ids, "lo": lo, "hi": hi, "n": n, "total": total})

    return run


def _cuts(hist: DataFrame, blocks: int) -> list[float]:
    ranges = -(-hist.count() // blocks)
    if ranges < 2:
        return []
    probs = [i / ranges for i in range(1, ranges)]
    return sorted(set(hist.agg(F.percentile_approx("x", probs, 100 * ranges)).first()[0]))


def _ranged(df: DataFrame, cuts: list[float], x: str, out: str) -> DataFrame:
    """Index of the range that holds x."""
    if not cuts:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    place = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=x, outputCol=out, handleInvalid="keep")
    return place.transform(df).withColumn(out, F.col(out).cast("bigint"))


def _regroup(borders: list, blocks: int) -> Iterator[list[int]]:
    """Neighbouring ranges to pool together: a pair at a violating border, and more while they are small."""
    i = 0
    while i < len(borders):
        group, size = [i], borders[i]["n"]
        while i + 1 < len(borders) and borders[i]["last"] >= borders[i + 1]["first"] and (len(group) == 1 or size + borders[i + 1]["n"] <= blocks):
            i += 1
            group.append(i)
            size += borders[i]["n"]
        if len(group) > 1:
            yield [borders[j]["range"] for j in group]
        i += 1


def fit_blocks(hist: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Blocks (lo, hi, n, total) of ascending means of a histogram (x, n, total) of distinct scores."""
    spark = hist.sparkSession
    # ids are spread, so that a range that is cut again finds ids of its own before the next one
    spread = 1_000
    first = _ranged(hist, _cuts(hist, blocks), "x", "range").select((F.col("range") * spread).alias("base"), F.col("x").alias("lo"), F.col("x").alias("hi"), F.col("n").cast("double"), F.col("total").cast("double"))
    state = cut_lineage(first.groupBy("base").applyInPandas(_pooler(blocks), _BLOCK))
    while True:
        mean = F.col("total") / F.col("n")
        edges = state.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
        borders = sorted(edges.collect(), key=lambda r: r["lo"])  # one row a range
        groups = list(_regroup(borders, blocks))
        if not groups:
            return state.drop("range")
        table = spark.createDataFrame([(r, min(g)) for g in groups for r in g], "range bigint, base bigint")
        marked = state.join(F.broadcast(table), "range", "left")  # one row a range
        pooled = marked.filter("base is not null").groupBy("base").applyInPandas(_pooler(blocks), _BLOCK)
        state = cut_lineage(marked.filter("base is null").select(*pooled.columns).unionByName(pooled))


def histogram(df: DataFrame, score: str, label: str) -> DataFrame:
    """(x, n, total) of the distinct scores of rows that have one."""
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("total")
    )


def fitted(df: DataFrame, score: str, label: str, blocks: int = BLOCKS) -> DataFrame:
    """(x, fitted) for every distinct score. Blocks are laid over the histogram range by range, so no task holds more than a
    range's scores however wide a block is."""
    hist = cut_lineage(histogram(df, score, label))
    found = fit_blocks(hist, blocks).withColumn("value", F.col("total") / F.col("n"))
    cuts = _cuts(hist, blocks)
    over = _ranged(_ranged(found, cuts, "lo", "_a"), cuts, "hi", "_b")
    over = over.select(F.explode(F.sequence("_a", "_b")).alias("_range"), F.col("lo").alias("x"), "value", F.lit(0).alias("_score"))
    rows = _ranged(hist, cuts, "x", "_range").select("_range", "x", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_score"))
    w = Window.partitionBy("_range").orderBy("x", "_score").rowsBetween(Window.unboundedPreceding, 0)
    laid = over.unionByName(rows).withColumn("fitted", F.last("value", ignorenulls=True).over(w))
    return laid.filter("_score = 1").select("x", "fitted")


class Calibrator:
    """A fitted isotonic map: knots (x, value) in ascending order, linear between them and flat beyond."""

    def __init__(self, knots: DataFrame):
        self.knots = knots.select("x", "value")
        rows = self.knots.orderBy("x").collect()  # a model: two rows for each block of the fit
        self.x, self.value = [r["x"] for r in rows], [r["value"] for r in rows]

    @classmethod
    def fit(cls, df: DataFrame, score: str, label: str, blocks: int = BLOCKS) -> Calibrator:
        found = fit_blocks(cut_lineage(histogram(df, score, label)), blocks)
        ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")
        return cls(found.select(ends, (F.col("total") / F.col("n")).alias("value")))

    def transform(self, df: DataFrame, score: str = "raw", out: str = "p") -> DataFrame:
        """Add `out`; NULL where the score is missing, or where nothing was fitted."""
        if not self.x:
            return df.withColumn(out, F.lit(None).cast("double"))
        if len(self.x) == 1:
            return df.withColumn(out, F.when(F.col(score).isNotNull(), F.lit(self.value[0])))
        inside = Bucketizer(splits=[-float("inf"), *self.x, float("inf")], inputCol="_s", outputCol="_k", handleInvalid="keep")
        xs, vs = (F.array(*[F.lit(float(v)) for v in values]) for values in (self.x, self.value))
        df = inside.transform(df.withColumn("_s", F.col(score).cast("double"))).withColumn("_k", F.col("_k").cast("int"))
        last = len(self.x)
        low, high = F.greatest(F.lit(1), F.least(F.lit(last), F.col("_k"))), F.greatest(F.lit(1), F.least(F.lit(last), F.col("_k") + 1))
        x0, x1, v0, v1 = (F.element_at(a, i) for a, i in ((xs, low), (xs, high), (vs, low), (vs, high)))
        between = F.when(x1 > x0, v0 + (v1 - v0) * (F.col("_s") - x0) / (x1 - x0)).otherwise(v0)
        return df.withColumn(out, F.when(F.col("_s").isNotNull(), between)).drop("_s", "_k")
