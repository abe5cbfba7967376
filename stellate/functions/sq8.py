"""8-bit scalar quantization with a minimum and a scale for each dimension, frozen once calibrated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .vectors import COSINE, DOT_PRODUCT, doubles, metric_of, norm

LEAST_RANGE = 1e-7
TARGET = 1024


def freeze_target(max_capacity: int, target: int = TARGET) -> int:
    return min(target, max_capacity) if max_capacity > 0 else target


@dataclass(frozen=True)
class Params:
    """Minimum and scale of each dimension."""

    low: tuple[float, ...]
    scale: tuple[float, ...]

    def as_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(self.low, self.scale, strict=True))], "dim int, min double, scale double")


def calibrate(rows: DataFrame, target: int) -> DataFrame:
    """``dim, min, scale`` over the ``target`` rows of lowest ``seq``, deleted ones among them."""
    first = rows.orderBy("seq").limit(target)
    ends = first.select(F.posexplode(doubles(F.col("vector"))).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("min"), F.max("x").alias("max"))
    return ends.select("dim", "min", (F.greatest(F.col("max") - F.col("min"), F.lit(LEAST_RANGE)) / 255).alias("scale"))


def freeze(rows: DataFrame, target: int) -> Params:
    """Calibrated parameters: one row for each dimension reaches the driver."""
    found = sorted(calibrate(rows, target).collect())
    return Params(tuple(r["min"] for r in found), tuple(r["scale"] for r in found))


def quantized(v: Column, p: Params) -> Column:
    """Codes -128 to 127; halves round up, values out of range clamp."""
    low, scale = F.lit(list(p.low)), F.lit(list(p.scale))
    one = lambda x, i: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor((x - low[i]) / scale[i] - 128 + 0.5))).cast("tinyint")
    return F.transform(doubles(v), one)


def dequantized(code: Column, p: Params) -> Column:
    low, scale = F.lit(list(p.low)), F.lit(list(p.scale))
    return F.transform(code, lambda c, i: low[i] + scale[i] * (c.cast("int") + 128))


def code_score(metric: str, code: Column, code_norm: Column, query: list[float], p: Params) -> Column:
    """Score of codes against a query whose scales are multiplied in beforehand: one product per dimension."""
    metric = metric_of(metric)
    scaled = F.lit([q * s for q, s in zip(query, p.scale, strict=True)])
    base = sum(q * (m + 128 * s) for q, m, s in zip(query, p.low, p.scale, strict=True))
    product = F.aggregate(F.transform(code, lambda c, i: scaled[i] * c.cast("double")), F.lit(base), lambda s, x: s + x)
    length = sum(q * q for q in query) ** 0.5
    if metric == DOT_PRODUCT:
        return product
    if metric == COSINE:
        return F.when((code_norm == 0) | F.lit(length == 0), F.lit(0.0)).otherwise(product / (code_norm * F.lit(length or 1.0)))
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(length * length) + code_norm * code_norm - 2 * product))


def with_codes(rows: DataFrame, p: Params) -> DataFrame:
    """Rows with ``code`` and ``code_norm``, the norm of the dequantized vector."""
    coded = rows.withColumn("code", quantized(F.col("vector"), p))
    return coded.withColumn("code_norm", norm(dequantized(F.col("code"), p)))
