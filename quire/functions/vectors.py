"""Vector functions as Catalyst column expressions (V1-V5): no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DIST_DECIMALS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(a), lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))


def l2_distance(a, b) -> Column:
    """V1: Euclidean distance of two equal-length vectors."""
    sq = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def page_distance(i, j) -> Column:
    """V2: absolute page-number difference."""
    return F.abs(_col(i) - _col(j))


def blended_distance(a, b, i, j, alpha: float, decimals: int | None = DIST_DECIMALS) -> Column:
    """V3: alpha * content distance + (1 - alpha) * page distance (alpha > 1 allowed).

    Rounded to ``decimals`` places so engines that sum in different orders agree on ties.
    """
    d = F.lit(float(alpha)) * l2_distance(a, b) + F.lit(1.0 - float(alpha)) * page_distance(i, j).cast("double")
    return F.round(d, decimals) if decimals is not None else d


def cosine_similarity(a, b) -> Column:
    """V4: cosine of two vectors; 0 when either is the zero vector."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def vector_add(a, b) -> Column:
    """V5: element-wise sum."""
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def mean_vector(df: DataFrame, keys: list[str], vec: str = "embedding", out: str = "mean") -> DataFrame:
    """V5 per group: element-wise mean of the group's vectors.

    Exploded to (keys, dim) so the average is a distributed partial/final aggregate over a key
    that includes the dimension - a hot group is spread over as many tasks as it has dimensions,
    and no group's rows are ever collected; only the d per-dimension means are gathered back.
    """
    per_dim = (
        df.select(*keys, F.posexplode(vec).alias("dim", "x"))
        .groupBy(*keys, "dim")
        .agg(F.avg("x").alias("m"))
    )
    return per_dim.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias(out)
    )
