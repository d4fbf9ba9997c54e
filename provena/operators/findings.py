"""The relation of findings, to which every check adds rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.sources.schemas import FLAGS, SEVERITY_WEIGHT, STEPS


def findings(df: DataFrame, field: Column | str, reason: Column | str, severity: Column | str, check: str, step: str, bbox: Column | None = None, order: tuple = (), page: Column | None = None) -> DataFrame:
    """Rows of ``df`` as findings. Strings of field, reason and severity are literals; order: up to three sort keys within the step."""
    return df.select(*columns(field, reason, severity, check, step, bbox, order, page))


def columns(field: Column | str, reason: Column | str, severity: Column | str, check: str, step: str, bbox: Column | None = None, order: tuple = (), page: Column | None = None) -> list[Column]:
    """The columns of findings()."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    keys = [*[F.col(k) if isinstance(k, str) else k for k in order], *[F.lit(0)] * 3][:3]
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        (page if page is not None else F.col("page")).cast("int").alias("page"),
        F.lit(STEPS[step]).alias("step"),
        *[k.cast("long").alias(n) for k, n in zip(keys, ("k1", "k2", "k3"), strict=True)],
        lit(field).alias("field"),
        lit(reason).alias("reason"),
        lit(severity).alias("severity"),
        F.lit(check).alias("check"),
        (bbox if bbox is not None else F.lit(None)).cast("array<int>").alias("bbox"),
        F.lit("yellow" if check == "font" else "red").alias("marker"),
    ]


def all_findings(parts: list[DataFrame]) -> DataFrame:
    """The union of checks' findings."""
    return reduce(DataFrame.unionByName, parts)


def numbered(flags: DataFrame) -> DataFrame:
    """Findings with flag_seq, in order of emission: document checks, then page by page, check by check."""
    order = W.partitionBy("doc_id").orderBy(F.when(F.col("step") == 0, 0).otherwise(F.col("page")), "step", "k1", "k2", "k3", "field", "reason")
    return flags.withColumn("flag_seq", F.row_number().over(order))


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, w in SEVERITY_WEIGHT.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], FLAGS)
