"""Bounds on what one Arrow batch carries to Python."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from provena.sources.shipping import ship

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch, unless the session sets its own bound. A single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bound(spark: SparkSession) -> None:
    """Let no batch pass BATCH_BYTES by more than one row, however long the texts are; and let workers import this package."""
    ship(spark)
    if not getattr(spark, "_provena_bounded", False):
        spark.conf.set(KEY, str(BATCH_BYTES))
        spark._provena_bounded = True


def trim() -> None:
    """Give memory that a finished task's arrays had back to the system; Python workers outlive their tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back
        pass


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` has it; case doesn't tell columns apart."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def runs(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that follow each other with equal keys (whole numbers, not null), run by run, of a task's sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in parts:
        if not batch.num_rows:
            continue
        cells = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cells])) + 1
        if last is not None and last != tuple(c[0] for c in cells):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cells)
    if held:
        yield pa.Table.from_batches(held)
