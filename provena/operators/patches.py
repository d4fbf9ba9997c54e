"""Means over boxes of a picture that is a relation of pixels: four lookups a tile, whatever the size of the box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pixels of a tile's side.
TILE = 32


def summed_tiles(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(page, ty, tx, columns, sums) of (page, x, y, v): each tile's table of sums from its top left, row by row.

    A page is a full rectangle of whole-numbered pixels from (0, 0) on. Both running sums and the
    table share one shuffle, by tile; no task needs more than a tile at a time.
    """
    key = ["page", "ty", "tx"]
    cut = pixels.select("page", "x", "y", F.col("v").cast("long").alias("v"), F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx")).repartition(*key)
    along, down = W.partitionBy(*key, "y").orderBy("x"), W.partitionBy(*key, "x").orderBy("y")
    summed = cut.withColumn("v", F.sum("v").over(along)).withColumn("v", F.sum("v").over(down))
    table = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"])
    return summed.groupBy(*key).agg((F.max("x") - F.min("x") + 1).cast("int").alias("columns"), table.alias("sums"))


def box_means(pixels: DataFrame, boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """(box_id, pixels, mean) of (box_id, page, x, y, w, h); boxes without a pixel of their page are left out.

    Boxes meet pages by tile: an equal join, in which a box has a row for each tile that it
    touches. Sums are partial before they are shuffled by box.
    """
    tiles = summed_tiles(pixels, tile)
    cells = lambda a, b: F.sequence(F.floor(a / tile).cast("int"), F.floor(b / tile).cast("int"))
    some = boxes.where("w > 0 and h > 0 and x + w > 0 and y + h > 0")
    some = some.select("box_id", "page", F.greatest("x", F.lit(0)).alias("x0"), F.greatest("y", F.lit(0)).alias("y0"), (F.col("x") + F.col("w") - 1).alias("x1"), (F.col("y") + F.col("h") - 1).alias("y1"))
    limits = pixels.groupBy("page").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    some = some.join(limits, "page").withColumns({"x1": F.least("x1", "mx"), "y1": F.least("y1", "my")}).where("x1 >= x0 and y1 >= y0")
    spread = some.withColumn("ty", F.explode(cells(F.col("y0"), F.col("y1")))).withColumn("tx", F.explode(cells(F.col("x0"), F.col("x1"))))
    met = spread.join(tiles, ["page", "ty", "tx"])
    low = lambda c, t: F.greatest(F.col(c) - F.col(t) * tile, F.lit(0))
    rows = (F.size("sums") / F.col("columns")).cast("int")
    met = met.withColumns({"a": low("x0", "tx"), "b": low("y0", "ty"), "c": F.least(F.col("x1") - F.col("tx") * tile, F.col("columns") - 1), "d": F.least(F.col("y1") - F.col("ty") * tile, rows - 1)})

    def at(y: Column, x: Column) -> Column:
        return F.when((y < 0) | (x < 0), F.lit(0).cast("long")).otherwise(F.get("sums", (y * F.col("columns") + x).cast("int")))

    part = at(F.col("d"), F.col("c")) - at(F.col("b") - 1, F.col("c")) - at(F.col("d"), F.col("a") - 1) + at(F.col("b") - 1, F.col("a") - 1)
    area = (F.col("c") - F.col("a") + 1) * (F.col("d") - F.col("b") + 1)
    out = met.groupBy("box_id").agg(F.sum(area).cast("long").alias("pixels"), F.sum(part).alias("total"))
    return out.select("box_id", "pixels", (F.col("total") / F.col("pixels")).alias("mean"))
