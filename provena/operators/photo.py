"""Photo integrity: tile grids, scores of tiles, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.sources.schemas import PHOTO, PhotoThresholds


def positions(length: Column, tile: int = PHOTO.tile, overlap: float = PHOTO.overlap) -> Column:
    """Starts of tiles along a side: every stride, and one that ends at the edge."""
    room = F.greatest(length - tile, F.lit(0))
    steps = F.sequence(F.lit(0), room.cast("int"), F.lit(int(tile * (1 - overlap))))
    return F.array_sort(F.array_distinct(F.when(F.element_at(steps, -1) + tile < length, F.concat(steps, F.array(room.cast("int")))).otherwise(steps)))


def tile_grid(images: DataFrame, tile: int = PHOTO.tile, overlap: float = PHOTO.overlap) -> DataFrame:
    """(image_id, tile_no, x, y) of (image_id, width, height), row by row."""
    df = images.select("image_id", positions(F.col("width"), tile, overlap).alias("xs"), positions(F.col("height"), tile, overlap).alias("ys"))
    df = df.select("image_id", F.size("xs").alias("nx"), "xs", F.posexplode("ys").alias("j", "y")).select("image_id", "nx", "j", "y", F.posexplode("xs").alias("i", "x"))
    return df.select("image_id", (F.col("j") * F.col("nx") + F.col("i")).alias("tile_no"), "x", "y")


def ai_label(labels: Column) -> Column:
    """The first label that speaks of a generated image; null if none does."""
    return F.try_element_at(F.filter(labels, lambda v: F.lower(v).rlike("ai|fake|synthetic")), F.lit(1))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; a lambda works out what it names from outside anew for each element."""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    """Shares of an array of doubles."""
    shares = lambda e: _once(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total))
    return _once(F.array_max(logits), lambda top: _once(F.transform(logits, lambda v: F.exp(v - top)), shares))


def label_score(results: Column, label: Column) -> Column:
    """A tile's score: the label's probability, 0 where there is none."""
    return F.coalesce(F.try_element_at(results, label), F.lit(0.0))


def ranked(tiles: DataFrame) -> DataFrame:
    """Tiles with rank (from 1) and n: by score, then from the top left."""
    image = W.partitionBy("image_id")
    return tiles.withColumn("rank", F.row_number().over(image.orderBy(F.col("score").desc(), "y", "x"))).withColumn("n", F.count("*").over(image))


def decision(avg: Column, top: Column, most: Column, suspicious: Column, t: PhotoThresholds = PHOTO) -> Column:
    return F.when((most >= t.fake) & (suspicious >= 1), "Fake Image Detected").when(top >= t.manipulated, "MANIPULATION SUSPECTED").when(avg >= t.review, "REVIEW").otherwise("LIKELY REAL")


def photo_decisions(tiles: DataFrame, t: PhotoThresholds = PHOTO) -> DataFrame:
    """One row per image: averages, maximum, suspicious tiles, decision.

    ``is_suspicious_ref`` is true for MANIPULATION SUSPECTED only; ``is_suspicious`` also for the
    stronger decision. One window and one aggregation with the same partitioning.
    """
    top = F.greatest(F.lit(1), F.floor(F.col("n") * t.top_share))
    out = ranked(tiles).groupBy("image_id").agg(
        F.count("*").alias("total_tiles"), F.avg("score").alias("average_ai_score"), F.max("score").alias("maximum_ai_score"),
        F.avg(F.when(F.col("rank") <= top, F.col("score"))).alias("top_10_average"), F.count_if(F.col("score") >= t.suspicious).alias("suspicious_tile_count"),
    )
    out = out.withColumn("decision", decision(F.col("average_ai_score"), F.col("top_10_average"), F.col("maximum_ai_score"), F.col("suspicious_tile_count"), t))
    return out.withColumn("is_suspicious_ref", F.col("decision") == "MANIPULATION SUSPECTED").withColumn("is_suspicious", F.col("decision").isin("MANIPULATION SUSPECTED", "Fake Image Detected"))


def prototype_decision(d: Column) -> Column:
    """The earlier wording, which has no decision stronger than manipulation."""
    return F.when(d == "Fake Image Detected", "MANIPULATION SUSPECTED").otherwise(d)


def photo_reports(tiles: DataFrame, images: DataFrame, t: PhotoThresholds = PHOTO) -> DataFrame:
    """One nested row per image of (image_id, image, width, height, ai_label), with its regions by rank."""
    tile = F.struct("rank", "x", "y", "score")
    regions = ranked(tiles).groupBy("image_id").agg(F.array_sort(F.collect_list(tile)).alias("r")).select("image_id", F.transform("r", lambda s: s.dropFields("rank")).alias("tile_scores"))
    df = images.join(photo_decisions(tiles, t), "image_id").join(regions, "image_id")
    return df.select(
        "image_id", "image", F.substring_index(F.regexp_replace("image", r"\\", "/"), "/", -1).alias("filename"), "width", "height", "total_tiles", "average_ai_score", "maximum_ai_score", "top_10_average",
        "suspicious_tile_count", F.lit(t.suspicious).alias("suspicious_threshold"), "decision", "ai_label", F.slice("tile_scores", 1, 10).alias("top_suspicious_regions"),
        F.filter("tile_scores", lambda s: s["score"] >= t.suspicious).alias("suspicious_regions"), "tile_scores",
    )
