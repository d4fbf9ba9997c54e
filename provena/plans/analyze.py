"""Whole analyses by path: the calls that a user starts with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators.findings import empty
from provena.operators.photo import photo_reports
from provena.operators.pixels import tile_predictions, tile_scores
from provena.operators.verdict import annotation_boxes, report_json, reports
from provena.plans.report import Options, Relations, all_checks
from provena.sources import files as sources
from provena.sources.pages import Pages, annotated_pages, page_counts, page_errors, page_ranges, page_words
from provena.sources.schemas import ELA_SCORES, LAYER_WORDS, PAGE_FONTS, PHOTO, SPANS, WORDS, PhotoThresholds
from provena.sources.sinks import below, write_files


@dataclass(frozen=True)
class Reading:
    """How pages become words: a provider of pictures, one of a picture's words and, for error levels of JPEG files, one of recompressed pictures."""

    pages: Callable[[], Pages]
    recognize: Callable[[], Callable[[np.ndarray], list[dict]]]
    recompress: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None


class Kept:
    """DataFrames that an analysis keeps, to be let go of when its results are written or collected."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist())
        return df

    def release(self) -> None:
        while self.frames:
            self.frames.pop().unpersist()


def relations_of(files: DataFrame, providers: dict[str, Callable] | None = None, reading: Reading | None = None, kept: Kept | None = None) -> Relations:
    """Metadata of the files, what providers (by relation: words, spans, layer_words, page_fonts) read of them, and the words of their pages, with all errors.

    What is read is kept by Spark, so checks and errors come from one reading; ``kept`` lets go of it.
    """
    kept = kept or Kept()
    kinds = {"words": WORDS, "spans": SPANS, "layer_words": LAYER_WORDS, "page_fonts": PAGE_FONTS}
    read = {name: kept.keep(sources.provided(files, make, kinds[name])) for name, make in (providers or {}).items()}
    made = {name: df.where("error is null").drop("error") for name, df in read.items()}
    failed = files.select("doc_id", F.lit(None).cast("string").alias("error")).limit(0)
    for name, df in read.items():
        failed = failed.unionByName(df.where("error is not null").select("doc_id", F.concat(F.lit(f"{name}: "), "error").alias("error")))
    if reading:
        if "words" in made:
            raise ValueError("words come from a provider or from pages, not from both")
        words = kept.keep(page_words(page_ranges(files, reading.pages), reading.pages, reading.recognize, reading.recompress))
        good = words.where("error is null")
        made |= {"words": good.select(*[f.name for f in WORDS.fields])}
        if reading.recompress:
            made |= {"ela_scores": good.where("ela is not null").select(*[f.name for f in ELA_SCORES.fields])}
        failed = failed.unionByName(page_errors(words, "words"))
    errors = failed.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("error"))
    return Relations(pdf_meta=sources.pdf_meta(files), exif=sources.exif(files), errors=errors, **made)


def analyze_documents(
    spark: SparkSession, path: str, providers: dict[str, Callable] | None = None, as_of: Column | None = None, options: Options = Options(), save_to: str | None = None, reading: Reading | None = None, kept: Kept | None = None
) -> DataFrame:
    """A report for each document below a path, with the providers' errors in ``error`` (null if none). FileNotFoundError if the path has none.

    With ``reading``, pages of PDFs and pictures are rendered and their words recognized. With
    ``save_to``, each report is a JSON file of its own there, at its document's place below the
    path; with both, annotated pages stand beside them and reports name them. Reports are lazy;
    ``kept.release()`` lets go of what they read once they are no longer needed.
    """
    kept = kept or Kept()
    files = sources.scan(spark, path)
    if files.select("doc_id").limit(1).count() == 0:
        raise FileNotFoundError(f"no document below {path}")
    known = relations_of(files, providers, reading, kept)
    flags = all_checks(known, as_of, options).unionByName(empty(spark))
    if save_to and reading:
        flags = kept.keep(flags)
    out = reports(flags, files.select("doc_id", "file"), known.errors)
    if save_to:
        if reading:
            counts = kept.keep(page_counts(page_ranges(files, reading.pages)))
            boxes = annotation_boxes(flags, counts.join(files.select("doc_id", below(F.col("file"), path).alias("file")), "doc_id"))
            drawn = kept.keep(annotated_pages(files, reading.pages, boxes))
            write_files(drawn.where("content is not null").select("name", "content"), save_to)
            made = drawn.where("content is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "name"))), lambda x: x["name"]).alias("annotated_files"))
            out = out.join(made, "doc_id", "left").withColumn("annotated_files", F.coalesce("annotated_files", F.array().cast("array<string>")))
        out = kept.keep(out)
        write_files(report_json(out).select(below(F.col("report_file"), path).alias("name"), F.col("json").alias("content")), save_to)
    return out


def analyze_photos(spark: SparkSession, path: str, model: Callable[[], Callable[[np.ndarray], list[dict[str, float]]]], labels: list[str], t: PhotoThresholds = PHOTO, kept: Kept | None = None) -> DataFrame:
    """A report for each picture below a path, by a model that scores batches of tiles.

    A picture that the JVM can't decode, or with a tile that the model raises on, is a row with
    ``error`` and no scores; it is null on all others. Predictions are kept; ``kept`` lets go of them.
    Files of no bytes are left out: no reader of Spark lists them.
    """
    images = sources.scan_images(spark, path)
    predicted = (kept or Kept()).keep(tile_predictions(images, model, t.tile, t.overlap, t.batch))
    failed = predicted.where("error is not null").groupBy("image_id").agg(F.min("error").alias("error"))
    tiles = tile_scores(predicted.join(failed.select("image_id"), "image_id", "left_anti"), labels)
    label = next(v for v in labels if any(k in v.lower() for k in ("ai", "fake", "synthetic")))
    scored = photo_reports(tiles, images.select("image_id", "image", "width", "height", F.lit(label).alias("ai_label")), t)
    read = images.select(sources.plain_path(F.url_decode(F.replace("image", F.lit("+"), F.lit("%2B")))).alias("read"))
    listed = sources.scan(spark, path, sources.IMAGES).select(F.col("doc_id").alias("image_id"), F.col("file").alias("image"))
    unread = listed.join(read, sources.plain_path(F.col("image")) == F.col("read"), "left_anti")
    unread = unread.withColumn("filename", F.substring_index("image", "/", -1)).withColumn("error", F.lit("not decoded: broken, or of a format that the JVM does not read"))
    raised = images.select("image_id", "image").join(failed, "image_id").withColumn("filename", F.substring_index("image", "/", -1)).withColumn("error", F.concat(F.lit("model: "), "error"))
    return scored.withColumn("error", F.lit(None).cast("string")).unionByName(unread, allowMissingColumns=True).unionByName(raised, allowMissingColumns=True)
