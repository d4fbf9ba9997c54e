"""Pixel work on pictures that the JVM has decoded: tiles, model scores, error levels of words, annotated PNGs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.operators.photo import ai_label, label_score, tile_grid
from provena.sources.schemas import PHOTO
from provena.sources.shipping import ship


def rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Height x width x 3 bytes, red first, of the image source's bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def crop(picture: np.ndarray, x: int, y: int, tile: int = PHOTO.tile) -> np.ndarray:
    """A tile, black beyond the picture's edge."""
    out = np.zeros((tile, tile, 3), np.uint8)
    part = picture[y : y + tile, x : x + tile]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def _bisected(predict: Callable[[np.ndarray], list[dict[str, float]]], tiles: list[np.ndarray]) -> list[tuple[dict[str, float] | None, str | None]]:
    """Each tile's results or error; about twice the logarithm of a batch in further calls for a tile at fault."""
    try:
        found = predict(np.stack(tiles))
        if len(found) != len(tiles):
            raise ValueError(f"{len(found)} results for {len(tiles)} tiles")
        return [(f, None) for f in found]
    except Exception as e:  # noqa: BLE001
        if len(tiles) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    half = len(tiles) // 2
    return _bisected(predict, tiles[:half]) + _bisected(predict, tiles[half:])


def tile_predictions(images: DataFrame, make: Callable[[], Callable[[np.ndarray], list[dict[str, float]]]], tile: int = PHOTO.tile, overlap: float = PHOTO.overlap, batch: int = PHOTO.batch) -> DataFrame:
    """(image_id, x, y, results, error) of every tile. ``make`` runs once in each worker; it gives a callable from a batch of tiles to label probabilities.

    Where it raises, the batch is halved until the tiles at fault are alone: these have their error
    and no results, all others their results.
    """
    grid = tile_grid(images, tile, overlap).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("tile_no", "x", "y"))).alias("tiles"))

    ship(images.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make()
        for part in parts:
            for r in part.itertuples():
                picture = rgb(bytes(r.data), r.width, r.height, r.nChannels)
                for at in range(0, len(r.tiles), batch):
                    some = r.tiles[at : at + batch]
                    found = _bisected(predict, [crop(picture, t["x"], t["y"], tile) for t in some])
                    yield pd.DataFrame({"image_id": r.image_id, "x": [t["x"] for t in some], "y": [t["y"] for t in some], "results": [f[0] for f in found], "error": [f[1] for f in found]})

    return images.join(grid, "image_id").select("image_id", "width", "height", "nChannels", "data", "tiles").mapInPandas(run, "image_id long, x int, y int, results map<string,double>, error string")


def tile_scores(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """(image_id, x, y, score) for the first label that speaks of a generated image; ValueError if there is none."""
    import re

    found = next((v for v in labels if re.search("ai|fake|synthetic", v.lower())), None)
    if found is None:
        raise ValueError(f"no label speaks of generated images: {labels}")
    label = ai_label(F.array(*map(F.lit, labels)))
    return predictions.select("image_id", "x", "y", label_score(F.col("results"), label).alias("score"))


#: Rows of a picture whose summed areas are held together.
BAND = 512


def box_means(picture: np.ndarray, again: np.ndarray, boxes: list[tuple[int, int, int, int]], band: int = BAND) -> list[float | None]:
    """Mean absolute difference of two pictures in each box (x, y, w, h); null where a box has no pixel of them.

    Differences are summed over the picture once, in bands of rows: a box's share of a band is four
    lookups in its table of summed areas, however large the box. Sums are whole numbers, so they
    don't hang on the bands; a band is all that is held besides the pictures.
    """
    height, width = picture.shape[:2]
    b = np.array(boxes, np.int64).reshape(-1, 4)
    x0, y0 = (np.clip(b[:, i], 0, m) for i, m in ((0, width), (1, height)))
    x1, y1 = (np.clip(b[:, i] + np.maximum(b[:, i + 2], 0), 0, m) for i, m in ((0, width), (1, height)))
    sums = np.zeros(len(b), np.int64)
    for top in range(0, height, band):
        here = np.flatnonzero((y0 < top + band) & (y1 > top))
        if len(here):
            part = np.abs(picture[top : top + band].astype(np.int16) - again[top : top + band]).sum(axis=2, dtype=np.int32)
            table = np.zeros((part.shape[0] + 1, width + 1), np.int64)
            np.cumsum(np.cumsum(part, axis=0, dtype=np.int64), axis=1, out=table[1:, 1:])
            low, high = np.clip(y0[here] - top, 0, part.shape[0]), np.clip(y1[here] - top, 0, part.shape[0])
            sums[here] += table[high, x1[here]] - table[low, x1[here]] - table[high, x0[here]] + table[low, x0[here]]
    areas = np.maximum(x1 - x0, 0) * np.maximum(y1 - y0, 0)
    return [s / (3 * a) if a > 0 else None for s, a in zip(sums.tolist(), areas.tolist(), strict=True)]


def word_errors(pages: DataFrame, words: DataFrame, recompress: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """The ela_scores relation: mean absolute difference of each word's box after recompression.

    ``pages``: (doc_id, page, width, height, nChannels, data); ``recompress`` makes, once in each
    worker, a callable from a picture to the picture saved as JPEG at quality 90 and read again.
    """
    boxes = words.where("w >= 4 and h >= 4").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("word_no", "text", "conf", "x", "y", "w", "h"))).alias("words"))
    names = ["doc_id", "page", "word_no", "text", "conf", "x", "y", "w", "h", "ela"]

    ship(pages.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = recompress()
        for part in parts:
            for r in part.itertuples():
                picture = rgb(bytes(r.data), r.width, r.height, r.nChannels)
                means = box_means(picture, again(picture), [(w["x"], w["y"], w["w"], w["h"]) for w in r.words])
                rows = [(r.doc_id, r.page, w["word_no"], w["text"], w["conf"], w["x"], w["y"], w["w"], w["h"], m) for w, m in zip(r.words, means, strict=True) if m is not None]
                yield pd.DataFrame(rows, columns=names)

    kinds = "doc_id long, page int, word_no int, text string, conf double, x int, y int, w int, h int, ela double"
    return pages.join(boxes, ["doc_id", "page"]).select("doc_id", "page", "width", "height", "nChannels", "data", "words").mapInPandas(run, kinds)


def png(picture: np.ndarray) -> bytes:
    """A PNG file of a height x width x 3 picture."""
    h, w, _ = picture.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((h, 1 + 3 * w), np.uint8)
    rows[:, 1:] = picture.reshape(h, 3 * w)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _rounded(h: int, w: int, radius: int) -> np.ndarray:
    """A mask of a rectangle with rounded corners."""
    y, x = np.mgrid[:h, :w]
    dy, dx = np.maximum(np.maximum(radius - y, y - (h - 1 - radius)), 0), np.maximum(np.maximum(radius - x, x - (w - 1 - radius)), 0)
    return dx * dx + dy * dy <= radius * radius


def highlight(picture: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, int, int], alpha: int, radius: int = 4) -> np.ndarray:
    """The picture under translucent boxes (left, top, right, bottom, all inclusive); boxes of one call don't darken each other."""
    h, w, _ = picture.shape
    mask = np.zeros((h, w), bool)
    for left, top, right, bottom in boxes:
        if right >= left and bottom >= top:
            shape = _rounded(bottom - top + 1, right - left + 1, radius)
            y0, x0, y1, x1 = max(0, top), max(0, left), min(h, bottom + 1), min(w, right + 1)
            if y1 > y0 and x1 > x0:
                mask[y0:y1, x0:x1] |= shape[y0 - top : y1 - top, x0 - left : x1 - left]
    out = picture.astype(np.float32)
    out[mask] = out[mask] * (1 - alpha / 255) + np.array(colour, np.float32) * (alpha / 255)
    return np.rint(out).astype(np.uint8)


#: Height of the legend's bar over an annotated page.
BAR = 52


#: Words of the legend by where they start, and rows of five bits of each letter in them.
LEGEND = {54: "Suspicious text / value", 358: "Font change"}
GLYPHS = {
    "S": (14, 17, 16, 14, 1, 17, 14), "F": (31, 16, 16, 30, 16, 16, 16), "u": (0, 0, 17, 17, 17, 19, 13), "s": (0, 0, 15, 16, 14, 1, 30),
    "p": (0, 0, 30, 17, 30, 16, 16), "i": (4, 0, 12, 4, 4, 4, 14), "c": (0, 0, 14, 16, 16, 17, 14), "o": (0, 0, 14, 17, 17, 17, 14),
    "t": (8, 8, 28, 8, 8, 9, 6), "e": (0, 0, 14, 17, 31, 16, 14), "x": (0, 0, 17, 10, 4, 10, 17), "/": (1, 1, 2, 4, 8, 16, 16),
    "v": (0, 0, 17, 17, 17, 10, 4), "a": (0, 0, 14, 1, 15, 17, 15), "l": (12, 4, 4, 4, 4, 4, 14), "n": (0, 0, 22, 25, 17, 17, 17),
    "h": (16, 16, 22, 25, 17, 17, 17), "g": (0, 0, 15, 17, 15, 1, 14), " ": (0,) * 7,
}


def write_words(picture: np.ndarray, text: str, x: int, y: int, scale: int = 2) -> None:
    """Write text on a picture in black, its top left at (x, y); what runs over the edge is cut."""
    bits = np.array([[[g >> k & 1 for k in (4, 3, 2, 1, 0)] + [0] for g in GLYPHS[c]] for c in text], bool)
    line = np.kron(np.concatenate(list(bits), axis=1), np.ones((scale, scale), bool))
    part = picture[y : y + line.shape[0], x : x + line.shape[1]]
    part[line[: part.shape[0], : part.shape[1]]] = 0


def annotated_png(picture: np.ndarray, boxes: list) -> bytes:
    """A PNG of a page with its boxes (marker, left, top, right, bottom) drawn, yellow first, under a bar with the legend."""
    of = lambda m: [(b["left"], b["top"], b["right"], b["bottom"]) for b in boxes if b["marker"] == m]
    picture = highlight(highlight(picture, of("yellow"), (255, 214, 0), 150), of("red"), (255, 0, 0), 110)
    bar = np.full((BAR, picture.shape[1], 3), 255, np.uint8)
    bar = highlight(highlight(bar, [(16, 12, 44, 40)], (255, 150, 150), 255), [(320, 12, 348, 40)], (255, 226, 90), 255)
    for x, text in LEGEND.items():
        write_words(bar, text, x, 19)
    return png(np.concatenate([bar, picture]))


def annotate(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """(annotated_file, png): pages with their boxes drawn, yellow first, under a bar with the two colours of the legend.

    ``pages``: (doc_id, page, width, height, nChannels, data); ``boxes``: as verdict.annotation_boxes
    gives them.
    """
    drawn = boxes.groupBy("doc_id", "page", "annotated_file").agg(F.array_sort(F.collect_list(F.struct("flag_seq", "marker", "left", "top", "right", "bottom"))).alias("boxes"))

    ship(pages.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                picture = rgb(bytes(r.data), r.width, r.height, r.nChannels)
                yield pd.DataFrame({"annotated_file": [r.annotated_file], "png": [annotated_png(picture, r.boxes)]})

    return pages.join(drawn, ["doc_id", "page"]).select("annotated_file", "width", "height", "nChannels", "data", "boxes").mapInPandas(run, "annotated_file string, png binary")
