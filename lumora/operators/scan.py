"""Scanned answers: page images, what is done to their pixels, recognition by pluggable engines, and pages as one text.

An image is a row of bytes; pixels are numpy arrays inside Arrow-batched functions, one image at a time. Engines and the
rasteriser are parameters, as none is part of Spark; a page that fails has its error in a column and an empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.text import choose_engine
from lumora.operators.segment import PAGE_BREAK

# Hue ranges (half degrees), least saturation and value of red ink; block and constant of the threshold.
RED_HUES = [(0, 10), (170, 180)]
RED_LEAST = 50
BLOCK, CONSTANT = 31, 12
GAUSS_3 = [0.25, 0.5, 0.25]
DPI = 150
IMAGE = "width int, height int, pixels binary"


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0 to 180), saturation and value (0 to 255) of an RGB image."""
    x = rgb.astype(np.float64)
    top, low = x.max(-1), x.min(-1)
    spread = np.where(top > low, top - low, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    turn = np.select([top == low, top == r, top == g], [0.0, (g - b) / spread, 2 + (b - r) / spread], 4 + (r - g) / spread)
    hue = np.rint(turn * 60 % 360 / 2) % 180
    return np.stack([hue, np.rint(np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0)), top], -1)


def red_mask(rgb: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(hsv(rgb), -1, 0)
    return np.any([(a <= h) & (h <= b) for a, b in RED_HUES], 0) & (s >= RED_LEAST) & (v >= RED_LEAST)


def _windows(x: np.ndarray, size: int, mode: str) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, size // 2, mode=mode), (size, size))


def without_red(rgb: np.ndarray) -> np.ndarray:
    """Red pixels and their eight neighbours painted white."""
    out = rgb.copy()
    out[_windows(red_mask(rgb), 3, "constant").any((-1, -2))] = 255
    return out


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8) if rgb.ndim == 3 else rgb


def blurred(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Rows, then columns, by a symmetric kernel; borders are mirrored."""
    n = len(kernel) // 2
    padded = np.pad(x.astype(np.float64), n, mode="reflect" if min(x.shape) > n else "edge")
    rows = sum(k * padded[:, i : i + x.shape[1]] for i, k in enumerate(kernel))
    return sum(k * rows[i : i + x.shape[0]] for i, k in enumerate(kernel))


def light(rgb: np.ndarray) -> np.ndarray:
    """Gray, smoothed by a three by three Gaussian."""
    return np.rint(blurred(gray(rgb), np.array(GAUSS_3))).astype(np.uint8)


def thresholded(rgb: np.ndarray, block: int = BLOCK, constant: float = CONSTANT) -> np.ndarray:
    """White where a pixel is above the Gaussian mean of its block less the constant."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(block) - block // 2) ** 2) / (2 * sigma**2))
    x = gray(rgb)
    return np.where(x > np.rint(blurred(x, kernel / kernel.sum())) - constant, 255, 0).astype(np.uint8)


def otsu(rgb: np.ndarray) -> np.ndarray:
    """White above the level that parts the pixels with the greatest variance between both sides."""
    x = gray(rgb)
    n = np.bincount(x.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    mean = mass / np.maximum(below, 1), (mass[-1] - mass) / np.maximum(above, 1)
    return np.where(x > int(np.argmax(below * above * (mean[0] - mean[1]) ** 2)), 255, 0).astype(np.uint8)


STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"without_red": without_red, "light": light, "threshold": thresholded, "otsu": otsu, "raw": lambda x: x}


def image(width: int, height: int, pixels: bytes) -> np.ndarray:
    x = np.frombuffer(pixels, np.uint8)
    return x.reshape(height, width, -1) if len(x) > width * height else x.reshape(height, width)


def processed(images: DataFrame, step: str) -> DataFrame:
    """``images(image_id, width, height, pixels)`` after one of STEPS; null or damaged pixels stay null."""
    change = STEPS[step]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["pixels"] = [None if p is None or not w or not h or len(p) % (w * h) else change(image(w, h, p)).tobytes() for w, h, p in zip(batch["width"], batch["height"], batch["pixels"], strict=True)]
            yield batch

    own = images.select("image_id", "width", "height", "pixels")
    return own.mapInPandas(run, own.schema)


def red_pixels(images: DataFrame) -> DataFrame:
    """image_id, n_red: red pixels left in each image; null for an image without pixels."""

    @F.pandas_udf("long")
    def count(w: pd.Series, h: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not a or not b or len(x) % (a * b) or len(x) < 3 * a * b else int(red_mask(image(a, b, x)).sum()) for a, b, x in zip(w, h, p, strict=True)], dtype="Int64")

    return images.select("image_id", count("width", "height", "pixels").alias("n_red"))


def rasterised(files: DataFrame, rasteriser: Callable[[bytes, int], list[tuple[int, int, bytes]]], dpi: int = DPI) -> DataFrame:
    """path, page_no, width, height, pixels, error: pages of ``files(path, content)`` in order; a failing file is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, i, w, h, p, None) for i, (w, h, p) in enumerate(rasteriser(content, dpi))]
                except Exception as e:  # whatever the rasteriser raises is that file's error
                    rows = [(path, 0, None, None, None, str(e)[:200])]
                yield pd.DataFrame(rows, columns=["path", "page_no", "width", "height", "pixels", "error"]).astype({"width": "Int32", "height": "Int32", "page_no": "int32"})

    return files.select("path", "content").mapInPandas(run, f"path string, page_no int, {IMAGE}, error string")


def recognised(images: DataFrame, engine: Callable[[np.ndarray], str], name: str = "text") -> DataFrame:
    """The images with a text column by one engine; an engine's error is an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for w, h, p in zip(batch["width"], batch["height"], batch["pixels"], strict=True):
                try:
                    out.append(engine(image(w, h, p)) or "")
                except Exception:  # whatever the engine raises
                    out.append("")
            yield batch.assign(**{name: out})

    return images.mapInPandas(run, images.schema.simpleString()[7:-1].replace(":", " ") + f", {name} string")


def chosen_texts(pages: DataFrame, slow_page: float | None = None) -> DataFrame:
    """doc_id, page_no, text of ``pages(doc_id, page_no, text_a, text_b, seconds)``: the better engine's text or both.

    Once a page of a document took more than ``slow_page`` seconds, later pages of it have the second engine's text only.
    The seconds are data, so the same input gives the same result.
    """
    before = F.max("seconds").over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    slow = F.coalesce(before > F.lit(slow_page), F.lit(False)) if slow_page is not None else F.lit(False)
    marked = pages.withColumn("slow", slow)
    text = F.when(F.col("slow"), F.coalesce("text_b", F.lit(""))).otherwise(choose_engine(F.col("text_a"), F.col("text_b")))
    return marked.select("doc_id", "page_no", text.alias("text"), "slow")


def strategies(images: DataFrame, engine: Callable[[np.ndarray], str], steps: tuple[str, ...] = ("otsu", "threshold", "raw")) -> DataFrame:
    """image_id, strategy, n_words, text: each image recognised after each of several steps."""
    from lumora.functions.text import readable_words

    one = [recognised(processed(images, s), engine).select("image_id", F.lit(s).alias("strategy"), readable_words(F.col("text")).alias("n_words"), "text") for s in steps]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


def page_concat(pages: DataFrame) -> DataFrame:
    """doc_id, text, n_pages, error for ``pages(doc_id, page_no, text, error)``: the pages in order, the page mark after each.

    A file with a failing page is an empty text with the first error.
    """
    g = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("x"),
                                    F.count("*").alias("n_pages"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_no"))).alias("error"))
    text = F.array_join(F.transform("x", lambda p: F.concat(p["text"], F.lit(f"\n{PAGE_BREAK}\n"))), "")
    return g.select("doc_id", F.when(F.col("error").isNull(), text).otherwise("").alias("text"), "n_pages", "error")
