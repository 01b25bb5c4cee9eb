"""Sources: populations, checksum manifests, JSON Lines records, documents, listings, page images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unused
from ..functions.text import page_stem, source_url, tokens

#: Smaller scans are no pages.
LEAST_SIDE = 500
# Darkness above paper that counts as ink, and the columns that are searched for a field or read as one.
INK, SEARCH, DEC_COLUMN = 30, (1000, 1260), (1222, 1340)


def population(runs: DataFrame, base_url: str | None = None) -> DataFrame:
    """(run, folder, n, page) for each page of runs (run, folder, first, last), both ends included; a range that ends before it begins is empty. base_url adds source_url."""
    numbers = F.when(F.col("last") >= F.col("first"), F.sequence("first", "last"))
    pages = runs.select("run", "folder", F.explode(numbers).alias("n")).withColumn("page", page_stem(F.col("folder"), F.col("n")))
    return pages if base_url is None else pages.withColumn("source_url", source_url(base_url, F.col("folder"), F.col("page")))


def _line_order() -> Column:
    """(file's path, where its split begins, place in the split): lines are in order by path and then by place, however the files' splits are dealt out to tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))


def checksum_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, sha1): lines of two words, checksum and name; any other line is passed over, and of a name's lines the last one counts, by path and place. Files of any length are read in splits."""
    lines = spark.read.text(path).select(tokens(F.col("value")).alias("t"), _line_order().alias("order")).where(F.size("t") == 2)
    return lines.groupBy(F.element_at("t", 2).alias("name")).agg(F.max_by(F.element_at("t", 1), "order").alias("sha1"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str, order: str = "line_no") -> DataFrame:
    """Records of JSON Lines with a struct that tells which line came later. Blank lines are passed over, keys that are missing are null, a malformed line raises.

    The struct is (file's path, where its split begins, place in the split), so that lines are in order by path and then by place, however the files' splits are dealt out to tasks.
    """
    read = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return read.select("*", _line_order().alias(order))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, text): whole files, bytes and UTF-8 text. A path without files raises."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.decode("content", "UTF-8").alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, length): file names and sizes; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", "").alias("stem"), "length")


def malformed(text: Column) -> Column:
    """Whether a text is no JSON that gate_rows() can read: a key that an object has twice counts as malformed. Null is not."""
    return text.isNotNull() & F.try_parse_json(text).isNull()


def gate_rows(text: DataFrame, column: str = "text") -> DataFrame:
    """(page, row): the rows of extractor output as VARIANT, each document parsed once: an object of lists by page, or one bare list, whose page is null.

    Documents of another shape, malformed ones (see malformed()) and null ones have no rows, nor has a page whose value is no list. Numbers keep up to 38 digits but for zeros at the end, larger ones are doubles, beyond their range infinite.
    """
    (doc,) = unused(text, "_doc")
    rows_of = lambda v: F.try_variant_get(v, "$", "array<variant>")
    pages = F.map_entries(F.try_variant_get(F.col(doc), "$", "map<string,variant>"))
    bare = rows_of(F.col(doc))
    entries = F.when(bare.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("page"), bare.alias("rows")))).otherwise(F.transform(pages, lambda e: F.struct(e["key"].alias("page"), rows_of(e["value"]).alias("rows"))))
    each = text.select(F.try_parse_json(column).alias(doc)).select(F.explode(entries).alias("e")).select("e.page", "e.rows")
    return each.select("page", F.explode("rows").alias("row"))


def gate_input(text: DataFrame, column: str = "text") -> DataFrame:
    """(page, row): the rows of gate_rows() as JSON text."""
    return gate_rows(text, column).select("page", F.to_json("row").alias("row"))


def _grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """8-bit luma of an image's BGR bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0].astype(float)
    luma = (a[:, :, 2].astype(np.int64) * 19595 + a[:, :, 1].astype(np.int64) * 38470 + a[:, :, 0].astype(np.int64) * 7471 + 32768) >> 16
    return luma.astype(float)


def images(spark: SparkSession, path: str, all_: bool = False) -> DataFrame:
    """(page, height, width, channels, data): page images decoded in the JVM, BGR bytes; with all_ also files that can't be decoded, whose height is not positive."""
    read = spark.read.format("image").option("dropInvalid", not all_).load(path)
    name = F.regexp_replace(F.element_at(F.split("image.origin", "/"), -1), r"\.[^.]*\z", "")
    return read.select(name.alias("page"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def ink_profiles(spark: SparkSession, path: str, axis: str = "x", column: tuple[int, int] = SEARCH, strict: bool = True) -> DataFrame:
    """(page, page_state, pos, ink): for each page image the share of ink in each pixel column (axis x) or row (axis y) of a window of columns.

    Ink is darker than the row's median by more than INK. An image that can't be decoded, or with strict is smaller than LEAST_SIDE, gives one row with page_state SOURCE_INPUT_INVALID.
    Images are decoded in the JVM; what leaves a task is a profile, not pixels.
    """
    lo, hi = column

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for page, h, w, c, data in zip(f["page"], f["height"], f["width"], f["channels"], f["data"]):
                bad = data is None or h <= 0 or strict and min(h, w) < LEAST_SIDE
                if bad:
                    yield pd.DataFrame({"page": [page], "page_state": ["SOURCE_INPUT_INVALID"], "pos": [None], "ink": [None]})
                    continue
                win = _grey(h, w, c, data)[:, lo:hi]
                dark = np.clip(np.median(win, axis=1, keepdims=True) - win, 0, None) if win.size else win
                ink = (dark > INK).mean(axis=0 if axis == "x" else 1)
                start = lo if axis == "x" else 0
                yield pd.DataFrame({"page": page, "page_state": None, "pos": np.arange(start, start + len(ink)), "ink": ink})

    return images(spark, path, all_=True).mapInPandas(run, "page string, page_state string, pos int, ink double")

