"""Readers of file trees and of single-file documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import urls


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, body, raw) of the Markdown files below a checked-out tree; path is relative to ``root``, ``raw`` are the file's bytes, and bad ones are replaced in ``body``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx}").load(root)
    inside = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.select(urls.relative_to(inside, F.lit(root.rstrip("/"))).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("body"), F.col("content").alias("raw"))


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below ``root``, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.select(urls.relative_to(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit(root.rstrip("/"))).alias("path"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of text files, one row per file: index documents, robots files, sitemaps, manifests."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
