"""Sources of text: trees of files, named files, raw strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a repository scan keeps and leaves out.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".md")
PRUNED = ("node_modules", "dist", "build", ".git", "tests", "test", "coverage")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


def below(path: Column, root: str) -> Column:
    """A file's path below a root folder."""
    base = re.sub("^[a-z0-9]+:/+", "/", root.rstrip("/"))
    return F.regexp_replace(_plain(path), f"^\\Q{base}\\E/?", "")


def decoded(content: Column) -> tuple[Column, Column]:
    """The text of UTF-8 bytes, and why there is none."""
    good = F.is_valid_utf8(content.cast("string"))
    return F.when(good, content.cast("string")), F.when(~good, F.lit("not valid UTF-8"))


def kept_path(path: Column, extensions: tuple[str, ...], pruned: tuple[str, ...]) -> Column:
    """Whether a path has one of the extensions and lies in no pruned folder."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.regexp_extract(path, "(\\.[^./]+)$", 1).isin(*extensions) & ~F.arrays_overlap(
        folders, F.array(*map(F.lit, pruned))
    )


def scan_files(
    spark: SparkSession, root: str, *, extensions: tuple[str, ...] = EXTENSIONS, pruned: tuple[str, ...] = PRUNED
) -> DataFrame:
    """path (below the root), text and error of the files with these extensions, outside pruned folders.

    A file is one row, read by one task; folders are matched by each segment below the root. Files that go meanwhile or
    can't be read are left out; one that isn't UTF-8 has no text but an error, so it holds up no other.
    """
    found = spark.read.format("binaryFile").option(
        "recursiveFileLookup", True
    ).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(root)
    path = below(F.col("path"), root)
    text, error = decoded(F.col("content"))
    return found.where(kept_path(path, extensions, pruned)).select(
        path.alias("path"), text.alias("text"), error.alias("error")
    )


def read_documents(spark: SparkSession, names: list[str], folder: str = "example_text") -> DataFrame:
    """nth, name and text of named files, whole, in the order given; a name may have folders, and may be given twice."""
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "nth int, name string")
    if not names:
        return wanted.withColumn("text", F.lit(""))
    paths = [f"{folder.rstrip('/')}/{n}" for n in dict.fromkeys(names)]
    found = spark.read.format("binaryFile").load(paths)
    found = found.select(decoded(F.col("content"))[0].alias("text"), _plain(F.col("path")).alias("_path"))
    # the list of names is what the caller typed; a path ends in its name, after the folder
    ends = F.concat(F.lit("/"), F.regexp_replace("name", "^/+", ""))
    return found.join(
        F.broadcast(wanted), F.col("_path").endswith(ends)
    ).withColumn("_n", F.length("name")).select("nth", "name", "text").orderBy("nth")


def markdown_strings(spark: SparkSession, rows: list[tuple[str, str, str | None, str | None]]) -> DataFrame:
    """repo, markdown, source and url of raw strings."""
    return spark.createDataFrame(rows, "repo string, markdown string, source string, url string")


def strip_tags(html: str = "html"):
    """A page's text without scripts, styles, comments and tags."""
    text = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " ")
    text = F.regexp_replace(text, "(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, "\\s+", " "))
