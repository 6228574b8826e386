"""Scans: files by extension, plain-text and JSON documents as pages, with rejects kept aside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by the pipeline that takes them.
PIPELINES = {
    "document": ["pdf", "docx", "pptx", "txt", "md"], "image": ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"], "audio": ["mp3", "wav", "m4a", "mp4", "mov", "webm", "ogg", "flac", "aac"],
}


def pipeline_of(path: Column) -> Column:
    """The pipeline of a file or address; null where none takes it."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(path.rlike(r"^https?://(?:www\.)?(?:youtube\.com|youtu\.be)/"), F.lit("youtube"))
    for name, exts in PIPELINES.items():
        out = out.when(ext.isin(exts), F.lit(name))
    return out


def binary_files(spark: SparkSession, folder: str, pipeline: str) -> DataFrame:
    """``path, modified, length, content`` of a pipeline's files below a folder; file listing and reading are distributed.

    Files without a byte are not listed.
    """
    glob = "*.{" + ",".join(PIPELINES[pipeline]) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return df.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def parsed_pages(files: DataFrame, parse: Callable[[str, bytes], list[str]]) -> tuple[DataFrame, DataFrame]:
    """(pages: ``path, page_no, text``; rejects: ``path, error``) of files read by any parser; one bad file never stops the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(parse(path, bytes(content)) or [""], 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"]).astype({"page_no": "Int64"})

    out = files.select("path", "content").mapInPandas(run, "path string, page_no int, text string, error string")
    return out.where("error is null").select("path", "page_no", "text"), out.where("error is not null").select("path", "error")


def plain_text(path: str, content: bytes) -> list[str]:
    """Pages of a text file: form feeds separate them."""
    return content.decode("utf-8", errors="replace").split("\f")


def split_rejects(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, rows that fail with the array of names of those they fail). A null check fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    x = df.withColumn("failed", failed)
    return x.where(F.size("failed") == 0).drop("failed"), x.where(F.size("failed") > 0)
