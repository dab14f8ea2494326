"""Scanning directories into the files of the data model."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schema as s
from shelfmark.functions import text
from shelfmark.operators import cache
from shelfmark.sources.parsers import excerpt

#: Types of files by extension.
MIME = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html",
    "json": "application/json", "xml": "text/xml", "zip": "application/zip", "tar": "application/x-tar", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "mp3": "audio/mpeg", "wav": "audio/x-wav", "mp4": "video/mp4", "mov": "video/quicktime", "rtf": "application/rtf", "doc": "application/msword", "xls": "application/vnd.ms-excel",
}


class TooManyFiles(RuntimeError):
    """A scan found more files than allowed."""


def _listing(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root if recursive else f"{root.rstrip('/')}/*")


def base_of(root: str) -> str:
    return "/" + root.removeprefix("file:").strip("/")


def _stats(base: str):
    """Adds times, and leaves out what lies behind a link or is gone."""

    def run(batches):
        real = os.path.realpath(base)
        for b in batches:
            at, created, accessed = [], [], []
            for i, path in enumerate(b.column(0).to_pylist()):
                try:
                    if os.path.realpath(path) != real + path[len(base) :]:
                        continue
                    st = os.stat(path)
                except OSError:
                    continue
                at.append(i)
                created.append(int(getattr(st, "st_birthtime", st.st_ctime) * 1e6))
                accessed.append(int(st.st_atime * 1e6))
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.record_batch([*kept.columns, *(pa.array(t, pa.timestamp("us", "UTC")) for t in (created, accessed))], names=[*b.schema.names, "created", "accessed"])

    return run


def scan(spark: SparkSession, root: str, recursive: bool = True, ignore=s.IGNORED, max_files: int | None = None) -> DataFrame:
    """(path, name, ext, size, modified, mime) of the files below ``root``; contents aren't read.

    A pattern that matches a directory takes all below it. Below a local root links are never followed, and ``created``
    and ``accessed`` come with it; other file systems have neither. With ``max_files`` a larger tree is an error, counted no further than one beyond it.
    """
    path = F.regexp_replace("path", "^file:/+", "/")
    base = F.lit("/" + root.removeprefix("file:").strip("/"))
    rows = _listing(spark, root, recursive).select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.where(~text.ignored(F.col("path"), base, ignore)) if ignore else rows
    local = root.startswith("file:") or "://" not in root
    rows = rows.mapInArrow(_stats(base_of(root)), "path string, size bigint, modified timestamp, created timestamp, accessed timestamp") if local else rows
    if max_files is not None and rows.limit(max_files + 1).count() > max_files:
        raise TooManyFiles(f"more than {max_files} files below {root}")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    mime = F.create_map(*[F.lit(x) for e, m in MIME.items() for x in ("." + e, m)])
    ext = text.extension(name)
    return rows.select("path", name.alias("name"), ext.alias("ext"), "size", "modified", *(["created", "accessed"] if local else []), F.coalesce(F.try_element_at(mime, ext), F.lit("application/octet-stream")).alias("mime"))


def parsed(spark: SparkSession, root: str, wanted: DataFrame | None = None, recursive: bool = True, most: int = 1_800, seconds: float = 5.0) -> DataFrame:
    """(path, excerpt) of the files below ``root``, or of those in ``wanted`` (path); only their contents are read by the parsers."""
    rows = _listing(spark, root, recursive).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    rows = rows if wanted is None else rows.join(wanted.select("path"), "path", "left_semi")

    def run(batches):
        for b in batches:
            paths = b.column(0).to_pylist()
            texts = [excerpt(c, p.rpartition("/")[2], most, seconds) for p, c in zip(paths, b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["path", "excerpt"])

    return rows.mapInArrow(run, "path string, excerpt string")


def entries(spark: SparkSession, root: str, cached: DataFrame | None = None, recursive: bool = True, **limits) -> DataFrame:
    """The scanned files with their excerpts: from the cache where it is valid, else parsed."""
    files = scan(spark, root, recursive, **limits)
    if cached is None:
        return files.join(parsed(spark, root, files, recursive), "path", "left")
    looked = cache.lookup(files.withColumn("mtime", F.col("modified").cast("double")), cached)
    cold = parsed(spark, root, looked.where("NOT hit"), recursive).withColumnRenamed("excerpt", "_fresh")
    return looked.join(cold, "path", "left").withColumn("excerpt", F.coalesce("excerpt", "_fresh", F.lit(""))).drop("_fresh", "hit", "mtime")
