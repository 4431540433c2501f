"""File sources and sinks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import removed, shared_dir

MAX_ASSET = 25 << 20
#: Bytes of files that Python hands on at once.
PIECE = 8 << 20
#: A task that reads small files takes about so many bytes, and at most so many of the partitions that Spark makes of them.
TASK_BYTES, TASK_PARTS = 128 << 20, 256


def listed(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """The files below the roots (path, modificationTime, length, content; no content is read that is not asked for). Spark counts each small file as some MB, so that a task gets a few of them; here a task gets more, by their real bytes, and no fewer tasks run than twice the cores."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    parts = files.rdd.getNumPartitions()
    held = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(2 * spark.sparkContext.defaultParallelism, held // TASK_BYTES, parts // TASK_PARTS)
    return files.coalesce(tasks) if tasks < parts else files


def scan_markdown(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, text, mtime, length) of .md and .markdown files below the roots, in any case; files that are not UTF-8 are left out (see scan_rejects)."""
    files = listed(spark, roots)
    kept = files.filter(F.lower("path").rlike(r"\.(md|markdown)$"))
    return kept.filter(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("mtime"), "length")


def scan_rejects(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, reason) of Markdown files that are not UTF-8."""
    files = listed(spark, roots)
    kept = files.filter(F.lower("path").rlike(r"\.(md|markdown)$"))
    return kept.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.lit("not UTF-8").alias("reason"))


def scan_assets(spark: SparkSession, root: str, max_bytes: int = MAX_ASSET) -> DataFrame:
    """(path, mime, length, content) of files of at most max_bytes; larger ones are never read."""
    files = listed(spark, root).filter(F.col("length") <= max_bytes)
    return files.select("path", T.ref_extension_mime(F.col("path")).alias("mime"), "length", "content")


def store_uri(spark: SparkSession, out: str) -> str:
    """The folder out, made if need be, as a URI that executors can write to by pyarrow.

    Spark's file systems resolve it, so a path without scheme lies in the default one, and what is mounted elsewhere is found there. A path that would be a
    local disk of each executor is an error: it must say file:// if that is a disk that all share.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(out)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    found = store.resolvePath(path).toString()
    if found.startswith("file:") and "://" not in out and not out.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{out} is a path on each machine's own disk; name its store")
    return _arrow_uri(found)


def _arrow_uri(path: str) -> str:
    """A path of Spark's file systems as pyarrow names it."""
    scheme, _, rest = path.partition(":")
    return "file:///" + rest.lstrip("/") if scheme == "file" else {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest


def contents(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of files below root (path, as Spark lists them), read where the paths lie: no other file is listed and no content is shuffled. A file that is gone has no row."""
    spark = paths.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    # The folder that holds all, up to the first wildcard; what is mounted elsewhere is read there.
    seen = store.makeQualified(hadoop.Path(root)).toString()
    if len(fixed := re.split(r"[*?\[{]", seen)[0]) < len(seen):
        seen = fixed.rpartition("/")[0]
    base = _arrow_uri(quote(store.resolvePath(hadoop.Path(seen)).toString(), safe=":/@"))

    def batch(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["path", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pa_fs.FileSystem.from_uri(base)
        for b in batches:
            names, texts, held = [], [], 0
            for name in b["path"].to_pylist():
                try:
                    with store.open_input_stream(folder.rstrip("/") + name.removeprefix(seen)) as f:
                        texts.append(f.read())
                except FileNotFoundError:
                    continue
                names.append(name)
                held += len(texts[-1])
                if held >= PIECE:
                    yield batch(names, texts)
                    names, texts, held = [], [], 0
            yield batch(names, texts)

    return paths.select("path").mapInArrow(read, "path string, content binary")


def sink_page_files(pages_md: DataFrame, out: str) -> None:
    """One Markdown file for each row (file_name, markdown) in the folder out, in any store that Spark and pyarrow both know (file, hdfs, s3a, gs, abfss).

    Two jobs: the first stages the files, the second gives the staged ones of finished tasks their names. If the first fails, nothing is published; tasks of
    either may be repeated or killed, and each file is there once. What is left of the stage is deleted in any case.
    """
    spark = pages_md.sparkSession
    base = store_uri(spark, out)
    stage = f"{base}/_stage-{uuid.uuid4().hex}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pa_fs.FileSystem.from_uri(stage)
        store.create_dir(folder, recursive=True)
        for b in batches:
            parts = [uuid.uuid4().hex for _ in range(b.num_rows)]
            for part, text in zip(parts, b["markdown"].to_pylist(), strict=True):
                with store.open_output_stream(f"{folder}/{part}") as f:
                    f.write((text or "").encode())
            yield pa.record_batch([pa.array(parts, pa.string()), b["file_name"]], names=["part", "file_name"])

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pa_fs.FileSystem.from_uri(base)
        staged = f"{folder}/{stage.rsplit('/', 1)[1]}"
        for b in batches:
            for part, name in zip(b["part"].to_pylist(), b["file_name"].to_pylist(), strict=True):
                # An earlier attempt of this task may have given it its name.
                if store.get_file_info(f"{staged}/{part}").type != pa_fs.FileType.NotFound:
                    store.move(f"{staged}/{part}", f"{folder}/{name}")
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    manifest = f"{shared_dir(spark)}/docloom-page-files-{uuid.uuid4().hex}"
    try:
        pages_md.select("file_name", "markdown").mapInArrow(put, "part string, file_name string").write.parquet(manifest)
        spark.read.parquet(manifest).mapInArrow(publish, "n long").agg({"n": "sum"}).collect()
    finally:
        removed(spark, stage)
        removed(spark, manifest)
