"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (hi, lo, docs), bucketed and sorted by the 128-bit line hash, with the number of documents of its batch that hold each
line. Each new batch merge-anti-joins the runs, bucket by bucket and without a shuffle of what they hold: the lines that no run
has become a run of level 0, and the counts of the others are kept beside the runs, so a line is in one run only. `FAN_IN`
runs of one level are merged into one run of the next. Two policies use them: `first_seen` lets only lines pass that no run has, and
`drop_repeated` removes every line that the batches found in at least `min_docs` documents.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import pieces, removed, text_bytes, written
from docloom.session import configure, shared_dir

STRIP = b" \t\n\x0b\x0c\r"
FAN_IN = 3
BATCHES = 4
MIN_DOCS = 10
#: Up to so many repeated lines (16 bytes each) are broadcast to the tasks that rewrite the texts; beyond, both sides are joined by a shuffle.
BROADCAST_LINES = 1 << 18
HASHED = pa.schema([("batch", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("docs", pa.int64())])
#: Rows of documents whose equal lines are counted before they are shuffled.
COUNTED = 4096
#: Rows whose texts are Python objects at a time.
PIECE = 256


def line_hash(line: bytes) -> bytes | None:
    """The hash of a line's key, the line stripped and with A-Z lower-cased; None for an empty key."""
    key = line.strip(STRIP).lower()
    return xxhash.xxh3_128_digest(key) if key else None


def _hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, hi, lo, docs): the documents that hold each key, counted over COUNTED rows, so that a very frequent line is few rows in the shuffle."""
    for whole in batches:
        for b in pieces(whole, COUNTED):
            found: dict[int, Counter] = {}
            for own in pieces(b, PIECE):
                for lot, text in zip(own["batch"].to_pylist(), text_bytes(own["text"]), strict=True):
                    found.setdefault(lot, Counter()).update({line_hash(x) for x in text.split(b"\n")} - {None})
            pairs = np.frombuffer(b"".join(h for own in found.values() for h in own), dtype="<i8").reshape(-1, 2)
            lots = np.repeat(np.array(list(found), np.int32), [len(x) for x in found.values()])
            docs = np.fromiter((n for own in found.values() for n in own.values()), np.int64, len(pairs))
            yield pa.record_batch([pa.array(lots), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(docs)], schema=HASHED)


class LineRuns:
    """Runs on shared storage by level, the counts of lines that came again, and the jobs that add to them."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, DataFrame]] = []
        self.again: list[DataFrame] = []
        self.tables: list[str] = []

    def _saved(self, df: DataFrame, partition: str | None = None) -> DataFrame:
        """df as a table in the shared folder, bucketed and sorted by hash."""
        name = f"docloom_lines_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", f"{shared_dir(self.spark)}/{name}")
        (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Drop all tables and their files."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, f"{shared_dir(self.spark)}/{name}")
        self.runs, self.again, self.tables = [], [], []

    def add(self, df: DataFrame, batches: int = 1) -> None:
        """Add the lines of df (doc_id, text), hashed in one pass over the texts, as that many batches one after the other."""
        lot = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
        hashed = df.select(lot.alias("batch"), "text").mapInArrow(_hashed_lines, "batch int, hi long, lo long, docs long")
        counted = hashed.repartition(self.buckets, "hi", "lo").groupBy("hi", "lo", "batch").agg(F.sum("docs").alias("docs"))
        lots = self._saved(counted, "batch")
        for i in range(batches):
            self._add(lots.filter(F.col("batch") == i).select("hi", "lo", "docs"))

    def _add(self, batch: DataFrame) -> None:
        """Add one batch (hi, lo, docs), bucketed like the runs."""
        if self.runs:
            new = self._saved(self.unseen(batch))
            self.again.append(batch.join(new.hint("merge"), ["hi", "lo"], "left_anti"))
        else:
            new = batch
        self.runs.append((0, new))
        self.compact()

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (hi, lo, ...) that no run has: one merge-anti-join for each run, of which there are fewer than fan_in at a level."""
        return reduce(lambda left, run: left.join(run[1].hint("merge"), ["hi", "lo"], "left_anti"), self.runs, lines)

    def compact(self) -> None:
        """Merge each level that has fan_in runs into one run of the next level."""
        level = 0
        while level <= max((x for x, _ in self.runs), default=-1):
            own = [d for x, d in self.runs if x == level]
            if len(own) >= self.fan_in:
                # No line is in two runs, so merging needs no sums.
                merged = self._saved(reduce(DataFrame.union, own).repartition(self.buckets, "hi", "lo"))
                self.runs = [(x, d) for x, d in self.runs if x != level] + [(level + 1, merged)]
            level += 1

    def first_seen(self, df: DataFrame) -> DataFrame:
        """(doc_id, line_no, line) of the lines whose key no run holds, each key once (smallest doc_id, line_no); the batch is then added.

        Lines with an empty key always pass.
        """
        exploded = df.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
        keyed = exploded.mapInArrow(_line_keys, "doc_id long, line_no int, line string, hi long, lo long")
        blank, full = keyed.filter("hi is null"), keyed.filter("hi is not null")
        first = self.unseen(full).groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "line_no", "line")).alias("first")).select("first.*")
        out = blank.select("doc_id", "line_no", "line").union(first)
        self.add(df)
        return out

    def repeated(self, min_docs: int) -> DataFrame:
        """(hi, lo) of the lines in at least min_docs documents: counts of the runs, joined with those of the lines that came again."""
        if not self.runs:
            return self.spark.createDataFrame([], "hi long, lo long")
        if not self.again:
            return reduce(DataFrame.union, (d.filter(F.col("docs") >= min_docs).select("hi", "lo") for _, d in self.runs))
        more = reduce(DataFrame.union, self.again).repartition(self.buckets, "hi", "lo").groupBy("hi", "lo").agg(F.sum("docs").alias("more"))
        more = self._saved(more)
        whole = (d.join(more.hint("merge"), ["hi", "lo"], "left").filter(F.col("docs") + F.coalesce("more", F.lit(0)) >= min_docs).select("hi", "lo") for _, d in self.runs)
        return reduce(DataFrame.union, whole)


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [line_hash(x) for x in text_bytes(b["line"])]
        pairs = [(None, None) if x is None else tuple(np.frombuffer(x, "<i8").tolist()) for x in found]
        yield pa.record_batch(
            [b["doc_id"], b["line_no"], b["line"], pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())],
            names=["doc_id", "line_no", "line", "hi", "lo"],
        )


def _kept(text: bytes, dropped) -> tuple[bytes, int, int]:
    """The text without the lines whose hash is in dropped; lines before and lines dropped."""
    lines = text.split(b"\n")
    stay = [x for x in lines if (h := line_hash(x)) is None or h not in dropped]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def drop_repeated(df: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """df with text rewritten, and n_lines and n_dropped (long) added.

    df needs doc_id (long) and text. A document's lines are its text split at newlines (null or empty: one empty
    line); those whose key is found in at least min_docs documents go from every document, the rest is joined by newlines.
    A line repeated inside one document counts once; lines with an empty key stay. Rows with the same doc_id count as
    different documents and each is returned; a null doc_id is allowed. Texts of any length are read whole. An empty table gives an
    empty result. Columns named n_lines and n_dropped are replaced, others pass through under any name.
    """
    # Its settings bound the batches by their bytes.
    runs = LineRuns(configure(df.sparkSession))
    try:
        runs.add(df, batches)
        hot = written(runs.repeated(min_docs), "hot-lines")
    finally:
        runs.close()
    rest = [c for c in df.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    shaped = df.select(*(f"`{c}`" for c in rest), "text")
    if hot.limit(broadcast_lines + 1).count() <= broadcast_lines:
        found = frozenset(np.array([r["hi"], r["lo"]], dtype="<i8").tobytes() for r in hot.collect())
        shared = df.sparkSession.sparkContext.broadcast(found)
        schema = T.StructType([*shaped.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dropped = shared.value
            for b in (x for whole in parts for x in pieces(whole, PIECE)):
                new = [_kept(x, dropped) for x in text_bytes(b["text"])]
                yield pa.record_batch(
                    [*(b[c] for c in rest), pa.array([x[0] for x in new], pa.binary()).cast(pa.string()), pa.array([x[1] for x in new], pa.int64()), pa.array([x[2] for x in new], pa.int64())],
                    names=[*rest, "text", "n_lines", "n_dropped"],
                )

        return shaped.mapInArrow(rewrite, schema)
    return _drop_by_shuffle(shaped, hot)


def _drop_by_shuffle(shaped: DataFrame, hot: DataFrame) -> DataFrame:
    """drop_repeated() where the repeated lines are too many to broadcast: lines and repeated lines meet by a shuffle on the hash.

    shaped is (..., text); its columns are renamed meanwhile, so that they may have any name.
    """
    names = shaped.columns
    keyed = written(shaped.toDF(*(f"c{i}" for i in range(len(names) - 1)), "text").withColumn("row_no", F.monotonically_increasing_id()), "line-docs")
    lines = keyed.select(F.col("row_no").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    hashed = lines.mapInArrow(_line_keys, "doc_id long, line_no int, line string, hi long, lo long").select("doc_id", "line_no", "hi", "lo")
    gone = hashed.join(hot, ["hi", "lo"], "left_semi").groupBy(F.col("doc_id").alias("row_no")).agg(F.collect_set("line_no").alias("gone"))
    joined = keyed.join(gone, "row_no", "left").drop("row_no")
    schema = T.StructType([*keyed.drop("row_no").schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in parts for x in pieces(whole, PIECE)):
            texts, counts = [], []
            for text, gone in zip(text_bytes(b["text"]), b["gone"].to_pylist(), strict=True):
                lines, out = text.split(b"\n"), frozenset(gone or ())
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in out))
                counts.append((len(lines), len(out)))
            columns = [b[c] for c in b.schema.names if c not in ("text", "gone")]
            yield pa.record_batch([*columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array([x[0] for x in counts], pa.int64()), pa.array([x[1] for x in counts], pa.int64())], names=schema.names)

    return joined.mapInArrow(rewrite, schema).toDF(*names, "n_lines", "n_dropped")


def op10_levelled_runs(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines found in ten documents or more."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated(documents).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: DuckDB text of op10_levelled_runs.
OP10_SQL = """
WITH numbered AS (
  SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT row_no, doc_id, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS line_no FROM numbered),
keyed AS (
  SELECT row_no, doc_id, line_no, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
hot AS (
  SELECT line_key FROM keyed WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT row_no) >= 10),
flagged AS (
  SELECT keyed.*, hot.line_key IS NOT NULL AS gone FROM keyed LEFT JOIN hot ON keyed.line_key = hot.line_key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY row_no, doc_id
"""
