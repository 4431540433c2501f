"""Structured Streaming forms; each also runs on a batch where Spark allows it."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import markdown as M
from docloom.sources import files


def debounce_sessions(fs_events: DataFrame, gap: str = "300 milliseconds", watermark: str | None = "1 minute") -> DataFrame:
    """(path, start, end, n): bursts of events of a path, ended by a quiet gap."""
    events = fs_events.withWatermark("ts", watermark) if watermark and fs_events.isStreaming else fs_events
    found = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def coalesce_changes(sessions: DataFrame, every: str = "hour", by: str = "start") -> DataFrame:
    """(batch, paths): the sorted distinct paths whose bursts began (or, by end, ended) in each trigger interval."""
    at = F.col("start") if by == "start" else F.col("end") - F.expr("interval 1 microsecond")
    # The filter keeps the burst's count in use: without it, Catalyst takes the session aggregate for a redundant one and drops it.
    return sessions.filter("n > 0").groupBy(F.date_trunc(every, at).alias("batch")).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def coalesced_bursts(fs_events: DataFrame, gap: str = "300 milliseconds", watermark: str = "1 minute", every: str = "1 hour") -> DataFrame:
    """(batch, paths) of events (path, ts): debounce_sessions and coalesce_changes by end as one plan, which as a stream runs in append mode.

    The watermark goes through both: a burst is handed on when no event can join it any more, and an interval when no burst can end in it. Events later
    than the watermark are dropped.
    """
    events = fs_events.withWatermark("ts", watermark) if fs_events.isStreaming else fs_events
    bursts = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    ended = bursts.select("path", F.window_time("w").alias("ended"))
    found = ended.groupBy(F.window("ended", every).alias("i")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return found.select(F.col("i.start").alias("batch"), "paths")


def crawl_dedup_stream(log: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The first successful extraction of each run and URL; a stream needs a ts column."""
    ok = log.filter("status = 'ok'")
    if log.isStreaming:
        return ok.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["run_id", "url"])
    first = F.min_by(F.struct(*ok.columns), "seq")
    return ok.groupBy("run_id", "url").agg(first.alias("r")).select("r.*")


LISTING = "path string, mtime timestamp, length long, removed boolean, listing long"
CHANGE = "path string, change string, mtime timestamp, version long, listing long"
#: Files that a task of the ingest reads.
FILES_EACH = 500


def list_files(spark: SparkSession, root: str, listings: str) -> None:
    """Append a listing of the Markdown files below root (path, mtime, length; no content is read), with those of the last listing that are gone as removed."""
    found = files.listed(spark, root).filter(F.lower("path").rlike(r"\.(md|markdown)$"))
    now = found.select("path", F.col("modificationTime").alias("mtime"), "length")
    empty = spark.createDataFrame([], LISTING)
    try:
        before = spark.read.schema(LISTING).parquet(listings)
    except AnalysisException:
        before = empty
    last = before.agg(F.coalesce(F.max("listing"), F.lit(-1))).first()[0]
    old = before.filter(F.col("listing") == last).filter("not removed").select("path", F.col("mtime").alias("old_mtime"), F.col("length").alias("old_length"))
    both = now.join(old, "path", "full").select("path", F.coalesce("mtime", "old_mtime").alias("mtime"), F.coalesce("length", "old_length").alias("length"), F.col("mtime").isNull().alias("removed"))
    both.withColumn("listing", F.lit(last + 1)).write.mode("append").parquet(listings)


def file_changes(listings: DataFrame) -> DataFrame:
    """(path, change, mtime, version, listing) of a stream of listings: new, changed or removed files, by the modification time, length and version kept as state of each path."""

    def step(key, frames, state):
        out = []
        for r in pd.concat(list(frames)).sort_values("listing").itertuples():
            at = int(pd.Timestamp(r.mtime).value // 1000)
            mtime, length, version = state.get if state.exists else (None, None, 0)
            if r.removed:
                if state.exists:
                    state.remove()
                    out.append((key[0], "removed", r.mtime, version, r.listing))
            elif (at, r.length) != (mtime, length):
                state.update((at, int(r.length), version + 1))
                out.append((key[0], "changed" if version else "new", r.mtime, version + 1, r.listing))
        yield pd.DataFrame(out, columns=["path", "change", "mtime", "version", "listing"])

    return listings.groupBy("path").applyInPandasWithState(step, CHANGE, "mtime long, length long, version long", "append", "NoTimeout")


def stream_ingest(spark: SparkSession, root: str, sink: str, checkpoint: str, facts=M.headings):
    """A trigger of the ingest of Markdown files: lists the files below root, and returns the query that reads those that are new or changed since the last one.

    The query ends when all listings are read, which are one batch: several only if a trigger before failed. It writes the changes of each batch below
    sink/changes, and the facts (a function of documents with path as doc_id) of files that are new or changed by its end below sink/facts; a batch that is
    repeated replaces its own. current_facts() has what holds now.
    """
    list_files(spark, root, f"{checkpoint}/listings")

    def land(batch: DataFrame, number: int) -> None:
        changes = f"{sink}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(changes)
        found = spark.read.schema(CHANGE).parquet(changes).groupBy("path").agg(F.max_by("change", "listing").alias("change")).filter("change <> 'removed'")
        n = found.count()
        if n:
            docs = files.contents(found.select("path").repartition(1 + n // FILES_EACH, "path"), root).select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("text"))
            facts(docs).write.mode("overwrite").parquet(f"{sink}/facts/batch={number}")

    stream = file_changes(spark.readStream.schema(LISTING).parquet(f"{checkpoint}/listings"))
    return stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()


def current_facts(spark: SparkSession, sink: str) -> DataFrame:
    """The facts of the files that are there, as of their last change: a changed file's replace those before, a removed file has none."""
    changes = spark.read.schema(f"{CHANGE}, batch long").parquet(f"{sink}/changes")
    last = changes.groupBy("path").agg(F.max_by(F.struct("change", "batch"), F.struct("batch", "listing")).alias("c")).filter("c.change <> 'removed'")
    return spark.read.parquet(f"{sink}/facts").join(last.select(F.col("path").alias("doc_id"), F.col("c.batch").alias("batch")), ["doc_id", "batch"]).drop("batch")


def _timeout(ttl: str | None) -> tuple[int | None, str]:
    """(milliseconds, timeout of the state). With one, Spark runs batches without data to find what is due, so such a query ends by itself (availableNow) only where spark.sql.streaming.noDataMicroBatches.enabled is false."""
    return (int(pd.Timedelta(ttl) / pd.Timedelta("1ms")), "ProcessingTimeTimeout") if ttl else (None, "NoTimeout")


def incremental_render_stream(docs: DataFrame, render, ttl: str | None = None) -> DataFrame:
    """(path, mtime, output, status, version) of a stream of documents (path, mtime long, ...), the last good output of each path kept as state.

    render(docs) -> Column, null for a failure. A document as old as the state's is reused; a failed one keeps the last good output and is tried again when it
    comes again; version counts the outputs that differ from the one before. State that nothing has used for ttl, if one is given, goes.
    """
    milliseconds, timeout = _timeout(ttl)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        mtime, output, version = state.get if state.exists else (None, None, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("mtime").itertuples():
            made = r.made if isinstance(r.made, str) else None
            if mtime is not None and r.mtime <= mtime:
                status = "reused"
            elif made is None:
                status = "kept_last" if output is not None else "failed"
            else:
                mtime, version, output, status = int(r.mtime), version + (made != output), made, "rendered"
            out.append((key[0], int(r.mtime), output, status, version))
        state.update((mtime, output, version))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=["path", "mtime", "output", "status", "version"])

    made = docs.select("path", F.col("mtime").cast("long").alias("mtime"), render(docs).cast("string").alias("made"))
    return made.groupBy("path").applyInPandasWithState(step, "path string, mtime long, output string, status string, version long", "mtime long, output string, version long", "append", timeout)


def version_publish_stream(renders: DataFrame, ttl: str | None = None) -> DataFrame:
    """The streaming form of version_publish: (path, seq, version, changed) of renders (path, seq, content), a content hash and the version kept as state of each path (until ttl, if one is given)."""
    milliseconds, timeout = _timeout(ttl)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        digest, version = state.get if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            out.append((key[0], int(r.seq), version + 1, r.digest != digest))
            digest, version = r.digest, version + 1
        state.update((digest, version))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=["path", "seq", "version", "changed"])

    hashed = renders.select("path", F.col("seq").cast("long").alias("seq"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    return hashed.groupBy("path").applyInPandasWithState(step, "path string, seq long, version long, changed boolean", "digest string, version long", "append", timeout)


def undo_stack_stream(edits: DataFrame, cap: int = 50) -> DataFrame:
    """The streaming form of undo_stack: (session, seq, depth, top) for each operation, the stack kept as state of its session."""

    def fold(key, frames, state):
        stack = list(state.get[0]) if state.exists else []
        rows = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.op == "commit" and r.records > 0:
                stack = [*stack, r.seq][-cap:]
            elif r.op == "undo_one":
                stack = stack[:-1]
            elif r.op in ("undo_all", "reset"):
                stack = []
            rows.append((key[0], r.seq, len(stack), stack[-1] if stack else None))
        state.update((stack,))
        yield pd.DataFrame(rows, columns=["session", "seq", "depth", "top"]).astype({"top": "Int64"})

    return edits.groupBy("session").applyInPandasWithState(fold, "session long, seq long, depth int, top long", "stack array<long>", "append", "NoTimeout")
