"""Streams against their batch forms, and files that come, change and go between triggers."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import corpus as C
from docloom.session import shared_dir
from docloom.sources import files
from docloom.streaming import flows


def fed(spark, tmp_path, parts, flow, mode="append"):
    """The rows of a flow over a stream that reads each part (a DataFrame) in a trigger of its own."""
    source, name = str(tmp_path / "in"), f"s{time.time_ns()}"
    schema = parts[0].schema
    rows = []
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = flow(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).queryName(f"{name}_{i}").trigger(availableNow=True).start()
        query.awaitTermination()
    return rows


def test_ingest_follows_files(spark, tmp_path):
    """Files are added, edited, deleted and made again between triggers: the facts are those of what is there."""
    root, sink, state = (str(tmp_path / x) for x in ("docs", "sink", "state"))
    os.makedirs(f"{root}/sub")

    def put(name, text, age):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
        at = time.time() - age
        os.utime(f"{root}/{name}", (at, at))

    def now():
        flows.stream_ingest(spark, root, sink, state).awaitTermination()
        return {(r["doc_id"].rsplit("/", 1)[1], r["text"]) for r in flows.current_facts(spark, sink).collect()}

    put("a.md", "# A\n## A2", 500)
    put("sub/b.markdown", "# B", 400)
    put("c.txt", "# no Markdown", 400)
    assert now() == {("a.md", "A"), ("a.md", "A2"), ("b.markdown", "B")}
    assert now() == {("a.md", "A"), ("a.md", "A2"), ("b.markdown", "B")}
    put("a.md", "# A new", 300)
    put("d.md", "# D", 600)
    assert now() == {("a.md", "A new"), ("b.markdown", "B"), ("d.md", "D")}
    os.remove(f"{root}/sub/b.markdown")
    assert now() == {("a.md", "A new"), ("d.md", "D")}
    put("sub/b.markdown", "# B again", 100)
    put("d.md", "no heading", 50)
    assert now() == {("a.md", "A new"), ("b.markdown", "B again")}
    changes = spark.read.parquet(f"{sink}/changes").groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in changes} == {"new": 4, "changed": 2, "removed": 1}


def test_ingest_reads_changed_files_in_place(spark, tmp_path):
    """The contents of files below a folder (of odd name, or named by a wildcard) are read without a listing, join or shuffle of them; a file that is gone has no row."""
    folder = tmp_path / "odd %20 name"
    os.makedirs(folder / "sub")
    texts = {"a b.md": b"x" * 100, "sub/%41.md": b"\xff\x00"}
    for name, text in texts.items():
        (folder / name).write_bytes(text)
    for root in (str(folder), f"{tmp_path}/odd*"):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").localCheckpoint()
        found = files.contents(listed.union(listed.limit(1).select(F.concat("path", F.lit(".gone")))), root)
        assert {r["path"].split("name/")[1]: bytes(r["content"]) for r in found.collect()} == texts
        assert "Exchange" not in files.contents(listed, root)._jdf.queryExecution().executedPlan().toString()


def test_listing_takes_few_tasks(spark, tmp_path):
    """A listing's tasks follow the cores, not the number of files; every listing is whole, and several that one trigger reads leave the last state."""
    os.makedirs(tmp_path / "in")
    for i in range(150):
        (tmp_path / "in" / f"{i}.md").write_text(f"# T{i}")
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in before:
        spark.conf.set(key, "4m")
    context, listings = spark.sparkContext, f"{tmp_path}/state/listings"
    try:
        context.setJobGroup("listing", "listing")
        flows.list_files(spark, f"{tmp_path}/in", listings)
        jobs = context.statusTracker().getJobIdsForGroup("listing")
        stages = [context.statusTracker().getStageInfo(k) for j in jobs for k in context.statusTracker().getJobInfo(j).stageIds]
        assert max(x.numTasks for x in stages if x) <= 2 * context.defaultParallelism < 150
    finally:
        context._jsc.clearJobGroup()
        for key, value in before.items():
            spark.conf.set(key, value)
    assert spark.read.parquet(listings).filter("not removed").count() == 150
    os.remove(tmp_path / "in" / "7.md")
    os.remove(tmp_path / "in" / "9.md")
    flows.list_files(spark, f"{tmp_path}/in", listings)
    (tmp_path / "in" / "8.md").write_text("# Longer than before")
    (tmp_path / "in" / "9.md").write_text("# T9")
    flows.stream_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/sink", f"{tmp_path}/state").awaitTermination()
    found = {r["text"]: r["n"] for r in flows.current_facts(spark, f"{tmp_path}/sink").groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {"Longer than before" if i == 8 else f"T{i}": 1 for i in range(150) if i != 7}


def test_render_stream_equals_batch(spark, tmp_path):
    schema = "path string, mtime long, text string"
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("c", 1, "z"), ("e", 1, "q")], schema)
    second = spark.createDataFrame([("a", 2, "y"), ("b", 2, "w"), ("c", 1, "other"), ("d", 5, None), ("e", 3, None)], schema)
    render = lambda d: F.upper(d["text"])
    found = fed(spark, tmp_path, [first, second], lambda s: flows.incremental_render_stream(s, render))
    cache = C.incremental_render(first, spark.createDataFrame([], "path string, mtime long, output string"), render).filter("output is not null").withColumn("mtime", F.lit(1).cast("long")).select("path", "mtime", "output")
    batch = {(r["path"], r["output"], r["status"]) for r in C.incremental_render(second, cache, render).collect()}
    assert {(r["path"], r["output"], r["status"]) for r in found[4:]} == batch
    assert ("e", "Q", "kept_last") in batch and ("d", None, "failed") in batch and ("c", "Z", "reused") in batch
    assert {r["path"]: r["version"] for r in found[4:]} == {"a": 2, "b": 1, "c": 1, "d": 0, "e": 1}


def test_version_stream_equals_batch(spark, tmp_path):
    rows = [("p", i, c) for i, c in enumerate("aabbbca")] + [("q", i, c) for i, c in enumerate([None, None, "", "x"])]
    df = spark.createDataFrame(rows, "path string, seq long, content string")
    found = fed(spark, tmp_path, [df.filter("seq < 2"), df.filter("seq between 2 and 4"), df.filter("seq > 4")], flows.version_publish_stream)
    batch = {(r["path"], r["seq"], r["version"], r["changed"]) for r in C.version_publish(df).collect()}
    assert {(r["path"], r["seq"], r["version"], r["changed"]) for r in found} == batch


def test_bursts_coalesce_in_one_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    times = [("a", 0), ("a", 10), ("b", 5), ("a", 120), ("c", 3590), ("c", 3595), ("b", 3700), ("a", 9000), ("z", 40_000)]
    df = spark.createDataFrame([(p, start + datetime.timedelta(seconds=s)) for p, s in times], "path string, ts timestamp")
    parts = [df.filter("ts < '2024-01-01 00:30'"), df.filter("ts between '2024-01-01 00:30' and '2024-01-01 03:00'"), df.filter("ts > '2024-01-01 03:00'")]
    flow = lambda s: flows.coalesced_bursts(s, "30 seconds", "1 minute")
    found = {(r["batch"], tuple(r["paths"])) for r in fed(spark, tmp_path, parts, flow)}
    batch = {(r["batch"], tuple(r["paths"])) for r in flow(df).collect()}
    twin = {(r["batch"], tuple(r["paths"])) for r in flows.coalesce_changes(flows.debounce_sessions(df, "30 seconds"), by="end").collect()}
    assert batch == twin
    # The interval of the last burst is open until the watermark has passed it.
    assert found == {x for x in batch if "z" not in x[1]}


def test_late_events_are_dropped(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    frame = lambda *s: spark.createDataFrame([("a", start + datetime.timedelta(seconds=x)) for x in s], "path string, ts timestamp")
    found = fed(spark, tmp_path, [frame(0, 7200), frame(5, 20_000), frame(40_000)], lambda s: flows.coalesced_bursts(s, "30 seconds", "1 minute"))
    assert sorted(r["batch"].hour for r in found) == [0, 2, 5]


# The sink


def test_sink_publishes_each_file_once(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"{i}.md", f"text {i}") for i in range(50)] + [("empty.md", None)], "file_name string, markdown string").repartition(7)
    files.sink_page_files(df, out)
    files.sink_page_files(df, "file://" + out)
    assert sorted(x for x in os.listdir(out) if not x.endswith(".crc")) == sorted([f"{i}.md" for i in range(50)] + ["empty.md"])
    assert open(f"{out}/7.md").read() == "text 7" and open(f"{out}/empty.md").read() == ""


def test_sink_publishes_nothing_if_a_task_fails(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(40).select(F.concat("id", F.lit(".md")).alias("file_name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("x").alias("markdown")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        files.sink_page_files(df, out)
    assert [x for x in os.listdir(out) if not x.endswith(".crc")] == []


def test_stores_of_paths(spark, tmp_path):
    assert files.store_uri(spark, str(tmp_path / "x")) == f"file://{tmp_path}/x"
    assert files.store_uri(spark, f"file:{tmp_path}/y") == f"file://{tmp_path}/y"


def test_shared_folder_without_scheme_on_a_cluster(spark, tmp_path, monkeypatch):
    """What spark.checkpoint.dir names is shared, also where no store is named and the master is a cluster; other folders without a store stay an error there."""
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: str(tmp_path / "shared") if key == "spark.checkpoint.dir" else get(self, key, *a))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    files.sink_page_files(spark.createDataFrame([("a.md", "A"), ("b.md", "B")], "file_name string, markdown string"), f"{shared_dir(spark)}/out")
    assert sorted(x for x in os.listdir(tmp_path / "shared" / "out") if not x.endswith(".crc")) == ["a.md", "b.md"]
    with pytest.raises(ValueError, match="name its store"):
        files.store_uri(spark, str(tmp_path / "own"))


# Trees


def test_cycles_and_own_parents(spark):
    schema = "page_id long, node_id long, parent_id long, role string, name string, ignored boolean"
    rows = [(1, 0, 0, "main", "root", False), (1, 1, 0, "generic", "", False), (1, 2, 1, "p", "leaf", False), (1, 3, 4, "p", "x", False), (1, 4, 5, "generic", "y", False), (1, 5, 3, "p", "z", False), (1, 6, 5, "p", "below", False), (2, 0, 0, "generic", "", False), (2, 1, 0, "p", "one", False), (3, 7, 9, "p", "orphan", False)]
    df = spark.createDataFrame(rows, schema)
    assert {(r["page_id"], r["node_id"]) for r in C.hierarchy_rejects(df).collect()} == {(1, 3), (1, 4), (1, 5), (1, 6)}
    found = {(r["page_id"], r["node_id"], r["kept_parent"], r["depth"], r["name"]) for r in C.hierarchy_collapse(df).collect()}
    assert found == {(1, 0, -1, 0, "root"), (1, 2, 0, 1, "leaf"), (2, 1, -1, 0, "one"), (3, 7, -1, 0, "orphan")}
