"""Literal cases of single operators."""

import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import corpus as C
from docloom.operators import hooks as H
from docloom.operators import markdown as M
from docloom.operators import web
from docloom.sources import files
from docloom.streaming import flows


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "pattern, url, hit",
    [
        ("/guides/*", "https://x.com/guides/7?page=2#top", True),
        ("/guides/*", "https://x.com/old/guides/7", False),
        ("https://x.com/a", "https://x.com/abc", True),
        ("https://x.com/?/b", "https://x.com/a/b", True),
        ("*.pdf", "https://x.com/a.pdf", True),
        ("*.pdf", "https://x.com/a.pdf?x", False),
        ("", "anything", True),
    ],
)
def test_url_filter(spark, pattern, url, hit):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    assert (web.url_filter(pages, pattern).count() == 1) == hit


def test_exclude_filter(spark):
    paths = spark.createDataFrame([(p,) for p in ("keep.md", "drafts/nested/skip.md", "guide/topic.md", "notes.tmp.md", "a/notes.tmp.md")], "path string")
    left = {r["path"] for r in C.exclude_filter(paths, ["drafts", "*.tmp.md"]).collect()}
    assert left == {"keep.md", "guide/topic.md", "a/notes.tmp.md"}
    assert {r["path"] for r in C.exclude_filter(paths, ["drafts/**", "**/topic.md"]).collect()} == {"keep.md", "notes.tmp.md", "a/notes.tmp.md"}


def test_session_key(spark):
    url = "https://example.com/a?b=1"
    assert one(spark, T.session_key(F.col("u")), u=url + "#frag") == str(uuid.uuid5(uuid.NAMESPACE_URL, url))
    assert one(spark, T.session_key(F.col("u")), u="  ") == "_unbound"


def test_slug_and_heading_ids(spark):
    found = M.headings(docs(spark, "# Setup\n## Setup\n# Setup\n# ??\n### 2.1 Load => Table & Rows"))
    assert [r["id"] for r in found.orderBy("line_no").collect()] == ["setup", "setup-2", "setup-3", "heading", "2-1-load-table-rows"]


def test_fence_closer_must_be_as_long(spark):
    found = M.fence_mask(docs(spark, "```\na\n````\nb\n```\nc")).orderBy("line_no").collect()
    assert [r["in_fence"] for r in found] == [True] * 5 + [False]


def test_front_matter(spark):
    found = M.front_matter(docs(spark, "---\na: 1\n---\nx\n", "---\n\n# No\n---\nx", "---\n---\ny", "text\n---\n", "﻿---\nb: c\n---\nz")).orderBy("doc_id").collect()
    assert [r["body"] for r in found] == ["x\n", "---\n\n# No\n---\nx", "y", "text\n---\n", "z"]
    assert found[0]["fm"] == {"a": "1"}


def test_currency_is_no_formula(spark):
    text = "From $3 up to $9, more\n（约 $14 每件，共 $6.5 万）\nrange $11-$12\nWas $8 → $6\nLet $a-b$ be $c$ here\n$$p=q$$"
    found = M.inline_math_candidates(docs(spark, text))
    assert [r["expr"] for r in found.collect() if r["line_no"] == 4] == ["a-b", "c"]
    assert {r["expr"] for r in M.display_math(docs(spark, text)).collect()} == {"p=q"}


def test_callouts(spark):
    found = M.callouts(docs(spark, "> [!NOTE] Own words\n> said\n\n:::warning Mind the step\nhere\n:::\n> [!nothing] x\n!!! tip\n    within")).orderBy("line_no").collect()
    assert [(r["kind"], r["title"], r["body"]) for r in found] == [("note", "Own words", "said"), ("warning", "Mind the step", "here"), ("tip", "Tip", "within")]


def test_footnotes(spark):
    d = docs(spark, "A[^1][^2].\n\n[^1]:\n[^1]: one\n    more\n[^2] : two\n[^1]: later")
    assert {r["label"]: r["body"] for r in M.footnote_first_wins(M.footnote_defs(d)).collect()} == {"1": "one\nmore", "2": "two"}
    fixed = M.footnote_repair(docs(spark, "Host line\n[^3]:\n\n[^1]: a [^2]： b\n")).first()
    assert fixed["text"] == "Host line[^3]\n\n[^1]: a\n\n[^2]: b\n" and fixed["n_stubs"] == 1


def test_cjk_emphasis(spark):
    assert M.cjk_emphasis_repair(docs(spark, "他**「回家」**了 7**「y」** 8")).first()["text"] == "他**​「回家」​**了 7**「y」** 8"


def test_html_table_and_zero_width(spark):
    pages = spark.createDataFrame([(1, '<table><tr><td class="head">Kind</td><td>Size</td></tr><tr><td>oak</td><td>9</td></tr></table><a href="/tree">﻿see</a>')], "page_id long, html string")
    md = web.html_to_markdown(web.explode_html_tokens(pages)).first()["markdown"]
    assert md == "| Kind | Size |\n| --- | --- |\n| oak | 9 |\n\n[see](/tree)"


def test_archive_crc(spark):
    rows = [("z", i, f"a/b {i}", "text" * i) for i in range(1, 5)]
    found = C.archive_manifest(spark.createDataFrame(rows, "archive string, entry_no int, title string, content string")).orderBy("entry_no").collect()
    assert [r["crc32"] for r in found] == [zlib.crc32(x[3].encode()) for x in rows]
    assert [r["offset"] for r in found] == sorted({r["offset"] for r in found}) and found[0]["name"] == "001_a_b_1.md"


def test_nav_tree(spark):
    found = C.nav_tree(spark.createDataFrame([("readme.md", ""), ("guide/start.md", ""), ("guide/advanced/topic.md", "")], "path string, label string"))
    top = [r["label"] for r in found.filter("parent_id = ''").orderBy("pos").collect()]
    assert top == ["guide", "readme.md"]


def test_empty_change_set_invalidates_all(spark):
    cache = spark.createDataFrame([("a",), ("b",)], "path string")
    assert all(r["invalid"] for r in C.invalidate_changed(cache, cache.limit(0)).collect())


def test_stop_predicate_callable_equals_column(spark):
    log = spark.createDataFrame([(1, i, f"u{i}", "t", "ok") for i in range(6)], "run_id long, seq long, url string, title string, status string")
    by_column = C.stop_predicate(log, F.col("page_index") >= 4).collect()
    assert by_column == C.stop_predicate(log, lambda url, n, urls, titles: len(urls) >= 4).collect()


def test_hooks(spark):
    pages = spark.createDataFrame([(1, "<a>"), (2, None)], "page_id long, html string")
    out = H.hook_pipeline(pages, H.Recipe("r", None, lambda html, p: {"title": p["t"], "html": html} if html else None), {"t": "x"})
    assert {(r["page_id"], r["status"], r["title"]) for r in out.collect()} == {(1, "ok", "x"), (2, "null", None)}
    assert {r["rule"] for r in H.hook_contract(out).collect()} == {"null_result", "no_removed"}


def test_undo_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, ["commit", "undo_one", "commit", "undo_all"][(s + i) % 4], i % 3) for s in range(3) for i in range(12)]
    log = spark.createDataFrame(rows, "session long, seq long, op string, records long")
    log.write.parquet(str(tmp_path / "in"))
    stream = flows.undo_stack_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), 2)
    q = stream.writeStream.format("memory").queryName("undo_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    order = lambda rows: sorted(((r["session"], r["seq"], r["depth"], r["top"]) for r in rows), key=lambda r: r[:2])
    assert order(spark.table("undo_out").collect()) == order(C.undo_stack(log, 2).collect())


def test_scan_markdown(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name in ("a.md", "nested/b.MARKDOWN", "nested/c.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    assert files.scan_markdown(spark, [str(tmp_path)]).count() == 2
    assert files.scan_rejects(spark, [str(tmp_path)]).count() == 1


def test_front_matter_with_nested_values(spark):
    yaml = "---\ntags:\n- a\n- b\nauthor:\n  name: X\nnote: |\n  free: text: here\n\"my key\": [1, 2]\n---\nbody"
    found = M.front_matter(docs(spark, yaml, "---\na: b: c\n---\nx", "---\nonly words\n---\nx", "---\n- a\n- b\n---\nx", "---\n# comment\n---\nx")).orderBy("doc_id").collect()
    assert [r["has_fm"] for r in found] == [True, False, False, False, False]
    assert found[0]["body"] == "body" and set(found[0]["fm"]) == {"tags", "author", "note", "my key"}


def test_long_document(spark):
    text = "plain words\n" * 3000 + "# At the end\n> [!TIP] Last\n> of all\n\nSee[^9].\n\n[^9]: note\n- [x] done\n"
    d = docs(spark, text)
    assert [(r["line_no"], r["text"]) for r in M.headings(d).collect()] == [(3000, "At the end")]
    assert M.callouts(d).first()["title"] == "Last" and M.footnote_defs(d).first()["label"] == "9" and M.task_items(d).first()["checked"]


def test_large_footnote_numbers(spark):
    rows = [(1, "4294967295", "a"), (1, "4294967296", "b"), (1, "12", "c"), (1, "x", "d")]
    found = M.footnote_sort(spark.createDataFrame(rows, "doc_id long, label string, body string")).orderBy("rank").collect()
    assert [r["label"] for r in found] == ["12", "4294967295", "4294967296", "x"]


def test_bundle_touches_references_alone(spark):
    html = '<img src="a" alt="banana"><video src="v" poster=\'a\'></video><style>b{x:url(a)} i{y:url("#f")}</style><link href="a"><a href="a">a</a><img src="big">'
    assets = spark.createDataFrame([("a", "m/x", bytearray(b"1")), ("big", "m/x", bytearray(b"12345"))], "path string, mime string, content binary")
    found = web.bundle_html_resources(web.explode_html_tokens(spark.createDataFrame([(1, html)], "page_id long, html string")), assets, max_bytes=4).first()
    d = "data:m/x;base64,MQ=="
    assert found["html"] == f'<img src="{d}" alt="banana"><video src="data:," poster=\'{d}\'></video><style>b{{x:url("{d}")}} i{{y:url("#f")}}</style><link href="{d}"><a href="a">a</a><img src="data:,">'
    assert (found["n_inlined"], found["n_failed"]) == (4, 2)


def test_preformatted_text_and_numbered_lists(spark):
    html = "<pre>a  b\n    c</pre><ol><li>x<ul><li>y</ul><li>z</ol><p>end"
    md = web.html_to_markdown(web.explode_html_tokens(spark.createDataFrame([(1, html)], "page_id long, html string"))).first()["markdown"]
    assert md == "```\na  b\n    c\n```\n\n1. x\n\n- y\n\n2. z\n\nend"


@pytest.mark.parametrize(
    "pattern, url, fits",
    [
        ("https://x.com/docs/*", "https://x.com/docs", True),
        ("https://x.com/docs/*", "https://www.x.com/docs/a?b#c", True),
        ("https://x.com/docs/*", "https://x.com/docsets", False),
        ("https://x.com/docs/*", "http://x.com/docs/a", False),
        ("https://x.com/*", "https://x.com/any", True),
        ("https://x.com/a", "https://x.com/a", True),
        ("https://x.com/a", "https://x.com/a/b", False),
        ("*.x.com/a", "https://q.x.com/abc", True),
        ("*.x.com", "https://x.com/", False),
        ("x.com/a*", "ftp://x.com/ab", True),
        ("*://x.com", "http://www.x.com/q", True),
        ("/g?/*", "https://any.org/go/1", True),
        ("/go", "https://any.org/gone", True),
        (" * ", "https://any.org", True),
    ],
)
def test_recipes(spark, pattern, url, fits):
    found = web.recipe_first_match(spark.createDataFrame([(1, url)], "page_id long, url string"), [("r", pattern)]).first()
    assert (found["recipe_id"] == "r") == fits


def test_latest_session_wins(spark, tmp_path):
    rows = [("https://x.com/#a", "b old", "one", 1), ("https://x.com/#b", "a new", "two", 2)]
    df = spark.createDataFrame(rows, "url string, title string, markdown string, captured_seq long")
    found = C.session_sink(df, str(tmp_path / "out")).collect()
    assert [(r["title"], r["markdown"]) for r in found] == [("a new", "two")]
    assert len(list((tmp_path / "out").glob("session_key=*"))) == 1


def test_deep_and_odd_trees(spark):
    schema = "page_id long, node_id long, parent_id long, role string, name string, ignored boolean"
    deep = [(1, i, i - 1 if i else None, "generic" if i % 2 else "item", "leaf" if i == 2000 else "", False) for i in range(2001)]
    odd = [(2, 0, None, "item", "", False), (2, 1, 0, "text", "t", False), (2, 2, 1, "item", "below text", False), (2, 3, 2, "item", "further", False), (2, 4, 0, "item", "n" * 120, True), (2, 5, 4, "item", "kept", False), (2, 6, None, "item", "", False)]
    found = {(r["page_id"], r["node_id"]): (r["kept_parent"], r["depth"], r["name"]) for r in C.hierarchy_collapse(spark.createDataFrame(deep + odd, schema)).collect()}
    assert {k: v for k, v in found.items() if k[0] == 2} == {(2, 0): (-1, 0, ""), (2, 5): (0, 1, "kept")}
    assert len([k for k in found if k[0] == 1]) == 1001 and found[1, 2000] == (1998, 1000, "leaf") and found[1, 0] == (-1, 0, "")


def test_runs_that_do_not_navigate(spark):
    rows = [(1, 1, "a", "null"), (1, 2, "b", "ok"), (2, 1, "a", "failed"), (3, 1, "a", "ok"), (3, 2, "b", "ok")]
    log = spark.createDataFrame(rows, "run_id long, seq long, url string, status string")
    assert {r["run_id"]: (r["stop_seq"], r["reason"]) for r in C.stop_rules(log, 5, navigates=False).collect()} == {1: (1, "extract_null"), 2: (1, "extract_failed"), 3: (1, "single_page")}


def streamed(spark, tmp_path, df, make, mode="append"):
    """The rows that a stream over df, written as files, hands on until it has read all."""
    df.write.parquet(str(tmp_path / "in"))
    out = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    name = f"out_{uuid.uuid4().hex}"
    out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_bursts_as_a_stream(spark, tmp_path):
    at = ["00:00:00.0", "00:00:00.2", "00:00:01.0", "00:10:00.0"]
    df = spark.createDataFrame([("p", f"2024-01-01 {t}") for t in at], "path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streamed(spark, tmp_path, df, lambda s: flows.debounce_sessions(s, watermark="1 second"))
    # The last burst stays open until the watermark has passed it.
    assert sorted(r["n"] for r in found) == [1, 2]
    assert sorted(r["n"] for r in flows.debounce_sessions(df).collect()) == [1, 1, 2]


def test_first_extractions_as_a_stream(spark, tmp_path):
    rows = [(1, i, f"u{i % 3}", "ok" if i else "failed", f"2024-01-01 00:00:0{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "run_id long, seq long, url string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streamed(spark, tmp_path, df, flows.crawl_dedup_stream)
    assert {r["url"] for r in found} == {"u0", "u1", "u2"} and len(found) == 3
