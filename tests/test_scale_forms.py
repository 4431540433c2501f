"""Forms for large groups and many rules against the plain ones, and pages with odd marks."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import corpus as C
from docloom.operators import web
from docloom.operators.running import numbered


def test_numbers_and_sums_equal_a_window(spark):
    """One group of most rows spreads over the tasks; ranks and sums are those of one window."""
    df = spark.range(60_000).select(F.when(F.col("id") % 20 == 0, (F.col("id") % 7).cast("string")).when(F.col("id") % 9999 != 1, "hot").alias("g"), F.xxhash64("id").alias("x"), (F.col("id") % 11).alias("v"))
    found = numbered(df, ["g"], [F.col("x").desc()], {"before": F.col("v")}, parts=16)
    w = Window.partitionBy("g").orderBy(F.col("x").desc())
    plain = df.withColumn("n_", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    columns = ["g", "x", "v", "n_", "before"]
    assert found.select(columns).exceptAll(plain.select(columns)).isEmpty() and found.count() == 60_000
    largest = found.withColumn("part", F.spark_partition_id()).filter("g = 'hot'").groupBy("part").count().agg(F.max("count")).first()[0]
    assert largest < 20_000
    assert numbered(df.limit(0), ["g"], [F.col("x")]).count() == 0


def test_many_exclude_rules_equal_the_branch_form(spark):
    rng = random.Random(4)
    words = ["a", "b", "src", "docs", "x.md", "y.tmp.md", "draft"]
    paths = sorted({"/".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(400)})
    rules = ["**", "*", "src/*", "docs/**", "**/x.md", "a/*/b", "*.tmp.md", "src/**/y.tmp.md", "draft", " ", "x.md", "a/b/src", "do*/a", "src/x.m?"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")

    def branch(rule, path):
        rule = rule.strip()
        return bool(rule) and (re.search(T.path_glob_regex(rule), path) is not None if re.search(r"[/*]", rule) else rule in path.split("/"))

    for rule in rules:
        assert {r["path"] for r in C.exclude_filter(df, [rule]).collect()} == {p for p in paths if not branch(rule, p)}, rule
    many = [f"none/{i}/*" for i in range(50_000)] + [f"name{i}" for i in range(50_000)] + ["src/*", "draft"]
    table = spark.createDataFrame([(p,) for p in many], "pattern string")
    assert {r["path"] for r in C.exclude_filter(df, table).collect()} == {p for p in paths if not branch("src/*", p) and not branch("draft", p)}


def test_many_selectors_equal_the_branch_form(spark):
    rng = random.Random(6)
    draw = lambda: rng.choice(["nav", "div", "p", "section"])
    attrs = ["", ' class="ads wide"', ' class=sidebar-left id="x"', ' id="comments-2"', ' class="a b c"', " data-x='y'"]
    html = ["".join(f"<{t}{rng.choice(attrs)}>t{i}</{t}>" for i, t in enumerate(draw() for _ in range(12))) for _ in range(30)]
    tokens = web.explode_html_tokens(spark.createDataFrame(list(enumerate(html)), "page_id long, html string").withColumn("url", F.lit("u")))
    rules = ["nav", ".ads", "#x", '[class*="bar"]', '[id*="comment"]', '[class*="c"]', "SECTION", ".wi", ".c"]
    table = spark.createDataFrame([(r,) for r in [*rules, *(f".none{i}" for i in range(30_000)), *(f'[class*="none{i}"]' for i in range(30_000))]], "selector string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    (a, b), (c, d) = web.clean_noise(tokens, rules), web.clean_noise(tokens, table)
    assert rows(b) == rows(d.select(b.columns)) and rows(a) == rows(c.select(a.columns))


def test_recipes_as_a_table(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x/1"), (2, "https://b.a.org/y"), (3, "http://c.org/")], "page_id long, url string")
    recipes = [("r1", "https://a.org/x/*"), ("r2", "*.a.org"), ("r3", "/y"), ("r4", "c.org")]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(recipes)], "ord int, recipe_id string, pattern string")
    rows = lambda r: sorted((x["page_id"], x["recipe_id"]) for x in web.recipe_first_match(pages, r).collect())
    assert rows(recipes) == rows(table)


def test_only_referenced_assets_are_fetched(spark, tmp_path):
    rows = [(f"d/{i}.png", "image/png", 3 if i != 7 else 99, bytearray(f"{i:03}".encode())) for i in range(200)]
    spark.createDataFrame(rows, "path string, mime string, length long, content binary").write.parquet(str(tmp_path / "assets"))
    assets = spark.read.parquet(str(tmp_path / "assets"))
    refs = spark.createDataFrame([(i, "d/doc.md", f"{k}.png?x#y") for i, k in enumerate([1, 1, 5, 7, 900, 42])], "doc_id long, path string, ref string")
    found = {r["doc_id"]: (r["status"], r["data_uri"]) for r in C.asset_inline(refs, assets, max_bytes=50).collect()}
    assert found == {0: ("inlined", "data:image/png;base64,MDAx"), 1: ("inlined", "data:image/png;base64,MDAx"), 2: ("inlined", "data:image/png;base64,MDA1"), 3: ("too_large", "data:,"), 4: ("missing", "data:,"), 5: ("inlined", "data:image/png;base64,MDQy")}
    wanted = spark.createDataFrame([(f"d/{i}.png",) for i in range(0, 200, 3)], "path string")
    got = C.fetched(assets, wanted, ["path", "content"], block=10)
    assert sorted(r["path"] for r in got.collect()) == sorted(f"d/{i}.png" for i in range(0, 200, 3))
    # Contents reach no exchange before the paths have dropped what is not wanted.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and not re.search(r"Exchange hashpartitioning", plan.split("BroadcastExchange")[0])


def test_resolve_inputs(spark):
    frame = lambda *p: spark.createDataFrame(list(enumerate(p)), "pos long, path string")
    found = C.resolve_inputs(frame("./b/../a.md", "c.md"), frame("a.md", "d/./e.md", "c.md")).orderBy("pos").collect()
    assert [r["path"] for r in found] == ["a.md", "c.md", "d/e.md"]
    with pytest.raises(ValueError, match="no input"):
        C.resolve_inputs(frame("x").limit(0), frame("x").limit(0))


def test_url_classes(spark):
    df = spark.createDataFrame([(3, "https://x.org/a/"), (1, "HTTPS://x.org/a#b"), (2, "https://x.org/b"), (9, None)], "page_id long, url string")
    assert {(r["page_id"], r["representative"]) for r in web.url_classes(df.filter("url is not null")).collect()} == {(3, 1), (1, 1), (2, 2)}


@pytest.mark.parametrize(
    "html, markdown",
    [
        ("<p>icon \ue000\ue001 font</p>", "icon \ue000\ue001 font"),
        ("<pre>a  b\n\tc \ufdd5</pre>", "```\na  b\n\tc \ufffd\n```"),
        ('<p title="a > b">text</p>', "text"),
        ("<p><a href=q.html class=x>t</a> <a title='href=\"no\"' href='y z'>u</a></p>", "[t](q.html) [u](y z)"),
        ("<p>&eacute;&#233;&#xE9;&#x1F600; &amp;lt; &nosuch; &#0; &#xD800; & 5 &lt; 6</p>", "ééé\U0001f600 &lt; &nosuch; � � & 5 < 6"),
        ('<p class="x>broken</p>', "broken"),
    ],
)
def test_html_to_markdown(spark, html, markdown):
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert web.html_to_markdown(web.explode_html_tokens(pages)).first()["markdown"] == markdown


def test_pages_of_many_files(spark, tmp_path):
    """More files than shuffle partitions: a join that turns out small reads its shuffle by files, and a union must not pair such partitions with those by page."""
    pages = spark.range(160).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<nav>n</nav><article><p>text "), "id", F.lit("</p><nav>x</nav></article>")).alias("html"))
    pages.repartition(32).write.parquet(str(tmp_path / "pages"))
    # Joins are planned as for large tables and found to be small when they run.
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.files.openCostInBytes": "128m"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        tokens = web.tokens_by_page(web.scan_pages(spark.read.parquet(str(tmp_path / "pages"))))
        clean, removed = web.clean_noise(tokens)
        md = web.html_to_markdown(web.content_tokens(clean))
        assert {r["page_id"]: r["markdown"] for r in md.collect()} == {i: f"text {i}" for i in range(160)}
        assert removed.agg(F.sum("removed")).first()[0] == 320
    finally:
        for key in sizes:
            spark.conf.unset(key)


def test_python_holds_a_piece_of_a_batch(spark):
    """A batch of any number of documents becomes Python objects piece by piece, with the results of one pass; hooks hand on piece by piece."""
    import pyarrow as pa

    from docloom.functions import blocks, yaml_block
    from docloom.operators import hooks as H

    n = 3 * blocks.PIECE + 5
    lines = [None if i % 50 == 7 else [f"> [!NOTE] t{i}", "> x", "```", "[^1]: no", "```"] for i in range(n)]
    sizes = []

    def made(own):
        sizes.append(len(own))
        return pa.array([blocks.marks(x or []) for x in own], blocks._KIND)

    found = blocks.in_pieces(pa.array(lines, pa.list_(pa.string())), made)
    assert found.to_pylist() == [blocks.marks(x or []) for x in lines] and max(sizes) == blocks.PIECE
    assert blocks.line_marks.func(pa.array(lines, pa.list_(pa.string()))).equals(found) and len(blocks.line_marks.func(pa.array([], pa.list_(pa.string())))) == 0
    pairs = yaml_block.mapping_of.func(pa.array([None if i % 3 == 0 else [f"k: {i}"] if i % 3 == 1 else ["a: b: c"] for i in range(n)], pa.list_(pa.string())))
    assert pairs.to_pylist() == [[("k", str(i))] if i % 3 == 1 else None for i in range(n)]
    pages = spark.range(2 * H.PIECE + 1).select(F.col("id").alias("page_id"), F.col("id").cast("string").alias("html")).coalesce(1)
    out = H.hook_pipeline(pages, H.Recipe("r", lambda html, p: (html, 1), lambda html, p: {"title": html, "html": html}))
    assert {(r["page_id"], r["html"], r["removed"]) for r in out.collect()} == {(i, str(i), 1) for i in range(2 * H.PIECE + 1)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_cleaning_pairs_no_partitions(spark, tmp_path):
    """As above where unions keep their inputs' partitioning, Spark's default: cleaning has none, nor a second shuffle of the tokens."""
    pages = spark.range(160).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<title>t</title><article><h1>h</h1><p>text "), "id", F.lit("</p><nav>x</nav></article>")).alias("html"))
    pages.repartition(32).write.parquet(str(tmp_path / "pages"))
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.files.openCostInBytes": "128m", "spark.sql.unionOutputPartitioning": "true"}
    before = {key: spark.conf.get(key, None) for key in sizes}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        tokens = web.tokens_by_page(web.scan_pages(spark.read.parquet(str(tmp_path / "pages"))))
        assert {r["page_id"]: r["html"] for r in web.extract_content(tokens, "article", ("h1", "nav")).collect()} == {i: f"<p>text {i}</p>" for i in range(160)}
        md = web.html_to_markdown(web.content_tokens(web.clean_noise(tokens)[0])).join(web.page_titles(tokens), "page_id")
        assert {(r["page_id"], r["title"], r["markdown"]) for r in md.collect()} == {(i, "t", f"# h\n\ntext {i}") for i in range(160)}
        plan = web.clean_noise(tokens)[0]._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in plan and "Join" not in plan and plan.count("Exchange") == 1
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


ARTICLES = ["<article>a<article>b</article>c</article><article>d</article>", "<p>x</p>", "<article>open <b>end</b>", "<article></article>z", "</article><article>y</article>"]


def test_content_meets_nothing(spark):
    """The first element, its end and a list's extents are found in the tokens' own rows: no join of tokens, one shuffle."""
    pages = spark.createDataFrame([*((i, f"https://x.org/{i}", x) for i, x in enumerate(ARTICLES)), (None, "https://x.org/n", ARTICLES[0])], "page_id long, url string, html string")
    tokens = web.tokens_by_page(web.scan_pages(pages))
    text = lambda d: {r["page_id"]: r["t"] for r in d.groupBy("page_id").agg(web.joined_in_order("text", "tok_no").alias("t")).collect()}
    content = web.content_tokens(tokens)
    assert text(content) == {0: "a<article>b</article>c", 2: "open <b>end", 4: "y"}
    extents = web.element_extents(tokens, ["article", "b"])
    assert {(r["page_id"], r["start_tok"]): r["end_tok"] for r in extents.filter("selector = 'article'").collect()} == {(0, 0): 6, (0, 2): 4, (0, 7): 9, (2, 0): 4, (3, 0): 1, (4, 1): 3}
    for d in (content, extents, web.content_tokens(web.clean_noise(tokens)[0])):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1


def test_captures_pair_no_partitions(spark, tmp_path):
    """Both captures of a page come without a union; a page without content has the first alone."""
    from docloom.plans import web_queries as W

    spark.createDataFrame([(i, f"https://x.org/{i}", x) for i, x in enumerate(ARTICLES)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = W.captures(spark, str(tmp_path))
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["captured_seq"], r["markdown"]) for r in found.collect()} == {(0, "a\n\nb\n\nc\n\nd"), (1, "x"), (2, "open **end**"), (3, "z"), (4, "y"), *((1_000_000_000 + i, m) for i, m in ((0, "a\n\nb\n\nc"), (2, "open **end"), (4, "y")))}


def test_content_and_markdown_share_one_order(spark):
    """Content is what lies in the first extent, for tags and classes, on random pages; and all windows from clean tokens to Markdown need one more order, that of lists."""
    rng = random.Random(11)
    draw = lambda: rng.choice(["<article>", "</article>", "<article class='a b'>", "<p class=a>", "</p>", "<div>", "</div>", "<article/>", "<br>", "x", "<table>", "<tr>", "</tr>", "<td>", "</td>", "<ol>", "</ol>", "<ul>", "</ul>", "<li>"])
    pages = [(i if i % 40 else None, "u", "".join(draw() for _ in range(rng.randint(1, 40)))) for i in range(200)]
    tokens = web.tokens_by_page(spark.createDataFrame(pages, "page_id long, url string, html string")).localCheckpoint()
    for selector in ("article", ".a"):
        first = {}
        for r in web.element_extents(tokens, [selector]).collect():
            first[r["page_id"]] = min(first.get(r["page_id"], (1e9, 0)), (r["start_tok"], r["end_tok"]))
        inside = {(r["page_id"], r["tok_no"]) for r in tokens.collect() if r["page_id"] in first and first[r["page_id"]][0] < r["tok_no"] < first[r["page_id"]][1]}
        assert {(r["page_id"], r["tok_no"]) for r in web.content_tokens(tokens, selector).collect()} == inside and len(inside) > 100

    def markdown(rows):
        """Tables and numbered lists alone, as they are counted one token after the other."""
        out, rows_ended, cells, depth, lists = "", 0, 0, 0, {}
        for r in rows:
            kind, tag = r["kind"], r["tag"]
            if kind == "open" and tag == "table":
                rows_ended = cells = 0
            cells += kind == "open" and tag == "td"
            rows_ended += kind == "close" and tag == "tr"
            depth += (kind == "open" and tag in ("ul", "ol")) - (kind == "close" and tag in ("ul", "ol"))
            if kind == "open" and tag in ("ul", "ol"):
                lists[depth] = [tag, 0]
            if kind == "open" and tag == "li":
                at = lists.setdefault(depth, [None, 0])
                at[1] += 1
                out += f"\n{at[1]}. " if at[0] == "ol" else "\n- "
            elif kind == "close" and tag == "tr":
                out += "|\n" + ("| --- " * cells + "|\n" if rows_ended == 1 else "")
        return out

    by_page = {}
    for r in sorted(tokens.filter("page_id is not null").collect(), key=lambda r: (r["page_id"], r["tok_no"])):
        by_page.setdefault(r["page_id"], []).append(r)
    only = web.fragments(tokens).join(tokens.filter("page_id is not null and (tag = 'li' and kind = 'open' or tag = 'tr' and kind = 'close')").select("page_id", "tok_no"), ["page_id", "tok_no"])
    assert {r["page_id"]: r["t"] for r in only.groupBy("page_id").agg(web.joined_in_order("frag", "tok_no").alias("t")).collect()} == {k: m for k, v in by_page.items() if (m := markdown(v))}
    sorts = lambda d: len(re.findall(r"\bSort \[", d._jdf.queryExecution().executedPlan().toString()))
    clean = web.clean_noise(web.tokens_by_page(spark.createDataFrame(pages, "page_id long, url string, html string")))[0]
    assert sorts(web.content_tokens(clean)) == sorts(clean) == 3 and sorts(web.fragments(web.content_tokens(clean))) == 4


def test_files_are_named_in_the_pages_own_rows(spark):
    """A page keeps its columns beside its file's name, so naming needs no join with itself; repeated keys stay a row each."""
    df = spark.createDataFrame([(1, 1, "u/x", "T", "a"), (1, 2, "u/x", "T", "b"), (1, 2, "u/y/", "", "c"), (2, 9, "u", None, None)], "run_id long, seq long, url string, title string, markdown string")
    found = C.unique_filename(df, "markdown", "title")
    assert found.columns == ["run_id", "seq", "file_name", "markdown", "title"] and found.count() == 4
    assert {(r["markdown"], r["file_name"]) for r in found.filter("markdown in ('a', 'c') or run_id = 2").collect() if r["markdown"] != "c"} == {("a", "001-t.md"), (None, "001-u.md")}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_small_files_share_tasks(spark, tmp_path):
    """Tasks follow the cores and the bytes, not the number of small files; every file is read, and one over the limit is not."""
    from docloom.sources import files

    for i in range(200):
        (tmp_path / f"{i}.md").write_text(f"t{i}")
    (tmp_path / "large.md").write_text("x" * 99)
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in before:
        spark.conf.set(key, "4m")
    try:
        found, text = files.scan_assets(spark, str(tmp_path), max_bytes=50), files.scan_markdown(spark, [str(tmp_path)])
        cores = spark.sparkContext.defaultParallelism
        assert found.rdd.getNumPartitions() <= 2 * cores and text.rdd.getNumPartitions() <= 2 * cores < 200
        # The limit reaches the scan through the coalescing, so large files stay unread.
        assert "LessThanOrEqual(length,50)" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(bytes(r["content"]).decode() for r in found.collect()) == sorted(f"t{i}" for i in range(200)) and text.count() == 201
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_written_pages_are_listed_in_few_tasks(spark):
    """What the sink wrote is read back by tasks that follow the cores, not the number of files."""
    from docloom.plans import registry

    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in before:
        spark.conf.set(key, "4m")
    try:
        found = registry.queries()["sink_page_files"](spark, "/root/testdata/sf0.01")
        assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < 250 == found.count()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
