"""Operators across documents: paths, links, assets, navigation, crawl runs, incremental state."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import markdown as M
from docloom.operators.running import numbered
from docloom.operators.web import joined_in_order
from docloom.session import written, written_alone


def resolve_inputs(explicit: DataFrame, scanned: DataFrame) -> DataFrame:
    """(pos, path) of two inputs (pos, path): explicit files first, each path once at its first place, without . and .. components; pos orders the result. No input at all is an error."""
    both = explicit.select(F.lit(0).alias("origin"), "pos", "path").union(scanned.select(F.lit(1).alias("origin"), "pos", "path"))
    if both.isEmpty():
        raise ValueError("no input files")
    first = both.groupBy(normal_path(F.col("path")).alias("path")).agg(F.min(F.struct("origin", "pos")).alias("p"))
    return first.select((F.col("p.origin") * F.lit(1 << 40) + F.col("p.pos")).alias("pos"), "path")


def combine_markdown(run_pages: DataFrame) -> DataFrame:
    """(run_id, markdown): the pages of a run (run_id, seq, markdown) in order, between rules."""
    return run_pages.groupBy("run_id").agg(joined_in_order("markdown", "seq", "\n\n---\n\n").alias("markdown"))


def session_sink(snapshots: DataFrame, out: str | None = None) -> DataFrame:
    """(session_key, page_url, title, markdown, meta_json): the latest snapshot (url, title, markdown, captured_seq) of each session; written below out, a folder a session, if named."""
    d = snapshots.select(T.session_key(F.col("url")).alias("session_key"), F.col("url").alias("page_url"), "title", "markdown", "captured_seq")
    last = d.groupBy("session_key").agg(F.max_by(F.struct("page_url", "title", "markdown"), "captured_seq").alias("p"))
    found = last.select("session_key", "p.*", F.to_json(F.struct("p.page_url", "p.title")).alias("meta_json"))
    if out:
        found.write.partitionBy("session_key").json(out)
    return found


def archive_manifest(results: DataFrame) -> DataFrame:
    """(archive, entry_no, name, crc32, size, offset) of entries (archive, entry_no, title, content): offsets advance by 30, the name and the content."""
    number = F.col("entry_no").cast("string")
    name = F.concat(F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number), F.lit("_"), T.sanitize_name(F.col("title")), F.lit(".md"))
    d = results.select("archive", "entry_no", name.alias("name"), F.crc32(F.col("content").cast("binary")).alias("crc32"), F.octet_length("content").cast("long").alias("size"))
    return numbered(d, ["archive"], [F.col("entry_no")], {"offset": 30 + F.octet_length("name") + F.col("size")}).drop("n_")


def section_order(sections: DataFrame) -> DataFrame:
    """(corpus, pos, section_id, panel_title, depth) of sections (corpus, pos, label, title, level)."""
    full = lambda c: F.when(T.trim_all(F.col(c)) != "", F.col(c))
    d = numbered(sections.select("corpus", "pos", "label", "title", "level"), ["corpus"], [F.col("pos")]).withColumnRenamed("n_", "n")
    return d.select("corpus", "pos", F.concat(F.lit("doc-"), "n").alias("section_id"), F.coalesce(full("label"), full("title"), F.concat(F.lit("Document "), "n")).alias("panel_title"), F.least(F.col("level") - 1, F.lit(5)).alias("depth"))


def assemble_document(sections: DataFrame) -> DataFrame:
    """(corpus, title, section_count, body) of sections (corpus, pos, title, body): one document for each corpus, sections doc-1, doc-2, ... in order."""
    n = F.row_number().over(Window.partitionBy("corpus").orderBy("pos"))
    part = F.concat(F.lit('<section id="doc-'), n, F.lit('">\n'), F.col("body"), F.lit("\n</section>"))
    d = sections.withColumn("part", part)
    title = F.min_by(F.when(F.col("title") != "", F.col("title")), F.when(F.col("title") != "", F.col("pos")))
    return d.groupBy("corpus").agg(F.coalesce(title, F.lit("Document")).alias("title"), F.count(F.lit(1)).alias("section_count"), joined_in_order("part", "pos", "\n").alias("body"))


def document_title(sections: DataFrame, title: str | None = None, stem: str | None = None) -> DataFrame:
    """(corpus, title): the given title, else the first section title, the output's stem, the first input's stem, or Document."""
    first = F.min_by(F.when(T.trim_all(F.col("title")) != "", F.col("title")), F.when(T.trim_all(F.col("title")) != "", F.col("pos")))
    input_stem = F.nullif(F.min_by(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1), "pos"), F.lit(""))
    found = F.coalesce(F.lit(title).cast("string"), first, F.lit(stem).cast("string"), input_stem, F.lit("Document"))
    return sections.groupBy("corpus").agg(found.alias("title"))


def exclude_filter(paths: DataFrame, patterns: list[str] | DataFrame, root: str = "") -> DataFrame:
    """Paths that no pattern matches: with / or * a glob on the path below the root, else the name of any component; blank ones say nothing.

    patterns is a list or a table (pattern) of any number of them. Names and globs without wildcard meet a path's components and leading folders by
    equality; other globs meet it by the folder before their first wildcard, and only those that share it are compared.
    """
    spark = paths.sparkSession
    table = patterns if isinstance(patterns, DataFrame) else spark.createDataFrame([(p,) for p in patterns], "pattern string")
    rules = table.select(F.trim("pattern").alias("pattern")).filter("pattern <> ''").distinct()
    rel = F.coalesce(T.relative_path(F.col("path"), F.lit(root)), F.col("path")) if root else F.col("path")
    each = paths.select("path").distinct().withColumn("rel", rel)
    names = rules.filter(~F.col("pattern").rlike("[/*]")).select(F.col("pattern").alias("key"))
    by_name = each.select("path", F.explode(F.split("rel", "/")).alias("key")).join(names, "key", "left_semi").select("path")
    globs = rules.filter(F.col("pattern").rlike("[/*]")).withColumn("before", F.regexp_extract("pattern", r"^([^*]*)", 1))
    globs = globs.select("pattern", F.regexp_extract("before", "^((?:[^/]*/)*)", 1).alias("key"), T.path_glob_pattern(F.col("pattern")).alias("rx"))
    folders = F.concat(F.array(F.lit("")), F.transform(path_prefixes(F.col("rel")), lambda x: F.concat(x, F.lit("/"))))
    by_glob = each.select("path", "rel", F.explode(F.array_distinct(folders)).alias("key")).join(globs, "key").filter(F.regexp_like("rel", F.col("rx"))).select("path")
    return paths.join(by_name.union(by_glob).distinct(), "path", "left_anti")


def content_change_filter(fs_events: DataFrame) -> DataFrame:
    """Events that change content: writes closed, creation, removal and modification, not reads or metadata."""
    return fs_events.filter(F.col("kind").isin("close_write", "create", "remove", "modify"))


def ref_class(ref: Column) -> Column:
    """remote, special (embedded, fragment, mail, script, blank) or local."""
    return F.when(ref.rlike("(?i)^https?://"), "remote").when((T.trim_all(ref) == "") | ref.rlike("(?i)^(data:|#|mailto:|tel:|javascript:|about:)"), "special").otherwise("local")


def classify_reference(refs: DataFrame) -> DataFrame:
    """refs (ref, ...) with ref_class."""
    return refs.withColumn("ref_class", ref_class(F.col("ref")))


def path_prefixes(path: Column) -> Column:
    """All proper and improper prefixes of a path, by whole components."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def nearest_scan_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): each file's deepest root, by an equi-join on its prefixes; its own folder where none is above it."""
    above = files.select("path", F.explode(path_prefixes(F.col("path"))).alias("root")).join(roots.select("root").distinct(), "root")
    deepest = above.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.select("path").distinct().join(deepest, "path", "left").select("path", F.coalesce("root", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).alias("root"))


def normal_path(path: Column) -> Column:
    """A relative path with . and .. resolved."""

    def step(done, x):
        return F.when((x == ".") | (x == ""), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def link_resolution(links: DataFrame, docs: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, line_no, target_path, anchor, status) of relative links (doc_id, line_no, dest): ok, missing_doc or missing_anchor."""
    local = links.filter(~F.col("dest").rlike("^(#|/)") & ~F.col("dest").rlike("(?i)^[a-z][a-z0-9+.-]*:"))
    base = docs.select("doc_id", F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("base"))
    page = F.regexp_replace(F.regexp_replace("dest", "#.*$", ""), r"\?.*$", "")
    anchor = F.try_url_decode(F.regexp_extract("dest", "#(.*)$", 1))
    d = local.join(base, "doc_id").select("doc_id", "line_no", normal_path(F.try_url_decode(F.concat("base", page))).alias("target_path"), anchor.alias("anchor"))
    targets = docs.select(F.col("path").alias("target_path"), F.col("doc_id").alias("target_id"))
    d = d.join(targets, "target_path", "left")
    found = headings.select(F.col("doc_id").alias("target_id"), F.col("id").alias("anchor"), F.lit(True).alias("has_anchor")).distinct()
    d = d.join(found, ["target_id", "anchor"], "left")
    status = F.when(F.col("target_id").isNull(), "missing_doc").when((F.col("anchor") != "") & F.col("has_anchor").isNull(), "missing_anchor").otherwise("ok")
    return d.select("doc_id", "line_no", "target_path", "anchor", status.alias("status"))


def footnote_integrity(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """(doc_id, label, status): ok, undefined or orphan, by a full join on document and label."""
    a = refs.select("doc_id", "label").distinct().withColumn("used", F.lit(True))
    b = defs.select("doc_id", "label").distinct().withColumn("defined", F.lit(True))
    return a.join(b, ["doc_id", "label"], "full").select("doc_id", "label", F.when(F.col("defined").isNull(), "undefined").when(F.col("used").isNull(), "orphan").otherwise("ok").alias("status"))


#: Paths of assets that are broadcast at once to fetch their contents.
FETCH_PATHS = 500_000


def fetched(assets: DataFrame, wanted: DataFrame, columns: list[str], block: int = FETCH_PATHS) -> DataFrame:
    """The named columns of the assets (path, ...) whose path is in wanted (path), without sending the contents of any other.

    Their paths are broadcast, in as many blocks of about `block` as they need, so that each scan drops what nobody refers to where it reads it.
    """
    keys = written(wanted.select("path").distinct(), "asset-paths")
    blocks = max(1, -(-keys.count() // block))
    lot = F.pmod(F.xxhash64("path"), F.lit(blocks))
    parts = [assets.select(*columns).join(F.broadcast(keys.filter(lot == k)), "path", "left_semi") for k in range(blocks)]
    return reduce(DataFrame.union, parts)


def asset_inline(refs: DataFrame, assets: DataFrame, max_bytes: int = 25 << 20) -> DataFrame:
    """refs (doc_id, path, ref) with resolved_path, data_uri and status (inlined, too_large, missing); the URI is a placeholder unless inlined.

    Two phases: references first meet the assets' paths, types and lengths; then the contents of those to be inlined are fetched, each encoded once.
    """
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    d = refs.withColumn("resolved_path", normal_path(F.concat(folder, F.regexp_replace("ref", "[?#].*$", ""))))
    d = d.join(assets.select(F.col("path").alias("resolved_path"), "mime", "length"), "resolved_path", "left")
    status = F.when(F.col("mime").isNull(), "missing").when(F.col("length") > max_bytes, "too_large").otherwise("inlined")
    d = d.withColumn("status", status)
    hits = fetched(assets, d.filter("status = 'inlined'").select(F.col("resolved_path").alias("path")), ["path", "content"])
    uris = hits.select(F.col("path").alias("resolved_path"), F.base64("content").alias("encoded"))
    uri = F.when(F.col("status") == "inlined", F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.coalesce("encoded", F.lit("")))).otherwise("data:,")
    return d.join(uris, "resolved_path", "left").select(*refs.columns, "resolved_path", uri.alias("data_uri"), "status")


def snapshot_diff(current: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, mtime): reuse if path and time are equal, else stale, new or removed."""
    a, b = current.select("path", F.col("mtime").alias("now"), F.lit(True).alias("here")), cache.select("path", F.col("mtime").alias("then"), F.lit(True).alias("known"))
    status = F.when(F.col("here").isNull(), "removed").when(F.col("known").isNull(), "new").when(F.col("now").eqNullSafe(F.col("then")), "reuse").otherwise("stale")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def invalidate_changed(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, invalid): cache rows at or below a changed path; no changed path invalidates all."""
    none = changed.select(F.count(F.lit(1)) == 0).scalar()
    above = cache.select("path", F.explode(path_prefixes(F.col("path"))).alias("up"))
    hit = above.join(changed.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("path").distinct().withColumn("hit", F.lit(True))
    return cache.select("path").join(hit, "path", "left").select("path", (F.coalesce("hit", F.lit(False)) | none).alias("invalid"))


def active_heading(probes: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, pos, heading_id): the last heading at or before each probe, else the document's first."""
    marks = headings.select("doc_id", F.col("line_no").alias("pos"), F.lit(0).alias("kind"), F.col("id").alias("heading_id"))
    both = marks.union(probes.select("doc_id", "pos", F.lit(1), F.lit(None).cast("string")))
    order = Window.partitionBy("doc_id").orderBy("pos", "kind")
    before = F.last("heading_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("heading_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("found", F.coalesce(before, first)).filter("kind = 1").select("doc_id", "pos", F.col("found").alias("heading_id"))


def common_path_prefix(paths: DataFrame, group: str | None = None) -> DataFrame:
    """(prefix), by group if named: the leading components that all paths share; null if there are none.

    All paths share what the smallest and the largest share, so two aggregates do.
    """
    parts = F.split("path", "/")
    ends = paths.groupBy(*([group] if group else [])).agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    same = F.transform("a", lambda x, i: x.eqNullSafe(F.get("b", i)))
    n = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size("a"))
    prefix = F.nullif(F.array_join(F.slice("a", F.lit(1), n.cast("int")), "/"), F.lit(""))
    return ends.select(*([group] if group else []), prefix.alias("prefix"))


def nav_tree(files: DataFrame) -> DataFrame:
    """(node_id, parent_id, kind, label, depth, pos) of files (path, label): folders from paths, folders before files, by name without case."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    ups = files.select(F.explode(F.filter(path_prefixes(folder), lambda x: x != "")).alias("node_id")).distinct()
    parent = F.regexp_extract("node_id", "^(.*)/[^/]*$", 1)
    folders = ups.select("node_id", parent.alias("parent_id"), F.lit("folder").alias("kind"), F.regexp_extract("node_id", "([^/]*)$", 1).alias("label"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    leaves = files.select(F.col("path").alias("node_id"), folder.alias("parent_id"), F.lit("file").alias("kind"), F.when(T.trim_all(F.col("label")) != "", F.col("label")).otherwise(name).alias("label"))
    both = folders.union(leaves).withColumn("depth", F.size(F.split("node_id", "/")) - 1)
    # A folder may hold any number of files.
    found = numbered(both, ["parent_id"], [F.col("kind").desc(), F.lower("label"), F.col("node_id")])
    return found.select(*both.columns, F.col("n_").cast("int").alias("pos"))


def dependency_set(docs: DataFrame) -> DataFrame:
    """(doc_id, ref): the distinct local references of a document, from Markdown links outside code, HTML attributes and CSS."""
    links = M.md_links(docs).select("doc_id", F.col("dest").alias("ref"))
    others = F.concat(*(F.regexp_extract_all("text", F.lit(rx), F.lit(1)) for rx in (T.REF_ATTRIBUTE, T.CSS_URL)))
    refs = links.union(docs.select("doc_id", F.explode(F.array_distinct(others)).alias("ref"))).distinct()
    return refs.filter(ref_class(F.col("ref")) == "local")


def referenced_labels(refs: DataFrame) -> DataFrame:
    """(doc_id, n_labels, n_uses) of footnote references."""
    return refs.groupBy("doc_id").agg(F.count_distinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n_uses"))


def corpus_footnotes(defs: DataFrame, corpus: str = "corpus") -> DataFrame:
    """(corpus, rank, doc_id, label, plain): the first definition of each label of a document, sorted within the corpus."""
    first = defs.groupBy(corpus, "doc_id", "label").agg(F.min(F.struct((F.col("body") == "").alias("empty"), "line_no", "body")).alias("b"))
    plain = first.select(corpus, "doc_id", "label", T.footnote_plain_title(F.col("b.body")).alias("plain"))
    return M.footnote_sort(plain, (corpus,))


def path_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or kept, by set operations."""
    a, b = old.select("path"), new.select("path")
    tagged = lambda d, name: d.withColumn("change", F.lit(name))
    return tagged(b.subtract(a), "added").union(tagged(a.subtract(b), "removed")).union(tagged(a.intersect(b), "kept"))


def _marked(log: DataFrame, failures: int = 3) -> DataFrame:
    """crawl log (run_id, seq, url, status) with revisit, streak, pages."""
    run, page = Window.partitionBy("run_id").orderBy("seq"), Window.partitionBy("run_id", "url").orderBy("seq")
    ok = (F.col("status") == "ok").cast("int")
    d = log.withColumn("revisit", F.coalesce(F.max(ok).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    d = d.withColumn("pages", F.sum(ok).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy("run_id", "pages").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("streak", F.when(F.col("status") != "ok", F.sum(1 - ok).over(since)).otherwise(0))


def crawl_loop_cut(log: DataFrame) -> DataFrame:
    """(run_id, seq, url) of the rows before the first visit to a URL that the run had extracted before."""
    d = _marked(log)
    cut = F.min(F.when(F.col("revisit"), F.col("seq"))).over(Window.partitionBy("run_id"))
    return d.withColumn("cut", cut).filter("cut is null or seq < cut").select("run_id", "seq", "url")


def failure_streak_stop(log: DataFrame, n: int = 3) -> DataFrame:
    """(run_id, stop_seq) of the runs in which n extractions in a row fail."""
    return _marked(log).filter(F.col("streak") == n).groupBy("run_id").agg(F.min("seq").alias("stop_seq"))


def stop_rules(log: DataFrame, max_pages: int | None = None, stop: Column | None = None, n: int = 3, navigates: bool = True) -> DataFrame:
    """(run_id, stop_seq, reason): the first visit that ends a run: loop, failures, max_pages, stop, or no_more_pages at the end of the log.

    A run that does not navigate ends at its first visit: extract_failed or extract_null if that failed, single_page after an extracted one.
    """
    ok = F.col("status") == "ok"
    reason = F.when(F.col("revisit"), "loop").when(F.col("streak") >= n, "failures")
    if not navigates:
        reason = reason.when(F.col("status") == "null", "extract_null").when(~ok, "extract_failed")
    if max_pages is not None:
        reason = reason.when(ok & (F.col("pages") >= max_pages), "max_pages")
    if not navigates:
        reason = reason.when(ok, "single_page")
    if stop is not None:
        reason = reason.when(ok & stop, "stop")
    d = _marked(log).withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason")))
    last = F.struct(F.max("seq").alias("seq"), F.lit("no_more_pages").alias("reason"))
    return d.groupBy("run_id").agg(F.coalesce(first, last).alias("s")).select("run_id", F.col("s.seq").alias("stop_seq"), "s.reason")


def run_report(log: DataFrame, stops: DataFrame) -> DataFrame:
    """(run_id, pages, chars, stop_reason): pages extracted up to a run's stop; a loop's own visit is not extracted."""
    d = log.join(stops, "run_id").filter((F.col("status") == "ok") & ((F.col("seq") < F.col("stop_seq")) | ((F.col("seq") == F.col("stop_seq")) & (F.col("reason") != "loop"))))
    sums = d.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("title")).alias("chars"))
    return stops.join(sums, "run_id", "left").select("run_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chars", F.lit(0)).alias("chars"), F.col("reason").alias("stop_reason"))


def unique_filename(run_pages: DataFrame, *keep: str) -> DataFrame:
    """(run_id, seq, file_name): NNN-slug of the title (80 characters), else of the URL's last segment, else page; repeats get -2, -3, ... Columns to keep follow."""
    slug, last = T.slugify(F.coalesce("title", F.lit(""))), T.slugify(F.regexp_extract(F.regexp_replace("url", "/+$", ""), "([^/]*)$", 1))
    base = F.when(slug != "", slug).when(last != "", last).otherwise("page")
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("seq")).cast("string")
    d = run_pages.withColumn("n", n).withColumn("base", F.when(F.length(base) > 80, F.regexp_replace(F.left(base, F.lit(80)), "-+$", "")).otherwise(base))
    d = d.withColumn("stem", F.concat(F.when(F.length("n") < 3, F.lpad("n", 3, "0")).otherwise(F.col("n")), F.lit("-"), "base"))
    k = F.row_number().over(Window.partitionBy("run_id", "stem").orderBy("seq"))
    return d.withColumn("k", k).select("run_id", "seq", F.concat("stem", F.when(F.col("k") > 1, F.concat(F.lit("-"), "k")).otherwise(""), F.lit(".md")).alias("file_name"), *keep)


def max_pages_limit(run_pages: DataFrame, n: int) -> DataFrame:
    """The first n pages of each run."""
    return run_pages.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).filter(F.col("_n") <= n).drop("_n")


def version_publish(renders: DataFrame) -> DataFrame:
    """(path, seq, version, changed) of renders (path, seq, content): every render is a version, changed if its content differs from the one before."""
    order = Window.partitionBy("path").orderBy("seq")
    return renders.select("path", "seq", F.row_number().over(order).alias("version"), (~F.lag("content").over(order).eqNullSafe(F.col("content"))).alias("changed"))


def stop_predicate(log: DataFrame, predicate) -> DataFrame:
    """(run_id, stop_seq): the first extracted visit at which a predicate holds. predicate is a Column over url, page_index, collected_urls and
    collected_titles, or a Python callable (url, page_index, urls, titles) -> bool, which runs visit by visit, its lists growing, until it holds.

    A list is collected only if the Column names it; a growing list is in each visit's row, so the callable is the form for very long runs.
    """
    ok = log.filter("status = 'ok'")
    if isinstance(predicate, Column):
        upto = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        d = ok.withColumn("page_index", F.count(F.lit(1)).over(upto))
        for name, column in (("collected_urls", "url"), ("collected_titles", "title")):
            if name in str(predicate):
                d = d.withColumn(name, F.collect_list(column).over(upto))
        return d.filter(predicate).groupBy("run_id").agg(F.min("seq").alias("stop_seq"))

    schema = f"run_id {dict(log.dtypes)['run_id']}, stop_seq long"

    def fold(frames):
        run, urls, titles, done = None, [], [], False
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                if r.run_id != run:
                    run, urls, titles, done = r.run_id, [], [], False
                if not done:
                    urls.append(r.url)
                    titles.append(r.title)
                    done = bool(predicate(r.url, len(urls), urls, titles))
                    if done:
                        rows.append((run, r.seq))
            yield pd.DataFrame(rows, columns=["run_id", "stop_seq"])

    return ok.select("run_id", "seq", "url", "title").repartition("run_id").sortWithinPartitions("run_id", "seq").mapInPandas(fold, schema)


TRANSPARENT_ROLES = ["none", "presentation", "generic"]


def _jumps(edges: DataFrame) -> list[DataFrame]:
    """Tables (page_id, node_id, up, far) of ancestors 1, 2, 4, ... edges (page_id, node_id, up) away, until none is so far: the number of tables is the log of the depth."""
    at = written(edges.select("page_id", "node_id", "up", F.lit(1).cast("long").alias("far")), "jumps")
    out = []
    while not at.isEmpty():
        out.append(at)
        again = at.select("page_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        at = written(at.join(again, ["page_id", "up"]).select("page_id", "node_id", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far")), "jumps")
    return out


def hierarchy_rejects(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id) of the nodes of trees (page_id, node_id, parent_id) that are on a cycle of parents or below one; a node that is its own parent is a root.

    Ancestors are doubled: after k rounds only nodes with an ancestor 2^k away are left, and a page of n nodes has none beyond n without a cycle.
    """
    edges = nodes.filter("parent_id is not null and parent_id <> node_id").select("page_id", "node_id", F.col("parent_id").alias("up"))
    most = nodes.groupBy("page_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    at = written(edges, "ancestors")
    for _ in range(int(most).bit_length()):
        if at.isEmpty():
            break
        at = written(at.join(at.select("page_id", F.col("node_id").alias("up"), F.col("up").alias("next")), ["page_id", "up"]).select("page_id", "node_id", F.col("next").alias("up")), "ancestors")
    return at.select("page_id", "node_id")


def hierarchy_collapse(nodes: DataFrame, transparent: tuple[str, ...] = tuple(TRANSPARENT_ROLES)) -> DataFrame:
    """(page_id, node_id, kept_parent, depth, name) of trees (page_id, node_id, parent_id, role, name, ignored): ignored and transparent nodes hand
    their children up, text leaves go, nodes without name and kept child go, names are cut at 100 characters.

    Ancestors are found by pointer doubling: a tree of depth d takes log d joins, and no page is gathered in one row. What is below a text
    leaf goes with it. A node that is its own parent, or whose parent is no node, is a root; nodes on or below a cycle go (hierarchy_rejects has them). The
    result is written in the shared folder, and what it is made from is deleted.
    """
    return written_alone(nodes.sparkSession, "hierarchy", lambda: _collapsed(nodes, transparent))


def _collapsed(nodes: DataFrame, transparent: tuple[str, ...]) -> DataFrame:
    nodes = nodes.withColumn("parent_id", F.when(F.col("parent_id") != F.col("node_id"), F.col("parent_id"))).join(hierarchy_rejects(nodes), ["page_id", "node_id"], "left_anti")
    d = written(
        nodes.select(
            "page_id", "node_id", F.col("parent_id").alias("up"), F.coalesce("name", F.lit("")).alias("name"), (F.col("role") == "text").alias("is_text"), (~F.col("ignored") & ~F.col("role").isin(*transparent) & (F.col("role") != "text")).alias("solid")
        ),
        "nodes",
    )
    own = d.select("page_id", F.col("node_id").alias("up"), F.col("solid").alias("up_solid"), F.col("is_text").alias("up_text"))
    # A node's link leads to its parent; a transparent parent is passed, until the nearest solid ancestor (or none) is reached.
    link = written(d.join(own, ["page_id", "up"], "left").select("page_id", "node_id", F.when(F.col("up_solid").isNotNull(), F.col("up")).alias("up"), F.coalesce("up_solid", F.lit(True)).alias("done"), F.coalesce("up_text", F.lit(False)).alias("gone")), "links")
    while not link.filter("not done").isEmpty():
        further = link.select("page_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("done").alias("next_done"), F.col("gone").alias("next_gone"))
        met = link.filter("not done").join(further, ["page_id", "up"]).select("page_id", "node_id", F.col("next").alias("up"), F.col("next_done").alias("done"), (F.col("gone") | F.col("next_gone")).alias("gone"))
        link = written(link.filter("done").select("page_id", "node_id", "up", "done", "gone").union(met), "links")
    solid = written(d.filter("solid").join(link.select("page_id", "node_id", F.col("up").alias("parent"), "gone"), ["page_id", "node_id"]).select("page_id", "node_id", "parent", "name", "gone"), "solid")
    jumps = _jumps(solid.filter("parent is not null").select("page_id", "node_id", F.col("parent").alias("up")))
    gone = solid.filter("gone").select("page_id", "node_id")
    if not gone.isEmpty():
        for jump in jumps:
            below = jump.join(gone.select("page_id", F.col("node_id").alias("up")), ["page_id", "up"], "left_semi").select("page_id", "node_id")
            gone = written(gone.union(below).distinct(), "gone")
        solid = written(solid.join(gone, ["page_id", "node_id"], "left_anti"), "solid")
    kept = solid.filter("name <> ''").select("page_id", "node_id")
    depth = solid.select("page_id", "node_id", F.col("node_id").alias("at"), F.lit(0).cast("long").alias("depth"))
    for jump in jumps:
        above = kept.join(jump, ["page_id", "node_id"]).select("page_id", F.col("up").alias("node_id"))
        kept = written(kept.union(above).distinct(), "kept")
    for jump in reversed(jumps):
        # The longest jumps first: each is taken at most once.
        step = jump.select("page_id", F.col("node_id").alias("at"), "up", "far")
        depth = written(depth.join(step, ["page_id", "at"], "left").select("page_id", "node_id", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.coalesce("far", F.lit(0))).alias("depth")), "depth")
    found = solid.join(kept, ["page_id", "node_id"], "left_semi").join(depth, ["page_id", "node_id"])
    return found.select("page_id", "node_id", F.coalesce("parent", F.lit(-1)).alias("kept_parent"), F.col("depth").cast("int").alias("depth"), F.left("name", F.lit(100)).alias("name"))


def incremental_render(docs: DataFrame, cache: DataFrame, render) -> DataFrame:
    """(path, output, status) of docs (path, mtime, ...) and cache (path, mtime, output): render(docs) -> Column runs on new and stale documents alone;
    a null result is a failure and keeps the last good output."""
    status = snapshot_diff(docs, cache).filter("status <> 'removed'")
    d = docs.join(status, "path").join(cache.select("path", F.col("output").alias("old")), "path", "left")
    fresh = d.filter("status <> 'reuse'").withColumn("made", render(d))
    done = fresh.select("path", F.coalesce("made", "old").alias("output"), F.when(F.col("made").isNotNull(), "rendered").when(F.col("old").isNotNull(), "kept_last").otherwise("failed").alias("status"))
    return done.union(d.filter("status = 'reuse'").select("path", F.col("old"), F.lit("reused")))


def undo_stack(edit_log: DataFrame, cap: int = 50) -> DataFrame:
    """(session, seq, depth, top) after each operation of a log (session, seq, op, records): commits with records push (the oldest goes beyond cap), undo_one
    pops, undo_all and reset clear; top is the seq of the surviving commit. Sorted rows stream through each task, which holds one stack."""
    schema = f"session {dict(edit_log.dtypes)['session']}, seq long, depth int, top long"

    def fold(frames):
        session, stack = None, deque(maxlen=cap)
        for pdf in frames:
            rows = []
            for s, seq, op, records in zip(pdf["session"], pdf["seq"], pdf["op"], pdf["records"], strict=True):
                if s != session:
                    session, stack = s, deque(maxlen=cap)
                if op == "commit" and records > 0:
                    stack.append(seq)
                elif op == "undo_one" and stack:
                    stack.pop()
                elif op in ("undo_all", "reset"):
                    stack.clear()
                rows.append((s, seq, len(stack), stack[-1] if stack else None))
            yield pd.DataFrame(rows, columns=["session", "seq", "depth", "top"]).astype({"top": "Int64"})

    return edit_log.select("session", "seq", "op", "records").repartition("session").sortWithinPartitions("session", "seq").mapInPandas(fold, schema)
