"""Queries across documents, crawl runs and incremental state, with their DuckDB twins."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import corpus as C
from docloom.operators import hooks as H
from docloom.operators import markdown as M
from docloom.operators import web
from docloom.plans import duck as D
from docloom.plans import markdown_queries as Q
from docloom.plans import web_queries as W
from docloom.session import shared_dir, table
from docloom.sources import files
from docloom.sources import fixtures as X
from docloom.streaming import flows

PATTERNS = ["src3", "src1/**", "src4/*/d0000*.md", "*.tmp.md", " "]
RUN_PAGES_EACH = 40
CORPUS_DOCS_EACH = 200
MAX_PAGES, STOP_URL = 12, "https://site.example/p/42"


def _docs(s, d):
    return X.docs(s, d)


def _log(s, d):
    return X.derived(s, d, X.CRAWL_LOG)


def _events(s, d):
    return X.derived(s, d, X.FS_EVENTS)


def _cache(s, d):
    return X.derived(s, d, X.OLD_CACHE, docs=_docs(s, d))


def _run_pages(s, d):
    md = W._markdown(s, d)
    # Runs of a fixed length, so that their number grows with the pages.
    return md.select(F.floor(F.col("page_id") / RUN_PAGES_EACH).alias("run_id"), F.col("page_id").alias("seq"), "url", "title", "markdown")


def _corpus():
    """Corpora of a bounded number of documents of one source."""
    return F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / CORPUS_DOCS_EACH))


def _sections(s, d):
    docs = _docs(s, d)
    title = M.headings(docs).filter("level = 1").groupBy("doc_id").agg(F.min_by("text", "line_no").alias("title"))
    return docs.join(title, "doc_id", "left").select(_corpus().alias("corpus"), F.col("doc_id").alias("pos"), "path", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("label"), (F.col("doc_id") % 8).cast("int").alias("level"), F.col("text").alias("body"))


def _refs(s, d):
    docs = _docs(s, d)
    return M.md_links(docs).select("doc_id", "line_no", F.col("dest").alias("ref"))


def _assets(s):
    rows = [("assets/logo.png", "image/png", 4, bytearray(b"\x89PNG")), ("assets/big.svg", "image/svg+xml", 27262976, None)]
    return s.createDataFrame(rows, "path string, mime string, length long, content binary")


def _image_refs(s, d):
    images = M.md_links(_docs(s, d)).filter("is_image").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "../../assets/big.svg").when(F.col("doc_id") % 11 == 0, "gone.gif").otherwise(F.col("dest")).alias("ref"))
    return images.join(_docs(s, d).select("doc_id", "path"), "doc_id")


def _probes(s, d):
    return M.explode_lines(_docs(s, d)).select("doc_id", F.col("line_no").alias("pos"))


def _headings(s, d):
    return M.headings(_docs(s, d))


def _nav_files(s, d):
    return _docs(s, d).select("path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Doc "), "doc_id")).alias("label"))


def _nodes(s, d):
    tokens = W._tokens(s, d)
    ext = web.element_extents(tokens, ["body", "nav", "ul", "li", "a", "article", "h1", "footer", "div"]).select("page_id", F.col("selector").alias("tag"), F.col("start_tok").alias("node_id"), "end_tok")
    up = ext.select("page_id", F.col("node_id").alias("a"), F.col("end_tok").alias("z"))
    parent = ext.join(up, "page_id").filter("a < node_id and node_id < z").groupBy("page_id", "node_id").agg(F.max("a").alias("parent_id"))
    name = tokens.filter("kind = 'text'").select("page_id", (F.col("tok_no") - 1).alias("node_id"), F.col("text").alias("name"))
    d2 = ext.join(parent, ["page_id", "node_id"], "left").join(name, ["page_id", "node_id"], "left")
    return d2.select("page_id", F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), F.when(F.col("tag") == "div", "generic").otherwise(F.col("tag")).alias("role"), F.col("name"), (F.col("tag") == "ul").alias("ignored"))


def _scratch(s, name):
    return f"{shared_dir(s)}/docloom-{name}-{uuid.uuid4().hex}"


def _written_pages(s, d):
    # Pages are named in their own rows: a join would turn them into Markdown twice.
    named = C.unique_filename(_run_pages(s, d), "markdown")
    out = _scratch(s, "pages")
    files.sink_page_files(named.select(F.concat(F.col("run_id"), F.lit("-"), F.col("file_name")).alias("file_name"), "markdown"), out)
    return out


def _name():
    """A file's name by its path."""
    return F.try_url_decode(F.regexp_extract("path", "([^/]*)$", 1)).alias("name")


def _sunk(s, d):
    """What the sink wrote: files and their bytes."""
    return files.listed(s, _written_pages(s, d)).select(_name(), "length")


def _scan(s, d):
    found = files.scan_markdown(s, [_written_pages(s, d)])
    return found.select(_name(), F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _scan_assets(s, d):
    return files.scan_assets(s, _written_pages(s, d)).select(_name(), "mime", "length")


def _ingest(s, d):
    """The corpus as Markdown files, read by the ingest's stream; a file's number is that of its document."""
    base = _scratch(s, "ingest")
    files.sink_page_files(_docs(s, d).select(F.concat("doc_id", F.lit(".md")).alias("file_name"), F.col("text").alias("markdown")), f"{base}/in")
    flows.stream_ingest(s, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return flows.current_facts(s, f"{base}/out").withColumn("doc_id", F.regexp_extract("doc_id", r"(\d+)\.md$", 1).cast("long"))


def _changed(s, d):
    # Files that events create, and a folder.
    return _events(s, d).filter("kind = 'create'").select("path").union(_docs(s, d).filter("source = 'src3'").select(F.col("source").alias("path"))).distinct()


def _render(s, d):
    cache = _cache(s, d).select("path", "mtime", F.concat(F.lit("old "), "path").alias("output"))
    return C.incremental_render(_docs(s, d), cache, lambda x: F.when(x["doc_id"] % 13 != 0, F.concat(F.lit("new "), x["path"])))


def clean_nav(html, params):
    """Remove navigation elements."""
    return re.subn(r"(?is)<nav\b.*?</nav>", "", html)


def extract_article(html, params):
    """The article's content, none without one; some results break the contract on purpose."""
    found = re.search(r"(?is)<article>(.*?)</article>", html)
    if not found:
        return None
    if len(html) % 7 == 0:
        raise ValueError("unreadable")
    return {"title": None if len(html) % 5 == 0 else "t", "html": " " if len(html) % 3 == 0 else found[1]}


def _hooked(s, d):
    return H.hook_pipeline(table(s, d, "pages"), H.Recipe("articles", clean_nav, extract_article))


def _sessions(s, d):
    """The latest captures as the sink wrote them."""
    out = _scratch(s, "sessions")
    C.session_sink(W.captures(s, d), out)
    return s.read.schema("session_key string, page_url string, title string, markdown string, meta_json string").json(out)


def _stops(s, d):
    """Stops of runs that navigate and of runs that do not."""
    rules = lambda on: C.stop_rules(_log(s, d), MAX_PAGES, F.col("url") == STOP_URL, navigates=on).withColumn("navigates", F.lit(on))
    return rules(True).union(rules(False))


QUERIES = {
    "scan_markdown": _scan,
    "scan_assets": _scan_assets,
    "sink_page_files": _sunk,
    "resolve_inputs": lambda s, d: C.resolve_inputs(_docs(s, d).filter("lang = 'en'").select((-F.col("doc_id")).alias("pos"), F.concat(F.lit("./"), "path").alias("path")), _docs(s, d).select(F.col("doc_id").alias("pos"), "path")),
    "combine_markdown": lambda s, d: C.combine_markdown(_run_pages(s, d)),
    "session_sink": _sessions,
    "archive_manifest": lambda s, d: C.archive_manifest(_run_pages(s, d).select(F.col("run_id").alias("archive"), F.col("seq").alias("entry_no"), "title", F.col("markdown").alias("content"))).drop("crc32"),
    "section_order": lambda s, d: C.section_order(_sections(s, d)),
    "assemble_document": lambda s, d: C.assemble_document(_sections(s, d)),
    "document_title": lambda s, d: C.document_title(_sections(s, d).withColumn("title", F.when(F.col("corpus") < "src5", F.col("title")).otherwise(""))),
    "exclude_filter": lambda s, d: C.exclude_filter(_docs(s, d).select("path"), PATTERNS),
    "content_change_filter": lambda s, d: C.content_change_filter(_events(s, d)).select("event_id", "path", "kind"),
    "classify_reference": lambda s, d: C.classify_reference(_refs(s, d)),
    "nearest_scan_root": lambda s, d: C.nearest_scan_root(_docs(s, d), _docs(s, d).select(F.when(F.col("lang") == "en", F.concat_ws("/", "source", "lang")).when(F.col("lang") == "fr", F.col("source")).alias("root")).filter("root is not null")),
    "link_resolution": lambda s, d: C.link_resolution(M.md_links(_docs(s, d)).filter("not is_image"), _docs(s, d), _headings(s, d)),
    "footnote_integrity": lambda s, d: C.footnote_integrity(M.footnote_refs(_docs(s, d)), M.footnote_defs(_docs(s, d))),
    "asset_inline": lambda s, d: C.asset_inline(_image_refs(s, d), _assets(s)),
    "snapshot_diff": lambda s, d: C.snapshot_diff(_docs(s, d), _cache(s, d)),
    "invalidate_changed": lambda s, d: C.invalidate_changed(_cache(s, d), _changed(s, d)),
    "active_heading": lambda s, d: C.active_heading(_probes(s, d), _headings(s, d)),
    "common_path_prefix": lambda s, d: C.common_path_prefix(_docs(s, d), "source"),
    "nav_tree": lambda s, d: C.nav_tree(_nav_files(s, d)),
    "run_report": lambda s, d: C.run_report(_log(s, d), C.stop_rules(_log(s, d), MAX_PAGES, F.col("url") == STOP_URL)),
    "dependency_set": lambda s, d: C.dependency_set(_docs(s, d)),
    "referenced_labels": lambda s, d: C.referenced_labels(M.footnote_refs(_docs(s, d))),
    "corpus_footnotes": lambda s, d: C.corpus_footnotes(M.footnote_defs(_docs(s, d)).join(_docs(s, d).select("doc_id", _corpus().alias("corpus")), "doc_id")),
    "crawl_loop_cut": lambda s, d: C.crawl_loop_cut(_log(s, d)),
    "failure_streak_stop": lambda s, d: C.failure_streak_stop(_log(s, d)),
    "stop_rules": _stops,
    "unique_filename": lambda s, d: C.unique_filename(_run_pages(s, d)),
    "version_publish": lambda s, d: C.version_publish(_events(s, d).select("path", F.col("event_id").alias("seq"), F.col("kind").alias("content"))),
    "max_pages_limit": lambda s, d: C.max_pages_limit(_log(s, d).filter("status = 'ok'"), 5).select("run_id", "seq", "url"),
    "path_delta": lambda s, d: C.path_delta(_cache(s, d), _docs(s, d)),
    "hierarchy_collapse": lambda s, d: C.hierarchy_collapse(_nodes(s, d)),
    "stream_ingest": _ingest,
    "debounce_sessions": lambda s, d: flows.debounce_sessions(C.content_change_filter(_events(s, d)), "30 minutes"),
    "coalesce_changes": lambda s, d: flows.coalesce_changes(flows.debounce_sessions(C.content_change_filter(_events(s, d)), "30 minutes")).withColumn("paths", F.array_join("paths", ",")),
    "coalesced_bursts": lambda s, d: flows.coalesced_bursts(C.content_change_filter(_events(s, d)), "30 minutes").withColumn("paths", F.array_join("paths", ",")),
    "incremental_render": _render,
    "undo_stack": lambda s, d: C.undo_stack(X.derived(s, d, X.EDIT_LOG), 3),
    "crawl_dedup_stream": lambda s, d: flows.crawl_dedup_stream(_log(s, d)).select("run_id", "seq", "url"),
    "hook_pipeline": _hooked,
    "hook_contract": lambda s, d: H.hook_contract(_hooked(s, d)),
    "stop_predicate": lambda s, d: C.stop_predicate(_log(s, d), (F.col("page_index") >= 3) & F.element_at("collected_titles", 1).startswith("click") & F.col("url").endswith("7")),
}

LOG, EVENTS, EDITS = (f"{name} AS ({X.duck_text(sql)})" for name, sql in (("log", X.CRAWL_LOG), ("fs_events", X.FS_EVENTS), ("edits", X.EDIT_LOG)))
CACHE = f"{Q.DOCS}, cache AS ({X.OLD_CACHE})"
RUN_PAGES = f"""{D.CLEAN},{D.content('clean')},{D.MARKDOWN},{D.TITLES},
run_pages AS (SELECT page_id // {RUN_PAGES_EACH} AS run_id, page_id AS seq, url, title, markdown FROM pages JOIN titles USING (page_id) JOIN markdowns USING (page_id))"""
_CORPUS = f"source || '/' || (doc_id // {CORPUS_DOCS_EACH})"
SECTIONS = f"""{Q.HEADINGS},
first_titles AS (SELECT doc_id, arg_min(text, line_no) AS title FROM headings WHERE level = 1 GROUP BY doc_id),
sections AS (SELECT {_CORPUS} AS corpus, doc_id AS pos, path, coalesce(title, '') AS title, CASE WHEN doc_id % 4 = 0 THEN lang END AS label, (doc_id % 8)::INT AS level, text AS body FROM docs LEFT JOIN first_titles USING (doc_id))"""
LINKS = rf"""{Q.HEADINGS},{Q.LINKS}"""
_NAME = D.slug("coalesce(title, '')")
_LAST = D.slug("regexp_extract(rtrim(url, '/'), '([^/]*)$', 1)")
FILE_NAMES = rf"""{RUN_PAGES},
bases AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n, CASE WHEN {_NAME} <> '' THEN {_NAME} WHEN {_LAST} <> '' THEN {_LAST} ELSE 'page' END AS base FROM run_pages),
stems AS (SELECT *, CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || '-' || CASE WHEN length(base) > 80 THEN rtrim(left(base, 80), '-') ELSE base END AS stem FROM bases),
file_names AS (SELECT run_id, seq, markdown, stem || '.md' AS file_name FROM stems)"""
MARKED = f"""{LOG},
seen AS (SELECT *, coalesce(max((status = 'ok')::INT) OVER (PARTITION BY run_id, url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS revisit,
  sum((status = 'ok')::INT) OVER (PARTITION BY run_id ORDER BY seq) AS pages FROM log),
crawl AS (SELECT *, CASE WHEN status <> 'ok' THEN seq - coalesce((SELECT max(l.seq) FROM log l WHERE l.run_id = seen.run_id AND l.seq < seen.seq AND l.status = 'ok'), 0) ELSE 0 END AS streak FROM seen),
reasons AS (SELECT *, CASE WHEN revisit THEN 'loop' WHEN streak >= 3 THEN 'failures' WHEN status = 'ok' AND pages >= {MAX_PAGES} THEN 'max_pages' WHEN status = 'ok' AND url = '{STOP_URL}' THEN 'stop' END AS reason FROM crawl),
stops AS (SELECT run_id, coalesce(min(seq) FILTER (reason IS NOT NULL), max(seq)) AS stop_seq, coalesce(arg_min(reason, seq) FILTER (reason IS NOT NULL), 'no_more_pages') AS reason FROM reasons GROUP BY run_id)"""
_CHANGES = "(SELECT * FROM fs_events WHERE kind IN ('close_write', 'create', 'remove', 'modify'))"
BURSTS = f"""{EVENTS},
gaps AS (SELECT path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {_CHANGES}),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM gaps),
bursts AS (SELECT path, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM numbered GROUP BY path, burst)"""
TREE = f"""{D.TOKENS},{D.extents(["body", "nav", "ul", "li", "a", "article", "h1", "footer", "div"])},
nodes AS (
  SELECT e.page_id, e.start_tok AS node_id, CASE WHEN selector = 'div' THEN 'generic' ELSE selector END AS role, selector = 'ul' AS ignored, t.text AS name,
    (SELECT max(u.start_tok) FROM extents u WHERE u.page_id = e.page_id AND u.start_tok < e.start_tok AND e.start_tok < u.end_tok) AS parent_id
  FROM extents e LEFT JOIN tokens t ON t.page_id = e.page_id AND t.tok_no = e.start_tok + 1 AND t.kind = 'text'),
plain AS (SELECT *, NOT ignored AND role <> 'generic' AND role <> 'text' AS solid FROM nodes),
ups AS (
  SELECT page_id, node_id, parent_id AS up FROM nodes WHERE parent_id IS NOT NULL
  UNION ALL SELECT u.page_id, u.node_id, n.parent_id FROM ups u JOIN nodes n ON n.page_id = u.page_id AND n.node_id = u.up WHERE n.parent_id IS NOT NULL),
keeps AS (
  SELECT * FROM plain p WHERE solid AND (coalesce(name, '') <> '' OR EXISTS (
    SELECT 1 FROM ups u JOIN plain c ON c.page_id = u.page_id AND c.node_id = u.node_id WHERE u.page_id = p.page_id AND u.up = p.node_id AND c.solid AND coalesce(c.name, '') <> '')))"""
_HTML = "html"
HOOKED = r"""
cleaned AS (SELECT page_id, html, regexp_replace(html, '(?is)<nav\b.*?</nav>', '', 'g') AS c, len(regexp_extract_all(html, '(?is)<nav\b.*?</nav>')) AS removed FROM pages),
hooked AS (
  SELECT page_id, removed, length(c) AS n, regexp_matches(c, '(?is)<article>(.*?)</article>') AS found FROM cleaned),
outcome AS (SELECT *, CASE WHEN NOT found THEN 'null' WHEN n % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM hooked)"""
ORACLES = {
    "scan_markdown": f"WITH {FILE_NAMES} SELECT run_id || '-' || file_name AS name, length(markdown)::INT AS chars, md5(markdown) AS text_md5 FROM file_names",
    "scan_assets": f"WITH {FILE_NAMES} SELECT run_id || '-' || file_name AS name, 'application/octet-stream' AS mime, strlen(markdown) AS length FROM file_names",
    "sink_page_files": f"WITH {FILE_NAMES} SELECT run_id || '-' || file_name AS name, strlen(markdown) AS length FROM file_names",
    "resolve_inputs": f"""WITH {Q.DOCS}, both_of AS (SELECT 0 AS origin, -doc_id AS pos, path FROM docs WHERE lang = 'en' UNION ALL SELECT 1, doc_id, path FROM docs),
firsts AS (SELECT path, arg_min(origin * 1099511627776 + pos, (origin, pos)) AS pos FROM both_of GROUP BY path)
SELECT pos, path FROM firsts""",
    "combine_markdown": f"WITH {RUN_PAGES} SELECT run_id, string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq) AS markdown FROM run_pages GROUP BY run_id",
    "session_sink": f"""WITH {W._BOTH},{D.TITLES}, keyed AS (SELECT {D.session_key('url')} AS session_key, url, title, markdown, captured_seq FROM captures JOIN titles ON page_id = captured_seq % 1000000000),
last AS (SELECT session_key, arg_max(url, captured_seq) AS page_url, arg_max(title, captured_seq) AS title, arg_max(markdown, captured_seq) AS markdown FROM keyed GROUP BY 1)
SELECT *, json_object('page_url', page_url, 'title', title)::VARCHAR AS meta_json FROM last""",
    "archive_manifest": rf"""WITH {RUN_PAGES}, entries AS (
  SELECT run_id AS archive, seq AS entry_no, CASE WHEN seq < 1000 THEN lpad(seq::VARCHAR, 3, '0') ELSE seq::VARCHAR END || '_' || left(regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), 80) || '.md' AS name, strlen(markdown) AS size FROM run_pages)
SELECT *, coalesce(sum(30 + strlen(name) + size) OVER (PARTITION BY archive ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM entries""",
    "section_order": f"""WITH RECURSIVE {SECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY pos) AS n FROM sections)
SELECT corpus, pos, 'doc-' || n AS section_id, CASE WHEN trim(coalesce(label, '')) <> '' THEN label WHEN trim(title) <> '' THEN title ELSE 'Document ' || n END AS panel_title, least(level - 1, 5) AS depth FROM n""",
    "assemble_document": f"""WITH RECURSIVE {SECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY pos) AS n FROM sections)
SELECT corpus, coalesce(arg_min(title, pos) FILTER (title <> ''), 'Document') AS title, count(*) AS section_count,
  string_agg('<section id="doc-' || n || '">' || chr(10) || body || chr(10) || '</section>', chr(10) ORDER BY pos) AS body FROM n GROUP BY corpus""",
    "document_title": rf"""WITH RECURSIVE {SECTIONS}, t AS (SELECT corpus, pos, path, CASE WHEN corpus < 'src5' THEN title ELSE '' END AS title FROM sections)
SELECT corpus, coalesce(arg_min(title, pos) FILTER (trim(title) <> ''), regexp_extract(arg_min(path, pos), '([^/]*?)(\.[^./]*)?$', 1)) AS title FROM t GROUP BY corpus""",
    "exclude_filter": f"""WITH {Q.DOCS} SELECT path FROM docs WHERE NOT list_contains(string_split(path, '/'), 'src3') AND NOT starts_with(path, 'src1/')
  AND NOT regexp_matches(path, '^src4/[^/]*/d0000[^/]*[.]md$') AND NOT regexp_matches(path, '^[^/]*[.]tmp[.]md$')""",
    "content_change_filter": f"WITH {EVENTS} SELECT event_id, path, kind FROM {_CHANGES}",
    "classify_reference": rf"""WITH RECURSIVE {LINKS} SELECT doc_id, line_no, dest AS ref, CASE WHEN regexp_matches(dest, '(?i)^https?://') THEN 'remote' WHEN trim(dest) = '' OR regexp_matches(dest, '(?i)^(data:|#|mailto:|tel:|javascript:|about:)') THEN 'special' ELSE 'local' END AS ref_class FROM links""",
    "nearest_scan_root": rf"""WITH {Q.DOCS}, roots AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN source || '/' || lang ELSE source END AS root FROM docs WHERE lang IN ('en', 'fr')),
fits AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS r FROM docs JOIN roots ON starts_with(path, root || '/'))
SELECT path, coalesce(root, regexp_extract(path, '^(.*)/[^/]*$', 1)) AS root FROM docs LEFT JOIN (SELECT * FROM fits WHERE r = 1) USING (path)""",
    "link_resolution": rf"""WITH RECURSIVE {LINKS},
relative AS (SELECT l.doc_id, line_no, dest, regexp_extract(path, '^(.*/)?[^/]*$', 1) || regexp_replace(dest, '[?#].*$', '') AS p FROM links l JOIN docs USING (doc_id) WHERE NOT is_image AND NOT regexp_matches(dest, '^(#|/)') AND NOT regexp_matches(dest, '(?i)^[a-z][a-z0-9+.-]*:')),
resolved AS (SELECT doc_id, line_no, url_decode(replace(p, '/./', '/')) AS target_path, url_decode(regexp_extract(dest, '#(.*)$', 1)) AS anchor FROM relative)
SELECT r.doc_id, r.line_no, target_path, anchor, CASE WHEN d.doc_id IS NULL THEN 'missing_doc' WHEN anchor <> '' AND NOT EXISTS (SELECT 1 FROM headings h WHERE h.doc_id = d.doc_id AND h.id = anchor) THEN 'missing_anchor' ELSE 'ok' END AS status
FROM resolved r LEFT JOIN docs d ON d.path = target_path""",
    "footnote_integrity": f"""WITH RECURSIVE {Q.FENCED},{Q.DEFS},{Q.REFS}, a AS (SELECT DISTINCT doc_id, label FROM refs), b AS (SELECT DISTINCT doc_id, label FROM defs)
SELECT doc_id, label, 'ok' AS status FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'undefined' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'orphan' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "asset_inline": rf"""WITH RECURSIVE {LINKS}, r AS (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN '../../assets/big.svg' WHEN doc_id % 11 = 0 THEN 'gone.gif' ELSE dest END AS ref FROM links JOIN docs USING (doc_id) WHERE is_image)
SELECT doc_id, path, ref, CASE WHEN starts_with(ref, '../../') THEN substr(ref, 7) ELSE regexp_extract(path, '^(.*/)[^/]*$', 1) || ref END AS resolved_path,
  CASE WHEN ref LIKE '%logo.png' THEN 'data:image/png;base64,iVBORw==' ELSE 'data:,' END AS data_uri, CASE WHEN ref LIKE '%logo.png' THEN 'inlined' WHEN ref LIKE '%big.svg' THEN 'too_large' ELSE 'missing' END AS status FROM r""",
    "snapshot_diff": f"""WITH {CACHE} SELECT coalesce(d.path, c.path) AS path, CASE WHEN d.path IS NULL THEN 'removed' WHEN c.path IS NULL THEN 'new' WHEN d.mtime = c.mtime THEN 'reuse' ELSE 'stale' END AS status FROM docs d FULL JOIN cache c ON c.path = d.path""",
    "invalidate_changed": f"""WITH {CACHE}, {EVENTS}, created AS (SELECT DISTINCT path FROM fs_events WHERE kind = 'create')
SELECT path, path IN (SELECT path FROM created) OR starts_with(path, 'src3/') AS invalid FROM cache""",
    "active_heading": f"""WITH RECURSIVE {Q.HEADINGS}, probes AS (SELECT doc_id, line_no AS pos FROM mlines)
SELECT p.doc_id, p.pos, coalesce(h.id, (SELECT arg_min(f.id, f.line_no) FROM headings f WHERE f.doc_id = p.doc_id)) AS heading_id FROM probes p ASOF LEFT JOIN headings h ON h.doc_id = p.doc_id AND p.pos >= h.line_no""",
    "common_path_prefix": f"""WITH {Q.DOCS}, parts AS (SELECT source, doc_id, unnest(string_split(path, '/')) AS c, unnest(generate_series(1, len(string_split(path, '/')))) AS i FROM docs),
same AS (SELECT source, i, min(c) AS c, count(DISTINCT c) = 1 AND count(*) = (SELECT count(*) FROM docs d WHERE d.source = parts.source) AS ok FROM parts GROUP BY source, i),
cut AS (SELECT source, coalesce(min(i) FILTER (NOT ok), 1000) AS stop FROM same GROUP BY source)
SELECT s.source, nullif(coalesce(string_agg(c, '/' ORDER BY i) FILTER (i < stop), ''), '') AS prefix FROM same s JOIN cut USING (source) GROUP BY s.source""",
    "nav_tree": rf"""WITH {Q.DOCS},
files AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'Doc ' || doc_id ELSE regexp_extract(path, '([^/]*)$', 1) END AS label FROM docs),
every AS (
  SELECT DISTINCT split_part(path, '/', 1) AS node_id, '' AS parent_id, 'folder' AS kind, split_part(path, '/', 1) AS label FROM files
  UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 1), 'folder', split_part(path, '/', 2) FROM files
  UNION SELECT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 'file', label FROM files)
SELECT *, (len(string_split(node_id, '/')) - 1)::INT AS depth, row_number() OVER (PARTITION BY parent_id ORDER BY kind DESC, lower(label), node_id)::INT AS pos FROM every""",
    "run_report": f"""WITH {MARKED}, kept AS (SELECT l.*, s.stop_seq, s.reason FROM log l JOIN stops s USING (run_id) WHERE status = 'ok' AND (seq < stop_seq OR (seq = stop_seq AND s.reason <> 'loop')))
SELECT s.run_id, count(k.seq) AS pages, coalesce(sum(length(k.title)), 0)::BIGINT AS chars, s.reason AS stop_reason FROM stops s LEFT JOIN kept k USING (run_id) GROUP BY s.run_id, s.reason""",
    "dependency_set": rf"""WITH RECURSIVE {Q.FENCED},{Q.LINKS}, r AS (
  SELECT doc_id, dest AS ref FROM links UNION SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[ \t\n](?:src|href|poster) *= *["''] *([^"''<>]+?) *["'']', 1)) FROM docs UNION SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\burl[(] *["'']? *([^ \t\n"''()]+)', 1)) FROM docs)
SELECT doc_id, ref FROM r WHERE NOT regexp_matches(ref, '(?i)^(https?://|data:|#|mailto:|tel:|javascript:|about:)') AND trim(ref) <> ''""",
    "referenced_labels": f"WITH {Q.BODY},{Q.REFS} SELECT doc_id, count(DISTINCT label) AS n_labels, count(*) AS n_uses FROM refs GROUP BY doc_id",
    "corpus_footnotes": rf"""WITH RECURSIVE {Q.FENCED},{Q.DEFS}, c AS (SELECT {_CORPUS} AS corpus, f.doc_id, label, body FROM first_defs f JOIN docs USING (doc_id)),
p AS (SELECT corpus, doc_id, label, left({D.trim(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '<.*', ' ', 'g'), '[\n\r\t]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')")}, 180) AS plain FROM c)
SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY {Q._NUMBER} NULLS LAST, label, doc_id)::INT AS rank FROM p""",
    "crawl_loop_cut": f"WITH {MARKED}, cuts AS (SELECT run_id, min(seq) FILTER (revisit) AS cut FROM crawl GROUP BY run_id) SELECT run_id, seq, url FROM crawl JOIN cuts USING (run_id) WHERE cut IS NULL OR seq < cut",
    "failure_streak_stop": f"WITH {MARKED} SELECT run_id, min(seq) AS stop_seq FROM crawl WHERE streak = 3 GROUP BY run_id",
    "stop_rules": f"""WITH {MARKED}, ending AS (SELECT *, CASE WHEN revisit THEN 'loop' WHEN streak >= 3 THEN 'failures' WHEN status = 'null' THEN 'extract_null' WHEN status <> 'ok' THEN 'extract_failed' WHEN pages >= {MAX_PAGES} THEN 'max_pages' ELSE 'single_page' END AS why FROM crawl)
SELECT run_id, stop_seq, reason, true AS navigates FROM stops UNION ALL SELECT run_id, min(seq), arg_min(why, seq), false FROM ending GROUP BY run_id""",
    "unique_filename": f"WITH {FILE_NAMES} SELECT run_id, seq, file_name FROM file_names",
    "version_publish": f"WITH {EVENTS} SELECT path, event_id AS seq, (row_number() OVER w)::INT AS version, (lag(kind) OVER w) IS DISTINCT FROM kind AS changed FROM fs_events WINDOW w AS (PARTITION BY path ORDER BY event_id)",
    "max_pages_limit": f"WITH {LOG} SELECT run_id, seq, url FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM log WHERE status = 'ok') WHERE n <= 5",
    "path_delta": f"""WITH {CACHE} SELECT path, 'added' AS change FROM (SELECT path FROM docs EXCEPT SELECT path FROM cache) UNION ALL SELECT path, 'removed' FROM (SELECT path FROM cache EXCEPT SELECT path FROM docs)
UNION ALL SELECT path, 'kept' FROM (SELECT path FROM docs INTERSECT SELECT path FROM cache)""",
    "hierarchy_collapse": f"""WITH RECURSIVE {TREE}
SELECT k.page_id, k.node_id, coalesce((SELECT max(u.up) FROM ups u JOIN keeps a ON a.page_id = u.page_id AND a.node_id = u.up WHERE u.page_id = k.page_id AND u.node_id = k.node_id), -1) AS kept_parent,
  (SELECT count(*) FROM ups u JOIN keeps a ON a.page_id = u.page_id AND a.node_id = u.up WHERE u.page_id = k.page_id AND u.node_id = k.node_id)::INT AS depth, left(coalesce(name, ''), 100) AS name FROM keeps k""",
    "stream_ingest": f"WITH RECURSIVE {Q.HEADINGS} SELECT doc_id, line_no, level, text, id FROM headings",
    "debounce_sessions": f'WITH {BURSTS} SELECT path, start, "end", n FROM bursts',
    "coalesce_changes": f"WITH {BURSTS} SELECT date_trunc('hour', start) AS batch, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM bursts GROUP BY 1",
    "coalesced_bursts": f"""WITH {BURSTS} SELECT date_trunc('hour', "end" - INTERVAL 1 MICROSECOND) AS batch, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM bursts GROUP BY 1""",
    "incremental_render": f"""WITH {CACHE}, d AS (SELECT d.*, c.path IS NOT NULL AS known, c.mtime = d.mtime AS same FROM docs d LEFT JOIN cache c USING (path))
SELECT path, CASE WHEN known AND same THEN 'old ' || path WHEN doc_id % 13 <> 0 THEN 'new ' || path WHEN known THEN 'old ' || path END AS output,
  CASE WHEN known AND same THEN 'reused' WHEN doc_id % 13 <> 0 THEN 'rendered' WHEN known THEN 'kept_last' ELSE 'failed' END AS status FROM d""",
    "undo_stack": f"""WITH RECURSIVE {EDITS},
walk AS (
  SELECT session, 0::BIGINT AS seq, []::BIGINT[] AS stack FROM (SELECT DISTINCT session FROM edits)
  UNION ALL SELECT e.session, e.seq, CASE WHEN op = 'commit' AND records > 0 THEN list_append(w.stack, e.seq)[-3:] WHEN op = 'undo_one' THEN w.stack[:-2] WHEN op = 'undo_all' THEN [] ELSE w.stack END
  FROM walk w JOIN edits e ON e.session = w.session AND e.seq = w.seq + 1)
SELECT session, seq, len(stack)::INT AS depth, stack[-1] AS top FROM walk WHERE seq > 0""",
    "crawl_dedup_stream": f"WITH {LOG} SELECT run_id, min(seq) AS seq, url FROM log WHERE status = 'ok' GROUP BY run_id, url",
    "hook_contract": f"""WITH {HOOKED}, broken AS (
  SELECT 'raised' AS rule FROM outcome WHERE status = 'error' UNION ALL SELECT 'null_result' FROM outcome WHERE status = 'null'
  UNION ALL SELECT 'no_title' FROM outcome WHERE status = 'ok' AND n % 5 = 0 UNION ALL SELECT 'empty_html' FROM outcome WHERE status = 'ok' AND n % 3 = 0)
SELECT 'articles' AS recipe_id, rule, count(*) AS n_rows FROM broken GROUP BY rule""",
    "stop_predicate": f"""WITH {LOG}, ok AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i, first_value(title) OVER (PARTITION BY run_id ORDER BY seq) AS t FROM log WHERE status = 'ok')
SELECT run_id, min(seq) AS stop_seq FROM ok WHERE i >= 3 AND starts_with(t, 'click') AND ends_with(url, '7') GROUP BY run_id""",
}
