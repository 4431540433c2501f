"""Queries on pages and URLs, with their DuckDB twins."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import web
from docloom.plans import duck as D
from docloom.sources import fixtures as X
from docloom.session import configure, table

RECIPES = [
    ("spanish", "/es/*"),
    ("net-en", "https://*.example.net/en/*"),
    ("com-www", "http://www.ththor.example.com/*"),
    ("org", "*.example.org/de/*"),
    ("bare", "ththor.example.com"),
    ("exact", "https://ththwh.example.org/en/270"),
    ("rest", "*"),
]
TARGETS = r"""SELECT CAST(floor(page_id / 50) AS BIGINT) AS grp, page_id AS ord,
  CASE page_id % 7 WHEN 0 THEN 'about:blank' WHEN 1 THEN 'chrome://settings' WHEN 2 THEN 'devtools://x' WHEN 3 THEN 'file:///a' ELSE url END AS url,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE substr(url, 9, 12) END AS title FROM pages"""


def _pages(spark, d):
    return table(configure(spark), d, "pages")


def _tokens(spark, d):
    return web.explode_html_tokens(web.scan_pages(_pages(spark, d)))


def _keyed(spark, d):
    return web.tokens_by_page(web.scan_pages(_pages(spark, d)))


def _content(spark, d):
    return web.content_tokens(web.clean_noise(_keyed(spark, d))[0], "article")


def _markdown(spark, d):
    """(page_id, url, title, markdown) of every page."""
    tokens = _keyed(spark, d)
    md = web.html_to_markdown(web.content_tokens(web.clean_noise(tokens)[0], "article"))
    return _pages(spark, d).select("page_id", "url").join(web.page_titles(tokens), "page_id").join(md, "page_id")


def captures(spark, d):
    """Two passes over the pages: all Markdown, then that of the main content. Both are joined to the page and made rows there, so no union pairs their partitions."""
    tokens = _keyed(spark, d)
    raw = web.html_to_markdown(tokens).withColumnRenamed("markdown", "raw")
    main = web.html_to_markdown(_content(spark, d))
    page = _pages(spark, d).select("page_id", "url").join(web.page_titles(tokens), "page_id").join(raw, "page_id").join(main, "page_id", "left")
    passes = F.array(F.struct(F.col("page_id").alias("captured_seq"), F.col("raw").alias("markdown")), F.when(F.col("markdown").isNotNull(), F.struct((F.col("page_id") + 1_000_000_000).alias("captured_seq"), "markdown")))
    return page.select("url", "title", F.explode(passes).alias("c")).filter("c is not null").select("url", "title", "c.captured_seq", "c.markdown")


def _targets(spark, d):
    _pages(spark, d).createOrReplaceTempView("docloom_pages")
    return spark.sql(X.spark_text(TARGETS))


BUNDLED = (
    '<p><img src="logo.png" alt="logo.png"><link href="site.css"><a href="#x">x</a><a href="site.css">y</a><img src="gone.png"></p><video poster=\'logo.png\' src="a"></video>'
    '<style>b{background:url("bg.png")} i{x:url(gone.gif)} u{y:url(#z)}</style><div style="b:url(\'bg.png\')" class="src = banana">'
)
ASSETS = [("logo.png", "image/png", b"\x89PNG"), ("site.css", "text/css", b"a{}"), ("a", "video/mp4", b"vid"), ("bg.png", "image/png", b"bg")]


def _bundle(spark, d):
    assets = spark.createDataFrame([(p, m, bytearray(c)) for p, m, c in ASSETS], "path string, mime string, content binary")
    return web.bundle_html_resources(web.explode_html_tokens(_pages(spark, d).withColumn("html", F.concat(F.lit(BUNDLED), F.col("html")))), assets)


#: Preformatted text and numbered lists before the article of each page.
LISTS = "<article><pre>a  b\n  <code>c</code>\n\n\nd</pre><ol><li>one<ul><li>x</ul><li>two</ol>"


def _listed(spark, d):
    """Markdown of the pages' content with LISTS before it."""
    pages = _pages(spark, d).withColumn("html", F.concat(F.lit(LISTS), F.col("html")))
    return web.html_to_markdown(web.content_tokens(web.clean_noise(web.tokens_by_page(pages))[0], "article"))


def _columns(spark, d, **columns):
    return _pages(spark, d).select("page_id", *(c.alias(k) for k, c in columns.items()))


def _snapshot(spark, d):
    found = web.page_snapshot(_pages(spark, d), _keyed(spark, d))
    return found.withColumn("outline", F.array_join("outline", " / "))


def _params(spark, d):
    made = _pages(spark, d).select(
        "page_id",
        T.params_merge(
            F.create_map(F.lit("depth"), F.lit("1"), F.lit("lang"), F.lit('"en"')),
            F.create_map(F.lit("lang"), F.concat(F.lit('"'), F.regexp_extract("url", "/(..)/", 1), F.lit('"')), F.concat(F.lit("k"), F.col("page_id") % 3), F.lit("true")),
        ).alias("m"),
    )
    return made.select("page_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("params"))


QUERIES = {
    "page_report": lambda s, d: web.page_report(_pages(s, d)),
    "scan_pages": lambda s, d: web.scan_pages(_pages(s, d), body_only=True),
    "explode_html_tokens": _tokens,
    "element_extents_join": lambda s, d: web.element_extents(_tokens(s, d), [*web.PAGE_NOISE, "article", "p", "b"]),
    "clean_noise": lambda s, d: web.clean_noise(_keyed(s, d))[0],
    "noise_removed": lambda s, d: web.noise_removed(_pages(s, d), _keyed(s, d)),
    "extract_content": lambda s, d: web.extract_content(_keyed(s, d), "article", ("h1",)),
    "html_to_markdown": _listed,
    "page_envelope": lambda s, d: web.page_envelope(_markdown(s, d)),
    "page_snapshot": _snapshot,
    "truncate_text": lambda s, d: web.truncate_text(table(configure(s), d, "conversations"), "text", 120),
    "extract_status": lambda s, d: web.extract_status(
        web.extract_content(_keyed(s, d)).withColumn("html", F.when(F.col("page_id") % 5 == 0, F.lit(None)).when(F.col("page_id") % 7 == 0, " ").otherwise(F.col("html"))).withColumn("markdown", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("html")))
    ),
    "url_filter": lambda s, d: web.url_filter(_pages(s, d), "/en/*").select("page_id", "url"),
    "recipe_first_match": lambda s, d: web.recipe_first_match(_pages(s, d), RECIPES),
    "url_equivalence": lambda s, d: web.url_equivalence(_pages(s, d).withColumn("url", F.regexp_replace("url", r"/[0-9]+.*$", "/"))).withColumn("page_ids", F.array_join(F.col("page_ids").cast("array<string>"), ",")),
    "url_classes": lambda s, d: web.url_classes(_pages(s, d).withColumn("url", F.regexp_replace("url", r"/[0-9]+.*$", "/"))),
    "best_target": lambda s, d: web.best_target(_targets(s, d), "https://therst.example.net/de/1373/"),
    "baseline_compare": lambda s, d: web.baseline_compare(captures(s, d)),
    "session_history": lambda s, d: web.session_history(captures(s, d)),
    "html_resource_refs": lambda s, d: web.html_resource_refs(web.explode_html_tokens(_pages(s, d).withColumn("html", F.concat(F.lit('<style>a{background:url("x.png")}</style><img src="a.svg" style="b:url(c.gif)">'), F.col("html"))))),
    "bundle_html_resources": _bundle,
    "slugify": lambda s, d: table(configure(s), d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug")),
    "html_escape": lambda s, d: _columns(s, d, escaped=T.html_escape(F.col("html"))),
    "plain_text": lambda s, d: table(configure(s), d, "conversations").select("conv_id", "turn", T.plain_text(F.concat(F.lit("**[a](b)** `c` "), F.col("text"))).alias("plain")),
    "footnote_plain_title": lambda s, d: _columns(s, d, plain=T.footnote_plain_title(F.col("html"))),
    "session_key": lambda s, d: _columns(s, d, session_key=T.session_key(F.col("url"))),
    "url_key": lambda s, d: _columns(s, d, url_key=T.url_key(F.col("url")), url_path=T.url_path(F.col("url"))),
    "ref_extension_mime": lambda s, d: _columns(s, d, mime=T.ref_extension_mime(F.concat(F.lit("a/b."), F.element_at(F.array(*map(F.lit, ["PNG", "css?x=1", "mjs#y", "bin", "woff2"])), (F.col("page_id") % 5 + 1).cast("int"))))),
    "relative_path": lambda s, d: _columns(s, d, rel=T.relative_path(F.col("url"), F.lit("https://ththwh.example.org"))),
    "sanitize_name": lambda s, d: _columns(s, d, name=T.sanitize_name(F.concat(F.col("url"), F.lit(' a  "b" |c')))),
    "params_merge": _params,
}

_HTML2 = """pages AS (SELECT page_id, url, '<style>a{background:url("x.png")}</style><img src="a.svg" style="b:url(c.gif)">' || html AS html FROM main.pages)"""
_BUNDLED = f"""pages AS (SELECT page_id, url, {D.q(BUNDLED)} || html AS html FROM main.pages)"""
_LISTED = f"""pages AS (SELECT page_id, url, {D.q(LISTS)} || html AS html FROM main.pages)"""
_ASSETS = " UNION ALL ".join(f"SELECT {D.q(p)} AS ref, 'data:{m};base64,{base64.b64encode(c).decode()}' AS data" for p, m, c in ASSETS)
_TARGET_ORACLE = f"""WITH targets AS ({TARGETS}), scored AS (
  SELECT *, CASE WHEN {D.url_key('url')} = {D.url_key("'https://therst.example.net/de/1373/'")} THEN 10000 ELSE 0 END +
    CASE WHEN regexp_matches(url, '^https?://') THEN 1000 + least(strlen({D.trim('title')}), 200) + least(strlen(url), 100)
         WHEN url = 'about:blank' THEN -500 WHEN regexp_matches(url, '^chrome(-untrusted)?://') THEN -2000 WHEN starts_with(url, 'devtools://') THEN -5000 ELSE -100 END AS score
  FROM targets)
SELECT grp, url, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, ord DESC) AS rank FROM scored) WHERE rank = 1"""
_HOST = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"
_RAW_MD = D.MARKDOWN.replace("markdowns", "raw_markdowns").replace("frags", "raw_frags").replace("counted", "raw_counted").replace("marked", "raw_marked").replace("FROM content", "FROM tokens")
_BOTH = f"""{D.CLEAN},{D.content('clean')},{D.MARKDOWN},{_RAW_MD},
captures AS (
  SELECT url, page_id AS captured_seq, markdown FROM raw_markdowns JOIN pages USING (page_id)
  UNION ALL SELECT url, page_id + 1000000000, markdown FROM markdowns JOIN pages USING (page_id))"""
ORACLES = {
    "page_report": f"""WITH {D.CLEAN},{D.content('clean')},{D.MARKDOWN},
gone AS (SELECT page_id, count(*) AS removed FROM noise GROUP BY page_id)
SELECT {_HOST} AS host, count(*) AS pages, sum(coalesce(removed, 0))::BIGINT AS removed, sum(coalesce(length(markdown), 0))::BIGINT AS chars_kept
FROM pages LEFT JOIN markdowns USING (page_id) LEFT JOIN gone USING (page_id) GROUP BY 1""",
    "scan_pages": rf"""SELECT page_id, url, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) ELSE html END AS html
FROM pages WHERE coalesce({D.trim('html')}, '') <> ''""",
    "explode_html_tokens": f"WITH {D.TOKENS} SELECT * FROM tokens",
    "element_extents_join": f"WITH {D.TOKENS},{D.extents([*web.PAGE_NOISE, 'article', 'p', 'b'])} SELECT page_id, selector, start_tok, end_tok FROM extents",
    "clean_noise": f"WITH {D.CLEAN} SELECT * FROM clean",
    "noise_removed": f"WITH {D.CLEAN} SELECT {_HOST} AS host, selector, count(*) AS removed FROM noise JOIN pages USING (page_id) GROUP BY ROLLUP ({_HOST}, selector)",
    "extract_content": f"""WITH {D.TOKENS},{D.extents(['h1'], 'strip')},
kept AS (SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM strip n WHERE n.page_id = t.page_id AND t.tok_no BETWEEN n.start_tok AND n.end_tok)),{D.content('kept')},{D.TITLES}
SELECT page_id, title, string_agg(text, '' ORDER BY tok_no) AS html FROM titles LEFT JOIN content USING (page_id) GROUP BY page_id, title""",
    "html_to_markdown": f"WITH {_LISTED},{D.CLEAN},{D.content('clean')},{D.MARKDOWN} SELECT page_id, markdown FROM markdowns",
    "page_envelope": f"""WITH {D.CLEAN},{D.content('clean')},{D.MARKDOWN},{D.TITLES}
SELECT page_id, url, title, CASE WHEN title <> '' THEN '# ' || title || chr(10) || chr(10) ELSE '' END || '> Source: ' || url || chr(10) || chr(10) || markdown || chr(10) AS markdown
FROM pages JOIN titles USING (page_id) JOIN markdowns USING (page_id)""",
    "page_snapshot": rf"""WITH {D.TOKENS},
t AS (SELECT *, lag(kind) OVER w AS bk, lag(tag) OVER w AS bt FROM tokens WINDOW w AS (PARTITION BY page_id ORDER BY tok_no)),
heads AS (SELECT page_id, tok_no, bt || ': ' || left({D.trim(D.decode('text'))}, 120) AS line, row_number() OVER (PARTITION BY page_id ORDER BY tok_no) AS rank
  FROM t WHERE kind = 'text' AND bk = 'open' AND bt IN ('h1', 'h2', 'h3', 'h4')),
outlines AS (SELECT page_id, string_agg(line, ' / ' ORDER BY tok_no) AS outline FROM heads WHERE rank <= 30 GROUP BY page_id),
names AS (SELECT page_id, arg_min(text, tok_no) AS title FROM t WHERE kind = 'text' AND bk = 'open' AND bt = 'title' GROUP BY page_id),
bodies AS (SELECT page_id, string_agg(text, ' ' ORDER BY tok_no) AS words FROM t WHERE kind = 'text' AND coalesce(bt, '') <> 'title' GROUP BY page_id)
SELECT page_id, url, {D.trim(D.decode("coalesce(title, '')"))} AS title, coalesce(outline, '') AS outline,
  left(coalesce({D.trim(f"regexp_replace({D.decode('words')}, '" + chr(92) + "s+', ' ', 'g')")}, ''), 800) AS preview
FROM pages LEFT JOIN names USING (page_id) LEFT JOIN outlines USING (page_id) LEFT JOIN bodies USING (page_id)""",
    "truncate_text": "SELECT conv_id, turn, role, CASE WHEN length(text) > 120 THEN left(text, 120) || chr(10) || chr(10) || '[truncated at 120 chars]' ELSE text END AS text FROM conversations",
    "extract_status": f"""WITH {D.TOKENS},{D.content('tokens')},{D.TITLES},
found AS (SELECT page_id, string_agg(text, '' ORDER BY tok_no) AS html FROM titles LEFT JOIN content USING (page_id) GROUP BY page_id),
changed AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN ' ' ELSE html END AS html FROM found),
both_of AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS markdown FROM changed)
SELECT page_id, CASE WHEN html IS NULL THEN 'null' WHEN {D.trim('html')} = '' THEN 'empty_html' WHEN {D.trim("coalesce(markdown, '')")} = '' THEN 'empty_markdown' ELSE 'ok' END AS status FROM both_of""",
    "url_filter": f"SELECT page_id, url FROM pages WHERE regexp_matches({D.url_path('url')}, '(?s)^/en/.*$')",
    "recipe_first_match": f"""WITH parts AS (
  SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host, {D.url_path('url')} AS path FROM pages)
SELECT page_id, CASE WHEN path LIKE '/es/%' THEN 'spanish'
  WHEN scheme = 'https' AND ends_with(host, '.example.net') AND (path = '/en' OR starts_with(path, '/en/')) THEN 'net-en'
  WHEN scheme = 'http' AND host IN ('www.ththor.example.com', 'www.www.ththor.example.com') THEN 'com-www'
  WHEN ends_with(host, '.example.org') AND starts_with(path, '/de/') THEN 'org'
  WHEN host IN ('ththor.example.com', 'www.ththor.example.com') THEN 'bare'
  WHEN scheme = 'https' AND host IN ('ththwh.example.org', 'www.ththwh.example.org') AND path = '/en/270' THEN 'exact'
  ELSE 'rest' END AS recipe_id FROM parts""",
    "url_classes": f"""WITH cut AS (SELECT page_id, regexp_replace(url, '/[0-9]+.*$', '/') AS url FROM pages)
SELECT page_id, {D.url_key('url')} AS url_key, min(page_id) OVER (PARTITION BY {D.url_key('url')}) AS representative FROM cut""",
    "url_equivalence": f"""WITH cut AS (SELECT page_id, regexp_replace(url, '/[0-9]+.*$', '/') AS url FROM pages)
SELECT {D.url_key('url')} AS url_key, count(*) AS n, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS page_ids FROM cut GROUP BY 1""",
    "best_target": _TARGET_ORACLE,
    "baseline_compare": f"""WITH {_BOTH},
ends AS (SELECT {D.session_key('url')} AS session_key, arg_min(markdown, captured_seq) AS a, arg_max(markdown, captured_seq) AS b FROM captures GROUP BY 1)
SELECT session_key, length(a)::INT AS chars_before, length(b)::INT AS chars_after, round(length(b) / length(a), 6) AS retained FROM ends""",
    "session_history": f"WITH {_BOTH} SELECT {D.session_key('url')} AS session_key, arg_min(markdown, captured_seq) AS baseline, arg_max(markdown, captured_seq) AS current FROM captures GROUP BY 1",
    "html_resource_refs": rf"""WITH {_HTML2},{D.TOKENS},
refs AS (
  SELECT page_id, tok_no, 'src' AS attr, {D.attribute('src')} AS ref FROM tokens WHERE kind = 'open'
  UNION ALL SELECT page_id, tok_no, 'poster', {D.attribute('poster')} FROM tokens WHERE kind = 'open'
  UNION ALL SELECT page_id, tok_no, 'href', {D.attribute('href')} FROM tokens WHERE kind = 'open' AND tag = 'link'
  UNION ALL SELECT page_id, tok_no, 'css', unnest(regexp_extract_all(text, 'url\(\s*[''"]?([^''")]+)[''"]?\s*\)', 1)) FROM tokens WHERE kind = 'open' OR (kind = 'raw' AND tag = 'style'))
SELECT * FROM refs WHERE ref <> ''""",
    "bundle_html_resources": rf"""WITH {_BUNDLED},{D.TOKENS},
assets AS ({_ASSETS}),
flagged AS (SELECT *, (kind = 'open' OR (kind = 'raw' AND tag = 'style')) AND regexp_matches(text, '(?is)\s(src|poster|href)\s*=|url\(') AS refers FROM tokens),
cut AS (
  SELECT page_id, tok_no, unnest(ps) AS piece, unnest(generate_series(0, len(ps) - 1)) AS part
  FROM (SELECT *, CASE WHEN tag = 'link' THEN regexp_extract_all(text, {D.q(web.PIECE_RX.format(names="src|poster|href"))}) ELSE regexp_extract_all(text, {D.q(web.PIECE_RX.format(names="src|poster"))}) END AS ps FROM flagged WHERE refers)),
named AS (
  SELECT *, regexp_matches(piece, {D.q(web.CSS_RX)}) AS css, CASE WHEN regexp_matches(piece, {D.q(web.ATTR_RX)}) THEN regexp_extract(piece, {D.q(web.ATTR_RX)}, 2) WHEN regexp_matches(piece, {D.q(web.CSS_RX)}) THEN regexp_extract(piece, {D.q(web.CSS_RX)}, 1) END AS r FROM cut),
refs AS (SELECT *, CASE WHEN NOT regexp_matches(trim(r), '^(#|data:|$)') THEN r END AS ref FROM named),
met AS (
  SELECT page_id, tok_no, part, refs.ref, data, CASE WHEN refs.ref IS NULL THEN piece WHEN css THEN 'url("' || coalesce(data, 'data:,') || '")'
    ELSE regexp_extract(piece, {D.q(web.ATTR_RX)}, 1) || piece[-1] || coalesce(data, 'data:,') || piece[-1] END AS new FROM refs LEFT JOIN assets ON assets.ref = refs.ref),
every AS (SELECT page_id, tok_no, part, ref, data, new FROM met UNION ALL SELECT page_id, tok_no, 0, NULL, NULL, text FROM flagged WHERE NOT refers)
SELECT page_id, string_agg(new, '' ORDER BY tok_no, part) AS html, count(*) FILTER (data IS NOT NULL) AS n_inlined, count(*) FILTER (ref IS NOT NULL AND data IS NULL) AS n_failed FROM every GROUP BY page_id""",
    "slugify": f"SELECT doc_id, {D.slug('text')} AS slug FROM documents",
    "html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages",
    "plain_text": f"SELECT conv_id, turn, {D.plain("'**[a](b)** `c` ' || text")} AS plain FROM conversations",
    "footnote_plain_title": rf"""SELECT page_id, left({D.trim(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '<.*', ' ', 'g'), '[\n\r\t]', ' ', 'g'), '\p{Cc}', '', 'g'), '[\s\p{Z}]+', ' ', 'g')")}, 180) AS plain FROM pages""",
    "session_key": f"SELECT page_id, {D.session_key('url')} AS session_key FROM pages",
    "url_key": f"SELECT page_id, {D.url_key('url')} AS url_key, {D.url_path('url')} AS url_path FROM pages",
    "ref_extension_mime": "SELECT page_id, ['image/png', 'text/css', 'text/javascript', 'application/octet-stream', 'font/woff2'][page_id % 5 + 1] AS mime FROM pages",
    "relative_path": "SELECT page_id, CASE WHEN url = 'https://ththwh.example.org' THEN '' WHEN starts_with(url, 'https://ththwh.example.org/') THEN substr(url, 28) END AS rel FROM pages",
    "sanitize_name": r"""SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(url || ' a  "b" |c', '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), 80) AS name FROM pages""",
    "params_merge": """SELECT page_id, 'depth=1,k' || (page_id % 3) || '=true,lang="' || regexp_extract(url, '/(..)/', 1) || '"' AS params FROM pages""",
}
