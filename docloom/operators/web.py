"""Operators on captured web pages: tokens, cleaning, extraction, Markdown, URLs."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: A > in a quoted attribute does not end its tag; one whose quotes are not ended ends at the next >.
TOKEN_RX = r'''(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<(?:[^"'>]++|"[^"]*+"|'[^']*+')++>|<[^>]+>|[^<]+'''
# Selectors of elements that are noise by default.
CLEAN_SELECTORS = ("header", "footer", "nav", "aside", ".sidebar", ".ads", ".cookie-notice", '[class*="sidebar"]', '[class*="comment"]', '[id*="comment"]')
#: The default selectors and the advert class of the captured pages.
PAGE_NOISE = (*CLEAN_SELECTORS, ".ad")
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
NOTICE = "\n\n[truncated at {n} chars]"
#: Stand-ins for the blanks, newlines and tabs of preformatted text: noncharacters, which no page may hold (one that does has them replaced).
HELD, REPLACED = "\ufdd4\ufdd5\ufdd6", "\ufffd" * 3
#: A tag or style sheet in pieces: attributes that name a resource, CSS references, and what lies between; then the reference in such a piece.
_VALUE = r"""(?:"[^"]*"|'[^']*')"""
PIECE_RX = r"""(?is)\s(?:{names})\s*=\s*""" + _VALUE + r"""|url\(\s*(?:"[^"]*"|'[^']*'|[^\s)'"]+)\s*\)|[^\suU]+|[\suU]"""
ATTR_RX = r"""(?is)^(\s(?:src|poster|href)\s*=\s*)["'](.*)["']$"""
CSS_RX = r"""(?is)^url\(\s*["']?(.*?)["']?\s*\)$"""


def scan_pages(pages: DataFrame, body_only: bool = False) -> DataFrame:
    """(page_id, url, html) of captures with html; the body's content alone if asked for."""
    body = F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1)
    html = F.when(F.col("html").rlike(r"(?is)<body[^>]*>.*</body>"), body).otherwise(F.col("html")) if body_only else F.col("html")
    return pages.filter(F.coalesce(T.trim_all(F.col("html")), F.lit("")) != "").select("page_id", "url", html.alias("html"))


def page_rejects(pages: DataFrame) -> DataFrame:
    """(page_id, url, reason) of captures without html."""
    return pages.filter(F.coalesce(T.trim_all(F.col("html")), F.lit("")) == "").select("page_id", "url", F.lit("empty html").alias("reason"))


def explode_html_tokens(pages: DataFrame) -> DataFrame:
    """One row for each comment, script, style, tag and text of a page: page_id, tok_no, kind, tag, attrs, text."""
    tokens = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN_RX), F.lit(0))).alias("tok_no", "text"))
    t = F.col("text")
    kind = (
        F.when(t.startswith("<!--"), "comment")
        .when(t.startswith("<!"), "decl")
        .when(t.rlike(r"(?is)^<(script|style)\b.*</(script|style)\s*>$"), "raw")
        .when(t.rlike("^</[a-zA-Z]"), "close")
        .when(t.rlike("^<[a-zA-Z]"), "open")
        .otherwise("text")
    )
    tag = F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    attrs = F.when(kind == "open", F.regexp_extract(t, "(?s)^<[a-zA-Z][a-zA-Z0-9]*(.*)>$", 1)).otherwise("")
    return tokens.select("page_id", "tok_no", kind.alias("kind"), tag.alias("tag"), F.trim(attrs).alias("attrs"), "text")


def tokens_by_page(pages: DataFrame) -> DataFrame:
    """explode_html_tokens of pages that are dealt by page_id first: windows and joins by page then need no shuffle of tokens."""
    return explode_html_tokens(pages.repartition("page_id"))


def attribute(name: str) -> Column:
    """An attribute of a tag's attrs, in either quotes or without; empty where absent. What other attributes hold in their quotes is passed over. The attrs are searched once."""
    other = r"""(?:[^\s"'=<>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"']++))?+|["'=<>])"""
    value = rf"""(?is)^\s*+(?:(?!{name}\s*+=){other}\s*+)*+{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    return F.regexp_replace(F.regexp_extract("attrs", value, 1), r"""(?s)^(["'])(.*)\1$""", "$2")


def selector_matches(selector: str, valued: Callable[[str], Column] = attribute) -> Column:
    """Whether an opening tag matches tag, .class, #id or [attr*="value"]. valued gives an attribute's value by its name."""
    if selector.startswith("."):
        return F.concat(F.lit(" "), F.regexp_replace(valued("class"), r"\s+", " "), F.lit(" ")).contains(f" {selector[1:]} ")
    if selector.startswith("#"):
        return valued("id") == selector[1:]
    if found := re.fullmatch(r'\[(\w+)\*="(.*)"\]', selector):
        return valued(found[1]).contains(found[2])
    return F.col("tag") == selector.lower()


def _with_hits(tokens: DataFrame, selectors: tuple[str, ...] | list[str]) -> DataFrame:
    """tokens with hits, the selectors that each one matches. Each attribute that selectors ask for is read once."""
    asked: dict[str, Column] = {}
    found = [F.when(selector_matches(s, lambda name: asked.setdefault(name.lower(), F.col(f"asked_{name.lower()}"))), F.lit(s)) for s in selectors]
    hits = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    valued = tokens.select("*", *(attribute(name).alias(f"asked_{name}") for name in asked))
    return valued.select(*tokens.columns, F.when(F.col("kind") == "open", hits).alias("hits"))


_ANY_PART = r"""^\[(\w+)\*=["']?(.*?)["']?\]$"""


def _selector_hits(opened: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, tok_no, next_tok, selector) of opening tags and a table of selectors (selector) of any size.

    Tags, classes and ids meet selectors by equality. [attr*="value"] meets an attribute's value by its first three characters, and only then is the rest compared.
    """
    r = rules.select(F.trim("selector").alias("selector")).filter("selector <> ''").distinct()
    part = F.regexp_extract("selector", _ANY_PART, 2)
    plain = r.filter(part == "").select("selector", F.when(F.col("selector").rlike("^[.#]"), F.col("selector")).otherwise(F.lower("selector")).alias("key"))
    classes = F.transform(F.filter(F.split(attribute("class"), r"\s+"), lambda x: x != ""), lambda x: F.concat(F.lit("."), x))
    keys = F.array_distinct(F.concat(F.array(F.col("tag")), classes, F.array(F.concat(F.lit("#"), attribute("id")))))
    columns = ["page_id", "tok_no", "next_tok"]
    found = [opened.select(*columns, F.explode(keys).alias("key")).join(plain, "key").select(*columns, "selector")]
    held = r.filter(part != "").select("selector", F.lower(F.regexp_extract("selector", _ANY_PART, 1)).alias("attr"), part.alias("part")).withColumn("gram", F.left("part", F.lit(3)))
    # A name for each attribute that selectors ask for, of which a page has few.
    for name in sorted(x["attr"] for x in held.select("attr").distinct().collect()):
        valued = opened.select(*columns, attribute(name).alias("value")).filter("value <> ''")
        grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.substring(F.col("value"), i, k))))
        met = valued.select(*columns, "value", F.explode(F.array_distinct(grams)).alias("gram")).join(held.filter(F.col("attr") == name), "gram")
        found.append(met.filter(F.contains("value", "part")).select(*columns, "selector").distinct())
    return reduce(DataFrame.union, found)


def _is_tag() -> Column:
    """Whether a token begins or ends an element: not a void or self-closing tag."""
    return F.col("kind").isin("open", "close") & ~F.col("tag").isin(VOID_TAGS) & (~F.col("attrs").endswith("/") | (F.col("kind") == "close"))


def _with_ends(tokens: DataFrame) -> DataFrame:
    """tokens with is_tag (not for void and self-closing ones) and next_tok: the end tag of an opening tag's element, null where there is none.

    An end tag belongs to the last open tag of its name, by depth within the page and name, so other unclosed tags do no harm.
    """
    own = Window.partitionBy("page_id", "is_tag", "tag").orderBy("tok_no")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = tokens.withColumn("is_tag", _is_tag()).withColumn("depth", F.sum(step).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    level = depth.withColumn("level", F.col("depth") + F.when(F.col("kind") == "close", 1).otherwise(0))
    same = Window.partitionBy("page_id", "is_tag", "tag", "level").orderBy("tok_no")
    return level.withColumn("next_tok", F.when(F.lead("kind").over(same) == "close", F.lead("tok_no").over(same))).drop("depth", "level")


def element_extents(tokens: DataFrame, selectors: tuple[str, ...] | list[str] | DataFrame) -> DataFrame:
    """(page_id, selector, start_tok, end_tok) of the elements that match selectors (a list, or a table of any size); an element without end tag reaches the page's last token."""
    last = F.max("tok_no").over(Window.partitionBy("page_id"))
    table = isinstance(selectors, DataFrame)
    ended = _with_ends(tokens if table else _with_hits(tokens, selectors))
    opened = ended.withColumn("next_tok", F.coalesce("next_tok", last)).filter("is_tag and kind = 'open' and page_id is not null")
    hits = _selector_hits(opened, selectors) if table else opened.select("page_id", "tok_no", "next_tok", F.explode_outer("hits").alias("selector")).filter("selector is not null")
    return hits.select("page_id", "selector", F.col("tok_no").alias("start_tok"), F.col("next_tok").alias("end_tok"))


def clean_noise(tokens: DataFrame, selectors: tuple[str, ...] | list[str] | DataFrame = PAGE_NOISE) -> tuple[DataFrame, DataFrame]:
    """(tokens outside all matching elements, (page_id, selector, removed) counts).

    A token is inside an element if the furthest end of those that began before reaches it: one running maximum over a page. A list of selectors is
    matched in the tokens' own rows, so tokens that are dealt by page meet nothing; one without end tag hides all that follows; hits of a table of selectors are joined to them.
    """
    extents = element_extents(tokens, selectors)
    if isinstance(selectors, DataFrame):
        ends = extents.groupBy("page_id", F.col("start_tok").alias("tok_no")).agg(F.max("end_tok").alias("end_tok"))
        marked = tokens.join(ends, ["page_id", "tok_no"], "left")
    else:
        hit = F.col("is_tag") & (F.size("hits") > 0)
        marked = _with_ends(_with_hits(tokens, selectors)).withColumn("end_tok", F.when(hit, F.coalesce("next_tok", F.lit(2**31 - 1))))
    reach = marked.withColumn("reach", F.max("end_tok").over(Window.partitionBy("page_id").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)))
    kept = reach.filter("reach is null or reach < tok_no").select(*tokens.columns)
    return kept, extents.groupBy("page_id", "selector").agg(F.count(F.lit(1)).alias("removed"))


def joined_in_order(value: str, order: str, separator: str = "") -> Column:
    """The strings of a group in the order of a column, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]), separator)


def content_tokens(tokens: DataFrame, selector: str = "article") -> DataFrame:
    """The tokens inside the first element of each page that matches, found in the tokens' own rows: one order of a page's tokens serves all windows, and nothing is joined.

    The element ends where as many of its tags have ended as have begun, or else at the page's last token.
    """
    ordered = Window.partitionBy("page_id").orderBy("tok_no")
    page, upto = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), ordered.rowsBetween(Window.unboundedPreceding, 0)
    hit = _is_tag() & (F.col("kind") == "open") & F.col("page_id").isNotNull() & selector_matches(selector)
    found = tokens.withColumns({"element": F.min(F.when(hit, F.struct("tok_no", "tag"))).over(page), "last_tok": F.max("tok_no").over(page)})
    step = F.when(_is_tag() & (F.col("tag") == F.col("element.tag")), F.when(F.col("kind") == "open", 1).otherwise(-1)).otherwise(0)
    depth = found.filter("tok_no >= element.tok_no").withColumn("depth", F.sum(step).over(upto))
    ended = depth.withColumn("end_tok", F.coalesce(F.min(F.when(F.col("depth") == 0, F.col("tok_no"))).over(page), F.col("last_tok")))
    return ended.filter("tok_no > element.tok_no and tok_no < end_tok").select(*tokens.columns)


def page_titles(tokens: DataFrame) -> DataFrame:
    """(page_id, title): the text of the title element, decoded and trimmed; empty where there is none."""
    named = tokens.withColumn("before", F.lag("tag").over(Window.partitionBy("page_id").orderBy("tok_no")))
    is_title = (F.col("kind") == "text") & (F.col("before") == "title")
    title = F.min_by(F.when(is_title, F.col("text")), F.when(is_title, F.col("tok_no")))
    return named.groupBy("page_id").agg(F.coalesce(T.trim_all(T.decode_entities(title)), F.lit("")).alias("title"))


def extract_content(tokens: DataFrame, selector: str = "article", strip: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, title, html): the content of the first element that matches, without the strip selectors; html is null where none does."""
    kept = clean_noise(tokens, strip)[0] if strip else tokens
    html = content_tokens(kept, selector).groupBy("page_id").agg(joined_in_order("text", "tok_no").alias("html"))
    return page_titles(tokens).join(html, "page_id", "left").select("page_id", "title", "html")


def fragments(tokens: DataFrame) -> DataFrame:
    """tokens with frag, the Markdown that each one becomes."""
    page = Window.partitionBy("page_id").orderBy("tok_no")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.withColumn("href", F.last(F.when((F.col("kind") == "open") & (F.col("tag") == "a"), attribute("href")), ignorenulls=True).over(upto))
    o, c, tag = F.col("kind") == "open", F.col("kind") == "close", F.col("tag")
    count = lambda which, over: F.sum(which.cast("int")).over(over)
    # What began since the last mark: a running count less what it was there. So tables and lists need no order of their own.
    since = lambda name, mark, over: F.col(name) - F.coalesce(F.last(F.when(mark, F.col(name)), ignorenulls=True).over(over), F.lit(0))
    step = lambda *tags: F.sum(F.when(o & tag.isin(*tags), 1).when(c & tag.isin(*tags), -1).otherwise(0)).over(upto)
    t = t.withColumns({"rows_ended": count(c & (tag == "tr"), upto), "cells": count(o & tag.isin("td", "th"), upto), "in_pre": step("pre") > 0, "list_depth": step("ul", "ol")})
    t = t.withColumns({name: since(name, o & (tag == "table"), upto) for name in ("rows_ended", "cells")})
    # The list of an item is the last one that began at its depth.
    at_depth = Window.partitionBy("page_id", "list_depth").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)
    begins = o & tag.isin("ul", "ol")
    t = t.withColumns({"item_no": count(o & (tag == "li"), at_depth), "list_kind": F.last(F.when(begins, tag), ignorenulls=True).over(at_depth)})
    t = t.withColumn("item_no", since("item_no", begins, at_depth))
    heading = tag.rlike("^h[1-6]$")
    bullet = F.when(F.col("list_kind") == "ol", F.concat(F.col("item_no").cast("string"), F.lit(". "))).otherwise("- ")
    words = F.translate(T.decode_entities(F.col("text")), HELD, REPLACED)
    frag = (
        F.when((F.col("kind") == "text") & F.col("in_pre"), F.translate(words, " \n\t", HELD))
        .when(F.col("kind") == "text", F.regexp_replace(words, r"\s+", " "))
        .when(o & heading, F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring("tag", 2, 1).try_cast("int")), F.lit(" ")))
        .when(c & heading, "\n\n")
        .when((o | c) & tag.isin("p", "ul", "ol", "div", "table", "section", "article", "blockquote"), "\n\n")
        .when(o & (tag == "li"), F.concat(F.lit("\n"), bullet))
        .when(o & (tag == "br"), "\n")
        .when(o & (tag == "hr"), "\n\n---\n\n")
        .when((o | c) & tag.isin("b", "strong"), "**")
        .when((o | c) & tag.isin("i", "em"), "*")
        .when((o | c) & (tag == "code") & ~F.col("in_pre"), "`")
        .when((o | c) & (tag == "pre"), "\n```\n")
        .when(o & (tag == "a"), "[")
        .when(c & (tag == "a"), F.concat(F.lit("]("), F.coalesce("href", F.lit("")), F.lit(")")))
        .when(o & tag.isin("td", "th"), "| ")
        .when(c & tag.isin("td", "th"), " ")
        .when(c & (tag == "tr"), F.concat(F.lit("|\n"), F.when(F.col("rows_ended") == 1, F.concat(F.repeat(F.lit("| --- "), F.col("cells").cast("int")), F.lit("|\n"))).otherwise("")))
        .otherwise("")
    )
    return t.select("page_id", "tok_no", frag.alias("frag"))


def html_to_markdown(tokens: DataFrame) -> DataFrame:
    """(page_id, markdown): headings, paragraphs, lists, links, emphasis, code and tables; zero-widths removed, trimmed. Preformatted text keeps its white space."""
    whole = fragments(tokens).groupBy("page_id").agg(joined_in_order("frag", "tok_no").alias("md"))
    md = F.regexp_replace(F.regexp_replace("md", r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")
    return whole.select("page_id", F.translate(T.trim_all(F.translate(md, T.ZERO_WIDTH, "")), HELD, " \n\t").alias("markdown"))


def page_envelope(pages_md: DataFrame, include_title: bool = True, include_source: bool = True) -> DataFrame:
    """pages_md (url, title, markdown, ...) with the title and source lines before the text and a newline at its end."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"))).otherwise("") if include_title else F.lit("")
    source = F.concat(F.lit("> Source: "), F.col("url"), F.lit("\n\n")) if include_source else F.lit("")
    whole = F.concat(title, source, F.coalesce("markdown", F.lit("")))
    return pages_md.withColumn("markdown", F.when(whole.endswith("\n"), whole).otherwise(F.concat(whole, F.lit("\n"))))


def page_snapshot(pages: DataFrame, tokens: DataFrame, headings: int = 30, preview: int = 800) -> DataFrame:
    """(page_id, url, title, outline, preview): the first h1 to h4 as `tag: text`, and the start of the page's text."""
    page = Window.partitionBy("page_id").orderBy("tok_no")
    t = tokens.withColumn("before_kind", F.lag("kind").over(page)).withColumn("before", F.lag("tag").over(page))
    heads = t.filter("kind = 'text' and before_kind = 'open' and before in ('h1', 'h2', 'h3', 'h4')")
    line = F.concat(F.col("before"), F.lit(": "), F.left(T.trim_all(T.decode_entities(F.col("text"))), F.lit(120)))
    ranked = heads.select("page_id", line.alias("line"), "tok_no", F.row_number().over(page).alias("rank")).filter(F.col("rank") <= headings)
    outline = ranked.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_no", "line"))), lambda x: x["line"]).alias("outline"))
    title = t.filter("kind = 'text' and before_kind = 'open' and before = 'title'").groupBy("page_id").agg(F.min_by("text", "tok_no").alias("title"))
    body = t.filter("kind = 'text' and coalesce(before, '') <> 'title'").groupBy("page_id").agg(joined_in_order("text", "tok_no", " ").alias("words"))
    flat = T.trim_all(F.regexp_replace(T.decode_entities(F.col("words")), r"\s+", " "))
    joined = pages.select("page_id", "url").join(title, "page_id", "left").join(outline, "page_id", "left").join(body, "page_id", "left")
    return joined.select(
        "page_id", "url", T.trim_all(T.decode_entities(F.coalesce("title", F.lit("")))).alias("title"), F.coalesce("outline", F.array().cast("array<string>")).alias("outline"), F.left(F.coalesce(flat, F.lit("")), F.lit(preview)).alias("preview")
    )


def truncate_text(df: DataFrame, col: str, n: int) -> DataFrame:
    """df with a column cut to n characters and a notice; n outside 1 to 500,000 is an error."""
    if not 1 <= n <= 500_000:
        raise ValueError("n must lie in 1..500000")
    return df.withColumn(col, F.when(F.length(col) > n, F.concat(F.left(F.col(col), F.lit(n)), F.lit(NOTICE.format(n=n)))).otherwise(F.col(col)))


def extract_status(extracted: DataFrame) -> DataFrame:
    """(page_id, status) of extractions (page_id, html, markdown): null, empty_html, empty_markdown or ok."""
    status = (
        F.when(F.col("html").isNull(), "null").when(T.trim_all(F.col("html")) == "", "empty_html").when(T.trim_all(F.coalesce("markdown", F.lit(""))) == "", "empty_markdown").otherwise("ok")
    )
    return extracted.select("page_id", status.alias("status"))


def noise_removed(pages: DataFrame, tokens: DataFrame, selectors: tuple[str, ...] | list[str] = PAGE_NOISE) -> DataFrame:
    """(host, selector, removed): elements removed by host and selector, with totals (null) by rollup."""
    host = pages.select("page_id", F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("host"))
    return clean_noise(tokens, selectors)[1].join(host, "page_id").rollup("host", "selector").agg(F.sum("removed").alias("removed"))


def url_filter(pages: DataFrame, pattern: str, col: str = "url") -> DataFrame:
    """Pages whose URL matches: blank or * all, a leading / the path alone, no wildcard equality or prefix, else a glob."""
    pattern = pattern.strip()
    if pattern in ("", "*"):
        return pages
    hay = T.url_path(F.col(col)) if pattern.startswith("/") else F.col(col)
    return pages.filter(hay.rlike(T.glob_regex(pattern)) if re.search(r"[*?]", pattern) else hay.startswith(pattern))


RULES = "ord int, recipe_id string, scheme string, host_key string, path_kind string, path string"
_PATTERN = re.compile(r"(?:(?P<scheme>\*|https?)://)?(?P<host>[^/]*)(?P<path>/.*)?", re.I | re.S)


def recipe_rules(recipes: list[tuple[str, str]]) -> list[tuple]:
    """RULES rows of recipes (id, pattern): what a URL's host (a name, *.domain or none), scheme and path must be.

    A path is to be equal (`is`), to start with a text (`from`), to be a folder or below it (`in`), to fit a regular expression (`like`), or anything.
    """
    rows = []
    for ord_, (recipe_id, pattern) in enumerate(recipes):
        found = _PATTERN.fullmatch(pattern.strip())
        scheme, host, path = found["scheme"], found["host"].lower(), found["path"]
        if host in ("", "*") and not scheme:
            globbed = path and re.search(r"[*?]", path)
            rule = (None, [""], "like" if globbed else "from" if path else "any", T.glob_regex(path) if globbed else path)
        else:
            hosts = [host] if host.startswith("*.") else [host, f"www.{host}"]
            if scheme in (None, "*"):
                rest = (path or "/")[1:]
                rule = (None, hosts, *(("any", None) if rest in ("", "*") else ("from", "/" + rest.removesuffix("*"))))
            else:
                folder = re.sub(r"/\*+/?$", "", path or "/")
                kind = ("is", path or "/") if folder == (path or "/") else ("in", folder) if folder else ("any", None)
                rule = (scheme.lower(), hosts, *kind)
        rows += [(ord_, recipe_id, rule[0], key, rule[2], rule[3]) for key in rule[1]]
    return rows


def recipe_first_match(pages: DataFrame, recipes: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(page_id, recipe_id): the first recipe whose pattern fits the page's URL; null if none does. recipes is a list of (id, pattern), or a table (ord, recipe_id, pattern).

    URLs meet the rules by an equi-join on their host and the domains above it.
    """
    if isinstance(recipes, DataFrame):

        def read(frames):
            for f in frames:
                rows = [(ord_, *row[1:]) for ord_, i, p in zip(f["ord"], f["recipe_id"], f["pattern"], strict=True) for row in recipe_rules([(i, p)])]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in RULES.split(", ")])

        rules = recipes.select(F.col("ord").cast("int").alias("ord"), "recipe_id", "pattern").mapInPandas(read, RULES)
    else:
        rules = pages.sparkSession.createDataFrame(recipe_rules(recipes), RULES)
    host = F.lower(F.regexp_extract("url", r"^[^:]+://([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = pages.select("page_id", F.lower(F.regexp_extract("url", "^([^:]+)://", 1)).alias("page_scheme"), T.url_path(F.col("url")).alias("page_path"), F.array_distinct(F.concat(F.array(F.lit(""), host), domains)).alias("keys"))
    met = parts.select("page_id", "page_scheme", "page_path", F.explode("keys").alias("host_key")).join(rules, "host_key")
    kind, own, want = F.col("path_kind"), F.col("page_path"), F.col("path")
    fits = F.when(kind == "any", True).when(kind == "is", own == want).when(kind == "from", own.startswith(want)).when(kind == "in", (own == want) | own.startswith(F.concat(want, F.lit("/")))).otherwise(F.expr("page_path rlike path"))
    first = met.filter((F.col("scheme").isNull() | (F.col("scheme") == F.col("page_scheme"))) & fits).groupBy("page_id").agg(F.min_by("recipe_id", "ord").alias("recipe_id"))
    return pages.select("page_id").join(first, "page_id", "left")


def url_equivalence(pages: DataFrame) -> DataFrame:
    """(url_key, n, page_ids): pages by the target that their URLs share."""
    return pages.groupBy(T.url_key(F.col("url")).alias("url_key")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("page_id")).alias("page_ids"))


def url_classes(pages: DataFrame) -> DataFrame:
    """(page_id, url_key, representative): pages with the smallest page_id of those whose URLs share their target. No group is gathered, so any number of pages may share one."""
    keyed = pages.select("page_id", T.url_key(F.col("url")).alias("url_key"))
    first = keyed.groupBy("url_key").agg(F.min("page_id").alias("representative"))
    return keyed.join(first, "url_key").select("page_id", "url_key", "representative")


def best_target(targets: DataFrame, preferred: str | None = None) -> DataFrame:
    """(grp, url, score): the best candidate page of each group; the last of equals wins."""
    url = F.col("url")
    score = (F.when(T.url_key(url) == T.url_key(F.lit(preferred)), 10_000).otherwise(0) if preferred else F.lit(0)) + (
        F.when(url.rlike("^https?://"), 1000 + F.least(F.octet_length(T.trim_all(F.col("title"))), F.lit(200)) + F.least(F.octet_length(url), F.lit(100)))
        .when(url == "about:blank", -500)
        .when(url.rlike("^chrome(-untrusted)?://"), -2000)
        .when(url.startswith("devtools://"), -5000)
        .otherwise(-100)
    )
    return targets.withColumn("score", score).groupBy("grp").agg(F.max_by(F.struct("url", "score"), F.struct("score", "ord")).alias("best")).select("grp", "best.url", "best.score")


def baseline_compare(captures: DataFrame) -> DataFrame:
    """(session_key, chars_before, chars_after, retained) of captures (url, captured_seq, markdown): first against last."""
    both = captures.withColumn("session_key", T.session_key(F.col("url"))).groupBy("session_key").agg(F.min_by("markdown", "captured_seq").alias("a"), F.max_by("markdown", "captured_seq").alias("b"))
    before, after = F.length("a"), F.length("b")
    return both.select("session_key", before.alias("chars_before"), after.alias("chars_after"), F.round(F.try_divide(after, before), 6).alias("retained"))


def session_history(captures: DataFrame) -> DataFrame:
    """(session_key, baseline, current): the first capture, never overwritten, and the latest."""
    return captures.groupBy(T.session_key(F.col("url")).alias("session_key")).agg(F.min_by("markdown", "captured_seq").alias("baseline"), F.max_by("markdown", "captured_seq").alias("current"))


def html_resource_refs(tokens: DataFrame) -> DataFrame:
    """(page_id, tok_no, attr, ref): src, poster and link href attributes, and CSS url() in styles and style attributes."""
    named = lambda name, only=None: tokens.filter((F.col("kind") == "open") & ((F.col("tag") == only) if only else F.lit(True))).select("page_id", "tok_no", F.lit(name).alias("attr"), attribute(name).alias("ref"))
    css = tokens.filter("(kind = 'raw' and tag = 'style') or kind = 'open'").select("page_id", "tok_no", F.lit("css").alias("attr"), F.explode(F.regexp_extract_all("text", F.lit(T.CSS_URL), F.lit(1))).alias("ref"))
    return named("src").union(named("poster")).union(named("href", "link")).union(css).filter("ref <> ''")


def bundle_html_resources(tokens: DataFrame, assets: DataFrame, placeholder: str = "data:,", max_bytes: int = 25 << 20) -> DataFrame:
    """(page_id, html, n_inlined, n_failed): every src, poster and link href attribute and CSS url() replaced by the data URI of its asset (path, mime, content).

    Fragments and data URIs stay. A reference without asset, or with one of over max_bytes, becomes the placeholder and counts as failed. Only
    tags and style sheets that refer to something are cut in pieces, and only their references meet the assets.
    """
    pieces = F.when(F.col("tag") == "link", F.regexp_extract_all("text", F.lit(PIECE_RX.format(names="src|poster|href")), F.lit(0))).otherwise(
        F.regexp_extract_all("text", F.lit(PIECE_RX.format(names="src|poster")), F.lit(0))
    )
    may_refer = ((F.col("kind") == "open") | ((F.col("kind") == "raw") & (F.col("tag") == "style"))) & F.col("text").rlike(r"(?is)\s(src|poster|href)\s*=|url\(")
    cut = tokens.filter(may_refer).select("page_id", "tok_no", F.posexplode(pieces).alias("part", "piece"))
    css = F.col("piece").rlike(CSS_RX)
    is_attr = F.col("piece").rlike(ATTR_RX)
    ref = F.when(is_attr, F.regexp_extract("piece", ATTR_RX, 2)).when(css, F.regexp_extract("piece", CSS_RX, 1))
    cut = cut.withColumn("ref", F.when(~F.trim(ref).rlike("^(#|data:|$)"), ref))
    data = F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.base64("content"))
    known = assets.filter((F.octet_length("content") <= max_bytes)).select(F.col("path").alias("ref"), data.alias("data"))
    refs = cut.filter("ref is not null").join(known, "ref", "left")
    uri = F.coalesce("data", F.lit(placeholder))
    quote = F.right("piece", F.lit(1))
    new = F.when(css, F.concat(F.lit('url("'), uri, F.lit('")'))).otherwise(F.concat(F.regexp_extract("piece", ATTR_RX, 1), quote, uri, quote))
    whole = cut.filter("ref is null").select("page_id", "tok_no", "part", F.col("piece").alias("new"), F.lit(None).cast("boolean").alias("hit"))
    whole = whole.union(refs.select("page_id", "tok_no", "part", new, F.col("data").isNotNull()))
    rest = tokens.filter(~may_refer).select("page_id", "tok_no", F.lit(0), "text", F.lit(None).cast("boolean"))
    order = F.array_sort(F.collect_list(F.struct("tok_no", "part", "new")))
    return whole.union(rest).groupBy("page_id").agg(
        F.array_join(F.transform(order, lambda x: x["new"]), "").alias("html"), F.count(F.when(F.col("hit"), 1)).alias("n_inlined"), F.count(F.when(~F.col("hit"), 1)).alias("n_failed")
    )


def page_report(pages: DataFrame) -> DataFrame:
    """(host, pages, removed, chars_kept): pages cleaned, extracted and turned into Markdown, by host."""
    tokens = tokens_by_page(scan_pages(pages))
    clean, removed = clean_noise(tokens)
    md = html_to_markdown(content_tokens(clean, "article"))
    gone = removed.groupBy("page_id").agg(F.sum("removed").alias("removed"))
    host = pages.select("page_id", F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("host"))
    joined = host.join(md, "page_id", "left").join(gone, "page_id", "left")
    return joined.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("removed", F.lit(0))).alias("removed"), F.sum(F.coalesce(F.length("markdown"), F.lit(0))).alias("chars_kept"))
