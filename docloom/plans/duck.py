"""Pieces of DuckDB text that the oracles share."""

from __future__ import annotations

from docloom.functions import text as T
from docloom.operators import web

NS = T.URL_NAMESPACE


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def slug(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


def decode(x: str) -> str:
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{mark}')"
    return x


def plain(x: str) -> str:
    x = rf"regexp_replace({x}, '!?\[([^\]\[]*)\]\([^)]*\)', '\1', 'g')"
    x = rf"regexp_replace({x}, '`+([^`]*)`+', '\1', 'g')"
    x = rf"regexp_replace({x}, '\*{{1,3}}([^*]+)\*{{1,3}}', '\1', 'g')"
    x = rf"regexp_replace({x}, '[\r\n]+', ' ', 'g')"
    return f"regexp_replace({x}, '[{T.ZERO_WIDTH}]', '', 'g')"


def url_key(x: str) -> str:
    low = f"split_part(lower({trim(x)}), '#', 1)"
    return f"(CASE WHEN length({low}) <= 9 THEN {low} WHEN length(rtrim({low}, '/')) < 9 THEN left({low}, 9) ELSE rtrim({low}, '/') END)"


def url_path(x: str) -> str:
    after = f"substr({x}, strpos({x}, '://') + 3)"
    return (
        f"(CASE WHEN strpos({x}, '://') = 0 THEN regexp_replace({x}, '(?s)[?#].*$', '') WHEN strpos({after}, '/') = 0 THEN '/' "
        f"ELSE regexp_replace(substr({after}, strpos({after}, '/')), '(?s)[?#].*$', '') END)"
    )


def session_key(x: str) -> str:
    bare = f"split_part({trim(x)}, '#', 1)"
    h = f"sha1(unhex('{NS}') || encode({bare}))"
    return (
        f"(CASE WHEN {bare} = '' THEN '_unbound' ELSE substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) END)"
    )


def attribute(name: str) -> str:
    rx = r'''(?is)(?:^|\s){name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'''.replace("{name}", name)
    return f"trim(regexp_extract(attrs, '{rx}', 1), '\"''')"


def matches(selector: str) -> str:
    if selector.startswith("."):
        return rf"contains(' ' || regexp_replace({attribute('class')}, '\s+', ' ', 'g') || ' ', ' {selector[1:]} ')"
    if selector.startswith("["):
        name, value = selector[1:].split("*=")
        value = value.strip('"]')
        return f"contains({attribute(name)}, '{value}')"
    return f"tag = '{selector}'"


KIND = r"""CASE WHEN starts_with(text, '<!--') THEN 'comment' WHEN starts_with(text, '<!') THEN 'decl'
  WHEN regexp_matches(text, '(?is)^<(script|style)\b.*</(script|style)\s*>$') THEN 'raw'
  WHEN regexp_matches(text, '^</[a-zA-Z]') THEN 'close' WHEN regexp_matches(text, '^<[a-zA-Z]') THEN 'open' ELSE 'text' END"""
_TAG_OR_TEXT = r'''(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<(?:[^"'>]|"[^"]*"|'[^']*')+>|<[^>]+>|[^<]+'''
TOKENS = rf"""
raw_tokens AS (
  SELECT page_id, unnest(t) AS text, unnest(generate_series(0, len(t) - 1)) AS tok_no
  FROM (SELECT page_id, regexp_extract_all(html, {q(_TAG_OR_TEXT)}) AS t FROM pages WHERE coalesce({trim('html')}, '') <> '')),
tokens AS (
  SELECT page_id, tok_no, kind, lower(regexp_extract(text, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
         trim(CASE WHEN kind = 'open' THEN regexp_extract(text, '(?s)^<[a-zA-Z][a-zA-Z0-9]*(.*)>$', 1) ELSE '' END) AS attrs, text
  FROM (SELECT *, {KIND} AS kind FROM raw_tokens))"""
VOIDS = ", ".join(q(t) for t in web.VOID_TAGS)


def extents(selectors, name: str = "extents") -> str:
    """A CTE of element extents: an end tag closes the last open tag of its name, found by running depths and a self join."""
    picks = ", ".join(f"CASE WHEN {matches(s)} THEN {q(s)} END" for s in selectors)
    return f"""
{name}_tags AS (
  SELECT page_id, tok_no, kind, tag, attrs, sum(CASE WHEN kind = 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY tok_no) AS depth
  FROM tokens WHERE kind IN ('open', 'close') AND tag NOT IN ({VOIDS}) AND (kind = 'close' OR NOT ends_with(attrs, '/'))),
{name}_hits AS (
  SELECT page_id, tok_no, tag, depth, unnest(list_filter([{picks}], lambda x: x IS NOT NULL)) AS selector FROM {name}_tags WHERE kind = 'open'),
{name} AS (
  SELECT h.page_id, h.selector, h.tok_no AS start_tok,
         coalesce((SELECT min(c.tok_no) FROM {name}_tags c WHERE c.page_id = h.page_id AND c.tag = h.tag AND c.kind = 'close' AND c.tok_no > h.tok_no AND c.depth = h.depth - 1),
                  (SELECT max(m.tok_no) FROM tokens m WHERE m.page_id = h.page_id)) AS end_tok
  FROM {name}_hits h)"""


CLEAN = f"""{TOKENS},{extents(web.PAGE_NOISE, 'noise')},
clean AS (
  SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM noise n WHERE n.page_id = t.page_id AND t.tok_no BETWEEN n.start_tok AND n.end_tok))"""


def content(source: str = "clean") -> str:
    """A CTE of the source's tokens inside the first article."""
    return f"""{extents(['article'], 'art')},
first_art AS (SELECT page_id, min(start_tok) AS start_tok, arg_min(end_tok, start_tok) AS end_tok FROM art GROUP BY page_id),
content AS (SELECT c.* FROM {source} c JOIN first_art f ON f.page_id = c.page_id AND c.tok_no > f.start_tok AND c.tok_no < f.end_tok)"""


TITLES = f"""
titles AS (
  SELECT page_id, coalesce({trim(decode("arg_min(text, tok_no) FILTER (kind = 'text' AND before = 'title')"))}, '') AS title
  FROM (SELECT *, lag(tag) OVER (PARTITION BY page_id ORDER BY tok_no) AS before FROM tokens) GROUP BY page_id)"""
_W = "(PARTITION BY page_id ORDER BY tok_no)"
MARKDOWN = rf"""
marked AS (
  SELECT *, last_value(CASE WHEN kind = 'open' AND tag = 'a' THEN {attribute('href')} END IGNORE NULLS) OVER {_W} AS href,
         sum((kind = 'open' AND tag = 'table')::INT) OVER {_W} AS table_no,
         sum(CASE WHEN tag <> 'pre' THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER {_W} > 0 AS in_pre,
         sum(CASE WHEN tag NOT IN ('ul', 'ol') THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER {_W} AS list_depth FROM content),
marked_lists AS (
  SELECT *, sum((kind = 'open' AND tag IN ('ul', 'ol'))::INT) OVER (PARTITION BY page_id, list_depth ORDER BY tok_no) AS list_no,
         last_value(CASE WHEN kind = 'open' AND tag IN ('ul', 'ol') THEN tag END IGNORE NULLS) OVER (PARTITION BY page_id, list_depth ORDER BY tok_no) AS list_kind FROM marked),
counted AS (
  SELECT *, sum((kind = 'open' AND tag = 'li')::INT) OVER (PARTITION BY page_id, list_depth, list_no ORDER BY tok_no) AS item_no,
         sum((kind = 'close' AND tag = 'tr')::INT) OVER (PARTITION BY page_id, table_no ORDER BY tok_no) AS rows_ended,
         sum((kind = 'open' AND tag IN ('td', 'th'))::INT) OVER (PARTITION BY page_id, table_no ORDER BY tok_no) AS cells FROM marked_lists),
frags AS (
  SELECT page_id, tok_no, CASE
    WHEN kind = 'text' AND in_pre THEN translate({decode('text')}, ' ' || chr(10) || chr(9), '{web.HELD}')
    WHEN kind = 'text' THEN regexp_replace({decode('text')}, '\s+', ' ', 'g')
    WHEN kind NOT IN ('open', 'close') THEN ''
    WHEN kind = 'open' AND regexp_matches(tag, '^h[1-6]$') THEN chr(10) || chr(10) || repeat('#', substr(tag, 2, 1)::INT) || ' '
    WHEN regexp_matches(tag, '^h[1-6]$') OR tag IN ('p', 'ul', 'ol', 'div', 'table', 'section', 'article', 'blockquote') THEN chr(10) || chr(10)
    WHEN kind = 'open' AND tag = 'li' THEN chr(10) || CASE WHEN list_kind = 'ol' THEN item_no || '. ' ELSE '- ' END WHEN kind = 'open' AND tag = 'br' THEN chr(10)
    WHEN kind = 'open' AND tag = 'hr' THEN chr(10) || chr(10) || '---' || chr(10) || chr(10)
    WHEN tag IN ('b', 'strong') THEN '**' WHEN tag IN ('i', 'em') THEN '*' WHEN tag = 'code' AND NOT in_pre THEN '`' WHEN tag = 'code' THEN ''
    WHEN tag = 'pre' THEN chr(10) || '```' || chr(10)
    WHEN kind = 'open' AND tag = 'a' THEN '[' WHEN tag = 'a' THEN '](' || coalesce(href, '') || ')'
    WHEN kind = 'open' AND tag IN ('td', 'th') THEN '| ' WHEN tag IN ('td', 'th') THEN ' '
    WHEN kind = 'close' AND tag = 'tr' THEN '|' || chr(10) || CASE WHEN rows_ended = 1 THEN repeat('| --- ', cells::INT) || '|' || chr(10) ELSE '' END
    ELSE '' END AS frag FROM counted),
markdowns AS (
  SELECT page_id, translate({trim(f"regexp_replace(regexp_replace(regexp_replace(string_agg(frag, '' ORDER BY tok_no), '[ " + chr(92) + "t]*" + chr(92) + "n[ " + chr(92) + "t]*', chr(10), 'g'), '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g'), '[" + T.ZERO_WIDTH + "]', '', 'g')")}, '{web.HELD}', ' ' || chr(10) || chr(9)) AS markdown
  FROM frags GROUP BY page_id)"""
