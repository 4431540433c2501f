"""Queries on the Markdown corpus, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import ALIAS_KIND
from docloom.operators import markdown as M
from docloom.plans import duck as D
from docloom.sources import fixtures as X

_N = "chr(10)"
DOCS = f"docs AS ({X.duck_text(X.DOCS)})"


def _line_list(text: str) -> str:
    """A text's lines as a list, without a phantom last one."""
    parts = f"string_split({text}, {_N})"
    return f"list_transform(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END, lambda x: regexp_replace(x, '\\r$', ''))"


#: What YAML makes of the corpus's front matter, written by hand; blocks that documents share are lines of a lower-case word and a value.
_JUDGED = ", ".join(f"({D.q(chr(10).join(lines))}, {'NULL' if fm is None else D.q(fm)})" for lines, fm in X.FRONT_MATTER.values())
BODY = rf"""{DOCS},
judged AS (SELECT * FROM (VALUES {_JUDGED}) AS j(block_text, fm_text)),
cut_lines AS (SELECT *, {_line_list("text")} AS l FROM docs),
cut_at AS (SELECT *, CASE WHEN trim(l[1]) = '---' THEN list_filter(generate_series(2, len(l)), lambda i: trim(l[i]) = '---')[1] END AS c FROM cut_lines),
cut_block AS (SELECT *, CASE WHEN c IS NOT NULL THEN l[2:c - 1] END AS block FROM cut_at),
cut_kinds AS (
  SELECT b.*, CASE WHEN len(list_filter(block, lambda x: trim(x) <> '')) = 0 THEN '' WHEN j.block_text IS NOT NULL THEN j.fm_text
    WHEN len(list_filter(block, lambda x: NOT regexp_matches(x, '^[a-z]+: [a-z0-9]+$'))) = 0 THEN array_to_string(list_sort(list_transform(block, lambda x: replace(x, ': ', '='))), ',') END AS fm
  FROM cut_block b LEFT JOIN judged j ON j.block_text = array_to_string(block, {_N})),
cut_kind AS (SELECT *, c IS NOT NULL AND fm IS NOT NULL AS has_fm FROM cut_kinds),
bodies AS (
  SELECT * EXCLUDE (l, c, block), CASE WHEN has_fm THEN array_to_string(l[c + 1:], {_N}) || CASE WHEN ends_with(text, {_N}) AND NOT ends_with(array_to_string(l[c + 1:], {_N}), {_N}) THEN {_N} ELSE '' END ELSE text END AS body FROM cut_kind),
body_lines AS (SELECT doc_id, source, lang, {_line_list("body")} AS l FROM bodies),
mlines AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(0, len(l) - 1)) AS line_no FROM body_lines)"""


def fences(lines: str = "mlines", name: str = "fences", code: bool = False) -> str:
    """CTEs of fences by walking their marks in order: of backticks and closed by exactly as many, or (code) of backticks or tildes and closed by as many or more."""
    mark = "(`{3,}|~{3,})" if code else "(`{3,})"
    opens = r"NOT regexp_matches(line, '^\s*`{3,}.*[^`].*`')" if code else "true"
    closes = "t.c = w.open_c AND t.n >= w.open_n" if code else "t.n = w.open_n"
    return rf"""
{name}_ticks AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM (
    SELECT doc_id, line_no, length(regexp_extract(line, '^\s*{mark}', 1)) AS n, left(ltrim(line), 1) AS c, regexp_matches(line, '^\s*(`+|~+)\s*$') AS bare, {opens} AS opens FROM {lines} WHERE regexp_matches(line, '^\s*{mark}')) WHERE opens),
{name}_walk AS (
  SELECT doc_id, k, line_no, n AS open_n, c AS open_c, line_no AS open_at, true AS is_open FROM {name}_ticks WHERE k = 1
  UNION ALL
  SELECT t.doc_id, t.k, t.line_no, CASE WHEN w.is_open THEN w.open_n ELSE t.n END, CASE WHEN w.is_open THEN w.open_c ELSE t.c END, CASE WHEN w.is_open THEN w.open_at ELSE t.line_no END,
         CASE WHEN w.is_open THEN NOT (t.bare AND {closes}) ELSE true END
  FROM {name}_walk w JOIN {name}_ticks t ON t.doc_id = w.doc_id AND t.k = w.k + 1),
{name} AS (
  SELECT w.doc_id, open_at AS a, CASE WHEN bool_or(NOT is_open) THEN max(w.line_no) ELSE any_value(m.last_line) END AS b, bool_or(NOT is_open) AS closed,
         row_number() OVER (PARTITION BY w.doc_id ORDER BY open_at) - 1 AS fence_id
  FROM {name}_walk w JOIN (SELECT doc_id, max(line_no) AS last_line FROM {lines} GROUP BY doc_id) m ON m.doc_id = w.doc_id GROUP BY w.doc_id, open_at)"""


#: Lines with the fences that footnotes see (masked), and with those of code (coded).
STRICT = f"""{BODY},{fences()},
masked AS (SELECT m.*, f.fence_id, f.fence_id IS NOT NULL AS in_fence FROM mlines m LEFT JOIN fences f ON f.doc_id = m.doc_id AND m.line_no BETWEEN f.a AND f.b)"""
FENCED = f"""{STRICT},{fences(name="code_fences", code=True)},
coded AS (SELECT m.*, f.fence_id IS NOT NULL AS in_fence FROM mlines m LEFT JOIN code_fences f ON f.doc_id = m.doc_id AND m.line_no BETWEEN f.a AND f.b)"""
_KIND = "CASE lower(trim({x})) " + " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in ALIAS_KIND.items()) + " END"
#: Markers of callouts: what stands before the kind, the kind, and the rest of the line.
_QUOTE, _COLONS, _BANGS = r"^[ ]{0,3}>\s*\[!([a-zA-Z]+)[-+]*\](.*)$", r"^\s*[:]{3}\s*([a-zA-Z]+)(.*)$", r"^\s*[!]{3}\s*([a-zA-Z]+)(.*)$"
CALLOUTS = rf"""
marks AS (
  SELECT doc_id, line_no, line, regexp_extract(line, '{_QUOTE}', 1) AS kq, regexp_extract(line, '{_COLONS}', 1) AS kf, regexp_extract(line, '{_BANGS}', 1) AS kb FROM mlines),
starts AS (
  SELECT doc_id, line_no AS i, CASE WHEN kq <> '' THEN '>' WHEN kf <> '' THEN ':::' ELSE '!!!' END AS syntax, {_KIND.format(x="CASE WHEN kq <> '' THEN kq WHEN kf <> '' THEN kf ELSE kb END")} AS kind,
         {D.trim(f"CASE WHEN kq <> '' THEN regexp_extract(line, '{_QUOTE}', 2) WHEN kf <> '' THEN regexp_extract(line, '{_COLONS}', 2) ELSE regexp_extract(line, '{_BANGS}', 2) END")} AS title
  FROM marks WHERE kq <> '' OR kf <> '' OR kb <> ''),
ends AS (
  SELECT s.*, (SELECT max(line_no) FROM mlines m WHERE m.doc_id = s.doc_id) AS last_line,
    (SELECT min(line_no) FROM mlines m WHERE m.doc_id = s.doc_id AND m.line_no > s.i AND CASE s.syntax WHEN '>' THEN NOT regexp_matches(m.line, '^ {{0,3}}>') WHEN ':::' THEN trim(m.line) = ':::' ELSE NOT regexp_matches(m.line, '^[ \t]|^\s*$') END) AS stop
  FROM starts s WHERE kind IS NOT NULL),
found AS (SELECT *, CASE WHEN syntax = ':::' THEN coalesce(stop, last_line) ELSE coalesce(stop - 1, last_line) END AS last, CASE WHEN syntax = ':::' THEN coalesce(stop - 1, last_line) ELSE coalesce(stop - 1, last_line) END AS last_body, 1 AS depth, NULL::INT AS parent FROM ends)"""


def _level(k: int) -> str:
    """CTEs of the quotes at depth k: those that begin in the bodies of the quotes one level up."""
    up, lines = ("found", "mlines") if k == 2 else (f"found{k - 1}", f"inner{k - 1}")
    same = "" if k == 2 else " AND m.parent = f.parent"
    return rf"""
inner{k} AS (SELECT m.doc_id, f.i AS parent, m.line_no, regexp_replace(m.line, '^ {{0,3}}> ?', '') AS line FROM {lines} m JOIN {up} f ON f.doc_id = m.doc_id AND m.line_no > f.i AND m.line_no <= f.last{same} WHERE f.syntax = '>'),
found{k} AS (
  SELECT s.doc_id, line_no AS i, '>' AS syntax, {_KIND.format(x=f"regexp_extract(line, '{_QUOTE}', 1)")} AS kind, {D.trim(f"regexp_extract(line, '{_QUOTE}', 2)")} AS title,
    coalesce((SELECT min(m.line_no) - 1 FROM inner{k} m WHERE m.doc_id = s.doc_id AND m.parent = s.parent AND m.line_no > s.line_no AND NOT regexp_matches(m.line, '^ {{0,3}}>')), (SELECT max(m.line_no) FROM inner{k} m WHERE m.doc_id = s.doc_id AND m.parent = s.parent)) AS last, {k} AS depth, parent
  FROM inner{k} s WHERE regexp_matches(line, '{_QUOTE}'))"""


_DEPTHS = range(2, 10)
NESTED = f"""{CALLOUTS},{",".join(map(_level, _DEPTHS))},
bodies1 AS (SELECT f.doc_id, f.i, f.depth, string_agg({{strip}}, {_N} ORDER BY m.line_no) AS body FROM found f JOIN mlines m ON m.doc_id = f.doc_id AND m.line_no > f.i AND m.line_no <= f.last_body GROUP BY ALL),
inner_bodies AS ({" UNION ALL ".join(f"SELECT f.doc_id, f.i, f.depth, string_agg(regexp_replace(m.line, '^ {{0,3}}> ?', ''), {_N} ORDER BY m.line_no) AS body FROM found{k} f JOIN inner{k} m ON m.doc_id = f.doc_id AND m.parent = f.parent AND m.line_no > f.i AND m.line_no <= f.last GROUP BY ALL" for k in _DEPTHS)}),
all_found AS (SELECT doc_id, i, syntax, kind, title, depth, parent FROM found {" ".join(f"UNION ALL SELECT doc_id, i, syntax, kind, title, depth, parent FROM found{k}" for k in _DEPTHS)}),
all_bodies AS (SELECT * FROM bodies1 UNION ALL SELECT * FROM inner_bodies)"""
_STRIP = r"CASE syntax WHEN '>' THEN regexp_replace(line, '^ {0,3}> ?', '') WHEN '!!!' THEN CASE WHEN regexp_matches(line, '^(    |\t)') THEN regexp_replace(line, '^(    |\t)', '') ELSE regexp_replace(line, '^\s+', '') END ELSE line END"
NESTED = NESTED.replace("{strip}", _STRIP.replace("line", "m.line"))
OPEN = f"""{FENCED},{CALLOUTS},
opened AS (SELECT *, EXISTS (SELECT 1 FROM found f WHERE f.doc_id = coded.doc_id AND f.syntax <> '>' AND coded.line_no BETWEEN f.i AND f.last) AS in_callout FROM coded)"""
_HEADING = r"^[ ]{0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"
HEADINGS = rf"""{OPEN},
raw_headings AS (
  SELECT doc_id, line_no, length(regexp_extract(line, '{_HEADING}', 1)) AS level, {D.plain(D.trim(f"regexp_extract(line, '{_HEADING}', 2)"))} AS text
  FROM opened WHERE NOT in_fence AND NOT in_callout AND regexp_matches(line, '{_HEADING}')),
slugged AS (SELECT *, CASE WHEN {D.slug('text')} = '' THEN 'heading' ELSE {D.slug('text')} END AS slug FROM raw_headings),
headings AS (
  SELECT *, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line_no) AS n FROM slugged))"""
BLOCKS = rf"""{FENCED},
infos AS (
  SELECT f.*, trim(regexp_replace(m.line, '^\s*(`+|~+)', '')) AS info FROM code_fences f JOIN mlines m ON m.doc_id = f.doc_id AND m.line_no = f.a),
blocks AS (
  SELECT i.doc_id, i.a AS start_line, i.info, lower(regexp_extract(i.info, '^(\S*)', 1)) AS lang, (i.b - i.a - i.closed::INT)::INT AS n_lines,
         coalesce((SELECT string_agg(m.line, {_N} ORDER BY m.line_no) FROM mlines m WHERE m.doc_id = i.doc_id AND m.line_no > i.a AND m.line_no <= i.b - i.closed::INT), '') AS code FROM infos i),
classed AS (
  SELECT *, CASE WHEN lang = 'diagram' AND regexp_extract(info, '^\S+\s+(\S+)', 1) = 'html' THEN 'diagram-html' WHEN lang IN ('math', 'latex') THEN 'math' WHEN lang IN ('mermaid', 'mmd') THEN 'mermaid'
    WHEN lang IN ('plantuml', 'puml', 'uml') THEN 'plantuml' WHEN lang = 'typst' THEN 'typst' WHEN lang = '' THEN 'plain' ELSE 'code' END AS class FROM blocks)"""
DEFS = rf"""
def_starts AS (SELECT doc_id, line_no, line, in_fence FROM masked WHERE regexp_matches(line, '{M.DEF}') AND NOT regexp_matches(line, '^(    |\t)')),
defs AS (
  SELECT s.doc_id, s.line_no, s.in_fence, regexp_extract(s.line, '{M.DEF}', 1) AS label,
    array_to_string(list_filter(list_concat([{D.trim(f"regexp_extract(s.line, '{M.DEF}', 2)")}],
      coalesce((SELECT list({D.trim('m.line')} ORDER BY m.line_no) FROM mlines m WHERE m.doc_id = s.doc_id AND m.line_no > s.line_no AND m.line_no <
        coalesce((SELECT min(z.line_no) FROM mlines z WHERE z.doc_id = s.doc_id AND z.line_no > s.line_no AND NOT regexp_matches(z.line, '^(    |\t)')), 1000000000)), [])), lambda x: x <> ''), {_N}) AS body
  FROM def_starts s),
first_defs AS (SELECT doc_id, label, body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY body = '', line_no) AS r FROM defs) WHERE r = 1)"""
REFS = r"""
refs AS (
  SELECT doc_id, line_no, regexp_extract(m, '\^([^\]]+)', 1) AS label
  FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\[\^([^\]\[:]+)\](:?)')) AS m FROM mlines) WHERE NOT ends_with(m, ':'))"""
#: Links by rewriting: what is escaped or code is blotted out, then the first bracket pair that holds no other is taken, again and again. A link becomes as many
#: characters of chr(2), anything else of chr(1), so places stay; a pair with a target that holds a link is none, unless it is an image.
_TARGET = r"""\((?:\s*<[^<>]*>|\s*[^()<\s]*(?:\([^()\s]*\)[^()\s]*)*)?(?:\s+(?:"[^"]*"|''[^'']*''|\([^()]*\)))?\s*\)"""
_PAIR = rf"!?\[[^\[\]]*\](?:{_TARGET})?"
LINKS = rf"""
ticked AS (
  SELECT doc_id, line_no, line, regexp_extract_all(regexp_replace(line, '\\[!-/:-@\[-`{{-~]', chr(1) || chr(1), 'g'), '`+|[^`]+') AS p FROM coded WHERE NOT in_fence AND contains(line, '](')),
unticked AS (
  SELECT doc_id, line_no, line, p, 1 AS k, '' AS m FROM ticked
  UNION ALL
  SELECT doc_id, line_no, line, p, k + 1 + j, m || CASE WHEN j > 0 THEN repeat(chr(1), length(array_to_string(p[k:k + j], ''))) ELSE p[k] END
  FROM (SELECT *, CASE WHEN starts_with(p[k], '`') THEN coalesce(list_position(p[k + 1:], p[k]), 0) ELSE 0 END AS j FROM unticked WHERE k <= len(p))),
blotted AS (SELECT doc_id, line_no, line, m FROM unticked WHERE k > len(p)),
rewritten AS (
  SELECT doc_id, line_no, line, m, 0 AS step, NULL::VARCHAR AS hit, 0 AS place FROM blotted
  UNION ALL
  SELECT doc_id, line_no, line, left(m, strpos(m, h) - 1) || repeat(CASE WHEN ends_with(h, ')') AND (NOT starts_with(h, '!') AND NOT contains(h, chr(2))) THEN chr(2) WHEN contains(h, chr(2)) THEN chr(2) ELSE chr(1) END, length(h)) || substr(m, strpos(m, h) + length(h)), step + 1, h, strpos(m, h)
  FROM (SELECT *, regexp_extract(m, '{_PAIR}') AS h FROM rewritten) WHERE h <> ''),
hits AS (
  SELECT doc_id, line_no, starts_with(hit, '!') AS is_image, substr(line, place, length(hit)) AS whole, strpos(hit, '](') AS cut FROM rewritten
  WHERE step > 0 AND ends_with(hit, ')') AND contains(hit, '](') AND (starts_with(hit, '!') OR NOT contains(hit, chr(2)))),
parts AS (
  SELECT doc_id, line_no, is_image, substr(whole, CASE WHEN is_image THEN 3 ELSE 2 END, cut - CASE WHEN is_image THEN 3 ELSE 2 END) AS inside, trim(substr(whole, cut + 2, length(whole) - cut - 2)) AS target FROM hits),
titled AS (SELECT *, regexp_extract(target, '(?:^|\s)("[^"]*"|''[^'']*''|\([^()]*\))$', 1) AS quoted FROM parts),
links AS (
  SELECT doc_id, line_no, is_image, {D.plain('inside')} AS text, regexp_replace(trim(left(target, length(target) - length(quoted))), '^<(.*)>$', '\1') AS dest, CASE WHEN quoted = '' THEN '' ELSE quoted[2:-2] END AS title FROM titled)"""
_NUMBER = r"CASE WHEN regexp_matches(label, '^\d{1,10}$') AND TRY_CAST(label AS BIGINT) < 4294967296 THEN TRY_CAST(label AS BIGINT) END"
MATH = rf"""
math_parts AS (
  SELECT doc_id, line_no, string_split(regexp_replace(replace(replace(line, '\\', chr(1) || chr(1)), '\$', chr(1) || chr(1)), '\$\$+', chr(2), 'g'), '$') AS p FROM opened WHERE NOT in_fence AND contains(line, '$')),
math_cells AS (
  SELECT doc_id, line_no, unnest(p) AS e, unnest(generate_series(0, len(p) - 1)) AS pos, len(p) AS n FROM math_parts),
math_open AS (
  SELECT doc_id, line_no, pos, {D.trim('e')} AS expr, NOT ({D.trim('e')} = '' OR regexp_matches({D.trim('e')}, '{M.NOT_MATH}') OR regexp_matches({D.trim('e')}, '{M.UNFINISHED}')) AS good
  FROM math_cells WHERE pos BETWEEN 1 AND n - 2),
math_runs AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, line_no, good ORDER BY pos) AS run FROM math_open),
formulas AS (
  SELECT doc_id, line_no, pos, expr FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, run ORDER BY pos) AS nth FROM math_runs WHERE good) WHERE nth % 2 = 1)"""


def _docs(s, d):
    return X.docs(s, d)


QUERIES = {
    "front_matter": lambda s, d: M.front_matter(_docs(s, d)).select("doc_id", "has_fm", "body", F.array_join(F.transform(F.array_sort(F.map_entries("fm")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fm")),
    "explode_lines": lambda s, d: M.explode_lines(_docs(s, d)),
    "fence_mask": lambda s, d: M.fence_mask(_docs(s, d)),
    "headings": lambda s, d: M.headings(_docs(s, d)),
    "heading_ids": lambda s, d: M.heading_ids(M.raw_headings(_docs(s, d))),
    "callouts": lambda s, d: M.callouts(_docs(s, d)),
    "callout_tables": lambda s, d: M.callout_tables(_docs(s, d)),
    "canonical_callout_kind": lambda s, d: M.callouts(_docs(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", M.T.callout_label(F.col("kind")).alias("label")),
    "footnote_defs": lambda s, d: M.footnote_defs(_docs(s, d)),
    "footnote_refs": lambda s, d: M.footnote_refs(_docs(s, d)),
    "footnote_first_wins": lambda s, d: M.footnote_first_wins(M.footnote_defs(_docs(s, d))),
    "footnote_sort": lambda s, d: M.footnote_sort(M.footnote_first_wins(M.footnote_defs(_docs(s, d)))),
    "footnote_repair": lambda s, d: M.footnote_repair(_docs(s, d)),
    "code_blocks": lambda s, d: M.code_blocks(_docs(s, d)),
    "diagram_sources": lambda s, d: M.diagram_sources(_docs(s, d)),
    "display_math": lambda s, d: M.display_math(_docs(s, d)),
    "inline_math_candidates": lambda s, d: M.inline_math_candidates(_docs(s, d)),
    "md_tables": lambda s, d: M.md_tables(_docs(s, d)),
    "task_items": lambda s, d: M.task_items(_docs(s, d)),
    "md_links": lambda s, d: M.md_links(_docs(s, d)),
    "block_inventory": lambda s, d: M.block_inventory(_docs(s, d)),
    "cjk_emphasis_repair": lambda s, d: M.cjk_emphasis_repair(_docs(s, d)),
    "construct_counts": lambda s, d: M.construct_counts(_docs(s, d)),
}
_RULE = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"
_CELLS = r"string_split(regexp_replace(regexp_replace({x}, '^\s*\|', ''), '\|\s*$', ''), '|')"
_REPAIR_RX = r"\[\^([^\]\[:]+)\][ \t]*[:：]"
ORACLES = {
    "front_matter": rf"""WITH {BODY}
SELECT doc_id, has_fm, body, coalesce(fm, '') AS fm FROM bodies""",
    "explode_lines": f"WITH {BODY} SELECT doc_id, line_no, line FROM mlines",
    "fence_mask": f"WITH RECURSIVE {STRICT} SELECT doc_id, line_no, line, in_fence, fence_id FROM masked",
    "headings": f"WITH RECURSIVE {HEADINGS} SELECT doc_id, line_no, level, text, id FROM headings",
    "heading_ids": f"WITH RECURSIVE {HEADINGS} SELECT doc_id, line_no, level, text, slug, id FROM headings",
    "callouts": rf"""WITH {BODY},{NESTED}
SELECT f.doc_id, f.i AS line_no, syntax, kind, CASE WHEN syntax <> '>' AND regexp_matches(title, '^".*"$') THEN title[2:-2] WHEN title <> '' THEN title ELSE upper(kind[1]) || kind[2:] END AS title,
  regexp_replace(coalesce(body, ''), '\n+$', '') AS body, f.depth, parent::INT AS parent_line FROM all_found f LEFT JOIN all_bodies b ON b.doc_id = f.doc_id AND b.i = f.i AND b.depth = f.depth""",
    "callout_tables": rf"""WITH {BODY},{CALLOUTS},
piped AS (SELECT *, contains(line, '|') AS is_table, {D.trim('line')} <> '' AS filled FROM mlines),
next_filled AS (SELECT *, coalesce(first_value(CASE WHEN filled THEN is_table END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS next_table FROM piped),
stops AS (SELECT *, NOT (is_table OR (NOT filled AND next_table)) AS stop FROM next_filled),
held AS (SELECT * FROM found f WHERE EXISTS (SELECT 1 FROM piped p WHERE p.doc_id = f.doc_id AND p.line_no > f.i AND p.line_no <= f.last AND is_table)),
sized AS (SELECT h.*, coalesce((SELECT min(line_no) FROM stops s WHERE s.doc_id = h.doc_id AND s.line_no > h.last AND s.stop), h.last_line + 1) - h.last - 1 AS n FROM held h)
SELECT doc_id, i AS line_no, n::INT AS n_absorbed,
  (SELECT string_agg(CASE WHEN m.line_no <= z.last THEN {_STRIP.replace('line', 'm.line')} ELSE {D.trim('m.line')} END, {_N} ORDER BY m.line_no) FROM mlines m WHERE m.doc_id = z.doc_id AND m.line_no > z.i AND m.line_no <= z.last + z.n) AS body
FROM sized z WHERE n > 0""",
    "canonical_callout_kind": f"WITH {BODY},{NESTED} SELECT kind, count(*) AS n, upper(kind[1]) || kind[2:] AS label FROM all_found GROUP BY kind",
    "footnote_defs": f"WITH RECURSIVE {STRICT},{DEFS} SELECT doc_id, label, body, line_no, in_fence FROM defs",
    "footnote_refs": f"WITH {BODY},{REFS} SELECT doc_id, line_no, label FROM refs",
    "footnote_first_wins": f"WITH RECURSIVE {STRICT},{DEFS} SELECT * FROM first_defs",
    "footnote_sort": f"WITH RECURSIVE {STRICT},{DEFS} SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_NUMBER} NULLS LAST, label)::INT AS rank FROM first_defs",
    "footnote_repair": rf"""WITH RECURSIVE {DOCS},
whole AS (SELECT doc_id, {_line_list('text')} AS l FROM docs),
wlines AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(0, len(l) - 1)) AS line_no FROM whole),{fences('wlines', 'wf')},
wmasked AS (SELECT m.*, f.a IS NOT NULL AS f FROM wlines m LEFT JOIN wf f ON f.doc_id = m.doc_id AND m.line_no BETWEEN f.a AND f.b),
cut AS (
  SELECT doc_id, line_no, f, CASE WHEN f THEN [line] ELSE string_split(regexp_replace(regexp_replace(line, '([^ \t])[ \t]*{_REPAIR_RX}', '\1' || chr(10) || chr(10) || '[^\2]:', 'g'), '{_REPAIR_RX}', '[^\1]:', 'g'), chr(10)) END AS xs FROM wmasked),
flat AS (SELECT doc_id, f, unnest(xs) AS x, line_no, unnest(generate_series(1, len(xs))) AS part FROM cut),
numbered AS (SELECT *, row_number() OVER w AS i, lead(x) OVER w AS next_x FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, part)),
kinds AS (SELECT *, NOT f AND regexp_matches(x, '{M.DEF}') AS is_def FROM numbered),
stubs AS (SELECT *, is_def AND trim(regexp_extract(x, '{M.DEF}', 2)) = '' AND NOT coalesce(regexp_matches(next_x, '^(    |\t)'), false) AS stub, NOT is_def AND {D.trim('x')} <> '' AS hosts, regexp_extract(x, '{M.DEF}', 1) AS label FROM kinds),
hosted AS (SELECT *, max(CASE WHEN hosts THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS host FROM stubs),
marks AS (SELECT h.doc_id, h.host, string_agg('[^' || h.label || ']', '' ORDER BY h.i) AS m FROM hosted h JOIN hosted o ON o.doc_id = h.doc_id AND o.i = h.host WHERE h.stub AND NOT contains(o.x, '[^' || h.label || ']') GROUP BY 1, 2),
done AS (SELECT s.doc_id, s.i, s.stub, CASE WHEN m.m IS NOT NULL THEN regexp_replace(s.x, '\s+$', '') || m.m ELSE s.x END AS x FROM stubs s LEFT JOIN marks m ON m.doc_id = s.doc_id AND m.host = s.i)
SELECT d.doc_id, string_agg(x, {_N} ORDER BY i) FILTER (NOT stub) || CASE WHEN ends_with(any_value(text), {_N}) THEN {_N} ELSE '' END AS text, count(*) FILTER (stub)::INT AS n_stubs
FROM done d JOIN docs USING (doc_id) GROUP BY d.doc_id""",
    "code_blocks": f"WITH RECURSIVE {BLOCKS} SELECT doc_id, start_line, info, lang, class, n_lines, code FROM classed",
    "diagram_sources": f"""WITH RECURSIVE {BLOCKS}, t AS (SELECT *, {D.trim('code')} AS c FROM classed WHERE class IN ('plantuml', 'typst', 'mermaid', 'diagram-html'))
SELECT doc_id, start_line, class, CASE class WHEN 'plantuml' THEN '@startuml' || {_N} || '{M.SKINPARAMS}' || {_N} || c || {_N} || '@enduml'
  WHEN 'typst' THEN '#set page(width: auto, height: auto, margin: 8pt)' || {_N} || c || {_N} ELSE c END AS source FROM t""",
    "display_math": rf"""WITH RECURSIVE {BLOCKS},
singles AS (SELECT doc_id, line_no, {D.trim(f"regexp_extract({D.trim('line')}, '^" + chr(92) + "$" + chr(92) + "$(.*)" + chr(92) + "$" + chr(92) + "$$', 1)")} AS expr FROM coded WHERE NOT in_fence),
dollars AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM coded WHERE NOT in_fence AND {D.trim('line')} = '$$'),
pairs AS (SELECT x.doc_id, x.line_no AS a, y.line_no AS b FROM dollars x JOIN dollars y ON y.doc_id = x.doc_id AND y.k = x.k + 1 WHERE x.k % 2 = 1),
inner_of AS (SELECT p.doc_id, p.a AS line_no, {D.trim(f"string_agg(m.line, {_N} ORDER BY m.line_no)")} AS expr FROM pairs p JOIN mlines m ON m.doc_id = p.doc_id AND m.line_no > p.a AND m.line_no < p.b GROUP BY 1, 2)
SELECT doc_id, line_no, expr, 'inline' AS form FROM singles WHERE expr <> '' AND NOT contains(expr, '$$')
UNION ALL SELECT doc_id, line_no, expr, 'block' FROM inner_of WHERE expr <> ''
UNION ALL SELECT doc_id, start_line, {D.trim('code')}, 'fence' FROM classed WHERE class = 'math' AND {D.trim('code')} <> ''""",
    "inline_math_candidates": f"WITH RECURSIVE {OPEN},{MATH} SELECT doc_id, line_no, pos::INT AS pos, expr FROM formulas",
    "md_tables": rf"""WITH RECURSIVE {FENCED},
flags AS (SELECT *, contains(line, '|') AND NOT in_fence AND NOT regexp_matches(line, '^ {{0,3}}>') AS pipe FROM coded),
near AS (SELECT *, lag(pipe) OVER w AS before, lag(line) OVER w AS head FROM flags WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
rules AS (SELECT doc_id, line_no AS r, line AS rule, head, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS table_no FROM near WHERE pipe AND before AND regexp_matches(line, '{_RULE}')),
table_spans AS (SELECT r.*, coalesce((SELECT min(line_no) FROM flags f WHERE f.doc_id = r.doc_id AND f.line_no > r.r AND NOT pipe), 1000000000) AS stop FROM rules r),
trows AS (
  SELECT doc_id, table_no, 0 AS row_no, rule, head AS x FROM table_spans
  UNION ALL SELECT s.doc_id, table_no, row_number() OVER (PARTITION BY s.doc_id, table_no ORDER BY line_no), rule, line FROM table_spans s JOIN flags f ON f.doc_id = s.doc_id AND f.line_no > s.r AND f.line_no < s.stop),
hidden AS (SELECT doc_id, table_no, row_no, rule, replace(x, '\|', chr(3)) AS x FROM trows),
-- A pipe is text where the code spans around it are paired: two ticks as long as each other, counted from the left.
spans AS (SELECT *, regexp_extract_all(x, '``[^`]+`[^`]+``|``[^`]+``|`[^`]+`') AS codes FROM hidden),
masked_rows AS (SELECT * EXCLUDE (x), list_reduce(list_prepend(x, codes), lambda acc, c: replace(acc, c, replace(c, '|', chr(3)))) AS x FROM spans),
cells AS (SELECT doc_id, table_no, row_no, {_CELLS.format(x='rule')} AS a, replace(unnest({_CELLS.format(x='x')}), chr(3), '|') AS cell, unnest(generate_series(0, len({_CELLS.format(x='x')}) - 1)) AS col_no FROM masked_rows)
SELECT doc_id, table_no::INT AS table_no, row_no::INT AS row_no, col_no::INT AS col_no, row_no = 0 AS is_header,
  CASE WHEN regexp_matches(trim(a[col_no + 1]), '^:-+:$') THEN 'center' WHEN regexp_matches(trim(a[col_no + 1]), '^:-+$') THEN 'left' WHEN regexp_matches(trim(a[col_no + 1]), '^-+:$') THEN 'right' ELSE 'none' END AS align, trim(cell) AS cell FROM cells""",
    "task_items": rf"""WITH RECURSIVE {FENCED}, bulleted AS (SELECT doc_id, line_no, regexp_replace(ltrim(line), '^([-*+]|[0-9]+[.)]) +', chr(1)) AS x FROM coded WHERE NOT in_fence)
SELECT doc_id, line_no, lower(x[3]) = 'x' AS checked, {D.trim("x[5:]")} AS text FROM bulleted WHERE x[1] = chr(1) AND x[2] = '[' AND x[3] IN (' ', 'x', 'X') AND x[4] = ']' AND x[5] = ' '""",
    "md_links": f"WITH RECURSIVE {FENCED},{LINKS} SELECT * FROM links",
    "block_inventory": rf"""WITH RECURSIVE {FENCED} SELECT doc_id, line_no, CASE WHEN in_fence THEN 'fence' WHEN regexp_matches(line, '^\s*$') THEN 'blank' WHEN regexp_matches(line, '{_HEADING}') THEN 'heading'
  WHEN regexp_matches(line, '^ {{0,3}}>') THEN 'blockquote' WHEN regexp_matches(line, '^ {{0,3}}([-*_])( *[-*_]){{2,}} *$') THEN 'rule' WHEN regexp_matches(line, '^\s*[-*+] ') THEN 'list_item'
  WHEN regexp_matches(line, '^\s*\d+[.)] ') THEN 'ordered_item' WHEN contains(line, '|') THEN 'table_row' ELSE 'paragraph' END AS block_type FROM coded""",
    "cjk_emphasis_repair": rf"""WITH {DOCS}, fixed AS (SELECT doc_id, text, regexp_replace(text, '」(\*{{1,3}})([{M.CJK}])', '」' || chr(8203) || '\1\2', 'g') AS t FROM docs)
SELECT doc_id, regexp_replace(t, '([{M.CJK}])(\*{{1,3}})「', '\1\2' || chr(8203) || '「', 'g') AS text, (len(regexp_extract_all(text, '」\*{{1,3}}[{M.CJK}]')) + len(regexp_extract_all(t, '[{M.CJK}]\*{{1,3}}「')))::INT AS n_fixes FROM fixed""",
    "construct_counts": f"""WITH RECURSIVE {BLOCKS},{NESTED},
opened AS (SELECT *, false AS in_callout FROM coded),{MATH},{DEFS},
facts AS (
  SELECT doc_id, class AS kind FROM classed WHERE class IN ('mermaid', 'plantuml', 'typst', 'diagram-html') UNION ALL SELECT doc_id, 'callout' FROM all_found
  UNION ALL SELECT doc_id, 'inline_math' FROM formulas UNION ALL SELECT doc_id, 'footnote' FROM defs)
SELECT source, lang, doc_id, kind, count(*) AS n FROM facts JOIN docs USING (doc_id) GROUP BY GROUPING SETS ((source, lang, doc_id, kind), (source, lang, kind), (source, kind), (kind))""",
}
