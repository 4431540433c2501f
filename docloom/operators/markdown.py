"""Markdown documents as rows: lines, fences, and the facts that lines hold.

A document's lines are handled as an array of its own row; one pass over them finds what they are (fences, callouts, tables, definitions), and only what a
fact needs is exploded, so none of these operators shuffles. Generators are outer ones with a filter on what they made: an inner one would have Catalyst infer a filter on its
array and push copies of the array's whole expression down to the scan. ATX headings and inline links are covered; setext headings and reference links are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import inline
from docloom.functions import text as T
from docloom.functions.blocks import line_marks
from docloom.functions.yaml_block import mapping_of

HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
OPEN_MARKS, CLOSE_MARKS = "「『（【〔〈《〖〘〚\"'⟨⟪(\\[{", "」』）】〕〉》〗〙〛\"'⟩⟫)\\]}"
# Text that rules a formula out: scripts that formulas do not use, and endings of an unfinished one.
NOT_MATH = "[⺀-⿟　-ㄯㆠ-ㆿㇰ-ㇿ㐀-䶿一-鿿가-힯豈-﫿＀-￯]"
UNFINISHED = r"[+–—−=/*:;,→←↔⇒⇐⇔-]$"


def line_array(text: Column) -> Column:
    """Lines of a text: split at newlines, carriage returns stripped, no phantom last line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def front_matter(docs: DataFrame, parse=mapping_of) -> DataFrame:
    """docs with has_fm, fm (map) and body: a leading --- block goes if it is empty or a YAML mapping. fm has the top-level keys with their scalars, the source of flow
    collections, and nothing for blocks below a key.

    parse takes the block's lines as an array Column and gives a map, null for what is no mapping; only blocks between --- lines reach it.
    """
    d = docs.withColumn("_lines", line_array(F.regexp_replace("text", "^\ufeff", "")))
    ends = F.filter(F.transform("_lines", lambda x, i: F.when((i > 0) & (F.trim(x) == "---"), i)), lambda i: i.isNotNull())
    d = d.withColumn("_end", F.when(F.trim(F.get("_lines", F.lit(0))) == "---", F.get(ends, F.lit(0))))
    d = d.withColumn("_block", F.when(F.col("_end").isNotNull(), F.slice("_lines", F.lit(2), F.greatest(F.col("_end") - 1, F.lit(0)))))
    d = d.withColumn("_fm", parse(F.col("_block")))
    blank = F.forall("_block", lambda x: T.trim_all(x) == "")
    d = d.withColumn("has_fm", F.coalesce(blank | F.col("_fm").isNotNull(), F.lit(False)))
    rest = F.array_join(F.slice("_lines", F.col("_end") + 2, F.greatest(F.size("_lines") - F.col("_end") - 1, F.lit(0))), "\n")
    body = F.when(F.col("has_fm"), F.concat(rest, F.when(F.col("text").endswith("\n") & ~rest.endswith("\n"), "\n").otherwise(""))).otherwise(F.col("text"))
    empty = F.create_map().cast("map<string,string>")
    return d.withColumn("fm", F.coalesce("_fm", empty)).withColumn("body", body).select(*docs.columns, "has_fm", "fm", "body")


def with_marks(docs: DataFrame) -> DataFrame:
    """docs with lines (array, of the body without front matter), and what one pass over them finds:

    in_fence and in_body (for each line whether it lies in a code fence, and in a ::: or !!! callout), fence_id (its fence by the stricter rule for footnotes, null outside),
    fences (a, b, closed: first and last line), found (callouts: i, syntax, kind, title, last, depth, parent, body), tables (r, stop: rule and end) and defs (i, stop).
    """
    d = front_matter(docs).withColumn("lines", line_array(F.col("body")))
    return d.withColumn("marks", line_marks("lines")).select(*docs.columns, "lines", "marks.*")


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the body, numbered from 0."""
    return front_matter(docs).select("doc_id", F.posexplode_outer(line_array(F.col("body"))).alias("line_no", "line")).filter(F.col("line_no").isNotNull())


def fence_mask(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, in_fence, fence_id): lines of a backtick fence, its marks included; only a line of exactly the opener's backticks closes it."""
    rows = with_marks(docs).select("doc_id", F.posexplode_outer(F.arrays_zip("lines", "fence_id")).alias("line_no", "r")).filter(F.col("line_no").isNotNull())
    return rows.select("doc_id", "line_no", F.col("r.lines").alias("line"), F.col("r.fence_id").isNotNull().alias("in_fence"), "r.fence_id")


def fence_class(info: Column) -> Column:
    """The kind of a fence by the first word of its info, and the second for diagrams."""
    lang = F.lower(F.regexp_extract(info, r"^(\S*)", 1))
    return (
        F.when((lang == "diagram") & F.regexp_extract(info, r"^\S+\s+(\S+)", 1).eqNullSafe("html"), "diagram-html")
        .when(lang.isin("math", "latex"), "math")
        .when(lang.isin("mermaid", "mmd"), "mermaid")
        .when(lang.isin("plantuml", "puml", "uml"), "plantuml")
        .when(lang == "typst", "typst")
        .when(lang == "", "plain")
        .otherwise("code")
    )


def _info(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^\s*(`+|~+)", ""))


def code_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, start_line, info, lang, class, n_lines, code) of every fence, of backticks or tildes; a line of as many marks or more closes it."""
    rows = with_marks(docs).select("doc_id", "lines", F.explode_outer("fences").alias("f")).filter(F.col("f").isNotNull())
    info = _info(F.get("lines", F.col("f.a")))
    lang = F.lower(F.regexp_extract(info, r"^(\S*)", 1))
    n = F.col("f.b") - F.col("f.a") - F.when(F.col("f.closed"), 1).otherwise(0)
    code = F.array_join(F.slice("lines", F.col("f.a") + 2, F.greatest(n, F.lit(0))), "\n")
    return rows.select("doc_id", F.col("f.a").alias("start_line"), info.alias("info"), lang.alias("lang"), fence_class(info).alias("class"), n.alias("n_lines"), code.alias("code"))


SKINPARAMS = "skinparam backgroundColor transparent"


def diagram_sources(docs: DataFrame, skinparams: str = SKINPARAMS) -> DataFrame:
    """(doc_id, start_line, class, source): PlantUML wrapped and themed, Typst with a page rule, other diagrams trimmed."""
    code = T.trim_all(F.col("code"))
    marked = code.contains("@start") & code.contains("@end")
    themed = F.when(code.contains("skinparam") | ~code.contains("\n"), code).otherwise(
        F.concat(F.regexp_extract(code, "^([^\n]*)", 1), F.lit(f"\n{skinparams}"), F.regexp_extract(code, "(?s)^[^\n]*(\n.*)$", 1))
    )
    plant = F.when(marked, themed).otherwise(F.concat(F.lit(f"@startuml\n{skinparams}\n"), code, F.lit("\n@enduml")))
    typst = F.when(code.contains("#set page"), code).otherwise(F.concat(F.lit("#set page(width: auto, height: auto, margin: 8pt)\n"), code, F.lit("\n")))
    rows = code_blocks(docs).filter(F.col("class").isin("plantuml", "typst", "mermaid", "diagram-html"))
    return rows.select("doc_id", "start_line", "class", F.when(F.col("class") == "plantuml", plant).when(F.col("class") == "typst", typst).otherwise(code).alias("source"))


def _first_from(flags: Column, start: Column) -> Column:
    """The number of the first true flag from a position on, the size if there is none."""
    at = F.array_position(F.slice(flags, start + 1, F.greatest(F.size(flags) - start, F.lit(0))), F.lit(True))
    return F.when((start < F.size(flags)) & (at > 0), start + at.cast("int") - 1).otherwise(F.size(flags))


def _callout_line(syntax: Column, x: Column) -> Column:
    return F.when(syntax == ">", F.regexp_replace(x, "^ {0,3}> ?", "")).when(syntax == "!!!", F.when(x.rlike("^(    |\t)"), F.regexp_replace(x, "^(    |\t)", "")).otherwise(F.regexp_replace(x, r"^\s+", ""))).otherwise(x)


def callouts(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, syntax, kind, title, body, depth, parent_line): three syntaxes, known kinds; the title falls back to the kind's label.

    A callout's body is read for callouts again: they have its depth plus one and its line as parent_line (null at depth 1). Bodies are read down to depth 8, so one of
    depth 9 is a row whose body is text.
    """
    rows = with_marks(docs).select("doc_id", F.explode_outer("found").alias("m")).filter(F.col("m").isNotNull())
    title = F.when(F.col("m.title") != "", F.col("m.title")).otherwise(T.callout_label(F.col("m.kind")))
    return rows.select("doc_id", F.col("m.i").alias("line_no"), "m.syntax", "m.kind", title.alias("title"), "m.body", "m.depth", F.col("m.parent").alias("parent_line"))


def callout_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_absorbed, body) of callouts that hold a table and are followed by table lines without marker, blank lines between them included."""
    top = F.filter("found", lambda m: m["depth"] == 1)
    d = with_marks(docs).withColumn("found", top).withColumn("table", F.transform("lines", lambda x: x.contains("|")))
    d = d.withColumn("stops", F.transform("lines", lambda x: ~x.contains("|") & (T.trim_all(x) != "")))
    rows = d.select("doc_id", "lines", "stops", "table", F.explode_outer("found").alias("m")).filter(F.col("m").isNotNull())
    first = F.col("m.last") + 1
    own = F.slice("lines", F.col("m.i") + 2, F.greatest(F.col("m.last") - F.col("m.i"), F.lit(0)))
    holds = F.exists(own, lambda x: x.contains("|"))
    # Up to the next line of text; blank lines at the end are not taken.
    following = F.slice("table", first + 1, F.greatest(_first_from(F.col("stops"), first) - first, F.lit(0)))
    back = F.array_position(F.reverse(following), F.lit(True)).cast("int")
    n = F.when(holds & (back > 0), F.size(following) - back + 1).otherwise(0)
    inner = F.transform(F.filter(own, lambda x: ~((F.col("m.syntax") == ":::") & (F.trim(x) == ":::"))), lambda x: _callout_line(F.col("m.syntax"), x))
    taken = F.transform(F.slice("lines", first + 1, F.greatest(n, F.lit(0))), lambda x: T.trim_all(x))
    return rows.withColumn("n", n).filter("n > 0").select("doc_id", F.col("m.i").alias("line_no"), F.col("n").alias("n_absorbed"), F.array_join(F.concat(inner, taken), "\n").alias("body"))


def _picked(d: DataFrame, wanted) -> DataFrame:
    """(doc_id, line_no, line) of the lines that wanted(line, line_no) picks; only these are exploded."""
    rows = F.filter(F.transform("lines", lambda x, i: F.when(wanted(x, i), F.struct(i.alias("i"), x.alias("x")))), lambda r: r.isNotNull())
    return d.select("doc_id", F.explode_outer(rows).alias("r")).filter(F.col("r").isNotNull()).select("doc_id", F.col("r.i").alias("line_no"), F.col("r.x").alias("line"))


def unfenced_lines(docs: DataFrame, wanted) -> DataFrame:
    """(doc_id, line_no, line) of the lines outside fences that wanted(line) picks."""
    return _picked(with_marks(docs), lambda x, i: wanted(x) & ~F.get("in_fence", i))


def raw_headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, text): ATX headings outside fences and the bodies of ::: and !!! callouts."""
    lines = _picked(with_marks(docs), lambda x, i: F.contains(x, F.lit("#")) & x.rlike(HEADING) & ~F.get("in_fence", i) & ~F.get("in_body", i))
    return lines.select("doc_id", "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), T.plain_text(T.trim_all(F.regexp_extract("line", HEADING, 2))).alias("text"))


def heading_ids(found: DataFrame) -> DataFrame:
    """headings with slug and id: the n-th repeat of a slug in a document gets -n; blank slugs are `heading`."""
    from pyspark.sql import Window

    slug = T.slugify(F.col("text"))
    d = found.withColumn("slug", F.when(slug == "", "heading").otherwise(slug))
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("line_no"))
    return d.withColumn("n", n).withColumn("id", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n"))).drop("n")


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, text, id)."""
    return heading_ids(raw_headings(docs)).drop("slug")


def cjk_emphasis_repair(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_fixes): a zero-width space between emphasis stars and CJK brackets where a CJK letter stands on the other side."""
    closing = rf"([{CLOSE_MARKS}])(\*{{1,3}})([{CJK}])"
    opening = rf"([{CJK}])(\*{{1,3}})([{OPEN_MARKS}])"
    once = F.regexp_replace("text", closing, "$1​$2$3")
    return docs.select("doc_id", F.regexp_replace(once, opening, "$1$2​$3").alias("text"), (F.regexp_count("text", F.lit(closing)) + F.regexp_count(once, F.lit(opening))).alias("n_fixes"))


def _formulas(line: Column) -> Column:
    """array<struct<pos, expr>>: what may be formulas between single dollars of a line, paired from the left; a pair that is none gives up its first dollar only."""
    masked = F.regexp_replace(F.regexp_replace(line, r"\\\\|\\\$", "\u0001\u0001"), r"\${2,}", "\u0002")
    cells = F.transform(F.split(masked, r"\$"), lambda e, i: F.struct(i.alias("pos"), T.trim_all(e).alias("expr")))
    inner = F.when(F.size(cells) > 2, F.slice(cells, F.lit(2), F.size(cells) - 2)).otherwise(F.slice(cells, F.lit(1), F.lit(0)))
    bad = lambda e: (e == "") | e.rlike(NOT_MATH) | e.rlike(UNFINISHED)
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<struct<pos:int,expr:string>>").alias("out"))

    def step(s, m):
        take = (s["skip"] == 0) & ~bad(m["expr"])
        return F.when(take, F.struct(F.lit(1).alias("skip"), F.concat(s["out"], F.array(m)).alias("out"))).otherwise(F.struct(F.lit(0).alias("skip"), s["out"].alias("out")))

    return F.aggregate(inner, start, step, lambda s: s["out"])


def inline_math_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, pos, expr): text between single dollars outside fences that may be a formula; blank, CJK and unfinished ones are out."""
    lines = unfenced_lines(docs, lambda x: x.contains("$"))
    return lines.select("doc_id", "line_no", F.explode_outer(_formulas(F.col("line"))).alias("m")).filter(F.col("m").isNotNull()).select("doc_id", "line_no", "m.pos", "m.expr")


def display_math(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, expr, form): one-line $$x$$, blocks between $$ lines, and math fences; empty and unclosed ones are text."""
    lines = unfenced_lines(docs, lambda x: x.contains("$$"))
    one = T.trim_all(F.regexp_extract(T.trim_all(F.col("line")), r"^\$\$(.*)\$\$$", 1))
    single = lines.filter((one != "") & ~one.contains("$$")).select("doc_id", "line_no", one.alias("expr"), F.lit("inline").alias("form"))
    d = with_marks(docs)
    marks = F.filter(F.transform("lines", lambda x, i: F.when(F.contains(x, F.lit("$$")) & (T.trim_all(x) == "$$") & ~F.get("in_fence", i), i)), lambda i: i.isNotNull())
    d = d.withColumn("marks", marks)
    pairs = F.filter(F.transform("marks", lambda a, k: F.when((k % 2 == 0) & (k + 1 < F.size("marks")), F.struct(a.alias("a"), F.get("marks", k + 1).alias("b")))), lambda p: p.isNotNull())
    rows = d.select("doc_id", "lines", F.explode_outer(pairs).alias("p")).filter(F.col("p").isNotNull())
    block = T.trim_all(F.array_join(F.slice("lines", F.col("p.a") + 2, F.col("p.b") - F.col("p.a") - 1), "\n"))
    blocks = rows.select("doc_id", F.col("p.a").alias("line_no"), block.alias("expr"), F.lit("block").alias("form")).filter("expr <> ''")
    fences = code_blocks(docs).filter(F.col("class") == "math").select("doc_id", F.col("start_line").alias("line_no"), T.trim_all(F.col("code")).alias("expr"), F.lit("fence").alias("form"))
    return single.union(blocks).union(fences.filter("expr <> ''"))


def md_tables(docs: DataFrame, pipes_in_code_split: bool = False) -> DataFrame:
    """(doc_id, table_no, row_no, col_no, is_header, align, cell): pipe tables outside fences; alignment from the separator row. An escaped pipe or one in a code span is text of its cell."""
    cells = lambda x: inline.cells(x, pipes_in_code_split)
    t = with_marks(docs).select("doc_id", "lines", F.posexplode_outer("tables").alias("table_no", "t")).filter(F.col("table_no").isNotNull())
    t = t.withColumn("aligns", F.transform(cells(F.get("lines", F.col("t.r"))), lambda c: F.when(F.trim(c).rlike("^:-+:$"), "center").when(F.trim(c).rlike("^:-+$"), "left").when(F.trim(c).rlike("^-+:$"), "right").otherwise("none")))
    rows = F.concat(F.array(F.get("lines", F.col("t.r") - 1)), F.slice("lines", F.col("t.r") + 2, F.greatest(F.col("t.stop") - F.col("t.r") - 1, F.lit(0))))
    out = t.select("doc_id", "table_no", "aligns", F.posexplode_outer(rows).alias("row_no", "row")).select("doc_id", "table_no", "row_no", "aligns", F.posexplode_outer(cells(F.col("row"))).alias("col_no", "cell")).filter(F.col("col_no").isNotNull())
    return out.select("doc_id", "table_no", "row_no", "col_no", (F.col("row_no") == 0).alias("is_header"), F.coalesce(F.get("aligns", F.col("col_no")), F.lit("none")).alias("align"), F.trim("cell").alias("cell"))


TASK = r"^\s*(?:[-*+]|\d{1,9}[.)])[ \t]+\[([ xX])\][ \t]+(.*)$"


def task_items(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, checked, text) of - [ ] and 1. [x] items outside fences."""
    lines = unfenced_lines(docs, lambda x: F.contains(x, F.lit("[")) & x.rlike(TASK))
    return lines.select("doc_id", "line_no", (F.lower(F.regexp_extract("line", TASK, 1)) == "x").alias("checked"), T.trim_all(F.regexp_extract("line", TASK, 2)).alias("text"))


def md_links(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, is_image, text, dest, title): inline links and images outside fences and code spans; text is what a reader sees (an image's alternative text), also of a link round an image."""
    lines = unfenced_lines(docs, lambda x: F.contains(x, F.lit("](")))
    read = lines.withColumn("t", inline.tokens(F.col("line"))).withColumn("k", inline.links(F.col("t")))
    read = read.withColumn("p", inline.shown(F.col("t"), F.col("k"))).select("doc_id", "line_no", "t", "p", F.explode_outer("k").alias("m")).filter(F.col("m").isNotNull())
    text = inline.without_emphasis(F.array_join(F.slice("p", F.col("m.a") + 2, F.col("m.b") - F.col("m.a") - 1), ""))
    target = F.get("t", F.col("m.b"))
    return read.select("doc_id", "line_no", F.col("m.image").alias("is_image"), F.translate(text, T.ZERO_WIDTH, "").alias("text"), inline.destination(target).alias("dest"), inline.title(target).alias("title"))


def block_inventory(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, block_type) of every line."""
    x = F.col("line")
    kind = (
        F.when(F.col("in_fence"), "fence")
        .when(x.rlike(r"^\s*$"), "blank")
        .when(x.rlike(HEADING), "heading")
        .when(x.rlike("^ {0,3}>"), "blockquote")
        .when(x.rlike(r"^ {0,3}([-*_])( *[-*_]){2,} *$"), "rule")
        .when(x.rlike(r"^\s*[-*+] "), "list_item")
        .when(x.rlike(r"^\s*\d+[.)] "), "ordered_item")
        .when(x.contains("|"), "table_row")
        .otherwise("paragraph")
    )
    rows = with_marks(docs).select("doc_id", F.posexplode_outer(F.arrays_zip("lines", "in_fence")).alias("line_no", "r")).filter(F.col("line_no").isNotNull())
    return rows.select("doc_id", "line_no", F.col("r.lines").alias("line"), "r.in_fence").select("doc_id", "line_no", kind.alias("block_type"))


DEF = r"^\s*\[\^([^\]\[:]+)\]\s*[:：]\s*(.*)$"


def footnote_defs(docs: DataFrame) -> DataFrame:
    """(doc_id, label, body, line_no, in_fence): definitions with their indented continuation lines; fences do not hide them."""
    rows = with_marks(docs).select("doc_id", "lines", "fence_id", F.explode_outer("defs").alias("f")).filter(F.col("f").isNotNull())
    line = F.get("lines", F.col("f.i"))
    more = F.transform(F.slice("lines", F.col("f.i") + 2, F.greatest(F.col("f.stop") - F.col("f.i") - 1, F.lit(0))), lambda x: T.trim_all(x))
    body = F.array_join(F.filter(F.concat(F.array(T.trim_all(F.regexp_extract(line, DEF, 2))), more), lambda x: x != ""), "\n")
    return rows.select("doc_id", F.regexp_extract(line, DEF, 1).alias("label"), body.alias("body"), F.col("f.i").alias("line_no"), F.get("fence_id", F.col("f.i")).isNotNull().alias("in_fence"))


def footnote_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, label): [^x] not followed by a colon; fences do not hide them."""
    found = explode_lines(docs).select("doc_id", "line_no", F.explode_outer(F.regexp_extract_all("line", F.lit(r"\[\^([^\]\[:]+)\](:?)"), F.lit(0))).alias("m")).filter(F.col("m").isNotNull())
    return found.filter(~F.col("m").endswith(":")).select("doc_id", "line_no", F.regexp_extract("m", r"\^([^\]]+)", 1).alias("label"))


def footnote_first_wins(defs: DataFrame) -> DataFrame:
    """(doc_id, label, body): the first definition of each label that is not empty; an empty one only where there is no other."""
    best = F.min(F.struct((F.col("body") == "").alias("empty"), "line_no", "body"))
    return defs.groupBy("doc_id", "label").agg(best.alias("best")).select("doc_id", "label", "best.body")


def footnote_sort(defs: DataFrame, group: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """defs with rank: numeric labels first and in order of number, then the others by text."""
    from pyspark.sql import Window

    parsed = F.when(F.col("label").rlike(r"^\d{1,10}$"), F.col("label").try_cast("bigint"))
    number = F.when(parsed < 1 << 32, parsed)
    order = Window.partitionBy(*group).orderBy(number.asc_nulls_last(), "label", *(c for c in ("doc_id",) if c not in group))
    return defs.withColumn("rank", F.row_number().over(order))


def footnote_repair(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_stubs): definitions split onto their own paragraphs, spaced and full-width colons made plain, and empty stubs turned into a reference on
    the last line before them that is neither blank nor a definition (unless it has one); fences stay."""
    d = docs.withColumn("lines", line_array(F.col("text")))
    d = d.withColumn("fence_id", line_marks("lines")["fence_id"])
    rx = r"\[\^([^\]\[:]+)\][ \t]*[:：]"
    fenced = lambda i: F.get("fence_id", i).isNotNull()
    split = lambda x: F.split(F.regexp_replace(F.regexp_replace(x, rf"([^ \t])[ \t]*{rx}", "$1\n\n[^$2]:"), rx, "[^$1]:"), "\n")
    d = d.withColumn("rows", F.flatten(F.transform("lines", lambda x, i: F.transform(F.when(fenced(i), F.array(x)).otherwise(split(x)), lambda y: F.struct(y.alias("x"), fenced(i).alias("f"))))))
    is_def = lambda r: ~r["f"] & r["x"].rlike(DEF)
    goes_on = lambda i: F.coalesce(F.get("rows", i + 1)["x"].rlike("^(    |\t)"), F.lit(False))
    stub = lambda r, i: is_def(r) & (F.trim(F.regexp_extract(r["x"], DEF, 2)) == "") & ~goes_on(i)
    d = d.withColumn("rows", F.transform("rows", lambda r, i: F.struct(r["x"].alias("x"), stub(r, i).alias("stub"), (~is_def(r) & (T.trim_all(r["x"]) != "")).alias("hosts"), F.regexp_extract(r["x"], DEF, 1).alias("label"))))
    # Stubs whose marker goes to each hosting line: those before the next hosting line.
    hosts = F.filter(F.transform("rows", lambda r, i: F.when(r["hosts"], i)), lambda i: i.isNotNull())
    d = d.withColumn("hosts", hosts)
    after = lambda i: F.coalesce(F.array_min(F.filter("hosts", lambda h: h > i)), F.size("rows"))

    def marked(r, i):
        mine = F.transform(F.filter(F.slice("rows", i + 2, F.greatest(after(i) - i - 1, F.lit(0))), lambda s: s["stub"]), lambda s: F.concat(F.lit("[^"), s["label"], F.lit("]")))
        return F.aggregate(mine, r["x"], lambda x, m: F.when(F.contains(x, m), x).otherwise(F.concat(F.regexp_replace(x, r"\s+$", ""), m)))

    out = F.transform(F.filter(F.transform("rows", lambda r, i: F.struct(F.when(r["hosts"], marked(r, i)).otherwise(r["x"]).alias("x"), r["stub"].alias("stub"))), lambda r: ~r["stub"]), lambda r: r["x"])
    n = F.size(F.filter("rows", lambda r: r["stub"]))
    return d.select("doc_id", F.concat(F.array_join(out, "\n"), F.when(F.col("text").endswith("\n"), "\n").otherwise("")).alias("text"), n.alias("n_stubs"))


def construct_counts(docs: DataFrame) -> DataFrame:
    """(source, lang, doc_id, kind, n): callouts, formulas, diagrams and footnotes by document, with totals by rollup."""
    d = with_marks(docs)
    infos = F.transform("fences", lambda f: _info(F.get("lines", f["a"])))
    formulas = F.transform(F.transform("lines", lambda x, i: F.when(x.contains("$") & ~F.get("in_fence", i), x)), lambda x: F.when(x.isNotNull(), F.size(_formulas(x))).otherwise(0))
    count = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    of_class = lambda kind: count(kind, F.size(F.filter(infos, lambda x: fence_class(x) == kind)))
    facts = F.array(
        *(of_class(k) for k in ("mermaid", "plantuml", "typst", "diagram-html")),
        count("callout", F.size("found")),
        count("inline_math", F.aggregate(formulas, F.lit(0), lambda s, x: s + x)),
        count("footnote", F.size("defs")),
    )
    counted = d.select("source", "lang", "doc_id", F.explode(facts).alias("f")).select("source", "lang", "doc_id", "f.kind", "f.n").filter("n > 0")
    # Counts by document, then totals by source and language, by source, and of all.
    return counted.groupingSets([["source", "lang", "doc_id", "kind"], ["source", "lang", "kind"], ["source", "kind"], ["kind"]], "source", "lang", "doc_id", "kind").agg(F.sum("n").alias("n"))
