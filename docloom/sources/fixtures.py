"""Relations derived from the given tables: one SQL text for Spark and DuckDB.

The texts avoid backslashes and use {g} where DuckDB wants the global flag of regexp_replace.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docloom.functions.text import ALIAS_KIND
from docloom.session import configure, table

_ALIASES = list(ALIAS_KIND)
_ALIAS = "CASE " + " ".join(f"WHEN doc_id % 29 <> 0 AND doc_id % {len(_ALIASES)} = {i} THEN '{a}'" for i, a in enumerate(_ALIASES)) + " ELSE 'zzz' END"
_LANGS = ["rust", "python", "mermaid", "mmd", "plantuml", "typst", "math", "diagram html", ""]
_FENCE_LANG = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LANGS)) + " END"


def _lines(*lines: str) -> str:
    """SQL of lines, each an expression, ended by newlines."""
    return " || ".join(f"{x} || chr(10)" for x in lines)


def _when(condition: str, *lines: str) -> str:
    return f"CASE WHEN {condition} THEN {_lines(*lines)} ELSE '' END"


def _text(line: str) -> str:
    """SQL of a line of text; backslashes by number."""
    return "'" + line.replace("'", "''").replace("\\", "' || chr(92) || '") + "'"


#: Front matter by doc_id % 35: its lines, and its keys and values in order of keys as YAML has them, None where it is no mapping.
FRONT_MATTER: dict[int, tuple[list[str], str | None]] = {
    1: (["", "# Only a heading"], None),
    2: (["tags:", "- a", "- b", "# comment", "author:", "    name: X", "note: |", "  free: text: here", '"my key": v'], "author=,my key=v,note=free: text: here,tags="),
    3: (["a: b: c"], None),
    4: (["plain words", "k: v"], None),
    6: (["title: 'It''s here'"], "title=It's here"),
    7: (['title: "He said \\"hi\\""'], 'title=He said "hi"'),
    8: (["tags: [one,", "  two]", "n: 3"], "n=3,tags=[one, two]"),
    9: (["{a: 1, b: [x, y]}"], "a=1,b=[x, y]"),
    11: (["first: &x 7", "second: *x"], "first=7,second=*x"),
    12: (["key: - x"], None),
    13: (["a: 1", "b: 2", "a: 3"], None),
    14: (["'x': \"y\"", "k: v # cut"], "k=v,x=y"),
    16: (["a:", "  b: 1", "   c: 2"], None),
    17: (["list:", "  - a: 1", "    b: [2, 3]", "  - c", "last: >-", "  two", "  lines"], "last=two lines,list="),
    18: (["open: [a, b"], None),
    19: (["a: 'x' y"], None),
}
_PARTS = [
    _when("doc_id % 5 = 0", "'---'", "'lang: ' || lang", "'source: ' || source", "'chars: ' || CAST(n_chars AS STRING)", "'---'"),
    *(_when(f"doc_id % 35 = {k}", "'---'", *map(_text, lines), "'---'") for k, (lines, _) in FRONT_MATTER.items()),
    _when("doc_id % 13 = 0", "'## Preface'", "''"),
    _lines("'# ' || title", "''", "'## Overview'", "''", "coalesce(text, '')", "''"),
    _when("doc_id % 3 = 0", "'## Overview'", "''", "'Again with `code` and **bold** text'", "''"),
    f"CASE doc_id % 3 WHEN 0 THEN {_lines("'> [!' || upper(alias) || '] Titled here'", "'> First line'", "'> Second line'", "''")} "
    f"WHEN 1 THEN {_lines("':::' || alias || ' Titled here'", "'# Inside callout'", "'Second line'", "':::'", "''")} "
    f"ELSE {_lines("'!!! ' || alias || ' \"Titled here\"'", "'    First line'", "'    Second line'", "''")} END",
    _when("doc_id % 10 = 3", "'> [!NOTE] T'", "'> | A | B |'", "'| --- | --- |'", "'| 1 | 2 |'", "''"),
    _when("doc_id % 10 = 6", *map(_text, ["> [!NOTE] Outer", "> Outer text", "> > [!TIP] Inner", "> > Inner text", "> > > [!BUG]", "> > > Deep text", "> Outer again", "> > [!quote]- Second", ""])),
    _when("doc_id % 20 = 7", *(_text("> " * k + f"[!TIP] Level {k}") for k in range(1, 12)), "''"),
    _lines("'Claim[^1] and claim[^n].'", "''", "'[^1]: First note ' || title", "'    and more'", "'[^n]: Other <b>note</b> here'", "''"),
    _when("doc_id % 4 = 0", "'[^orphan]: Nobody refers to me'"),
    _when("doc_id % 7 = 0", "'See[^missing].'", "''"),
    _when("doc_id % 8 = 0", "'[^1]: A second body'", "''"),
    _when("doc_id % 6 = 5", "'Text before a stub'", "'[^s]:'", "'[^a]: one [^b] : two'", "''"),
    _lines("'```' || fence_lang", "'# not a heading'", "'[^x]: keep'", "'```'", "''"),
    _when("doc_id % 6 = 0", "'````text'", "'```'", "'inner'", "'````'", "''"),
    _when("doc_id % 6 = 1", *map(_text, ["~~~python", "# not a heading either", "[none](fenced.md)", "~~~~", ""])),
    _lines("'| lang | source | chars |'", "'| :--- | :---: | ---: |'", "'| ' || lang || ' | ' || source || ' | ' || CAST(n_chars AS STRING) || ' |'", "''"),
    _when("doc_id % 4 = 2", *map(_text, ["| a | b | c |", "|---|:-:|---|", "| x \\| y | `p | q` | ``r`s | t`` |", "| lone ` tick | 2 | 3", ""])),
    _when("doc_id % 4 = 3", *map(_text, ["1. [x] ordered and done", "2) [ ] ordered and open", "3. [y] no task", ""])),
    _lines("'- [x] done ' || lang", "'- [' || CASE WHEN doc_id % 2 = 0 THEN 'X' ELSE ' ' END || '] open'", "'1. first'", "''"),
    _lines("'[next](d' || lpad(CAST(doc_id + 20 AS STRING), 6, '0') || '.md#overview)'", "'See [site](https://example.com/a) and ![logo](../../assets/logo.png)'"),
    _when(
        "doc_id % 8 = 3",
        *map(
            _text,
            [
                "See [spaced](<a b.md> 'one title') and [balanced](x_(y)_z.md \"two\").",
                "[![badge](img/b.png)](https://example.com/c \"three\") then `[none](code.md)` and \\[no](esc.md).",
                "Out [in [deep](d.md) side](e.md), [q](r.md (four)), [not closed](x.md and ![pic [nested] alt](p.png).",
                "Words [with **bold** and `code`](b.md) ``a [tick`](t.md)`` end.",
            ],
        ),
    ),
    _when("doc_id % 9 = 0", "'[gone](missing%20file.md)'"),
    _when("doc_id % 11 = 0", "'[lost](./d' || lpad(CAST(doc_id AS STRING), 6, '0') || '.md#no-such)'"),
    _lines("'Inline $x+y$ here.'", "'$$E=mc^2$$'", "''"),
    _when("doc_id % 2 = 0", "'（门票 $30 一张，套票 $4.50 起）'", "'Tickets are $5 or $7, then'"),
    _when("doc_id % 4 = 1", "'$$'", "'a = b'", "'$$'", "''"),
    _when("doc_id % 12 = 0", "'在**「晨雾」**里'"),
]
DOCS = f"""
SELECT doc_id, source || '/' || lang || '/d' || lpad(CAST(doc_id AS STRING), 6, '0') || '.md' AS path, lang, source,
  {" || ".join(_PARTS)} AS text, 1704067200 + doc_id AS mtime
FROM (
  SELECT doc_id, lang, source, n_chars, text, {_ALIAS} AS alias, {_FENCE_LANG} AS fence_lang,
    trim(regexp_replace(split_part(text, chr(10), 1), '[^[:alnum:] ]', ''{{g}})) AS title
  FROM documents)
"""
CRAWL_LOG = """
SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  'https://site.example/p/' || k AS url, event_type || ' ' || k AS title,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'null' ELSE 'ok' END AS status
FROM (SELECT *, regexp_replace(props, '[^0-9]', ''{g}) AS k FROM events)
"""
FS_EVENTS = """
SELECT e.event_id, e.ts, d.path,
  CASE e.event_type WHEN 'view' THEN 'access' WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'create' WHEN 'error' THEN 'metadata' ELSE 'close_write' END AS kind
FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS k FROM events) e
JOIN (
  SELECT row_number() OVER (PARTITION BY n.part ORDER BY n.doc_id) + p.before - 1 AS k, n.path
  FROM (SELECT doc_id, floor(doc_id / 4096.0) AS part, source || '/' || lang || '/d' || lpad(CAST(doc_id AS STRING), 6, '0') || '.md' AS path FROM documents) n
  JOIN (SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT floor(doc_id / 4096.0) AS part, count(*) AS n FROM documents GROUP BY 1) c) p ON p.part = n.part) d ON d.k = e.k
"""
EDIT_LOG = """
SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'undo_one' WHEN event_type = 'signup' AND k % 10 = 0 THEN 'undo_all' ELSE 'commit' END AS op,
  CASE event_type WHEN 'click' THEN 1 + k % 3 WHEN 'view' THEN k % 2 WHEN 'signup' THEN 1 ELSE 0 END AS records
FROM (SELECT *, CAST(regexp_replace(props, '[^0-9]', ''{g}) AS BIGINT) AS k FROM events)
"""
OLD_CACHE = """
SELECT path, mtime - CASE WHEN doc_id % 7 = 0 THEN 3600 ELSE 0 END AS mtime, doc_id FROM docs WHERE doc_id % 10 <> 0
UNION ALL SELECT 'gone/' || path, mtime, doc_id FROM docs WHERE doc_id % 50 = 3
"""


def spark_text(sql: str) -> str:
    """A shared text for Spark, with its tables under names of our own, so that no view of the session is shadowed."""
    own = re.sub(r"\b(FROM|JOIN) (\w+)\b", r"\1 docloom_\2", sql)
    return own.replace("{g}", "").replace("[:alnum:]", "\\\\p{L}\\\\p{N}")


def duck_text(sql: str) -> str:
    """A shared text for DuckDB."""
    return sql.replace("{g}", ", 'g'").replace("[:alnum:]", "\\p{L}\\p{N}")


def derived(spark: SparkSession, sf_dir: str, sql: str, **views: DataFrame) -> DataFrame:
    """A relation of a shared text over the given tables."""
    configure(spark)
    for name in ("documents", "events", "pages"):
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(f"docloom_{name}")
    for name, view in views.items():
        view.createOrReplaceTempView(f"docloom_{name}")
    return spark.sql(spark_text(sql))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown corpus (doc_id, path, lang, source, text, mtime)."""
    return derived(spark, sf_dir, DOCS)
