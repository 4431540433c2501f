"""Markdown cases: YAML front matter, inline marks, fences, nested callouts, tables and tasks."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import yaml_block
from docloom.functions.blocks import marks
from docloom.operators import markdown as M


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Front matter


@pytest.mark.parametrize(
    "block, keys",
    [
        ("title: 'It''s here'", {"title": "It's here"}),
        ('title: "He said \\"hi\\""', {"title": 'He said "hi"'}),
        ("tags: [a,\n  b]\nx: 1", {"tags": "[a, b]", "x": "1"}),
        ("{a: 1}", {"a": "1"}),
        ("a: &x 1\nb: *x", {"a": "1", "b": "*x"}),
        ("key: - x", None),
        ("a: 1\na: 2", None),
        ("'x': \"y\"", {"x": "y"}),
        ("k: v # c", {"k": "v"}),
        ("a: b: c", None),
        ("- a\n- b", None),
        ("plain words\nk: v", None),
        ("tags:\n- a\n- b\nauthor:\n    name: X\nnote: |\n  free: text: here", {"tags": "", "author": "", "note": "free: text: here"}),
        ("a:\n  b: 1\n   c: 2", None),
        ("a: [1, 2", None),
        ("a: {b: 1, b: 2}", None),
        ("a: 'x' y", None),
        ("a: *unknown", None),
        ("url: http://x.y/z#a", {"url": "http://x.y/z#a"}),
        ("a: x\n  y", {"a": "x y"}),
        ("a: x\n  y: z", None),
        ("a: >\n  x\n  y\nb: 1", {"a": "x y", "b": "1"}),
        ("list:\n  - a: 1\n    b: 2\n  - c", {"list": ""}),
        ('a: "x\\q"', None),
        ('"a\\u0041": 1', {"aA": "1"}),
        ("a: !!str 5", {"a": "5"}),
        ("a: @x", None),
        ("\ta: b", None),
    ],
)
def test_yaml_mapping(block, keys):
    assert yaml_block.mapping(block.split("\n")) == keys


def test_yaml_agrees_with_a_parser():
    """Random blocks of the lines that front matter has: the same verdict and the same scalars as a YAML library."""
    yaml = pytest.importorskip("yaml")

    def twice(node):
        if isinstance(node, yaml.MappingNode):
            keys = [k.value for k, _ in node.value if isinstance(k, yaml.ScalarNode)]
            return len(keys) != len(set(keys)) or any(twice(v) for _, v in node.value)
        return isinstance(node, yaml.SequenceNode) and any(map(twice, node.value))

    def judged(text):
        try:
            node = yaml.compose(text, Loader=yaml.SafeLoader)
        except yaml.YAMLError:
            return None
        if not isinstance(node, yaml.MappingNode) or twice(node):
            return None
        return {k.value: v.value.rstrip("\n") if isinstance(v, yaml.ScalarNode) else None for k, v in node.value}

    rng = random.Random(3)
    lines = ["a: b", "k: 'q'", 'k2: "d"', "- x", "- a: 1", "  - y", "  z: 1", "x:", "l: [a, b]", "m: {a: 1}", "# c", "", "text", "  cont", "n: |", "  bl: ock", "u: *a", "v: &a 1", "w: - x", "y: x: z", "'s s': 1", "o: {a: b, c}", "p: >-", "a: 2", "- - z", "k3: # c", "k4: v # c"]
    for _ in range(4000):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 5)))
        mine, theirs = yaml_block.mapping(text.split("\n")), judged(text)
        assert (mine is None) == (theirs is None), text
        assert all(mine[k] == v for k, v in (theirs or {}).items() if v is not None and "\n" not in v and not mine[k].startswith("*")), text


def test_front_matter_keeps_what_is_no_mapping(spark):
    found = M.front_matter(docs(spark, "---\nk: v # c\n---\nBody", "---\nkey: - x\n---\nBody", "---\n\n---\nBody\n", "\ufeff---\n'a': \"b\"\n---\n", "---\nopen: 1\n", None)).orderBy("doc_id").collect()
    assert [(r["has_fm"], r["fm"], r["body"]) for r in found] == [(True, {"k": "v"}, "Body"), (False, {}, "---\nkey: - x\n---\nBody"), (True, {}, "Body\n"), (True, {"a": "b"}, "\n"), (False, {}, "---\nopen: 1\n"), (False, {}, None)]


# Inline marks


@pytest.mark.parametrize(
    "line, found",
    [
        ("[t](<a b.md>)", [(False, "t", "a b.md", "")]),
        ("[t](a.md 'one (x)')", [(False, "t", "a.md", "one (x)")]),
        ('[t](a.md "say \\"x\\"")', [(False, "t", "a.md", 'say "x"')]),
        ("[t](a.md (paren))", [(False, "t", "a.md", "paren")]),
        ("[t](x_(y)_(z(w)).md)", [(False, "t", "x_(y)_(z(w)).md", "")]),
        ("[![alt](s.png)](l.md)", [(False, "alt", "l.md", ""), (True, "alt", "s.png", "")]),
        ("`[n](c.md)` ``[n`](c.md)`` [y](d.md)", [(False, "y", "d.md", "")]),
        ("\\[n](c.md) [y\\]z](d.md)", [(False, "y]z", "d.md", "")]),
        ("[out [in](i.md) side](o.md)", [(False, "in", "i.md", "")]),
        ("![out [in](i.md) side](o.png)", [(False, "in", "i.md", ""), (True, "out in side", "o.png", "")]),
        ("[a [b] c](d.md)", [(False, "a [b] c", "d.md", "")]),
        ("[never closed [y](d.md)", [(False, "y", "d.md", "")]),
        ("[t]() [u](<>)", [(False, "t", "", ""), (False, "u", "", "")]),
        ("[t](a b.md) [u](a(.md)", []),
        ("[`c*d*` **b** _i_](d.md)", [(False, "c*d* b i", "d.md", "")]),
        ("[a](x\\).md) <b title='](y)'>", [(False, "a", "x).md", "")]),
        ("[^1](a.md)", [(False, "^1", "a.md", "")]),
        ("] [a](b.md) ]( )", [(False, "a", "b.md", "")]),
    ],
)
def test_links(spark, line, found):
    rows = M.md_links(docs(spark, line)).collect()
    assert sorted((r["is_image"], r["text"], r["dest"], r["title"]) for r in rows) == sorted(found)


@pytest.mark.parametrize(
    "text, shown",
    [
        ("**[a](b)** `c*d*` ![alt](x.png 't')", "a c*d* alt"),
        ("a \\*not\\* *yes* __strong__ snake_case_word ~~gone~~", "a *not* yes strong snake_case_word gone"),
        ("***both*** **a *b* c**", "both a b c"),
        ("x <b>tag</b> <https://e.org/a_b_c> 1 < 2 &amp; 3", "x tag https://e.org/a_b_c 1 < 2 & 3"),
        ("`` a`b `` and `&lt;`", "a`b and &lt;"),
        ("2 * 3 * 4 and lone ` tick", "2 * 3 * 4 and lone ` tick"),
        ("line\nbreak", "line break"),
        ("private \ue000\ue001 use", "private \ue000\ue001 use"),
        ("", ""),
    ],
)
def test_plain_text(spark, text, shown):
    assert spark.createDataFrame([(text,)], "t string").select(T.plain_text(F.col("t")).alias("x")).first()["x"] == shown


# Tables, tasks, fences


def test_table_cells(spark):
    table = "| a | b |\n|---|:-:|\n| x \\| y | `p | q` |\n| ``r`s | t`` | lone ` tick |\n"
    rows = M.md_tables(docs(spark, table)).filter("not is_header").orderBy("row_no", "col_no").collect()
    assert [(r["cell"], r["align"]) for r in rows] == [("x | y", "none"), ("`p | q`", "center"), ("``r`s | t``", "none"), ("lone ` tick", "center")]
    split = M.md_tables(docs(spark, table), pipes_in_code_split=True).filter("row_no = 1").orderBy("col_no").collect()
    assert [r["cell"] for r in split] == ["x | y", "`p", "q`"]


def test_tasks(spark):
    found = M.task_items(docs(spark, "- [ ] a\n1. [x] b\n2) [X]  c\n* [y] d\n[x] e\n   + [x]\tf\n~~~\n- [ ] g\n~~~")).orderBy("line_no").collect()
    assert [(r["checked"], r["text"]) for r in found] == [(False, "a"), (True, "b"), (True, "c"), (True, "f")]


def test_fences(spark):
    text = "~~~py\n# no\n```\n~~\n~~~~\n# Yes\n``` `x`\n# Also\n```js\na\n````\n# Third\n~~~\n# open"
    assert [r["text"] for r in M.headings(docs(spark, text)).orderBy("line_no").collect()] == ["Yes", "Also", "Third"]
    found = M.code_blocks(docs(spark, text)).orderBy("start_line").collect()
    assert [(r["lang"], r["code"]) for r in found] == [("py", "# no\n```\n~~"), ("js", "a"), ("", "# open")]


# Callouts


def test_nested_callouts(spark):
    text = "> [!NOTE] Outer\n> text\n> > [!TIP] Inner\n> > more\n> !!! bug \"Box\"\n>     in the box\n>     ::: warning Deep\n>     deepest\n>     :::\n> end\n\n:::info\n> [!quote]\n> said\n:::\n> > [!TIP] in a plain quote"
    found = M.callouts(docs(spark, text)).orderBy("line_no").collect()
    assert [(r["line_no"], r["depth"], r["parent_line"], r["syntax"], r["kind"], r["title"], r["body"]) for r in found] == [
        (0, 1, None, ">", "note", "Outer", 'text\n> [!TIP] Inner\n> more\n!!! bug "Box"\n    in the box\n    ::: warning Deep\n    deepest\n    :::\nend'),
        (2, 2, 0, ">", "tip", "Inner", "more"),
        (4, 2, 0, "!!!", "bug", "Box", "in the box\n::: warning Deep\ndeepest\n:::"),
        (6, 3, 4, ":::", "warning", "Deep", "deepest"),
        (11, 1, None, ":::", "info", "Info", "> [!quote]\n> said"),
        (12, 2, 11, ">", "quote", "Quote", "said"),
    ]


def test_callouts_end_at_depth(spark):
    found = M.callouts(docs(spark, "\n".join("> " * k + f"[!TIP] Level {k}" for k in range(1, 13)))).orderBy("depth").collect()
    assert [r["depth"] for r in found] == list(range(1, 10)) and found[-1]["body"].startswith("> [!TIP] Level 10\n")


def test_marks_take_linear_time():
    """Documents of many marks are read in one pass."""
    import time

    for line in ("```", "> [!NOTE] x", ":::note", "!!! tip", "| a | b |", "|---|---|", "[^1]: note", "    more", "~~~"):
        started = time.time()
        marks([line, "text"] * 50_000)
        assert time.time() - started < 5, line
