"""Inline Markdown of a line: one scan from left to right into tokens, and one fold over its brackets with a stack.

A token is an escape, a code span, a tag, an autolink, a bracket, a closing bracket with the target of a link behind it, or text, so what one construct
holds never looks like another. The fold keeps the open brackets: a closing one with a target makes a link or an image of the innermost, and a link closes
the brackets of links around it, as links do not nest. All are column expressions.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPE = r"\\[!-/:-@\[-`{-~]"
CODE = r"(`++)(?!`).+?(?<!`)\1(?!`)"
AUTOLINK = r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*+>"
TAG = r"<(?:!--.*?--|/?[A-Za-z][^<>]*+)>"


def _target(capture: str) -> str:
    """What stands behind the closing bracket of a link: a destination in angle brackets or with balanced parentheses, and a title in one of three quotes."""
    unit = r"\\.|[^\s\\()]"
    nested = rf"(?:{unit})"
    for _ in range(8):
        nested = rf"(?:{unit}|\({nested}*+\))"
    title = r"""\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\])*+'|\((?:\\.|[^()\\])*+\)"""
    return rf"\]\(\s*+{capture}<(?:\\.|[^<>\\\n])*+>|(?!<){nested}++)?(?:\s++{capture}{title}))?\s*+\)"


TARGET = _target("(?:")
TARGET_PARTS = rf"(?s)^{_target('(')}$"
TOKEN = rf"(?s){ESCAPE}|{CODE}|`++|{AUTOLINK}|{TAG}|!\[|{TARGET}|[\[\]]|[^\\`<!\[\]]++|."
#: Marks of emphasis that stand for themselves are put aside as noncharacters while emphasis is read.
MARKS, ASIDE = "*_~", "\ufdd0\ufdd1\ufdd2"
EMPHASIS = [
    r"(\*{1,3})(?=[^\s*])([^*]*?[^\s*])\1",
    r"(?<![\p{L}\p{N}_])(_{1,3})(?=[^\s_])([^_]*?[^\s_])\1(?![\p{L}\p{N}_])",
    r"(~{1,2})(?=[^\s~])([^~]*?[^\s~])\1",
]


def entities(text: Column) -> Column:
    """Text with its character references as characters: by name as HTML 4 has them, by number in either base; others stay as they are.

    Numbers of no character (surrogates, zero and beyond Unicode) become the replacement character.
    """
    names = F.create_map(*(F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (name, chr(code))))

    def read(piece: Column) -> Column:
        decimal, hexadecimal = F.regexp_extract(piece, r"^&#0*(\d{1,7});$", 1), F.regexp_extract(piece, r"(?i)^&#x0*([0-9a-f]{1,6});$", 1)
        code = F.when(decimal != "", decimal).when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).cast("int")
        sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        mark = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.try_element_at(names, F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*);$", 1))
        return F.when(code.isNotNull(), F.when(sound, mark).otherwise("\ufffd")).otherwise(F.coalesce(named, piece))

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#?[A-Za-z0-9]{1,32};|[^&]++|&"), F.lit(0))
    read_all = F.array_join(F.transform(pieces, lambda x: F.when(F.startswith(x, F.lit("&")) & (F.length(x) > 1), read(x)).otherwise(x)), "")
    return F.when(F.contains(text, F.lit("&")), read_all).otherwise(text)


def tokens(text: Column) -> Column:
    """A text's tokens; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def links(found: Column) -> Column:
    """Links and images among tokens as array<struct<a, b, image>>: the places of the bracket that opens one and of the one that closes it, inner ones first."""
    kind = lambda t: F.when(t == "[", 1).when(t == "![", 2).when(t == "]", 3).when(F.startswith(t, F.lit("](")), 4).otherwise(0)
    marks = F.filter(F.transform(found, lambda t, i: F.struct(i.alias("i"), kind(t).alias("k"))), lambda m: m["k"] > 0)
    start = F.struct(F.array().cast("array<struct<i:int,image:boolean,live:boolean>>").alias("open"), F.array().cast("array<struct<a:int,b:int,image:boolean>>").alias("done"))

    def step(s, m):
        size = F.size(s["open"])
        top = F.get(s["open"], size - 1)
        rest = F.slice(s["open"], F.lit(1), F.greatest(size - 1, F.lit(0)))
        opened = F.concat(s["open"], F.array(F.struct(m["i"].alias("i"), (m["k"] == 2).alias("image"), F.lit(True).alias("live"))))
        made = (m["k"] == 4) & (size > 0) & top["live"]
        outer = F.transform(rest, lambda o: F.struct(o["i"].alias("i"), o["image"].alias("image"), (o["live"] & o["image"]).alias("live")))
        link = F.array(F.struct(top["i"].alias("a"), m["i"].alias("b"), top["image"].alias("image")))
        return F.struct(
            F.when(m["k"] < 3, opened).when(made & ~top["image"], outer).when(size > 0, rest).otherwise(s["open"]).alias("open"),
            F.when(F.coalesce(made, F.lit(False)), F.concat(s["done"], link)).otherwise(s["done"]).alias("done"),
        )

    return F.aggregate(marks, start, step, lambda s: s["done"])


def _shown(token: Column) -> Column:
    """What a token that is no bracket of a link shows, with marks that are no emphasis put aside."""
    code = F.regexp_extract(token, r"(?s)^(`++)(.+?)(?<!`)\1$", 2)
    # One blank at either end of a code span is no part of it, unless it is all blank.
    trimmed = F.when(code.rlike("(?s)^ .*[^ ].* $"), F.substring(code, F.lit(2), F.length(code) - 2)).otherwise(code)
    return (
        F.when(F.startswith(token, F.lit("`")) & (code != ""), F.translate(trimmed, MARKS, ASIDE))
        .when(token.rlike(rf"^{ESCAPE}$"), F.translate(F.substring(token, 2, 1), MARKS, ASIDE))
        .when(token.rlike(rf"^{AUTOLINK}$"), F.translate(F.substring(token, F.lit(2), F.length(token) - 2), MARKS, ASIDE))
        .when(F.startswith(token, F.lit("<")) & (F.length(token) > 1), F.lit(""))
        .otherwise(entities(token))
    )


def shown(found: Column, made: Column) -> Column:
    """What each token shows; the brackets and targets of links show nothing."""
    opens, closes = F.transform(made, lambda m: m["a"]), F.transform(made, lambda m: m["b"])
    return F.transform(found, lambda t, i: F.when(F.array_contains(opens, i) | F.array_contains(closes, i), F.lit("")).otherwise(_shown(t)))


def without_emphasis(text: Column) -> Column:
    """Text without the marks of emphasis, up to three inside each other, and with those put aside in their place again."""
    for _ in range(3):
        for rx in EMPHASIS:
            text = F.regexp_replace(text, rx, "$2")
    return F.translate(text, ASIDE, MARKS)


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")


def destination(target: Column) -> Column:
    """The destination of a closing bracket's token."""
    raw = F.regexp_extract(target, TARGET_PARTS, 1)
    return _unescaped(F.when(F.startswith(raw, F.lit("<")), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))


def title(target: Column) -> Column:
    """The title of a closing bracket's token, empty if it has none."""
    raw = F.regexp_extract(target, TARGET_PARTS, 2)
    return _unescaped(F.when(raw != "", F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))


def plain_text(text: Column) -> Column:
    """Visible text of inline Markdown: images become their alternative text, links their text, code and emphasis their content; tags go."""
    found = tokens(text)
    # A text without any mark is its own visible text.
    return F.when(text.rlike(r"[\\`<!\[\]*_~&]"), without_emphasis(F.array_join(shown(found, links(found)), ""))).otherwise(text)


def cells(row: Column, pipes_in_code_split: bool = False) -> Column:
    """The cells of a table's row: pipes that are escaped, or in a code span unless asked for, split none."""
    aside = "\ufdd3"
    kept = F.regexp_replace(F.trim(row), r"\\\|", aside)
    if not pipes_in_code_split:
        kept = F.array_join(F.transform(F.regexp_extract_all(kept, F.lit(rf"\\.|{CODE}|`++|[^\\`]++|."), F.lit(0)), lambda t: F.when(F.startswith(t, F.lit("`")), F.translate(t, "|", aside)).otherwise(t)), "")
    split = F.split(F.regexp_replace(F.regexp_replace(kept, r"^\s*\|", ""), r"\|\s*$", ""), r"\|")
    return F.transform(split, lambda c: F.translate(c, aside, "|"))
