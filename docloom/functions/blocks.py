"""What the lines of a Markdown document are, found in one pass over them: fences, callouts, tables and footnote definitions.

These are state machines with a stack (a callout's body is a document again), which column expressions can only fold with work that grows with the square of a document's
marks. The pass returns positions; texts and facts are made from them by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from docloom.functions.text import ALIAS_KIND

#: Documents whose lines are Python objects at a time.
PIECE = 128
#: Callouts of a depth below this have their bodies read for further ones.
DEEPEST = 9
BLANK = " \t\n\x0b\f\r"
QUOTE = re.compile(r" {0,3}>")
QUOTED = re.compile(r" {0,3}> ?")
QUOTE_MARK = re.compile(r" {0,3}> ?[ \t]*\[!([^\]]*)\](.*)$", re.S)
BLOCK_MARK = re.compile(r"\s*(:::|!!!)\s*(\S+)(.*)$", re.S | re.A)
FENCE = re.compile(r"\s*(`{3,}|~{3,})(.*)$", re.S | re.A)
DEFINITION = re.compile(r"\s*\[\^[^\]\[:]+\]\s*[:：]", re.A)
RULE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def _fences(lines: list[str]) -> tuple[list[tuple[int, int, bool]], list[tuple[int, int]]]:
    """(code fences with whether they are closed, fences by the stricter rule for footnotes), each by its first and last line.

    A code fence is ended by a line of as many or more of its marks, either ` or ~. For footnotes only backticks count, and only a line of exactly as many ends one.
    """
    code, strict = [], []
    mark, code_at, code_n, strict_at, strict_n = "", -1, 0, -1, 0
    for i, line in enumerate(lines):
        if "```" not in line and "~~~" not in line:
            continue
        m = FENCE.match(line)
        if not m:
            continue
        n, bare = len(m[1]), not m[2].strip(BLANK)
        if code_at < 0:
            if m[1][0] == "~" or "`" not in m[2]:
                mark, code_at, code_n = m[1][0], i, n
        elif bare and m[1][0] == mark and n >= code_n:
            code.append((code_at, i, True))
            code_at = -1
        if m[1][0] == "`":
            if strict_at < 0:
                strict_at, strict_n = i, n
            elif bare and n == strict_n:
                strict.append((strict_at, i))
                strict_at = -1
    if code_at >= 0:
        code.append((code_at, len(lines) - 1, False))
    if strict_at >= 0:
        strict.append((strict_at, len(lines) - 1))
    return code, strict


def _marker(line: str) -> tuple[str, str, str] | None:
    """(syntax, kind, title) of a line that opens a callout of a known kind."""
    if "[!" in line and (m := QUOTE_MARK.match(line)):
        kind = ALIAS_KIND.get(m[1].rstrip("+-").strip(" ").lower())
        if kind:
            return ">", kind, m[2].strip()
    if (":::" in line or "!!!" in line) and (m := BLOCK_MARK.match(line)):
        kind, title = ALIAS_KIND.get(m[2].lower()), m[3].strip()
        if kind:
            return m[1], kind, title[1:-1] if len(title) > 1 and title[0] == title[-1] and title[0] in "\"'" else title
    return None


def _body(lines: list[str], i: int, syntax: str) -> tuple[int, list[str]]:
    """(the place after a callout's last line, its lines without their marks) of a callout whose marker stands at i."""
    at, out = i + 1, []
    while at < len(lines):
        line = lines[at]
        if syntax == ":::":
            if line.strip(" ") == ":::":
                return at + 1, out
            out.append(line)
        elif syntax == ">":
            if not QUOTE.match(line):
                break
            out.append(QUOTED.sub("", line, count=1))
        else:
            if line.strip(BLANK) and line[0] not in " \t":
                break
            out.append(line[4:] if line.startswith("    ") else line[1:] if line.startswith("\t") else line.lstrip(BLANK))
        at += 1
    return at, out


def _callouts(lines: list[str], first: int = 0, depth: int = 1, parent: int | None = None) -> Iterator[tuple]:
    """Callouts in order, those inside others after them: (line, syntax, kind, title, last line, depth, line of the one it is in, body)."""
    at = 0
    while at < len(lines):
        mark = _marker(lines[at])
        if not mark:
            at += 1
            continue
        end, body = _body(lines, at, mark[0])
        yield first + at, *mark, first + end - 1, depth, parent, "\n".join(body).rstrip("\n")
        if depth < DEEPEST:
            yield from _callouts(body, first + at + 1, depth + 1, first + at)
        at = end


def _stop(lines: list[str], at: int, goes_on) -> int:
    while at < len(lines) and goes_on(at):
        at += 1
    return at


def marks(lines: list[str]) -> dict:
    """All positions of one document, as the column function returns them."""
    code, strict = _fences(lines)
    in_fence = [False] * len(lines)
    for a, b, _ in code:
        in_fence[a : b + 1] = [True] * (b + 1 - a)
    fence_id: list[int | None] = [None] * len(lines)
    for k, (a, b) in enumerate(strict):
        fence_id[a : b + 1] = [k] * (b + 1 - a)
    found = list(_callouts(lines))
    in_body = [False] * len(lines)
    for i, syntax, _, _, last, depth, _, _ in found:
        if depth == 1 and syntax != ">":
            in_body[i : last + 1] = [True] * (last + 1 - i)
    row = [("|" in x) and not in_fence[i] and not QUOTE.match(x) for i, x in enumerate(lines)]
    tables, defs, stop = [], [], 0
    for i, x in enumerate(lines):
        if row[i] and i and row[i - 1] and "-" in x and RULE.match(x):
            # Rules of one run of rows share its end.
            stop = stop if stop > i else _stop(lines, i + 1, lambda k: row[k])
            tables.append((i, stop))
        if "[^" in x and DEFINITION.match(x) and not x.startswith(("    ", "\t")):
            defs.append((i, _stop(lines, i + 1, lambda k: lines[k].startswith(("    ", "\t")))))
    names = ("i", "syntax", "kind", "title", "last", "depth", "parent", "body")
    return {
        "in_fence": in_fence,
        "in_body": in_body,
        "fence_id": fence_id,
        "fences": [{"a": a, "b": b, "closed": closed} for a, b, closed in code],
        "found": [dict(zip(names, f, strict=True)) for f in found],
        "tables": [{"r": r, "stop": s} for r, s in tables],
        "defs": [{"i": i, "stop": s} for i, s in defs],
    }


_TEXT, _INT, _FLAG = pa.string(), pa.int32(), pa.bool_()
_FOUND = pa.struct([("i", _INT), ("syntax", _TEXT), ("kind", _TEXT), ("title", _TEXT), ("last", _INT), ("depth", _INT), ("parent", _INT), ("body", _TEXT)])
_KIND = pa.struct(
    [
        ("in_fence", pa.list_(_FLAG)),
        ("in_body", pa.list_(_FLAG)),
        ("fence_id", pa.list_(_INT)),
        ("fences", pa.list_(pa.struct([("a", _INT), ("b", _INT), ("closed", _FLAG)]))),
        ("found", pa.list_(_FOUND)),
        ("tables", pa.list_(pa.struct([("r", _INT), ("stop", _INT)]))),
        ("defs", pa.list_(pa.struct([("i", _INT), ("stop", _INT)]))),
    ]
)


def in_pieces(column: pa.Array, make: Callable[[list], pa.Array]) -> pa.Array:
    """make() of the values of a column, PIECE at a time, as one array: of a batch only a piece is held as Python objects."""
    return pa.concat_arrays([make(column.slice(at, PIECE).to_pylist()) for at in range(0, max(len(column), 1), PIECE)])


@F.arrow_udf(from_arrow_type(_KIND))
def line_marks(lines: pa.Array) -> pa.Array:
    """marks() of each document's lines."""
    return in_pieces(lines, lambda own: pa.array([marks(x or []) for x in own], _KIND))
