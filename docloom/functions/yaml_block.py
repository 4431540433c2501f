"""Whether a block of lines is a YAML mapping, and what stands under its top-level keys.

A push-down recogniser for the YAML that front matter holds: block mappings and sequences by indentation, flow collections over lines, quoted scalars with their
escapes, block scalars, anchors, aliases, tags and comments. It judges structure and gives top-level keys with their scalars; it does not build values.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from docloom.functions.blocks import in_pieces

_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": " ", "P": " "}
_HEX = {"x": 2, "u": 4, "U": 8}
_BLOCK_SCALAR = re.compile(r"[|>](?:[1-9]?[+-]?|[+-][1-9])[ \t]*(?: #.*)?$")
_PROPERTY = re.compile(r"(&[^\s\[\]{},]+|!<[^>\s]*>|!\S*)(?:[ \t]+|$)")
_ALIAS = re.compile(r"\*([^\s\[\]{},]+)")
_DEEPEST = 100


class NoYaml(ValueError):
    """The block is no YAML that a mapping can be."""


class Block:
    """The lines of a block, and the place up to which they are read."""

    def __init__(self, lines: list[str]):
        self.lines, self.at = lines, 0
        self.anchors: set[str] = set()
        for line in lines:
            if re.match(r" *\t", line) and line.strip() and not line.lstrip().startswith("#"):
                raise NoYaml("a tab indents")

    def skip(self) -> None:
        """Go past blank lines and comments."""
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith("#")):
            self.at += 1

    def indent(self) -> int:
        """The indentation of the next line with content, -1 at the end."""
        self.skip()
        if self.at == len(self.lines):
            return -1
        line = self.lines[self.at]
        return len(line) - len(line.lstrip(" "))


def _rest(text: str) -> None:
    """Only a comment may stand after a value."""
    if text.strip() and not re.match(r"[ \t]+#", text):
        raise NoYaml("text after a value")


def _properties(block: Block, text: str) -> str:
    """text without anchors and tags."""
    while m := _PROPERTY.match(text):
        if m[1].startswith("&"):
            block.anchors.add(m[1][1:])
        text = text[m.end() :]
    return text


def _double(text: str) -> tuple[str, int] | None:
    """(value, end) of a double-quoted scalar that begins text, None if its end is not in it."""
    out, i = [], 1
    while i < len(text):
        c = text[i]
        if c == '"':
            return "".join(out), i + 1
        if c == "\\":
            if i + 1 == len(text):
                return None
            e = text[i + 1]
            if e in _HEX:
                digits = text[i + 2 : i + 2 + _HEX[e]]
                if len(digits) < _HEX[e] or not re.fullmatch("[0-9a-fA-F]+", digits) or int(digits, 16) > 0x10FFFF:
                    raise NoYaml("escape")
                out.append(chr(int(digits, 16)))
                i += 2 + _HEX[e]
                continue
            if e == "\n":
                i += 2
                while i < len(text) and text[i] in " \t":
                    i += 1
                continue
            if e not in _ESCAPES:
                raise NoYaml("escape")
            out.append(_ESCAPES[e])
            i += 2
            continue
        out.append(c)
        i += 1
    return None


def _single(text: str) -> tuple[str, int] | None:
    m = re.match(r"'((?:[^']|'')*)'(?!')", text, re.S)
    return (m[1].replace("''", "'"), m.end()) if m else None


def _quoted(block: Block, text: str) -> tuple[str, str]:
    """(value, what follows on its last line) of a quoted scalar, which may go on over lines of any indentation."""
    read = _double if text[0] == '"' else _single
    while True:
        found = read(text)
        if found:
            return re.sub(r"[ \t]*\n[ \t]*", " ", found[0]), text[found[1] :]
        if block.at >= len(block.lines):
            raise NoYaml("quote is not ended")
        text += "\n" + block.lines[block.at]
        block.at += 1


def _flow(block: Block, text: str) -> tuple[str, str]:
    """(source, what follows) of a flow collection that begins text; a stack of brackets over as many lines as it takes.

    An open collection is [bracket, what may stand next (an entry, the value behind a colon, or a separator as one is done), keys, whether the entry has a colon].
    """
    stack: list[list] = []
    source: list[str] = []
    # A plain scalar goes on after a line break.
    plain = broken = False
    while True:
        text = text.lstrip(" \t")
        if not text or text[0] == "#":
            if block.at >= len(block.lines):
                raise NoYaml("flow is not ended")
            text = block.lines[block.at]
            block.at += 1
            broken = True
            continue
        c, top = text[0], stack[-1] if stack else None
        if c in "[{" and (top is None or top[1] != "done"):
            if len(stack) >= _DEEPEST:
                raise NoYaml("too deep")
            stack.append([c, "entry", set(), False])
            text, took, plain = text[1:], c, False
        elif top is None:
            raise NoYaml("flow")
        elif c in "]}":
            if (c == "]") != (top[0] == "["):
                raise NoYaml("brackets")
            stack.pop()
            text, took, plain = text[1:], c, False
            if not stack:
                return "".join(source).rstrip(", ") + c, text
            stack[-1][1] = "done"
        elif c == ",":
            if top[1] == "entry":
                raise NoYaml("an entry is missing")
            top[1], top[3] = "entry", False
            text, took, plain = text[1:], ", ", False
        elif c == ":" and top[1] == "done" or (c == ":" and text[1:2] in ("", " ", "\t", ",", "[", "]", "{", "}")):
            if top[3]:
                raise NoYaml("two colons")
            top[1], top[3] = "value", True
            text, took, plain = text[1:], ": ", False
        else:
            if top[1] == "done" and not (plain and broken):
                raise NoYaml("a comma is missing")
            goes_on, before = top[1] == "done", text
            if c == "?" and text[1:2] in (" ", "\t"):
                raise NoYaml("a key of its own mark")
            text = _properties(block, text)
            if not text:
                continue
            if text[0] in "[{":
                continue
            key, plain, broken = None, False, False
            if text[0] in "\"'":
                key, text = _quoted(block, text)
            elif m := _ALIAS.match(text):
                if m[1] not in block.anchors:
                    raise NoYaml("unknown alias")
                text = text[m.end() :]
            else:
                m = re.match(r"(?![@`%|>!&]|[-?][ \t])(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|$)|(?<=[^\s])#|[ \t]+(?![\s#,:\[\]{}])|[ \t]+(?=:[^\s,\[\]{}]))+", text)
                if not m:
                    raise NoYaml("flow scalar")
                key, text, plain = m[0], text[m.end() :], True
            if top[0] == "{" and top[1] == "entry" and re.match(r"[ \t]*:(?:[\s,\[\]{}]|$)", text) and key is not None:
                if key in top[2]:
                    raise NoYaml("a key twice")
                top[2].add(key)
            took = (" " if goes_on else "") + (before[: len(before) - len(text)].strip() if before.endswith(text) else str(key))
            top[1] = "done"
        source.append(took)


def _plain_end(text: str) -> int:
    """Where a plain scalar that begins text ends: at `: `, at ` #` or at the end of the line."""
    m = re.search(r":(?=[ \t]|$)|[ \t]#", text)
    return m.start() if m else len(text)


def _key(block: Block, text: str) -> tuple[str, str] | None:
    """(key, what follows the colon) if text is an entry of a block mapping."""
    bare = _properties(block, text)
    if bare[:1] in ('"', "'"):
        found = (_double if bare[0] == '"' else _single)(bare)
        if found and re.match(r"[ \t]*:(?:[ \t]|$)", bare[found[1] :]):
            return found[0], bare[found[1] :].lstrip(" \t")[1:]
        return None
    if m := re.match(r"\*([^\s\[\]{},]+)[ \t]+:(?=[ \t]|$)", bare):
        if m[1] not in block.anchors:
            raise NoYaml("unknown alias")
        return m[0][:-1].strip(), bare[m.end() :]
    if bare[:1] and bare[0] in "[{":
        depth = Block([])
        try:
            source, rest = _flow(depth, bare)
        except NoYaml:
            return None
        return (source, rest.lstrip(" \t")[1:]) if re.match(r"[ \t]*:(?:[ \t]|$)", rest) else None
    end = _plain_end(bare)
    if bare[end : end + 1] != ":" or not bare or bare[0] in "#&*!|>@`%,[]{}":
        return None
    if bare[0] in "-?" and bare[1:2] in ("", " ", "\t"):
        return None
    return bare[:end].rstrip(), bare[end + 1 :]


def _scalar(block: Block, text: str, indent: int) -> str:
    """A plain scalar and the lines that it goes on over, which are indented more than its parent."""
    if text[0] in "@`%|>!&,]}" or (text[0] in "-?:" and text[1:2] in ("", " ", "\t")):
        raise NoYaml("no scalar")
    end = _plain_end(text)
    if text[end : end + 1] == ":":
        raise NoYaml("a mapping in a value")
    parts = [text[:end].strip()]
    commented = bool(text[end:].strip())
    while block.at < len(block.lines):
        line = block.lines[block.at]
        if not line.strip():
            block.at += 1
            continue
        if len(line) - len(line.lstrip(" ")) <= indent:
            break
        own = line.strip()
        if own.startswith("#"):
            block.at += 1
            commented = True
            continue
        end = _plain_end(own)
        if commented or own[end : end + 1] == ":":
            raise NoYaml("a value goes on as something else")
        parts.append(own[:end].strip())
        commented = bool(own[end:].strip())
        block.at += 1
    return " ".join(parts)


def _value(block: Block, text: str, indent: int, depth: int, in_sequence: bool = False) -> str:
    """What follows a key or a dash: the scalar's value, the source of a flow collection, or nothing for what stands on lines of its own.

    indent is that of the entry; a block below must be indented more, a sequence below a key may stand at its own column.
    """
    if depth > _DEEPEST:
        raise NoYaml("too deep")
    text = text.strip(" \t")
    text = _properties(block, text)
    if text.startswith("#"):
        text = ""
    if not text:
        below = block.indent()
        line = block.lines[block.at][below:] if below >= 0 else ""
        dash = line[:1] == "-" and line[1:2] in ("", " ", "\t")
        if below > indent or (below == indent and dash and not in_sequence and indent >= 0):
            return _node(block, below, depth + 1)
        return ""
    if text[0] in "|>":
        if not _BLOCK_SCALAR.match(text):
            raise NoYaml("block scalar")
        lines = []
        while block.at < len(block.lines) and (not block.lines[block.at].strip() or len(block.lines[block.at]) - len(block.lines[block.at].lstrip(" ")) > indent):
            lines.append(block.lines[block.at].strip())
            block.at += 1
        while lines and not lines[-1]:
            lines.pop()
        return ("\n" if text[0] == "|" else " ").join(lines)
    if text[0] in "\"'":
        value, rest = _quoted(block, text)
        _rest(rest)
        return value
    if text[0] in "[{":
        source, rest = _flow(block, text)
        _rest(rest)
        return source
    if m := _ALIAS.match(text):
        if m[1] not in block.anchors:
            raise NoYaml("unknown alias")
        _rest(text[m.end() :])
        return m[0]
    return _scalar(block, text, indent)


def _node(block: Block, indent: int, depth: int) -> str:
    """A block collection or scalar on lines of its own at this indentation."""
    if depth > _DEEPEST:
        raise NoYaml("too deep")
    line = block.lines[block.at][indent:]
    if line[:1] == "-" and line[1:2] in ("", " ", "\t"):
        _sequence(block, indent, depth)
        return ""
    if (line[:1] == "?" and line[1:2] in ("", " ", "\t")) or _key(block, line) is not None:
        _mapping(block, indent, depth)
        return ""
    block.at += 1
    return _value(block, line, indent - 1, depth + 1)


def _inline(block: Block, text: str, column: int, depth: int) -> None:
    """A collection that begins on the line of a dash: its first entry is read as if it stood alone at its column."""
    block.at -= 1
    block.lines[block.at] = " " * column + text
    _node(block, column, depth)


def _sequence(block: Block, indent: int, depth: int) -> None:
    while block.indent() == indent:
        line = block.lines[block.at]
        if line[indent : indent + 1] != "-" or line[indent + 1 : indent + 2] not in ("", " ", "\t"):
            return
        rest = line[indent + 1 :]
        text = rest.lstrip(" \t")
        block.at += 1
        bare = _properties(block, text)
        if bare and ((bare[0] == "-" and bare[1:2] in ("", " ", "\t")) or _key(block, bare) is not None):
            _inline(block, bare, indent + 1 + len(rest) - len(bare), depth + 1)
        else:
            _value(block, text, indent, depth + 1, in_sequence=True)
    if block.indent() > indent:
        raise NoYaml("indentation")


def _mapping(block: Block, indent: int, depth: int) -> dict[str, str]:
    out: dict[str, str] = {}
    while block.indent() == indent:
        line = block.lines[block.at][indent:]
        found = _key(block, line)
        if found is None:
            raise NoYaml("no entry")
        key, rest = found
        if key in out:
            raise NoYaml("a key twice")
        if rest[:1] not in ("", " ", "\t"):
            raise NoYaml("no blank after a colon")
        block.at += 1
        # A sequence or a mapping cannot begin on a key's own line.
        text = _properties(block, rest.strip(" \t"))
        if text[:1] in ("-", "?") and text[1:2] in ("", " ", "\t"):
            raise NoYaml("a collection on a key's line")
        out[key] = _value(block, rest, indent, depth + 1)
    if block.indent() > indent:
        raise NoYaml("indentation")
    return out


def mapping(lines: list[str]) -> dict[str, str] | None:
    """The top-level keys of a block that is a YAML mapping, with their scalars (quotes and escapes resolved, comments cut), the source of flow collections and nothing for blocks below; None for other blocks."""
    try:
        block = Block(list(lines))
        indent = block.indent()
        if indent < 0:
            return None
        line = block.lines[block.at][indent:]
        if line[:1] == "{" and _key(block, line) is None:
            block.at += 1
            source, rest = _flow(block, line)
            _rest(rest)
            out = _flow_entries(source)
        elif _key(block, line) is not None:
            out = _mapping(block, indent, 0)
        else:
            return None
        return out if block.indent() < 0 else None
    except NoYaml:
        return None


def _flow_entries(source: str) -> dict[str, str]:
    """The entries of a flow mapping's source."""
    out, depth, quote, part, parts = {}, 0, "", "", []
    for c in source[1:-1]:
        quote = "" if c == quote else quote or (c if c in "\"'" and not part.strip() or c in "\"'" and part.rstrip().endswith(":") else "")
        depth += (c in "[{") - (c in "]}") if not quote else 0
        if c == "," and not depth and not quote:
            parts.append(part)
            part = ""
        else:
            part += c
    for entry in [*parts, part]:
        if entry.strip():
            block = Block([])
            found = _key(block, entry.strip() if ":" in entry else entry.strip() + ":") or (entry.strip(), "")
            text = found[1].strip()
            out[found[0]] = _value(block, text, -1, 0) if text and text[0] != "*" else text
    return out


@F.arrow_udf(MapType(StringType(), StringType()))
def mapping_of(blocks: pa.Array) -> pa.Array:
    """mapping() of each block; null for a null block and for one that is no mapping."""

    def made(own: list) -> pa.Array:
        found = [None if x is None else mapping(x) for x in own]
        return pa.array([None if x is None else list(x.items()) for x in found], pa.map_(pa.string(), pa.string()))

    return in_pieces(blocks, made)
