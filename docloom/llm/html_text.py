"""Main text of web pages by composite text density.

For every node of a page, the composite density is its characters per tag, adjusted by how many of its characters and
tags are links; tags of words inside a line (but links) do not count, and text that a node holds itself counts as a child of one tag. A
node's density sum adds the densities of its children; the container with the largest sum is the main subtree, whatever it is called. The
smallest density on its path to the body is the threshold: blocks beside the path join the main subtree if they reach it and are of the same kind, and in an
article element whatever they are, as does a block before it with the page's heading; lists of links that do not reach it go. Elements that are no content by
their kind or name (menus, forms, scripts, adverts, reader comments and the like) are cut off before anything is measured, but never one
that holds the page: its heading or article and most of its text, or nearly all of it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|object|canvas|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|</([a-zA-Z][^\s>/]*)[^>]*>|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
# HTML element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav button select option dialog menu head".split())
SOFT_TAGS = frozenset("aside footer form label fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NOISE_ROLES = frozenset("navigation search dialog alert alertdialog menu menubar".split())
SOFT_ROLES = frozenset("banner contentinfo complementary form".split())
# Words of classes and ids: of what is never content; of what is none if they stand alone or last; of what makes a list of the latter; of content; of places and
# parts, which may follow a noise word; of what tells of a layout or a state, before a noise word.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored breadcrumb breadcrumbs sidebar navbar navigation masthead topbar cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe subscription signup disqus comments commentlist pagination pager social".split()
)
WEAK_NAMES = frozenset("promo promotion banner menu nav aside footer header notice login share sharing related recommended comment reply replies respond widget toolbar skip hidden".split())
LIST_NAMES = frozenset("area articles bar block box buttons form items link links list posts section stories tools wrapper".split())
CONTENT_NAMES = frozenset("article blog content entry main page post story text".split())
PART_NAMES = LIST_NAMES | frozenset("left right top bottom upper lower inner outer primary secondary first second body container content holder unit slot zone widget column col group frame icons media network networks message modal overlay bg mobile desktop notice inline".split())
LAYOUT_NAMES = frozenset("has no not non is with without hide hidden below above after before under near show toggle".split())
#: Parts of a page's text that an element must hold not to be cut: beside its heading or article, and without either.
MOST, NEARLY_ALL = 0.5, 0.8
#: Elements of text: only a class that is a noise word by itself tells of them.
TEXT_TAGS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption".split())
#: Elements that may be the main subtree.
CONTAINERS = frozenset("html body div article main section td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Implied end tags: an opening tag closes an open one of these, looked for up to the second set.
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
P_ONLY = frozenset(["p"])
P_SCOPE = frozenset("body article section main div table td th button ul ol li blockquote html".split())
GAPS = re.compile(r"\s+")


class Node:
    """An element: what it directly holds, in order, and the sums of its subtree."""

    __slots__ = ("tag", "parent", "items", "kind", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total", "inside", "head", "holds")

    def __init__(self, tag: str, parent: Node | None, kind: str = "", noise: str = ""):
        self.tag, self.parent, self.kind, self.noise = tag, parent, kind, noise
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.inside = bool(parent and parent.inside) or tag in ("article", "main")
        self.head, self.holds = tag == "h1", False

    def kids(self) -> list[Node]:
        """Children that are no noise."""
        return [x for x in self.items if isinstance(x, Node) and not x.noise]


def is_noise_name(name: str, tag: str) -> str:
    """Whether one name of a class or id tells that an element is no content: by being a noise word (word), by its parts (name), or not (empty)."""
    parts = [x for x in re.split(r"[_\-]+", name) if x]
    if len(parts) < 2:
        return "word" if name in NOISE_NAMES or (name in WEAK_NAMES and tag not in HEADINGS) else ""
    if tag in TEXT_TAGS:
        return ""
    for i, part in enumerate(parts):
        if part in NOISE_NAMES | WEAK_NAMES and not LAYOUT_NAMES.isdisjoint(parts[:i]):
            return ""
        if part in NOISE_NAMES and all(x in PART_NAMES or x in NOISE_NAMES or x in WEAK_NAMES or x[0].isdigit() for x in parts[i + 1 :]):
            return "name"
    if parts[-1] in ("header", "banner"):
        return "name" if CONTENT_NAMES.isdisjoint(parts[:-1]) or parts[0] == "page" else ""
    return "name" if parts[-1] in WEAK_NAMES or (parts[0] in WEAK_NAMES and (parts[-1] in PART_NAMES or parts[-1].isdigit())) else ""


def read_attributes(tag: str, attributes: str, parent: Node) -> tuple[str, str]:
    """An element's class, and why it is noise: always (kind), by a kind that may hold a page (soft), by a word or a longer name, or not (empty)."""
    kind, noise = "", "soft" if tag in SOFT_TAGS or (tag == "header" and not parent.inside) else ""
    if tag in NOISE_TAGS:
        return kind, "kind"
    if not attributes or tag in ("html", "body", "main"):
        return kind, noise
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)) or (name == "role" and value in NOISE_ROLES):
            return kind, "kind"
        if name == "role" and value in SOFT_ROLES:
            noise = noise or "soft"
        if name == "class":
            kind = value
        if name in ("class", "id"):
            found = [is_noise_name(x, tag) for x in value.split()]
            noise = "word" if "word" in found else noise or next((x for x in found if x), "")
    return kind, noise


class Parser:
    """The open elements of a page while it is read; how many of each kind are open is known, so no end tag looks for what is not there."""

    def __init__(self) -> None:
        self.root = self.at = Node("html", None)
        self.open: Counter = Counter()

    def enter(self, node: Node) -> None:
        self.at = node
        self.open[node.tag] += 1

    def leave(self, node: Node) -> None:
        """End all open elements up to and including this one."""
        while True:
            left, self.at = self.at, self.at.parent
            self.open[left.tag] -= 1
            if left is node:
                return

    def innermost(self, tags: frozenset, scope: frozenset = frozenset()) -> Node | None:
        """The innermost open element of these tags that no element of the scope hides."""
        if not any(self.open[t] for t in tags):
            return None
        up = self.at
        while up.parent and up.tag not in tags:
            if up.tag in scope:
                return None
            up = up.parent
        return up if up.parent else None


def parse(html: str) -> Node:
    """The page's tree; unknown end tags are skipped, open elements end with their parents, a tag that is not ended is none."""
    page = Parser()
    end = 0
    for m in TOKEN.finditer(html):
        if m.start() > end:
            page.at.items.append(html[end : m.start()])
        end = m.end()
        closing, tag = m[2], m[3]
        if closing:
            closing = closing.lower()
            if found := page.innermost(frozenset([closing])):
                page.leave(found)
            elif closing == "p" or closing == "br":
                page.at.items.append(Node("br", page.at))
        elif tag and (tag := tag.lower()) != "html":
            for ends in ((P_ONLY, P_SCOPE) if tag in CLOSES_P else None, CLOSED_BY.get(tag)):
                if ends and (found := page.innermost(*ends)):
                    page.leave(found)
            if tag == "body" and page.at.tag == "head":
                page.leave(page.at)
            new = Node(tag, page.at, *read_attributes(tag, m[4], page.at))
            page.at.items.append(new)
            if tag not in VOID and not m[4].endswith("/"):
                page.enter(new)
    if end < len(html):
        page.at.items.append(html[end:])
    return page.root


def _ordered(root: Node, noise: bool = False) -> list[Node]:
    """Nodes, parents before children, without noise unless asked for."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node) and (noise or not x.noise)]
    return out


def clear_holders(root: Node) -> None:
    """What is noise by a soft kind or by its name is none if it holds the page.

    It does if the page has no article elsewhere and it has one, or no heading elsewhere and it has it, with most of the text; or nearly all text of a page without
    either. A noise word by itself, such as of comments or adverts, must leave next to nothing of the page besides.
    """
    nodes = _ordered(root, noise=True)
    for node in reversed(nodes):
        if node.noise != "kind":
            inner = [x for x in node.items if isinstance(x, Node)]
            node.chars = 0 if node.tag == "a" else sum(len(x.strip()) for x in node.items if isinstance(x, str)) + sum(k.chars for k in inner)
            node.head |= any(k.head for k in inner)
            node.holds = node.tag in ("article", "main") or any(k.holds for k in inner)
    total = max(1, root.chars)
    seen = articles = heads = 0
    waiting: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        seen += sum(len(x.strip()) for x in node.items if isinstance(x, str))
        articles += node.tag in ("article", "main")
        heads += node.tag == "h1"
        for x in reversed(node.items):
            if isinstance(x, Node) and x.noise != "kind":
                (waiting if x.noise else todo).append(x)
        while not todo and waiting:
            x = waiting.pop()
            most = x.chars >= MOST * total and (x.noise != "word" or seen * 4 < x.chars)
            nearly_all = x.noise != "word" and x.chars >= NEARLY_ALL * total
            if (most and ((x.holds and not articles) or (x.head and not heads))) or (nearly_all and not articles and not heads):
                x.noise = ""
                todo.append(x)


def measure(root: Node) -> list[Node]:
    """Sums, composite densities and density sums of all nodes that are not noise, parents first."""
    clear_holders(root)
    nodes = _ordered(root)
    own = {}
    for node in reversed(nodes):
        own[node] = sum(len(GAPS.sub(" ", entities.unescape(x)).strip()) for x in node.items if isinstance(x, str))
        kids = node.kids()
        link = node.tag == "a"
        node.head = node.tag == "h1" or any(k.head for k in kids)
        node.chars = own[node] + sum(k.chars for k in kids)
        node.tags = sum(k.tags + (k.tag not in INLINE or k.tag == "a") for k in kids)
        node.link_chars = node.chars if link else sum(k.link_chars for k in kids)
        node.link_tags = node.tags if link else sum(k.link_tags + (k.tag == "a") for k in kids)
    body_chars, body_links = max(1, root.chars), root.link_chars
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not node.link_chars:
            node.density = c / t
        else:
            plain = max(1, c - node.link_chars)
            base = math.log(c * lc / plain + body_links * c / body_chars + math.e)
            ratio = (c / lc) * (t / lt)
            # Links never raise a density.
            node.density = c / t * min(1.0, math.log(ratio) / math.log(base)) if ratio > 1 and base > 1 else 0.0
        node.total = own[node] + sum(x.density for x in node.kids())
    return nodes


def main_nodes(nodes: list[Node]) -> tuple[list[Node], float]:
    """The roots of the main text in page order, and the threshold: the container with the largest density sum and the blocks that join it."""
    best = max((n for n in nodes if n.tag in CONTAINERS), key=lambda n: (n.total, n.chars))
    threshold, up = best.density, best
    while up.parent and up.tag != "body":
        up = up.parent
        threshold = min(threshold, up.density)
    path = [best]
    while path[-1].parent:
        path.append(path[-1].parent)
    # How far up the path lies in an article.
    inside = max((i for i, n in enumerate(path) if n.tag == "article"), default=-1)
    chosen = [best]
    for level, at in enumerate(path[:-1]):
        kids = at.parent.kids()
        place = kids.index(at)
        # The page's heading joins whatever its length; other blocks by their density and kind, those of the same article unless they are links.
        heading = [x for x in kids[:place] if x.head and not at.head and not _is_link_list(x)]
        alike = [x for x in kids if x is not at and x.chars and not _is_link_list(x) and (level < inside or (x.density >= threshold and _alike(x, at)))]
        chosen = [x for x in kids[:place] if x in heading or x in alike] + chosen + [x for x in kids[place + 1 :] if x in alike]
    return chosen, threshold


def _alike(x: Node, other: Node) -> bool:
    """Whether two blocks are of one kind: tag and class, and paragraphs where a div has no class."""
    return x.tag == other.tag and x.kind == other.kind and (bool(x.kind) or x.tag != "div" or any(k.tag == "p" for k in x.kids()))


def _is_link_list(node: Node) -> bool:
    """Whether most of a block's characters are links."""
    return node.chars > 0 and node.link_chars * 2 > node.chars and node.link_tags > 1


def main_text(html: str) -> str:
    """The blocks of the main subtree in page order, joined by newlines."""
    nodes = measure(parse(html))
    roots, threshold = main_nodes(nodes)
    blocks: list[str] = []
    line: list[str] = []

    def ended() -> None:
        if text := GAPS.sub(" ", entities.unescape("".join(line))).strip():
            blocks.append(text)
        line.clear()

    todo: list[Node | str | None] = [x for root in reversed(roots) for x in (None, root)]
    while todo:
        item = todo.pop()
        if item is None:
            ended()
        elif isinstance(item, str):
            line.append(item)
        elif item.noise or (item not in roots and item.tag not in INLINE and item.density < threshold and _is_link_list(item)):
            ended() if item.tag not in INLINE else None
        else:
            if item.tag not in INLINE:
                ended()
                todo.append(None)
            todo += reversed(item.items)
    ended()
    return "\n".join(blocks)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df without html_col, with text and n_chars (long, code points).

    A null or empty html has an empty text; a page of any length or depth is read whole. Each row is read alone, so repeated rows and null ids are
    returned as they are; an empty table gives an empty result; columns of df named text or n_chars are replaced.
    """
    rest = [c for c in df.columns if c not in (html_col, "text", "n_chars")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x or "") for x in b[html_col].to_pylist()]
            yield pa.record_batch([*(b[c] for c in rest), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return df.select(*rest, F.col(html_col)).mapInArrow(run, f"{fields}, text string, n_chars long")


def op9_text_density(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
