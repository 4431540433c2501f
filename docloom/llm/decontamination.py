"""Benchmark decontamination by templates.

Texts are brought to templates: numbers, units and names (capitalised words inside a sentence) become typed placeholders, other
words lose case and punctuation. A capitalised word that opens a sentence may be a name or not, so there is a second template in which
it is one, and a third without placeholders. Windows of `PIECE` template tokens of the benchmark items are hashed; the same windows of
every document meet them by a hash join against the items' windows, which are broadcast in blocks of bounded size. A
matching window counts only if its slots are consistent: within an alignment, one value of an item's slot
always goes with one value in the document, and a window of slots alone counts only next to one that holds a plain word. Alignments start from each run of windows along a diagonal in turn, so a look-alike elsewhere
does not bind the slots of a true copy, and take up what else is consistent: short windows on diagonals nearby, and runs of `WINDOW`
tokens anywhere. The best one counts. A document leaks an item if its tokens in them are `SHARE` of the item's, so an edit costs
only the tokens around it, or if one run has `RUN` tokens, so a passage of a long item is enough; slot values may be
the item's own (exact) or others (re-parameterised). Items of fewer than `PIECE` tokens are found where a whole sentence or line of the
document is the item, value for value.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Tokens of a window that is looked up, of a run that counts at any place in a document, and of a run that is a leak by itself.
PIECE = 5
WINDOW = 8
RUN = 13
#: Diagonals apart that are one alignment: so many tokens may be put in or left out.
NEARBY = 8
SHARE = 0.5
#: Tokens of benchmark items that are broadcast at once; a larger benchmark is joined block by block.
BLOCK_TOKENS = 1_000_000
#: A window of more items than this is looked up only for items that a rarer window has met, unless such windows alone could tell of a leak.
COMMON = 64
#: Raw words whose token a worker remembers.
REMEMBERED = 250_000
FLAG_BITS = 20
# Unit words and signs.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months "
    "year years % percent ° °c °f k kb mb gb tb hz khz mhz ghz w kw mw v a ah n j kj cal kcal pa bar mph kph km/h m/s $ € £ ¥ usd eur gbp dollar dollars cent cents "
    "euro euros pound pounds meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres".split()
)
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?$|[+-]?\.\d+$")
NUMBER_UNIT = re.compile(r"([$€£¥]?)([+-]?\d+(?:[.,:/]\d+)*)([^\d\s]{0,4})$")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
LINE_END = " "
NUM, UNIT, NAME, PLAIN, SKIP = range(5)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


SLOT_HASH = np.array([_hash(f"\0slot{k}") for k in range(3)], np.uint64)


class Template(NamedTuple):
    """A text's tokens: surfaces (lower case, made when asked for), whether each opens a sentence, and the views: kinds and hashes of the template
    tokens, with names inside sentences, with names anywhere, and without placeholders."""

    surface: Callable[[int], str]
    opens: np.ndarray
    views: list[tuple[np.ndarray, np.ndarray]]


class Canonical:
    """Texts to templates. What a raw word becomes is remembered; plain words outside the vocabulary are all alike."""

    def __init__(self, vocabulary: frozenset[str] | None = None, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.number: dict[str, int] = {}
        self.alike: dict[tuple[str | None, int, bool, bool], int] = {}
        self.kind, self.plain = np.empty(1024, np.int8), np.empty(1024, np.uint64)
        self.name, self.ends = np.empty(1024, bool), np.empty(1024, bool)
        self._set(LINE_END, "", SKIP, False, True)

    def _set(self, raw: str, surface: str, kind: int, name: bool, ends: bool) -> None:
        """Number a raw word by what it becomes; all plain words outside the vocabulary become one."""
        known = self.vocabulary is None or surface in self.vocabulary
        key = (surface if known else None, kind, name, ends)
        n = self.alike.get(key)
        if n is None:
            n = self.alike[key] = len(self.alike)
            if n == len(self.kind):
                self.kind, self.plain, self.name, self.ends = (np.concatenate([x, np.empty_like(x)]) for x in (self.kind, self.plain, self.name, self.ends))
            self.kind[n], self.plain[n], self.name[n], self.ends[n] = kind, _hash(surface) if known else 0, name, ends
        self.number[raw] = n

    def read(self, raw: str) -> tuple[str, int, bool, bool]:
        """A raw word's surface and kind, whether it is written like a name, whether it ends a sentence."""
        bare = raw.rstrip(".,;:!?")
        if bare.isalpha():
            low = bare.lower()
            return low, UNIT if low in UNITS else PLAIN, len(bare) > 1 and bare[0].isupper() and bare[1:].islower(), bare is not raw and raw[-1] != ","
        bare = EDGES.sub("", raw)
        low = bare.lower()
        sign = raw.strip(".,;:!?()[]\"'").lower()
        ends = raw.rstrip("\"'”’»)]*")[-1:] in (".", "!", "?", ":", ";", "…")
        amount = NUMBER_UNIT.match(sign)
        if NUMBER.match(low) or (amount and (amount[1] or amount[3] in UNITS)):
            kind, low = NUM, low if NUMBER.match(low) else sign
        elif low in UNITS or sign in UNITS:
            kind, low = UNIT, low or sign
        else:
            kind = PLAIN if low else SKIP
        return low, kind, kind == PLAIN and len(bare) > 1 and bare[0].isupper() and bare[1:].islower(), ends

    def _numbers(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = {w for w in words if w not in self.number}
            if len(self.number) + len(new) > self.remembered:
                self.__init__(self.vocabulary, self.remembered)
                new = set(words) - {LINE_END}
            for w in new:
                self._set(w, *self.read(w))
            return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def template(self, text: str) -> Template:
        words = text.replace("\n", f" {LINE_END} ").split()
        ids = self._numbers(words)
        kind, plain, name = self.kind[ids], self.plain[ids], self.name[ids]
        starts = np.ones(len(ids), bool)
        starts[1:] = self.ends[ids[:-1]]
        stay = np.flatnonzero(kind != SKIP)
        sentence = np.cumsum(starts)[stay]
        opens = np.ones(len(stay), bool)
        opens[1:] = sentence[1:] != sentence[:-1]
        kind, plain, name = kind[stay], plain[stay], name[stay]

        def view(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = np.where(names, np.int8(NAME), kind)
            return own, np.where(own < PLAIN, SLOT_HASH[np.minimum(own, 2)], plain)

        views = [view(name & ~starts[stay])]
        if (name & starts[stay]).any():
            views.append(view(name))
        return Template(lambda i: self.read(words[stay[i]])[0], opens, [*views, (np.full(len(stay), PLAIN, np.int8), plain)])


def windows_of(flags: np.ndarray, width: int) -> np.ndarray:
    """The flags of each run of `width` tokens, as rows."""
    return np.lib.stride_tricks.sliding_window_view(flags, width) if len(flags) >= width else np.empty((0, width), bool)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` tokens."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + hashes[k : k + n]) * _STEP
        out ^= out >> np.uint64(31)
    return out


class Run(NamedTuple):
    """Matching windows along one diagonal (document position less item position), each with its slots (kind, item's value, document's value)."""

    diagonal: int
    windows: list[tuple[int, list[tuple[int, str, str]]]]


def bind(slots: list[tuple[int, str, str]], to: dict, back: dict) -> bool:
    """Whether slots agree among themselves and with the bindings; if so they are added."""
    new, old = {}, {}
    for k, a, b in slots:
        if to.get((k, a), new.setdefault((k, a), b)) != b or new[k, a] != b or back.get((k, b), old.setdefault((k, b), a)) != a or old[k, b] != a:
            return False
    to.update(new)
    back.update(old)
    return True


Entry = tuple[int, int, tuple]


class Index:
    """Windows of a block of items by their hash; equal texts are one item with several ids."""

    def __init__(self, items: list[tuple[object, str]], share: float = SHARE, common: int = COMMON):
        canonical, entries = Canonical(), defaultdict(dict)
        self.share = share
        self.vocabulary: set[str] = set()
        self.items: dict[int, tuple[list[object], list[str], int, int]] = {}
        #: By item and position, hashes and slots of windows of slots alone.
        self.bare: dict[int, dict[int, dict[int, tuple]]] = defaultdict(lambda: defaultdict(dict))
        same: dict[str, list[object]] = {}
        for item_id, text in items:
            same.setdefault(text or "", []).append(item_id)
        for number, (text, ids) in enumerate(same.items()):
            t = canonical.template(text)
            n = len(t.opens)
            if not n:
                continue
            width, surface = min(PIECE, n), [t.surface(i) for i in range(n)]
            self.vocabulary.update(surface)
            self.items[number] = (ids, surface, width, n)
            # A match of plain words binds the slots of the first view to themselves; a short item has its words alone.
            views = [*t.views[:-1], (t.views[0][0], t.views[-1][1])] if n >= PIECE else t.views[-1:]
            for k, (kind, view) in enumerate(views):
                slotted = kind < PLAIN
                kinds, has, bare = kind.tolist(), windows_of(slotted, width).any(axis=1).tolist(), windows_of(slotted, width).all(axis=1).tolist()
                for at, h in enumerate(windows(view, width).tolist()):
                    slots = tuple((i, kinds[at + i]) for i in range(width) if kinds[at + i] < PLAIN) if has[at] else ()
                    if bare[at] and k < len(views) - 1:
                        self.bare[number][at][h] = slots
                    else:
                        entries[width, h][number, at, slots] = None
        self.entries: dict[tuple[int, int], list[Entry]] = {}
        #: Entries of common windows by item, for items that these windows alone do not give away.
        self.deferred: dict[tuple[int, int], dict[int, list[Entry]]] = {}
        shared = {key: found for key, found in entries.items() if len(found) > common}
        covered: dict[int, set[int]] = defaultdict(set)
        for (width, _), found in shared.items():
            for number, at, _ in found:
                covered[number].update(range(at, at + width))
        enough = {number for number, tokens in covered.items() if len(tokens) >= min(share * self.items[number][3], RUN)}
        for key, found in entries.items():
            self.entries[key] = [e for e in found if key not in shared or e[0] in enough]
            for e in found:
                if key in shared and e[0] not in enough:
                    self.deferred.setdefault(key, {}).setdefault(e[0], []).append(e)
        self.bare = {number: dict(at) for number, at in self.bare.items()}
        self.keys = {w: np.array(sorted(h for v, h in entries if v == w), np.uint64) for w in {v for v, _ in entries}}
        # By the first bits of a hash, whether any key begins with them.
        self.flags = {w: np.zeros(1 << FLAG_BITS, bool) for w in self.keys}
        for w, keys in self.keys.items():
            self.flags[w][(keys >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True

    def matches(self, t: Template) -> dict[int, set[Entry]]:
        """(item position, document position, slots of the window) of the windows that a document shares with each item."""
        out: dict[int, set[Entry]] = defaultdict(set)
        later: list[tuple[tuple[int, int], int]] = []
        for width, keys in self.keys.items():
            for _, view in t.views if width == PIECE else t.views[-1:]:
                own = windows(view, width)
                if not len(own):
                    continue
                maybe = np.flatnonzero(self.flags[width][(own >> np.uint64(64 - FLAG_BITS)).astype(np.int64)])
                few = own[maybe]
                for at in maybe[keys[np.minimum(np.searchsorted(keys, few), len(keys) - 1)] == few].tolist():
                    key = width, int(own[at])
                    if key in self.deferred:
                        later.append((key, at))
                    for number, position, slots in self.entries[key]:
                        # A short item is a whole sentence.
                        if width == PIECE or self.items[number][3] >= PIECE or (t.opens[at] and (at + width == len(t.opens) or t.opens[at + width])):
                            out[number].add((position, at, slots))
        met = list(out)
        for key, at in later:
            found = self.deferred[key]
            for number in met if len(met) < len(found) else [x for x in found if x in out]:
                out[number].update((position, at, slots) for _, position, slots in found.get(number, ()))
        self._beside(out, t)
        return out

    def _beside(self, out: dict[int, set[Entry]], t: Template) -> None:
        """Add the windows of slots alone that continue another match."""
        bare = {number: self.bare[number] for number in out if number in self.bare}
        if not bare:
            return
        own = [windows(view, PIECE).tolist() for _, view in t.views[:-1]]
        for number, places in bare.items():
            todo = list(out[number])
            while todo:
                position, at, _ = todo.pop()
                for p, a in ((position - 1, at - 1), (position + 1, at + 1)):
                    for h, slots in places.get(p, {}).items():
                        if (p, a, slots) not in out[number] and any(0 <= a < len(view) and view[a] == h for view in own):
                            out[number].add((p, a, slots))
                            todo.append((p, a, slots))

    def runs(self, number: int, pairs: set[tuple[int, int, tuple]], t: Template) -> list[Run]:
        """An item's matching windows in maximal runs along a diagonal that bind their slots consistently, longest first."""
        surface = self.items[number][1]
        out, last = [], None
        for position, at, places in sorted(pairs, key=lambda x: (x[1] - x[0], x[0], len(x[2]))):
            slots = [(kind, surface[position + k], t.surface(at + k)) for k, kind in places]
            if last == (position, at):
                # The same window by another view: with the fewest slots that fit.
                if bound_here or not bind(slots, *bound):
                    continue
                bound_here = True
                out[-1].windows.append((position, slots))
                continue
            bound_here = last == (position - 1, at - 1) and bind(slots, *bound)
            if not bound_here:
                bound = {}, {}
                bound_here = bind(slots, *bound)
                out.append(Run(at - position, []))
            if bound_here:
                out[-1].windows.append((position, slots))
            last = position, at
        return sorted((x for x in out if x.windows), key=lambda x: -len(x.windows))

    def leaks(self, t: Template) -> list[tuple[object, int, float, str]]:
        """(item_id, windows of WINDOW tokens, share of the item's tokens, exact or reparameterised) of the items that a document leaks."""
        out = []
        for number, pairs in self.matches(t).items():
            ids, _, width, n = self.items[number]
            found = {position + k for position, _, _ in pairs for k in range(width)}
            if len(found) < min(self.share * n, RUN):
                continue
            runs = self.runs(number, pairs, t)
            longest = max((len(x.windows) + width - 1 for x in runs), default=0)
            best = self._best_alignment(runs, width, n)
            if best[0] >= self.share * n or longest >= RUN:
                out += [(item_id, best[2], best[0] / n, "exact" if best[1] else "reparameterised") for item_id in ids]
        return sorted(out, key=repr)

    def _best_alignment(self, runs: list[Run], width: int, n: int) -> tuple[int, bool, int]:
        """(tokens, exact, windows of WINDOW tokens) of the best alignment: each run in turn takes up what agrees with it, nearest diagonals first."""
        best, tried = (0, False, 0), set()
        positions = {p for run in runs for p, _ in run.windows}
        by_diagonal = sorted(runs, key=lambda x: (x.diagonal, -len(x.windows)))
        diagonals = [x.diagonal for x in by_diagonal]
        up = [x for x in by_diagonal if len(x.windows) + width - 1 >= WINDOW]
        down = sorted(up, key=lambda x: (-x.diagonal, -len(x.windows)))
        ups, downs = [x.diagonal for x in up], [-x.diagonal for x in down]
        for seed in runs:
            key = (seed.diagonal, frozenset(x for _, slots in seed.windows for x in slots))
            if key in tried or best[:2] == (n, True):
                continue
            tried.add(key)
            to, back, good, tokens, exact = {}, {}, set(), set(), True
            nearest = lambda x, d=seed.diagonal: (abs(x.diagonal - d), -len(x.windows))
            near = by_diagonal[bisect_left(diagonals, seed.diagonal - NEARBY) : bisect_right(diagonals, seed.diagonal + NEARBY)]
            below, above = islice(down, bisect_right(downs, NEARBY - seed.diagonal), None), islice(up, bisect_right(ups, seed.diagonal + NEARBY), None)
            for run in chain([seed], sorted(near, key=nearest), merge(below, above, key=nearest)):
                # Where every position is taken, no run adds any.
                if len(good) == len(positions):
                    break
                for position, slots in run.windows:
                    if position not in good and bind(slots, to, back):
                        good.add(position)
                        tokens.update(range(position, position + width))
                        exact &= all(a == b for _, a, b in slots)
            whole = min(WINDOW, n)
            best = max(best, (len(tokens), exact, sum(all(p + k in tokens for k in range(whole)) for p in range(n - whole + 1))))
        return best


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """Items (item_id, text) in blocks of about BLOCK_TOKENS tokens."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += r["text"].count(" ") + 1
        if size >= BLOCK_TOKENS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(df: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, kind) for each document of df (doc_id, text) and item that it leaks.

    Null and empty texts leak nothing and are not leaked; texts of any length are read whole; repeated items and rows give a row each; null
    ids are returned as they are. An empty table on either side gives an empty result. Other columns are ignored, so they may have any name.
    """
    spark: SparkSession = df.sparkSession
    id_type = benchmark.schema["item_id"].dataType
    arrow_id = to_arrow_type(id_type)
    schema = f"doc_id long, item_id {id_type.simpleString()}, n_windows long, coverage double, kind string"
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(block, share))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            canonical = Canonical(frozenset(index.vocabulary))
            for b in batches:
                rows = [(doc, *leak) for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) if text for leak in index.leaks(canonical.template(text))]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = [pa.int64(), arrow_id, pa.int64(), pa.float64(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "n_windows", "coverage", "kind"])

        out = out.union(df.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema))
    return out


def without_leaks(df: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of df (text, ...) that leak no item, each judged in its place: nothing is joined or shuffled, and rows without an id are judged like others."""
    for block in blocks(benchmark):
        shared = df.sparkSession.sparkContext.broadcast(Index(block, share))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            canonical = Canonical(frozenset(index.vocabulary))
            for b in batches:
                clean = [not (text and index.leaks(canonical.template(text))) for text in b["text"].to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        df = df.mapInArrow(keep, df.schema)
    return df


def op1_template_windows(spark, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark item, with the item."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return leaks(read("documents"), read("benchmark"))
