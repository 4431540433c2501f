"""SimHash near-duplicates found with BK-trees.

A document's sketch holds 64-bit SimHash fingerprints of which some pair must be near. Documents with equal sketches are one node. Two
nodes link if some fingerprint differs in at most `radius` bits and, where nodes carry sets of shingles, those are similar enough.

A BK-tree of all fingerprints would have to be sent to every task, so it has no size bound. Instead the
fingerprints are cut into shards without losing a pair: bits are split into radius + 1 parts, and two
fingerprints within the radius agree in at least one part, so a shard is all fingerprints with one value in one part. A
shard of more than `SHARD` nodes is cut again by the bits that are still free. A cut copies its nodes radius + 1 times and
does not part nodes that share the searched fingerprint, so a shard that is little larger, that holds few
fingerprints, or that is still large after `CUTS` cuts is dealt into blocks instead, and every two blocks meet: the cuts end
whatever the fingerprints are. Each shard's BK-tree is built and searched in one task, where it follows only the edges whose
distance lies within the radius (two blocks are compared as a whole), and the shard reports the links of a local
spanning forest, never all pairs. The links are joined to components by large-star and small-star rounds.

Similarity of five-word shingles (0.8 or more) is too little for one SimHash: ten of its 64 bits differ, and no search of that radius
is cheaper than comparing all. `near_classes` therefore searches SimHashes of small samples: for each of `tables` orders of all shingles, the
fingerprint of the `sample` first shingles of the document in that order. At similarity s two documents agree in a sample with
probability s^sample, so `tables` of them find a pair of 0.8 with 0.98; the link itself is judged by the exact Jaccard similarity.
A changed word breaks five shingles of five words on either side, so a copy with every tenth word changed is some 0.4 similar by them.
`near_verdicts` finds such copies by pairs of words, of which a changed word breaks two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import byte_words, text_bytes, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Nodes in one BK-tree.
SHARD = 1024
#: Times that a shard is cut by its bits before it is dealt into blocks.
CUTS = 2
#: For dedup by five-word shingles: searched fingerprints, shingles in the sample of each, radius (samples are equal or differ in many bits), and nodes in a tree.
NEAR = {"tables": 10, "sample": 5, "radius": 0, "shard": 512}
#: Words of a shingle, and Jaccard similarity of near copies, as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: As NEAR, for copies with words changed throughout: a pair of similarity 0.7 is found with 0.94.
EDITED = {**NEAR, "sample": 4, "words": 2, "similar": (3, 5)}
_CHUNK = 1 << 15


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """Space-joined runs of n words, repeats included; the whole sequence if there are fewer words, nothing if there are none."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(n)), strict=False)]


def majority(hashes: np.ndarray) -> bytes:
    """Little-endian bits that are set in over half of the rows of a uint64 array of shape (n, words)."""
    total = np.zeros(hashes.shape[1] * 64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK])
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").tobytes()


def _hashes(items: list[bytes], seeds: range) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([[digest(x, s) for x in items] for s in seeds], dtype="<u8").T


def simhash(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The fingerprint of a text by its shingles, 8 bytes, little-endian; zero without words."""
    found = shingles(byte_words(text), shingle)
    return majority(_hashes(found, range(SEED, SEED + 1))) if found else bytes(8)


def near_sketch(text: bytes, tables: int, sample: int, words: int = WORDS) -> tuple[bytes, bytes]:
    """The `tables` fingerprints of samples and a digest of the set of shingles (of five words, if not told otherwise); the set itself as sorted 32-bit hashes."""
    found = set(shingles(byte_words(text), words))
    if not found:
        return bytes(8 * tables + 16), b""
    base = np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), ">u8").astype(np.uint64))
    orders = np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rank = _mixed(base[:, None] ^ orders)
    first = np.argpartition(rank, sample - 1, axis=0)[:sample] if len(base) > sample else np.broadcast_to(np.arange(len(base))[:, None], (len(base), tables))
    return majority(_mixed(base)[first]) + xxhash.xxh3_128_digest(base.tobytes()), np.unique((base >> np.uint64(32)).astype("<u4")).tobytes()


def _mixed(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser of hashes."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def similar(a: bytes, b: bytes, least: tuple[int, int] = SIMILAR) -> bool:
    """Whether two sets of sorted 32-bit hashes have a Jaccard similarity of a fraction or more."""
    part, whole = least
    if min(len(a), len(b)) * whole < max(len(a), len(b)) * part:
        return False
    both = len(np.intersect1d(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), assume_unique=True))
    return both * whole >= part * ((len(a) + len(b)) // 4 - both)


class BKTree:
    """Fingerprints as integers; a child hangs on the edge of its Hamming distance to its parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert; the node's number (an equal value gets a node of its own on edge 0)."""
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            edge = (self.values[at] ^ value).bit_count()
            down = self.children[at].get(edge)
            if down is None:
                self.children[at][edge] = new
                break
            at = down
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius; only edges within it of the distance to a node are followed."""
        out, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            far = (self.values[at] ^ value).bit_count()
            if far <= radius:
                out.append(at)
            children = self.children[at]
            if len(children) > 2 * radius + 1:
                todo += [children[e] for e in range(far - radius, far + radius + 1) if e in children]
            else:
                todo += [c for e, c in children.items() if -radius <= e - far <= radius]
        return out


class Forest:
    """Joined sets of numbered nodes; each joining is kept as a link."""

    def __init__(self, ids: list[int]):
        self.ids, self.parent, self.links = ids, list(range(len(ids))), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int, linked: Callable[[int, int], bool] | None) -> None:
        """Join two nodes that are apart so far, if they are linked."""
        a, b = self.root(i), self.root(j)
        if a != b and (linked is None or linked(i, j)):
            self.parent[max(a, b)] = min(a, b)
            self.links.append((self.ids[i], self.ids[j]))


def tree_links(ids: list[int], values: list[int], radius: int, earlier: list[int], linked: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
    """Links that span each component among the nodes of one shard, by its BK-tree; linked judges two nodes by their numbers.

    A pair that also agrees in the bits of one of the `earlier` masks meets in that shard of its table, and is left to it.
    """
    tree, forest = BKTree(), Forest(ids)
    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            if not any((value ^ values[j]) & e == 0 for e in earlier):
                forest.join(i, j, linked)
        tree.add(value)
    return forest.links


def block_links(ids: list[int], values: np.ndarray, radius: int, earlier: list[int], linked: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
    """As tree_links, but of an array, comparing each node with each: equal values cost no more than others."""
    out, label = [], np.arange(len(ids))
    for at in range(0, len(ids), 256):
        differ = values[at : at + 256, None] ^ values[: at + 256]
        near = np.bitwise_count(differ) <= radius
        for mask in earlier:
            near &= differ & np.uint64(mask) != 0
        for i, row in enumerate(near, at):
            hits = np.flatnonzero(row[:i])
            # Only nodes that are not joined yet are judged.
            while len(hits := hits[label[hits] != label[i]]):
                j, hits = int(hits[0]), hits[1:]
                if linked is None or linked(i, j):
                    out.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
    return out


def _parts(free: int, n: int) -> list[int]:
    """Masks that split the set bits of `free` into n runs of nearly equal numbers."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(nodes: DataFrame, tables: int = 1, radius: int = RADIUS, shard: int = SHARD, least: tuple[int, int] = SIMILAR) -> DataFrame:
    """(a, b): links that join every pair of nodes (node, id, sketch) that link, though not each pair itself.

    Nodes may have a column shingles (sorted 32-bit hashes): pairs must then be similar as well, by the fraction least. It is sent only to shards of two nodes or more.
    """
    schema, out = pa.schema([("a", pa.int64()), ("b", pa.int64())]), []
    judged = "shingles" in nodes.columns
    # A mask is a set of bits that agree; the level's masks are numbered, and each knows the parts before its own at every level.
    masks = _parts((1 << 64) - 1, radius + 1)
    before = [masks[:m] for m in range(len(masks))]
    every = F.array(
        *(
            F.struct(F.lit(t).alias("t"), F.lit(m).alias("m"), F.col(f"w{t}").bitwiseAND(F.lit(_signed(mask))).alias("v"), F.col(f"w{t}").alias("w"))
            for t in range(tables)
            for m, mask in enumerate(masks)
        )
    )
    keyed = nodes.select("node", "id", *(_word(t).alias(f"w{t}") for t in range(tables))).select("node", "id", F.explode(every).alias("k")).select("node", "id", "k.*")
    for level in range(CUTS + 1):
        sizes = keyed.groupBy("t", "m", "v").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("w").alias("values")).filter("n > 1")
        dense = (F.col("n") > shard) & ((F.col("n") <= (radius + 1) * shard) | (F.col("values") * 4 < F.col("n")) | F.lit(level == CUTS))
        several = written(sizes.select("t", "m", "v", F.ceil(F.col("n") / shard).cast("int").alias("blocks"), dense.alias("dense")), "shards")
        kinds = {(r["large"], r["dense"]) for r in several.select((F.col("blocks") > 1).alias("large"), "dense").distinct().collect()}
        members = keyed.join(several, ["t", "m", "v"])
        whole = members.join(nodes.select("node", "shingles"), "node") if judged else members.withColumn("shingles", F.lit(None).cast("binary"))
        member = F.array_sort(F.collect_list(F.struct("id", "w", "shingles"))).alias("members")

        def search(batches: Iterator[pa.RecordBatch], before=before, blocks=False) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: list[tuple[int, int]] = []
                own, ends = b["members"].values, b["members"].offsets.to_pylist()
                ids, sets = own.field("id").to_pylist(), own.field("shingles")
                values = own.field("w").to_numpy(zero_copy_only=False).view(np.uint64)
                for m, at, to in zip(b["m"].to_pylist(), ends, ends[1:], strict=False):
                    linked = None
                    if judged:
                        mine = sets[at:to].to_pylist()
                        linked = lambda i, j, mine=mine: similar(mine[i], mine[j], least)
                    found += block_links(ids[at:to], values[at:to], radius, before[m], linked) if blocks else tree_links(ids[at:to], values[at:to].tolist(), radius, before[m], linked)
                yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=schema)

        small = whole.filter("blocks = 1").groupBy("t", "m", "v").agg(member)
        out.append(written(small.select("m", "members").mapInArrow(search, "a long, b long"), "links"))
        if (True, True) in kinds:
            # A node of block k goes to the meeting of k with each block.
            inside = whole.filter("dense").withColumn("k", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
            dealt = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("k", "other")).withColumn("j", F.greatest("k", "other"))
            met = dealt.groupBy("t", "m", "v", "i", "j").agg(member).select("m", "members")
            out.append(written(met.mapInArrow(partial(search, blocks=True), "a long, b long"), "links"))
        if (True, False) not in kinds:
            break
        inside = members.filter("blocks > 1 and not dense").select("node", "id", "t", "m", "w")
        parts = [_parts(((1 << 64) - 1) & ~m, radius + 1) for m in masks]
        before = [[*before[m], *own[:i]] for m, own in enumerate(parts) for i in range(len(own))]
        cut = [[m | part for part in own] for m, own in zip(masks, parts, strict=True)]
        masks, width = [x for row in cut for x in row], radius + 1
        picks = F.array(*(F.array(*(F.lit(_signed(x)) for x in row)) for row in cut))
        finer = F.transform(F.get(picks, F.col("m")), lambda x, i: F.struct((F.col("m") * width + i).cast("int").alias("m"), F.col("w").bitwiseAND(x).alias("v")))
        keyed = written(inside.withColumn("k", F.explode(finer)).select("node", "id", "t", "k.m", "k.v", "w"), "finer-shards")
    return reduce(DataFrame.union, out)


def _word(t: int):
    """Searched fingerprint t of a sketch as a long."""
    digits = F.hex(F.substring("sketch", 8 * t + 1, 8))
    order = F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2)))
    high, low = F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.conv(F.substring(order, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def components(found: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for each id that has a link to another id.

    Large-star and small-star rounds over (a, b); each round is written, and the rounds end when nothing changes.
    """
    edges = written(found.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(least).distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def classes(sketched: DataFrame, tables: int = 1, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """sketched (doc_id, sketch, and shingles if links are to be judged by them) with component_id: the smallest doc_id reachable over links, itself included.

    Rows with one doc_id are one document, so their nodes share a component. A null doc_id has no links and a null component_id.
    """
    known = sketched.filter("doc_id is not null")
    nodes = _nodes(known)
    same = known.groupBy("doc_id").agg(F.min("sketch").alias("lo"), F.max("sketch").alias("hi")).filter("lo <> hi")
    twice = known.select("doc_id", "sketch").join(same.select("doc_id"), "doc_id", "left_semi").join(nodes.select("sketch", "id"), "sketch").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    roots = components(links(nodes, tables, radius, shard).union(twice))
    named = nodes.join(roots, "id", "left").select("sketch", F.coalesce("root", "id").alias("component_id"))
    out = sketched.select("doc_id", "sketch").join(named, "sketch", "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def _nodes(known: DataFrame) -> DataFrame:
    """(node, id, sketch, and shingles if known has them), written: the different sketches of known (doc_id, sketch), id being the smallest doc_id of each."""
    judged = ["shingles"] if "shingles" in known.columns else []
    grouped = known.groupBy("sketch").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in judged))
    return written(grouped.select(F.monotonically_increasing_id().alias("node"), "id", "sketch", *judged), "nodes")


def sketches(df: DataFrame, make: Callable[[bytes], tuple], judged: bool, keyed: bool = False) -> DataFrame:
    """(doc_id long, text_key long if keyed, sketch binary, and shingles binary if judged) of df (doc_id, text), written once; make gives the latter two of a text."""
    names, keys = ["sketch", "shingles"][: 1 + judged], ["doc_id", "text_key"][: 1 + keyed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(x) for x in text_bytes(b["text"])]
            yield pa.record_batch([*(b[k].cast(pa.int64()) for k in keys), *(pa.array([x[i] for x in made], pa.binary()) for i in range(len(names)))], names=[*keys, *names])

    rows = df.select("doc_id", "text", *([text_key()] if keyed else []))
    return written(rows.mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), *(f"{n} binary" for n in names)])), "sketches")


def text_key():
    """The column that tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def simhash_classes(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of df (doc_id, text).

    Null, empty and blank texts have fingerprint zero and link like any other; texts of any length are read whole. A tie (a bit set in exactly
    half of the shingles) is 0. Repeated rows are returned each; a null doc_id has a null component_id. An empty table gives an
    empty result; other columns of df are ignored, so they may have any name.
    """
    found = classes(sketches(df, lambda x: (simhash(x, shingle),), False), radius=radius, shard=shard)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("sketch")), 16, "0")).alias("little"), "component_id").select(
        "doc_id", F.concat(*(F.substring("little", i, 2) for i in range(15, 0, -2))).alias("fingerprint"), "component_id"
    )


def near_classes(df: DataFrame, near: dict = NEAR) -> DataFrame:
    """(doc_id, component_id): documents whose sets of five-word shingles are 0.8 similar or more, directly or over others.

    Exact copies always share a class; no pair that is less similar is linked. A pair of similarity s has the chance 1 - (1 - s^sample)^tables to be
    found: 0.98 at 0.8, 0.997 at 0.85. Null, empty and blank texts are copies of each other; a text of fewer than five
    words is one shingle. Repeated rows are returned each; a null doc_id has a null component_id; an empty table gives an empty result.
    """
    tables, sample = near["tables"], near["sample"]
    found = classes(sketches(df, lambda x: near_sketch(x, tables, sample), True), tables, near["radius"], near["shard"])
    return found.select("doc_id", "component_id")


def near_verdicts(df: DataFrame, near: dict = EDITED) -> DataFrame:
    """(doc_id, text_key, class, gone, repeated) of the texts of df (doc_id, text) whose doc_id has a text that goes or is on several rows.

    Classes are those of near copies by the shingles and similarity that near names, over links. A text is gone if its class holds a smaller doc_id. Unlike
    near_classes, rows are told apart by doc_id and text, so texts of one doc_id share a class only if they are near copies. Rows without a doc_id have no verdict.
    """
    tables, sample, words = near["tables"], near["sample"], near["words"]
    known = sketches(df, lambda x: near_sketch(x, tables, sample, words), True, keyed=True).filter("doc_id is not null")
    nodes = _nodes(known)
    roots = components(links(nodes.withColumn("id", F.col("node")), tables, near["radius"], near["shard"], near["similar"]))
    named = nodes.select("node", "id", "sketch").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("class", F.coalesce("root", "node"))
    least = named.groupBy("class").agg(F.min("id").alias("least"))
    classed = named.join(least, "class").select("sketch", "class", "least")
    rows = written(known.select("doc_id", "text_key", "sketch").join(classed, "sketch").select("doc_id", "text_key", "class", (F.col("least") < F.col("doc_id")).alias("gone")), "judged")
    ids = rows.groupBy("doc_id").agg(F.max("gone").alias("any_gone"), (F.count(F.lit(1)) > 1).alias("repeated")).filter("any_gone or repeated")
    return rows.join(ids.select("doc_id", "repeated"), "doc_id").select("doc_id", "text_key", "class", "gone", "repeated").distinct()


def op8_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
