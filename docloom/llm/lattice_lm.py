"""Subword-lattice likelihood with an existing subword vocabulary.

A word is the sum over all its cuts into pieces of a public SentencePiece vocabulary, each piece drawn alone with its own
probability: a forward recursion in log space over the lattice of all cuts gives this marginal, and no piece crosses the start
of a word. A text is its words and an end. The pieces' probabilities start from the vocabulary's own scores: it ranks its pieces, so its
prior is a 1 / rank law; their counts come from all words of the training texts, first by the vocabulary's own cuts, then by
expectation-maximisation over the lattice. All this is learned for each class of training documents (here by language) as one component
of a mixture, and a document's marginal probability sums over the components, whichever its own may be.

The corpus is read twice. The first pass counts words in each task and sums them by a shuffle. Every different word is then
scored once. The second pass sums what each document needs: the most frequent words are broadcast (a table of HOT_BYTES), all others meet their scores by a join on the word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import byte_words, gathered, pieces, text_bytes, written

#: Bytes of the most frequent words, broadcast as 64-bit hashes with their count and scores (16 bytes and 8 for each component); the others are joined.
HOT_BYTES = 48_000_000
#: Different words that a task counts before it hands them on.
COUNTED = 400_000
ROUNDS = 2
#: Words whose lattices are gone through at once.
AT_ONCE = 120_000
#: Weight of the prior in pieces, and the rank added to all in its 1 / rank law.
PRIOR, PRIOR_RANK = 2_000.0, 200.0
MARK = "▁"
CELLS = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)


class Arcs:
    """The pieces that fit in words of one length: for each length of piece, by start, the words (rows) and piece numbers."""

    def __init__(self, rows: int, n: int, single: np.ndarray, longer: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        self.rows, self.n, self.single = rows, n, single
        self.longer = []
        for k, row, start, piece in longer:
            order = np.argsort(start, kind="stable")
            self.longer.append((k, row[order], np.searchsorted(start[order], np.arange(n + 1)), piece[order]))


class Lattice:
    """The vocabulary's pieces by length, with log probabilities, and the forward and backward recursions."""

    def __init__(self, path: str, log_p: np.ndarray | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = self.sp.get_piece_size()
        self.bytes = np.zeros(256, np.int64)
        self.plain: list[tuple[int, str]] = []
        for i in range(n):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or MARK in piece[1:]):
                self.plain.append((i, piece))
        # For each length, the hashes of all beginnings of pieces, and the piece that ends there (-1: none).
        number = {p: i for i, p in self.plain}
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, max(map(len, number)) + 1):
            own = sorted({p[:k] for p in number if len(p) >= k})
            codes = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").reshape(-1, k)
            keys, at = self._hash(codes), np.array([number.get(x, -1) for x in own], np.int64)
            order = np.argsort(keys)
            self.tables.append((keys[order], at[order]))
        self.log_p = self.prior() if log_p is None else log_p

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for i in range(codes.shape[1]):
            h = Lattice._longer(h, codes[:, i])
        return h

    @staticmethod
    def _longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The hashes with one more character each."""
        h = (h + code.astype(np.uint64) + np.uint64(1)) * _P
        return h ^ (h >> np.uint64(29))

    def usable(self) -> np.ndarray:
        """Numbers of the pieces that a lattice may use."""
        return np.concatenate([self.bytes, [i for i, _ in self.plain]])

    def prior(self) -> np.ndarray:
        """Log probabilities from the vocabulary's own ranking."""
        out = np.full(self.size, -np.inf)
        use = self.usable()
        weight = 1 / (np.argsort(np.argsort(use)) + PRIOR_RANK)
        out[use] = np.log(weight / weight.sum())
        return out

    def learned(self, counts: np.ndarray) -> np.ndarray:
        """Log probabilities from piece counts and the prior."""
        weight = counts + PRIOR * np.exp(self.prior())
        with np.errstate(divide="ignore"):
            return np.log(weight / weight.sum())

    def cut_counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Piece counts of words that stand so many times, by the vocabulary's own cuts."""
        cut = self.sp.encode(words, num_threads=1)
        ids = np.fromiter((i for own in cut for i in own), np.int64)
        out = np.bincount(ids, np.repeat(times, [len(x) for x in cut]), self.size)
        out[np.setdiff1d(np.arange(self.size), self.usable())] = 0
        return out

    def _groups(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Numbers and code points of marked words of one length, a bounded number of cells at a time."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            n = len(words[order[at]]) + 1
            end = at
            while end < len(order) and len(words[order[end]]) + 1 == n and (end - at) * n < CELLS:
                end += 1
            own = order[at:end]
            yield own, np.frombuffer("".join(MARK + words[i] for i in own).encode("utf-32-le"), "<u4").reshape(-1, n)
            at = end

    def _arcs(self, codes: np.ndarray) -> Arcs:
        """All pieces in words of one length. Where no piece begins with what was read, no longer one is looked for."""
        rows, n = codes.shape
        row, start = np.repeat(np.arange(rows), n), np.tile(np.arange(n), rows)
        h, single, longer = np.zeros(rows * n, np.uint64), None, []
        for k, (keys, ids) in enumerate(self.tables, 1):
            if not len(row):
                break
            h = self._longer(h, codes[row, start + k - 1])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            met = keys[at] == h
            piece = np.where(met, ids[at], -1)
            if k == 1:
                single = piece.reshape(rows, n)
            elif (hit := piece >= 0).any():
                longer.append((k, row[hit], start[hit], piece[hit]))
            on = met & (start + k < n)
            row, start, h = row[on], start[on], h[on]
        return Arcs(rows, n, single, longer)

    def _singles(self, codes: np.ndarray, arcs: Arcs, log_p: np.ndarray) -> np.ndarray:
        """Log probability of each single character; characters that are no piece are their UTF-8 bytes."""
        hit = arcs.single >= 0
        out = np.where(hit, log_p[arcs.single], 0.0)
        for code in np.unique(codes[~hit]).tolist():
            out[(codes == code) & ~hit] = log_p[self.bytes[list(chr(code).encode("utf-8", "surrogatepass"))]].sum()
        return out

    @staticmethod
    def _summed(dense: np.ndarray, sparse: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """log(exp(dense) + the exps of the sparse terms (rows, values)), each term having a row once."""
        top = dense.copy()
        for row, value in sparse:
            top[row] = np.maximum(top[row], value)
        total = np.exp(dense - top)
        for row, value in sparse:
            total[row] += np.exp(value - top[row])
        return top + np.log(total)

    def _forward(self, arcs: Arcs, singles: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Log weight of all cuts of each beginning of each word, by position."""
        alpha = np.zeros((arcs.n + 1, arcs.rows))
        for j in range(1, arcs.n + 1):
            sparse = []
            for k, row, bounds, piece in arcs.longer:
                if k <= j and bounds[j - k] < bounds[j - k + 1]:
                    at = slice(bounds[j - k], bounds[j - k + 1])
                    sparse.append((row[at], alpha[j - k, row[at]] + log_p[piece[at]]))
            alpha[j] = self._summed(alpha[j - 1] + singles[:, j - 1], sparse)
        return alpha

    def _backward(self, arcs: Arcs, singles: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Log weight of all cuts of each ending of each word, by position."""
        beta = np.zeros((arcs.n + 1, arcs.rows))
        for j in range(arcs.n - 1, -1, -1):
            sparse = []
            for k, row, bounds, piece in arcs.longer:
                if bounds[j] < bounds[j + 1]:
                    at = slice(bounds[j], bounds[j + 1])
                    sparse.append((row[at], beta[j + k, row[at]] + log_p[piece[at]]))
            beta[j] = self._summed(beta[j + 1] + singles[:, j], sparse)
        return beta

    def marginals(self, words: list[str], several: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural-log probability of each word over all its cuts; a column for each of several log_p."""
        several = several or [self.log_p]
        out = np.empty((len(words), len(several)))
        for own, codes in self._groups(words):
            arcs = self._arcs(codes)
            for k, log_p in enumerate(several):
                out[own, k] = self._forward(arcs, self._singles(codes, arcs, log_p), log_p)[-1]
        return out

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected piece counts over all cuts of words that stand so many times, by forward and backward recursion."""
        out = np.zeros(self.size)
        for own, codes in self._groups(words):
            arcs, weight = self._arcs(codes), times[own]
            singles = self._singles(codes, arcs, self.log_p)
            alpha, beta = self._forward(arcs, singles, self.log_p), self._backward(arcs, singles, self.log_p)
            share = (np.exp(alpha[:-1] + singles.T + beta[1:] - alpha[-1]) * weight).T
            hit = arcs.single >= 0
            out += np.bincount(arcs.single[hit], share[hit], self.size)
            for code in np.unique(codes[~hit]).tolist():
                np.add.at(out, self.bytes[list(chr(code).encode("utf-8", "surrogatepass"))], share[(codes == code) & ~hit].sum())
            for k, row, bounds, piece in arcs.longer:
                start = np.repeat(np.arange(arcs.n), np.diff(bounds))
                out += np.bincount(piece, np.exp(alpha[start, row] + self.log_p[piece] + beta[start + k, row] - alpha[-1, row]) * weight[row], self.size)
        return out


_lattices: dict[str, Lattice] = {}


def lattice_of(path: str) -> Lattice:
    """The worker's lattice of a file, made once."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def in_training():
    """Rows that the model learns from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2


def word_counts(documents: DataFrame, classes: int) -> DataFrame:
    """(word binary, c0, c1, ... long) of documents (class int, text): every different word with its count in the training rows of each class; class -1 only names its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: Counter() for k in range(-1, classes)}

        def handed() -> Iterator[pa.RecordBatch]:
            for k, found in counts.items():
                yield pa.record_batch(
                    [pa.array(list(found), pa.binary()), pa.array(np.full(len(found), k, np.int32)), pa.array(list(found.values()), pa.int64())], names=["word", "class", "c"]
                )
                found.clear()

        for b in batches:
            for k, text in zip(b["class"].to_pylist(), text_bytes(b["text"]), strict=True):
                counts[k].update(byte_words(text))
                if sum(map(len, counts.values())) > COUNTED:
                    yield from handed()
        yield from handed()

    own = [F.sum(F.when(F.col("class") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
    return documents.mapInArrow(run, "word binary, class int, c long").groupBy("word").agg(*own)


def _piece_counts(words: DataFrame, path: str, components: int, log_p: list[np.ndarray] | None) -> np.ndarray:
    """Piece counts of each component's training words: by the vocabulary's own cuts without log_p, else expected over the lattice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        out = np.zeros((components, lattice.size))
        for b in gathered(batches, AT_ONCE):
            own = np.array([x.decode() for x in b["word"].to_pylist()], object)
            for k in range(components):
                times = b[f"c{k}"].to_numpy()
                at = np.flatnonzero(times)
                if len(at):
                    lattice.log_p = lattice.log_p if log_p is None else log_p[k]
                    count = lattice.cut_counts if log_p is None else lattice.expected
                    out[k] += count(own[at].tolist(), times[at].astype(float))
        at = np.flatnonzero(out)
        yield pa.record_batch([pa.array(at), pa.array(out.ravel()[at])], names=["cell", "n"])

    size = lattice_of(path).size
    counts = np.zeros(components * size)
    # At most as many rows as the components have pieces.
    for r in words.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return counts.reshape(components, size)


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of the largest counts c, by whole steps of a logarithmic histogram, at most so many; no task gathers candidates of the others."""
    step = F.floor(F.log2(F.col("c") + 1.0) * 16)
    left, cut = most, None
    for r in sorted(table.groupBy(step.alias("step")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, cut = left - r["count"], r["step"]
    return table.filter(F.lit(False) if cut is None else step >= cut)


def _hashed(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def scores(df: DataFrame, learn, path: str, class_col: str | None = None, hot: int | None = None, rounds: int = ROUNDS, components: int | None = None) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of df (doc_id, text, and class_col if named), a row for each row.

    learn is a Column: rows that count for both models (null: they do not). score is the log10 marginal probability of the text's words and its
    end, summed over one component for each class (or over the `components` - 1 most frequent classes and one for all others, if that is given); base_score that of
    an add-one word model. Null and empty texts are the end alone; texts of any length are read whole; a null class is a class.
    Rows that share a doc_id or have none are scored each. An empty table gives an empty result; without training rows both models
    are their smoothing. Other columns are ignored, so they may have any name.
    """
    spark = df.sparkSession
    label = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), label.alias("label"), "text")
    sizes = own.filter("learn").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ordered = sizes.orderBy(F.desc("n"), "label")
    # A row for each class.
    top = (ordered.limit(components - 1) if components else ordered).collect()
    n_docs = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names, docs = [r["label"] for r in top], [r["n"] for r in top]
    docs.append(n_docs - sum(docs))
    docs = docs if docs[-1] or len(docs) == 1 else docs[:-1]
    components = len(docs)
    hot = HOT_BYTES // (16 + 8 * components) if hot is None else hot
    number = F.lit(components - 1)
    for k, name in enumerate(names[:components]):
        number = F.when(F.col("label") == name, k).otherwise(number)
    words = written(word_counts(own.select(F.when(F.col("learn"), number).otherwise(-1).alias("class"), "text"), components), "words")
    cs = [f"c{k}" for k in range(components)]
    found = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"n{c}") for c in cs), F.count(F.when(sum(map(F.col, cs)) > 0, 1)).alias("types")).first()
    total, types = sum(found[f"n{c}"] for c in cs) + n_docs, found["types"] + (n_docs > 0)
    lattice, log_p = lattice_of(path), None
    for _ in range(1 + rounds):
        counts = _piece_counts(words, path, components, log_p)
        log_p = [lattice.learned(x) for x in counts]
    # A text ends where a piece might stand.
    ending = [(d + 1e-9) / (x.sum() + d + 2e-9) for x, d in zip(counts, docs, strict=True)]
    log_p = [x + np.log1p(-e) for x, e in zip(log_p, ending, strict=True)]
    ends = [float(np.log10(e)) for e in ending]
    ls = [f"l{k}" for k in range(components)]

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for b in gathered(batches, AT_ONCE):
            if b.num_rows:
                lp = lattice.marginals([x.decode() for x in b["word"].to_pylist()], log_p) / np.log(10)
                c = sum(b[x].to_numpy() for x in cs)
                yield pa.record_batch([b["word"], pa.array(_hashed(b["word"].to_pylist()).view(np.int64)), pa.array(c), *(pa.array(lp[:, k]) for k in range(components))], names=["word", "h", "c", *ls])

    table = written(words.mapInArrow(marginal, "word binary, h long, c long, " + ", ".join(f"{x} double" for x in ls)), "scored-words")
    frequent = _frequent(table, hot).select("h", "c", *ls).toArrow().combine_chunks()
    keys = frequent["h"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], frequent["c"].to_numpy()[order], np.stack([frequent[x].to_numpy()[order] for x in ls])))
    base = lambda c: np.log10((c + 1.0) / (total + 1.0 * (types + 1)))
    end_base, known_end = float(base(float(n_docs))), int(n_docs > 0)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, lps = shared.value
        for b in batches:
            for part in pieces(b, 512):
                counts = [Counter(byte_words(t)) for t in text_bytes(part["text"])]
                width = np.array([len(x) for x in counts], np.int64)
                word, n = [w for x in counts for w in x], np.fromiter((k for x in counts for k in x.values()), np.int64, int(width.sum()))
                doc, h = np.repeat(np.arange(len(counts)), width), _hashed(word)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if len(keys) else np.zeros(len(h), np.int64)
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                own, k, m = doc[hit], n[hit], at[hit]
                sums = lambda v, own=own, size=len(counts): np.bincount(own, v, size)
                cold = np.flatnonzero(~hit)
                cells = pa.StructArray.from_arrays([pa.array([word[i] for i in cold], pa.binary()), pa.array(n[cold])], names=["word", "n"])
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[cold], minlength=len(counts)))]).astype(np.int32)
                yield pa.record_batch(
                    [
                        part["row_no"],
                        part["doc_id"],
                        part["learn"],
                        pa.array(np.bincount(doc, n, len(counts)).astype(np.int64) + 1),
                        pa.array(sums(k * (c[m] > 0)).astype(np.int64) + known_end),
                        pa.array(sums(k * base(c[m])) + end_base),
                        *(pa.array(sums(k * lps[j][m]) + ends[j]) for j in range(components)),
                        pa.ListArray.from_arrays(pa.array(bounds), cells),
                    ],
                    names=["row_no", "doc_id", "learn", "n_tokens", "n_known", "base", *(f"s{j}" for j in range(components)), "cold"],
                )

    ss = [f"s{j}" for j in range(components)]
    fields = ", ".join(f"{x} double" for x in ["base", *ss])
    numbered = own.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "learn", "text")
    # Written, so that a row's number is the same wherever it is used.
    found = written(numbered.mapInArrow(summed, f"row_no long, doc_id long, learn boolean, n_tokens long, n_known long, {fields}, cold array<struct<word:binary,n:bigint>>"), "document-sums")
    rare = found.select("row_no", F.explode("cold").alias("x")).select("row_no", "x.word", "x.n").join(table, "word")
    cold_base = F.log10((F.col("c") + 1.0) / F.lit(float(total + types + 1)))
    more = rare.groupBy("row_no").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * cold_base).alias("more_base"), *(F.sum(F.col("n") * F.col(x)).alias(f"more_{s}") for x, s in zip(ls, ss, strict=True))
    )
    met = found.drop("cold").join(more, "row_no", "left")
    plus = lambda name, extra: F.col(name) + F.coalesce(F.col(extra), F.lit(0))
    shares = [float(np.log10(max(d, 1e-9) / max(1, n_docs))) for d in docs]
    joint = [plus(s, f"more_{s}") + share for s, share in zip(ss, shares, strict=True)]
    best = F.greatest(*joint) if components > 1 else joint[0]
    mixed = best + F.log10(sum(F.pow(F.lit(10.0), F.greatest(x - best, F.lit(-300.0))) for x in joint))
    return met.select(
        "doc_id", F.col("learn").alias("learned"), "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), mixed.alias("score")
    )


def default_vocabulary() -> str:
    """The public SentencePiece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_subword_lattice(spark, sf_dir: str) -> DataFrame:
    """Every document's base score and marginal log10 probability."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = scores(documents, in_training(), default_vocabulary(), "lang")
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
