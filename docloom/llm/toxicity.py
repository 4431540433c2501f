"""Toxic spans by a linear-chain conditional random field.

A two-label CRF tags every token of every text. Its features are the word, its first four and last three characters, its
shape, the words on both sides, and the transitions of labels. Forward-backward marginals give each document the expected number of
toxic tokens and the largest marginal; a logistic regression turns both into the document's score, and tokens of a marginal
of one half or more are its toxic spans.

Only documents carry labels, so token labels are learned with the model: tokens of clean documents are 0; in toxic ones those are 1
whose word or beginning stands in many different contexts of toxic documents and in few of clean ones, then, in a second round,
those that the CRF itself tags. The fit runs on the driver over a bounded sample of labelled rows; a third of the sample is kept for
the logistic regression, so that it sees marginals of texts that the CRF did not learn from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import byte_words, pieces, text_bytes

#: The sample: of each label whole rows in the order of a hash of their id, at most so many, while they have under so many bytes (the first in any case).
SAMPLE_ROWS = 2000
FIT_BYTES = 4 << 20
#: Tokens in a row of the fit; texts are cut into rows with the tokens on both sides.
BLOCK = 64
REJECT_AT = 0.7
STRIP = b".,!?;:#*$%&|<>\"'()[]{}-_~+="
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Contexts, and root of twice the log-likelihood gain, by which a word or beginning labels tokens of toxic documents at first.
MIN_CONTEXTS, MIN_ROOT = 4, 4.0
HEAD, TAIL = 4, 3
#: Words have a weight of their own if so many documents of the sample hold them: a hundredth of it, between these.
FEWEST_DOCS, MIN_DOCS = 3, 15
EPOCHS, STEPS, BATCH, RATE, L2 = (10, 5), 250, 256, 0.5, 1e-5
#: Tokens in a row of the forward-backward recursion over whole texts.
ROW = 32
#: Words without a weight of their own whose features a task remembers.
REMEMBERED = 100_000


class Model(NamedTuple):
    """words: number from 1 of each word with weights; own, left, right: log weight of label 1 for the word itself (all its features) and as a neighbour on the left
    and right, 0 for other words; heads, tails, shapes: weights by which other words count; move: 2x2 transitions."""

    words: dict[bytes, int]
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    heads: dict[bytes, float]
    tails: dict[bytes, float]
    shapes: np.ndarray
    move: np.ndarray
    logit: np.ndarray


def tokens(text: bytes) -> list[bytes]:
    """Words without punctuation at their ends."""
    return [w.strip(STRIP) for w in byte_words(text)]


def affixes(word: bytes) -> tuple[bytes, bytes]:
    """The first HEAD and last TAIL characters of a longer word; empty for others."""
    text = word.decode("utf-8", "replace")
    return text[:HEAD].encode() if len(text) > HEAD else b"", text[-TAIL:].encode() if len(text) > TAIL else b""


SHAPES = 16


def shape(word: bytes) -> int:
    """A word's shape: length in four steps, whether it holds digits, whether it holds other marks than letters."""
    return min(len(word) // 4, 3) + 4 * any(48 <= c <= 57 for c in word) + 8 * any(c < 128 and not 48 <= c <= 57 and not 97 <= c <= 122 for c in word)


# The chain


def marginals(score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over rows of equal length: P(label 1) for each token, expected transitions (2x2) of all rows, and log partition of each."""
    rows, length = score.shape
    emit = np.stack([np.zeros_like(score), score], axis=2)
    forward, backward = np.empty((rows, length, 2)), np.zeros((rows, length, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, length):
        forward[:, t] = emit[:, t] + np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1])
    for t in range(length - 2, -1, -1):
        after = emit[:, t + 1] + backward[:, t + 1]
        backward[:, t] = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
    whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    one = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None])
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            pairs[a, b] = np.exp(forward[:, :-1, a] + move[a, b] + emit[:, 1:, b] + backward[:, 1:, b] - whole[:, None]).sum()
    return one, pairs, whole


def text_marginals(score: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(label 1) for each token of texts that lie one after the other in score, sizes giving their tokens.

    Texts are cut into rows of ROW tokens. The products of each row's transfer matrices carry the forward and backward weights from
    row to row, so the result is that of one recursion over each whole text.
    """
    rows_of = -(-sizes // ROW)
    n = int(rows_of.sum())
    if not n:
        return np.empty(0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(score)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first_row = np.cumsum(rows_of) - rows_of
    at = (first_row[text] + within // ROW, within % ROW)
    real = np.zeros((n, ROW), bool)
    real[at] = True
    odds = np.ones((n, ROW))
    odds[at] = np.exp(np.clip(score, -30, 30))
    m = np.exp(move)
    # A step of the matrix product: columns are labels after the step; past a text's end it stays as it is.
    whole = np.zeros((n, 2, 2))
    whole[:, 0, 0] = whole[:, 1, 1] = 1
    for t in range(ROW):
        if t == 0:
            # A text's first token has no transition before it.
            step = whole @ m
            step[first_row[rows_of > 0]] = np.eye(2)
        else:
            step = whole @ m
        step[:, :, 1] *= odds[:, t, None]
        step /= step.max((1, 2), keepdims=True)
        whole = np.where(real[:, t, None, None], step, whole)
    begin, end = np.ones((n, 2)), np.ones((n, 2))
    order = np.argsort(-rows_of, kind="stable")
    counts = rows_of[order]
    for j in range(1, int(counts[0])):
        live = first_row[order[: np.searchsorted(-counts, -j, side="left")]] + j
        ahead = np.einsum("ka,kab->kb", begin[live - 1], whole[live - 1])
        begin[live] = ahead / ahead.max(1, keepdims=True)
    for j in range(int(counts[0]) - 2, -1, -1):
        live = first_row[order[: np.searchsorted(-counts, -(j + 1), side="left")]] + j
        back = np.einsum("kab,kb->ka", whole[live + 1], end[live + 1])
        end[live] = back / back.max(1, keepdims=True)
    starts = np.zeros(n, bool)
    starts[first_row[rows_of > 0]] = True
    forward, ahead = np.empty((n, ROW, 2)), begin
    for t in range(ROW):
        step = ahead @ m
        if t == 0:
            step[starts] = 1
        step[:, 1] *= odds[:, t]
        step /= step.max(1, keepdims=True)
        forward[:, t] = ahead = step
    one, back = np.empty((n, ROW)), end
    for t in range(ROW - 1, -1, -1):
        both = forward[:, t] * back
        one[:, t] = both[:, 1] / both.sum(1)
        step = np.stack([back[:, 0], back[:, 1] * odds[:, t]], axis=1) @ m.T
        step /= step.max(1, keepdims=True)
        back = np.where(real[:, t, None], step, back)
    return one[at]


# The fit


class Sample:
    """Tokenised documents as numbers of words, and the words' features."""

    def __init__(self, rows):
        self.numbers: dict[bytes, int] = {}
        self.documents: list[np.ndarray] = []
        self.labels: list[int] = []
        for words, label in rows:
            self.documents.append(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int32))
            self.labels.append(int(label))
        self.words = list(self.numbers)
        own = [affixes(w) for w in self.words]
        self.head, self.heads = self._numbered([x[0] for x in own])
        self.tail, self.tails = self._numbered([x[1] for x in own])
        self.shape = np.array([shape(w) for w in self.words], np.int64)
        self.word = self._kept(np.arange(len(self.words)))

    @staticmethod
    def _numbered(parts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        numbers: dict[bytes, int] = {b"": 0}
        return np.array([numbers.setdefault(x, len(numbers)) for x in parts], np.int64), list(numbers)

    def _kept(self, item_of: np.ndarray) -> np.ndarray:
        """For each word, the number from 1 of its item if enough documents hold it, else 0."""
        least = max(FEWEST_DOCS, min(MIN_DOCS, len(self.documents) // 100))
        found = np.zeros(int(item_of.max(initial=-1)) + 1, np.int64)
        for own in self.documents:
            found[np.unique(item_of[own])] += 1
        number = np.where(found >= least, np.cumsum(found >= least), 0)
        return number[item_of] if len(item_of) else item_of

    def suspects(self, item_of: np.ndarray) -> np.ndarray:
        """Whether each item (a word's, by item_of) stands in far more different contexts in toxic documents, by a likelihood-ratio test."""
        items = int(item_of.max(initial=-1)) + 1
        contexts, size = np.zeros((2, items)), np.zeros(2)
        for label in (0, 1):
            own = [d for d, y in zip(self.documents, self.labels, strict=True) if y == label]
            flat = np.concatenate([np.empty(0, np.int64), *own])
            around = np.concatenate([np.empty((0, 2), np.int64), *(np.stack([np.append(-1, d[:-1]), np.append(d[1:], -1)], axis=1) for d in own if len(d))])
            around = around.astype(np.int64)
            mixed = (item_of[flat] * 0x9E3779B1 + around[:, 0]) * 0x85EBCA6B + around[:, 1]
            _, first = np.unique(mixed, return_index=True)
            contexts[label] = np.bincount(item_of[flat][first], minlength=items)
            size[label] = len(flat)
        if not size.all():
            return np.zeros(items, bool)
        clean, toxic = contexts
        share = size[1] / size.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 2 * (np.where(toxic, toxic * np.log(toxic / ((toxic + clean) * share)), 0) + np.where(clean, clean * np.log(clean / ((toxic + clean) * (1 - share))), 0))
            odds = (toxic + 0.5) / size[1] / ((clean + 0.5) / size[0])
        return (toxic >= MIN_CONTEXTS) & (odds > 4) & (np.sqrt(np.maximum(gain, 0)) >= MIN_ROOT)


class Weights:
    """The CRF's parameters in one vector: word, head, tail, shape, left and right neighbour, transitions."""

    def __init__(self, sample: Sample):
        words = int(sample.word.max(initial=0)) + 1
        self.sizes = [words, len(sample.heads), len(sample.tails), SHAPES, words, words, 4]
        self.at = np.cumsum([0, *self.sizes])
        self.w, self.squares = np.zeros(self.at[-1]), np.full(self.at[-1], 1e-3)
        self.w[self.at[3] : self.at[4]] = -2.0

    def part(self, i: int) -> np.ndarray:
        return self.w[self.at[i] : self.at[i + 1]]

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        return sum(self.part(i)[f] * (f > 0 if i != 3 else 1) for i, f in enumerate(features))

    def learn(self, features: list[np.ndarray], labels: np.ndarray) -> None:
        """One step of Adagrad on the log likelihood of rows of tokens."""
        one, pairs, _ = marginals(self.score(features), self.part(6).reshape(2, 2))
        off = labels - one
        parts = [np.bincount(f.ravel(), (off * (f > 0) if i != 3 else off).ravel(), self.sizes[i]) for i, f in enumerate(features)]
        a, b = labels[:, :-1], labels[:, 1:]
        seen = np.array([((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()])
        g = np.concatenate([*parts, seen - pairs.ravel()]) / len(labels) - L2 * self.w
        self.squares += g * g
        self.w += RATE * g / np.sqrt(self.squares)


def _features(one: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text: 1, the largest marginal, and the logs of 1 and the sums of marginals inside spans and outside of them."""
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        out[full, 1] = np.maximum.reduceat(one, at)
        out[full, 2], out[full, 3] = (np.log1p(np.add.reduceat(x, at)) for x in (one * (one >= 0.5), one * (one < 0.5)))
    return out


def fit(rows, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model of (words, label) rows; weights: how many labelled rows one of each label stands for. Every third row of a label fits the logistic regression alone."""
    # Equal words are one object.
    pool: dict[bytes, bytes] = {}
    rows = [([pool.setdefault(w, w) for w in words], int(label)) for words, label in rows]
    seen = Counter(label for _, label in rows)
    n = [seen[k] * weights[k] for k in (0, 1)]
    flat = np.array([math.log((n[1] + 1) / (n[0] + 1)), 0.0, 0.0, 0.0])
    place, turn = Counter(), []
    for _, label in rows:
        turn.append(place[label] % 3)
        place[label] += 1
    sample = Sample([r for r, k in zip(rows, turn, strict=True) if k < 2])
    suspect = np.zeros(len(sample.words), bool)
    if n[0] and n[1] and sample.words:
        head = sample.suspects(sample.head)
        head[0] = False
        suspect = sample.suspects(np.arange(len(sample.words))) | head[sample.head]
        suspect &= np.array([bool(w) for w in sample.words])
    if not suspect.any():
        return Model({}, np.zeros(1), np.zeros(1), np.zeros(1), {}, {}, np.zeros(SHAPES), np.zeros((2, 2)), flat)
    learned = Weights(sample)
    # Blocks of documents with their neighbours; the last block of each is filled up with its document's first tokens.
    filled = []
    for d, y in zip(sample.documents, sample.labels, strict=True):
        if len(d):
            whole = np.resize(d, -(-len(d) // BLOCK) * BLOCK)
            around = (np.append(np.int32(-1), whole[:-1]), np.append(whole[1:], np.int32(-1)))
            filled.append([*(x.reshape(-1, BLOCK) for x in (whole, *around)), np.full(len(whole) // BLOCK, y)])
    word, before, after, toxic = (np.concatenate([x[i] for x in filled]) for i in range(4))
    # Only the rows for the logistic regression are needed any more.
    kept = [r for r, k in zip(rows, turn, strict=True) if k == 2]
    kept = rows if len({y for _, y in kept}) < 2 else kept
    del filled, rows, sample.documents
    labels = suspect[word] & (toxic > 0)[:, None]
    rng = np.random.default_rng(0)
    chosen = np.arange(len(toxic))
    number = np.append(sample.word, 0)
    take = lambda at: [number[word[at]], sample.head[word[at]], sample.tail[word[at]], sample.shape[word[at]], number[before[at]], number[after[at]]]
    for k, epochs in enumerate(EPOCHS):
        if k:
            for at in np.array_split(chosen, max(1, len(chosen) // 1024)):
                one, _, _ = marginals(learned.score(take(at)), learned.part(6).reshape(2, 2))
                labels[at] = (one >= 0.5) & (toxic[at] > 0)[:, None]
        batches = max(1, len(chosen) // BATCH)
        # A small sample is gone through more often.
        for _ in range(max(epochs, -(-STEPS // batches))):
            for at in np.array_split(rng.permutation(chosen), batches):
                learned.learn(take(at), labels[at].astype(float))
    heads = {h: float(w) for h, w in zip(sample.heads, learned.part(1), strict=True) if h and w}
    tails = {t: float(w) for t, w in zip(sample.tails, learned.part(2), strict=True) if t and w}
    shapes = learned.part(3).copy()
    words = {w: int(i) for w, i in zip(sample.words, sample.word, strict=True) if i}
    own = learned.part(0).copy()
    for w, i in words.items():
        h, t = affixes(w)
        own[i] += heads.get(h, 0.0) + tails.get(t, 0.0) + shapes[shape(w)]
    model = Model(words, own, learned.part(4).copy(), learned.part(5).copy(), heads, tails, shapes, learned.part(6).reshape(2, 2).copy(), flat)
    model.left[0] = model.right[0] = 0.0
    tagger = Tagger(model)
    x = np.concatenate([_features(*tagger.tag([w for w, _ in kept[at : at + 256]])) for at in range(0, len(kept), 256)])
    y = np.array([y for _, y in kept], float)
    return model._replace(logit=logistic(x, y, np.where(y > 0, weights[1], weights[0])))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.1 * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


# The use


class Tagger:
    """A model at work in a task; features of words without weights of their own are remembered."""

    def __init__(self, model: Model):
        self.model, self.other = model, {}

    def affix_score(self, word: bytes) -> float:
        """What a word without a weight of its own scores by its beginning, ending and shape."""
        found = self.other.get(word)
        if found is None:
            h, t = affixes(word)
            found = self.model.heads.get(h, 0.0) + self.model.tails.get(t, 0.0) + float(self.model.shapes[shape(word)])
            if len(self.other) < REMEMBERED:
                self.other[word] = found
        return found

    def tag(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """P(label 1) of all tokens of the texts, one after the other, and the texts' tokens."""
        model, sizes = self.model, np.array([len(x) for x in texts], np.int64)
        words = [w for x in texts for w in x]
        ids = np.fromiter((model.words.get(w, 0) for w in words), np.int64, len(words))
        score = model.own[ids]
        others = np.flatnonzero(ids == 0)
        score[others] = [self.affix_score(words[i]) for i in others.tolist()]
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        left, right = np.append(0.0, model.left[ids[:-1]]), np.append(model.right[ids[1:]], 0.0)
        if len(words):
            left[starts] = 0.0
            right[starts[1:] - 1] = 0.0
            score = score + left + right
        return text_marginals(score, sizes, model.move), sizes


def held_out():
    """Rows that no model may learn from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text."""
    for b in batches:
        out = [b" ".join(w or b"-" for w in tokens(text)) for text in text_bytes(b["text"])]
        yield pa.record_batch([b["doc_id"], b["toxic"], pa.array(out, pa.binary())], names=["doc_id", "toxic", "words"])


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """A model of a bounded sample of the labelled rows outside the held-out third: of each label at most sample_rows ids, with whole texts, while they have under fit_bytes bytes."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    n = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    picked = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1)]
    # At most 2 * sample_rows ids, so they may be broadcast, and their sizes fit in a window.
    few = F.broadcast(picked[0].union(picked[1]))
    sizes = documents.select("doc_id", F.octet_length("text").alias("bytes")).join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.max("bytes"), F.lit(0)).alias("bytes"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).filter(F.col("before") < fit_bytes).select("doc_id", "toxic")
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    words = texts.mapInArrow(_words, f"doc_id {dict(texts.dtypes)['doc_id']}, toxic int, words binary")
    # One row for each id, in an order that does not depend on the tasks.
    rows = words.groupBy("doc_id", "toxic").agg(F.min("words").alias("words")).toArrow().sort_by([("doc_id", "ascending")])
    labelled = rows["toxic"].to_pylist()
    weights = tuple(n.get(k, 0) / max(1, labelled.count(k)) for k in (0, 1))
    return fit(((t.as_py().split(), y) for t, y in zip(rows["words"], labelled, strict=True)), weights)


def scored(documents: DataFrame, model: Model, reject_at: float = REJECT_AT) -> DataFrame:
    """documents with score (0 to 1), predicted (int) and spans (start, end, p: characters of tokens with P(toxic) of at least one half).

    Texts of any length are tagged whole; null and empty texts have no token and get the score of such texts. Each row is scored alone, so
    repeated rows and null ids are returned as they are; an empty table gives an empty result; columns named like a result are replaced.
    """
    rest = [c for c in documents.columns if c.lower() not in ("score", "predicted", "spans")]
    kept = documents.select(*(f"`{c}`" for c in rest))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tagger = Tagger(own)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for whole in batches:
            for b in pieces(whole, 256):
                texts = text_bytes(b["text"])
                one, sizes = tagger.tag([tokens(t) for t in texts])
                score = 1 / (1 + np.exp(-np.clip(_features(one, sizes) @ own.logit, -30, 30)))
                spans: list[list[dict]] = [[] for _ in texts]
                ends = np.cumsum(sizes)
                hot = np.flatnonzero(one >= 0.5)
                of = np.searchsorted(ends, hot, side="right")
                for i in np.unique(of).tolist():
                    mine = hot[of == i]
                    spans[i] = _spans(texts[i], (mine - (ends[i] - sizes[i])).tolist(), one[mine].tolist())
                yield pa.record_batch([*(b[c] for c in rest), pa.array(score), pa.array((score >= reject_at).astype(np.int32)), pa.array(spans, span)], names=[*rest, "score", "predicted", "spans"])

    return kept.mapInArrow(run, f"{fields}, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def _spans(text: bytes, numbers: list[int], p: list[float]) -> list[dict]:
    """The characters of tokens by their numbers."""
    at = [m.span() for m in TOKEN.finditer(text.decode())]
    return [{"start": at[i][0], "end": at[i][1], "p": x} for i, x in zip(numbers, p, strict=True)]


def op5_crf_spans(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(documents, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
