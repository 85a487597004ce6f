"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (hashed to buckets) and itself, so
misspellings share vectors with what was seen. The vectors of a window of
words are averaged, and a linear softmax gives the window's odds; a document
is as toxic as its worst window, so one insult in a long text is not averaged
away. Embeddings and softmax are trained jointly in numpy on document labels:
a document's windows share its gradient by a softmax over their own odds,
which is sharpened step by step.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, bound_batches, crc_mod, records, sole

BUCKETS = 1 << 20
DIM = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 6
#: The model is fitted on about so many labelled rows of each class, and about
#: so many bytes of text at most, chosen by a hash of the id; all words of
#: these rows are learned from.
SAMPLE_TOXIC = 1_500
SAMPLE_CLEAN = 3_000
SAMPLE_BYTES = 16 << 20
#: Windows, and n-grams of words, that a step of training holds at once.
WINDOWS_AT_ONCE = 250_000
GRAMS_AT_ONCE = 1_000_000
STEPS = 120
RATE = 80.0
#: The toxic class's share in the loss, whatever its share of the rows.
TOXIC_WEIGHT = 0.3
#: Largest step of a bucket, so that frequent words do not swing.
CLIP = 0.03
#: Shrinkage of the embeddings in a step.
DECAY = 0.015
#: Share of a word's n-grams that take part in a step of training.
KEEP = 0.5
#: Words whose scores a worker keeps.
CACHE_WORDS = 500_000

_EDGE = " \t.,;:!?\"'`()[]{}<>|*#$%&+=~_/\\-–—…«»„“”‘’¡¿"


def subwords(word: bytes) -> list[int]:
    """Buckets of a word and its n-grams."""
    text = f"<{word.decode('utf-8', 'replace').lower().strip(_EDGE)}>"
    found = [text] + [text[i : i + n] for n in GRAMS if n < len(text) for i in range(len(text) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in found]


class Model:
    """Bucket scores: each embedding's product with the softmax's difference of classes.

    Buckets that no training word falls into are unknown (NaN) and left out
    of a word's average.
    """

    def __init__(self, scores: np.ndarray, bias: float):
        self.scores, self.bias = scores.astype(np.float64), float(bias)
        self.cache: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return {"scores": self.scores.astype(np.float32), "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["scores"], state["bias"])

    def word(self, word: bytes) -> float:
        """A word's share of the odds; 0 if none of its n-grams is known."""
        found = self.scores[subwords(word)]
        known = found[~np.isnan(found)]
        return float(known.mean()) if len(known) else 0.0

    def score(self, raw: bytes | None) -> float:
        """Probability that a text is toxic; the prior's for a text without words."""
        words = (raw or b"").lower().split()
        if not words:
            return 1 / (1 + np.exp(-min(self.bias, 0.0)))
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        try:
            each = np.fromiter(map(self.cache.__getitem__, words), float, len(words))
        except KeyError:
            for w in set(words).difference(self.cache):
                self.cache[w] = self.word(w)
            each = np.fromiter(map(self.cache.__getitem__, words), float, len(words))
        n = min(WINDOW, len(each))
        sums = np.concatenate(([0.0], np.cumsum(each)))
        worst = float((sums[n:] - sums[:-n]).max()) / WINDOW + self.bias
        return float(1 / (1 + np.exp(-np.clip(worst, -500, 500))))


def _cuts(ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of items that sum to about `most` (one item at least), given their running sums."""
    out, at = [], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        out.append((at, to))
        at = to
    return out


def train(samples: Iterable[tuple[bytes, int]], steps: int = STEPS, dim: int = DIM, seed: int = 5) -> Model:
    """Joint training of embeddings and softmax on (text, label) rows.

    Every row with words takes part with all its windows. Windows and n-grams
    are gone through in blocks: beside a block and the different words, eight
    bytes are held for each word of the texts.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    ids, lengths, labels = array("i"), [], []
    for raw, label in samples:
        words = (raw or b"").lower().split()
        if words:
            ids.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
            lengths.append(len(words))
            labels.append(label)
    if not labels or len(set(labels)) < 2:  # nothing to tell apart
        return Model(np.full(BUCKETS, np.nan), 4.0 if labels and labels[0] else -4.0)
    y = np.array(labels, float)
    flat, sizes = np.frombuffer(ids, np.int32), np.array(lengths)
    grams, each_word = array("i"), array("i")
    for w in vocabulary:
        own = subwords(w)
        grams.extend(own)
        each_word.append(len(own))
    parts, sizes_of = np.frombuffer(grams, np.int32), np.frombuffer(each_word, np.int32)
    ends_of = np.cumsum(sizes_of, dtype=np.int64)
    first = ends_of - sizes_of
    word_blocks = _cuts(ends_of, GRAMS_AT_ONCE)
    del vocabulary
    # Windows: every place of a document where a whole window fits (one if it is shorter).
    base = np.cumsum(sizes) - sizes
    width = np.minimum(sizes, WINDOW)
    per = sizes - width + 1
    head = np.cumsum(per) - per
    n_windows = int(per.sum())

    def windows(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, slice, np.ndarray]:
        """A block of windows: their documents, starts and ends in the block's words, these words, and where documents begin."""
        to = min(n_windows, at + WINDOWS_AT_ONCE)
        d0, d1 = np.searchsorted(head, [at, to - 1], side="right") - 1
        begin = np.maximum(head[d0 : d1 + 1], at)
        n = np.diff(begin, append=to)
        doc = np.repeat(np.arange(d0, d1 + 1), n)
        start = np.arange(at, to) + (base - head)[doc]
        end = start + width[doc]
        low = int(start[0])
        return doc, start - low, end - low, slice(low, int(end[-1])), begin - at

    def averages(word: np.ndarray, start: np.ndarray, end: np.ndarray, own: slice) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(word[flat[own]], dtype=float)))
        return (sums[end] - sums[start]) / WINDOW

    E = rng.random((BUCKETS, dim), np.float32)
    E *= 2
    E -= 1
    E /= np.float32(dim)
    W = rng.normal(0, 0.5, (2, dim))
    bias = np.zeros(2)
    vE, vW, vb = np.zeros_like(E), np.zeros_like(W), np.zeros(2)
    weight = np.where(y == 1, TOXIC_WEIGHT / y.sum(), (1 - TOXIC_WEIGHT) / (1 - y).sum())
    rate, momentum = RATE, 0.9
    kept, counts, word = np.empty(len(parts), bool), np.empty(len(first), np.int32), np.empty(len(first))
    z = np.empty(n_windows, np.float32)
    for step in range(steps):
        sharp = 0.5 + 3.5 * min(1.0, step / (0.6 * steps))
        u = W[1] - W[0]
        s = E @ u.astype(np.float32)
        for at in range(0, len(parts), GRAMS_AT_ONCE):  # some n-grams sit a step out, so that the others learn the word too
            some = slice(at, min(len(parts), at + GRAMS_AT_ONCE))
            kept[some] = rng.random(some.stop - at, np.float32) < KEEP
        kept[first + rng.integers(0, sizes_of)] = True
        for w0, w1 in word_blocks:
            some = slice(int(first[w0]), int(ends_of[w1 - 1]))
            heads = first[w0:w1] - first[w0]
            counts[w0:w1] = np.add.reduceat(kept[some].astype(np.int32), heads)
            word[w0:w1] = np.add.reduceat(np.where(kept[some], s[parts[some]], np.float32(0)), heads) / counts[w0:w1]
        # A document's softmax over its windows, put together from blocks.
        top, mass, odds = np.full(len(y), -np.inf), np.zeros(len(y)), np.zeros(len(y))
        for at in range(0, n_windows, WINDOWS_AT_ONCE):
            doc, start, end, own, begin = windows(at)
            here = z[at : at + len(doc)]
            here[:] = averages(word, start, end, own) + (bias[1] - bias[0])
            docs = slice(int(doc[0]), int(doc[-1]) + 1)
            new = np.maximum(top[docs], np.maximum.reduceat(here, begin))
            fade = np.exp(sharp * (top[docs] - new))
            share = np.exp(np.float32(sharp) * (here - new[doc - doc[0]].astype(np.float32)))
            mass[docs] = mass[docs] * fade + np.add.reduceat(share, begin)
            odds[docs] = odds[docs] * fade + np.add.reduceat(share * here, begin)
            top[docs] = new
        p = 1 / (1 + np.exp(-np.clip(odds / mass, -60, 60)))
        g = weight * (p - y)
        at_word = np.zeros(len(word))
        for at in range(0, n_windows, WINDOWS_AT_ONCE):
            doc, start, end, own, _ = windows(at)
            share = np.exp(np.float32(sharp) * (z[at : at + len(doc)] - top.astype(np.float32)[doc]))
            each = share * (g / (WINDOW * mass))[doc]
            edge = np.zeros(own.stop - own.start + 1)
            edge[start] = each  # no two windows start or end at the same place
            edge[end] -= each
            at_word += np.bincount(flat[own], np.cumsum(edge[:-1]), len(word))
        at_word /= counts
        a = np.zeros(BUCKETS)
        for w0, w1 in word_blocks:
            some = slice(int(first[w0]), int(ends_of[w1 - 1]))
            a += np.bincount(parts[some], np.where(kept[some], np.repeat(at_word[w0:w1], sizes_of[w0:w1]), 0), BUCKETS)
        gu = (E.T @ a.astype(np.float32)).astype(float)
        vE *= momentum
        for at in range(0, BUCKETS, 1 << 16):
            some = slice(at, at + (1 << 16))
            vE[some] -= np.clip(rate * a[some], -CLIP, CLIP).astype(np.float32)[:, None] * u.astype(np.float32)[None, :]
        vW = momentum * vW - 0.02 * rate * (np.stack((-gu, gu)) + 1e-3 * W)
        vb = momentum * vb - 0.05 * rate * np.array([-g.sum(), g.sum()])
        E *= np.float32(1 - DECAY)
        E += vE
        W += vW
        bias += vb
    scores = E @ (W[1] - W[0])
    seen = np.zeros(BUCKETS, bool)
    for w0, w1 in word_blocks:
        some = slice(int(first[w0]), int(ends_of[w1 - 1]))
        word[w0:w1] = np.add.reduceat(scores[parts[some]], first[w0:w1] - first[w0]) / sizes_of[w0:w1]
        seen[parts[some]] = True
    worst = np.full(len(y), -np.inf)
    for at in range(0, n_windows, WINDOWS_AT_ONCE):
        doc, start, end, own, begin = windows(at)
        docs = slice(int(doc[0]), int(doc[-1]) + 1)
        worst[docs] = np.maximum(worst[docs], np.maximum.reduceat(averages(word, start, end, own), begin))
    scale, shift = calibrate(worst, y, weight, bias[1] - bias[0])
    scores *= scale
    scores[~seen] = np.nan
    return Model(scores, shift)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, shift: float) -> tuple[float, float]:
    """Scale and shift of the worst windows' odds: a ridged logistic fit by Newton steps."""
    at = np.array([1.0, shift])
    x = np.stack((z, np.ones_like(z)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -60, 60)))
        slope = x @ (weight * (p - y)) + 1e-3 * (at - [1.0, shift])
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        at[0] = max(at[0], 0.1)
    return float(at[0]), float(at[1])



def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on rows of docs (doc_id, text) that labels (doc_id, toxic) covers.

    Of each class a share of the ids is chosen by a hash, such that about so
    many rows, and half of so many bytes, are expected; what is chosen does
    not depend on the order of rows. Labels that are null, and labels of no
    document, are passed over; rows that are equal in id, text and label
    count once.
    """
    known = labels.select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).cast("int").alias("label")).where("__id is not null and label is not null").distinct()
    sizes = docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("size"))
    known = known.join(sizes, "__id")  # ids and lengths only: no text is shuffled
    found = {r[0]: (r[1], r[2]) for r in known.groupBy("label").agg(F.sum("n"), F.sum("size")).collect()}
    clean, toxic = (min(1.0, most / found[k][0], sample_bytes / 2 / max(1, found[k][1])) if k in found else 0.0 for k, most in ((0, sample_clean), (1, sample_toxic)))
    place = F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1_000_000)) / 1e6
    chosen = known.where(place < F.when(F.col("label") == 1, F.lit(toxic)).otherwise(F.lit(clean))).select("__id", "label")
    rows = docs.select("doc_id", as_bytes("text").alias("text")).where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # a bounded number of ids
    rows = rows.select("text", "label", "doc_id").distinct().collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r[2]).encode()), bytes(r[0]), r[1]))  # the same model whatever order the rows came in
    rows.reverse()
    return train((bytes(r[0]), r[1]) for r in iter(lambda: rows.pop() if rows else None, None))  # a text goes when its words are counted


def _score(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        sole("toxicity", model.cache.clear)
        for whole in batches:
            for batch in blocks(whole, "text"):
                scores = [model.score(t) for t in batch.column("text").to_pylist()]
                yield records([batch.column("key"), pa.array(scores, pa.float64())], ["key", "score"])

    return run


def score(docs: DataFrame, model: Model, key=None, text_col: str = "text") -> DataFrame:
    """key, score for every row. key: a column or struct to carry along (doc_id unless given)."""
    bound_batches(docs.sparkSession)
    own = docs.select((F.col("doc_id").cast("bigint") if key is None else key).alias("key"), as_bytes(text_col).alias("text"))
    share = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the input
    return own.mapInArrow(_score(share), f"key {own.schema['key'].dataType.simpleString()}, score double")


def train_and_score(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Labels of documents whose crc32(doc_id) mod modulus is the remainder are
    not learned from. Null and empty texts get the prior's score. Without
    labels of both classes all scores say the one class there is (clean, if
    none). Rows with a null id are scored, not learned from, and not held
    out; equal rows are rows. Only doc_id and text of docs are read.
    """
    fold = crc_mod("doc_id", modulus)
    model = fit(docs.where(F.col("doc_id").isNotNull() & (fold != remainder)), labels)
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold == remainder, F.lit(False)).alias("held_out"))
    found = score(docs, model, key)
    return found.select("key.doc_id", "key.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""
    found = score(docs, model, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text_col)
    return found.where(F.col("score") < threshold).select(*[F.col(f"key.`{c}`").alias(c) for c in docs.columns])
