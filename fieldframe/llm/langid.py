"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language.
An unseen word falls back to the longest of its character n-grams that are
known, and on to shorter ones; each step back costs a penalty that is the
same for all languages and so falls away.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, bound_batches, crc_mod, records, sole

#: The model is fitted on about so many labelled rows (chosen by a hash of
#: the id, in equal parts a language). It knows all their words and n-grams.
SAMPLE_ROWS = 4_000
GRAMS = (5, 4, 3, 2, 1)
#: Words whose scores a worker keeps.
CACHE_WORDS = 400_000
#: Evidence of a text counts as if its words came in runs of this many.
TEMPER = 4.0

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies of words and n-grams by language: tables of places, and rows of frequencies."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        place = {lang: i for i, lang in enumerate(self.langs)}
        words = [Counter() for _ in self.langs]
        for lang, text in samples:
            words[place[lang]].update(words_of(text))
        self.words, self.word_rows = self._table(words)
        self.grams: dict[int, dict[str, int]] = {}
        self.gram_rows: dict[int, np.ndarray] = {}
        for n in GRAMS:
            grams = [Counter() for _ in self.langs]
            for counts, own in zip(words, grams):
                for word, k in counts.items():
                    for g in grams_of(word, n):
                        own[g] += k
            self.grams[n], self.gram_rows[n] = self._table(grams)
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(self.langs))))

    @staticmethod
    def _table(counts: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
        known: dict[str, int] = {}
        for c in counts:
            for w in c:
                known.setdefault(w, len(known))
        table = np.zeros((len(known), max(1, len(counts))), np.float32)
        for i, c in enumerate(counts):
            table[np.fromiter(map(known.__getitem__, c), np.int64, len(c)), i] = np.fromiter(c.values(), np.float32, len(c))
        sums = np.array([sum(c.values()) + 1.0 for c in counts] or [1.0])
        return known, np.log((table + 0.1) / (sums + 0.1 * (len(known) + 1))).astype(np.float32)

    def word_scores(self, word: str) -> np.ndarray:
        """Scores of a word by language, less their mean."""
        at = self.words.get(word)
        if at is not None:
            found = self.word_rows[at]
        else:
            for n in GRAMS:
                places = [p for p in map(self.grams[n].get, grams_of(word, n)) if p is not None]
                if places:
                    found = self.gram_rows[n][places].mean(axis=0)
                    break
            else:
                return np.zeros(len(self.langs))
        return found - found.mean()

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the share of belief it has; `und`, 0 without letters or languages."""
        words = words_of(text or "")
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        at = [self.cache.get(w, -1) for w in words]
        if -1 in at:
            for w in set(words).difference(self.cache):
                k = len(self.cache)
                if k == len(self.rows):
                    self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                self.rows[k] = self.word_scores(w)
                self.cache[w] = k
            at = [self.cache[w] for w in words]
        total = self.rows[at].sum(axis=0) / TEMPER
        belief = np.exp(total - total.max())
        belief /= belief.sum()
        best = int(np.argmax(belief))
        return self.langs[best], float(belief[best])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "rows": np.zeros((1024, max(1, len(self.langs))))}


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows of docs (text, lang, doc_id) that have text and lang."""
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([])
    each = max(1, sample_rows // len(sizes))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1e6
    rows = known.where(place < F.element_at(share, F.col("lang"))).select("lang", "text").limit(2 * sample_rows).collect()
    return Model([(r[0], r[1]) for r in rows])


def _predict(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        sole("langid", model.cache.clear)
        for whole in batches:
            for batch in blocks(whole, "text"):
                found = [model.predict(None if t is None else t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
                yield records([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text).

    Null texts and texts without a letter are `und` with score 0. Ties go to
    the first language in alphabetical order. Equal rows and null ids stay
    rows. An empty table gives no rows. Other columns are not read.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    bound_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), as_bytes("text").alias("text"))
    share = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_predict(share), "doc_id bigint, held_out boolean, lang_pred string, score double")


def train_and_identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on documents whose crc32(doc_id) mod modulus is not the remainder; predict all."""
    fold = crc_mod("doc_id", modulus)
    model = fit(docs.where(F.col("doc_id").isNotNull() & (fold != remainder)), sample_rows)
    return identify(docs, model, fold == remainder)
