"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are runs of ASCII digits, ASCII letters (lower-cased) and characters
beyond ASCII. A window is eight consecutive words of a benchmark item; an
item of one to seven words is a single window. Document windows are looked up
by a rolling hash of word numbers and verified word by word.

The set is broadcast in parts of at most about `max_windows` windows, dealt by
a hash of the window. Each part is a pass of its own over the documents,
without a shuffle, that adds to the hits of those before; its result is
written and its broadcast let go before the next: a benchmark of any size, or
with items of any size, is searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, bound_batches, records, sole, stash

WINDOW = 8
#: Windows in one broadcast (about 100 bytes each in a worker).
MAX_WINDOWS = 500_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_TABLE = bytes(low if (low := bytes([c]).lower()[0]) in _KEEP else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """The words of a text; null has none."""
    return (raw or b"").translate(_TABLE).split()


class WindowSet:
    """Windows of benchmark items, found in documents by hash and verified."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.exact: dict[tuple[int, ...], set[str]] = {}
        for item, raw in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(raw))
            n = min(window, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                self.exact.setdefault(ids[at : at + n], set()).add(item)
        rng = np.random.default_rng(7)
        self.codes = rng.integers(1, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64) | np.uint64(1)
        self.lengths = sorted({len(k) for k in self.exact})
        self.mixers = {n: rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1) for n in self.lengths}
        self.hashes = {}
        for n in self.lengths:
            keys = np.array([k for k in self.exact if len(k) == n], np.int64)
            self.hashes[n] = np.unique(self._mix(keys.T, n))

    def _mix(self, columns: list[np.ndarray] | np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for k in range(n):
            total += self.codes[columns[k]] * self.mixers[n][k]
        return total

    def find(self, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """Mark hit words and add the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, _ZEROS), np.int64, len(words))
        known = ids > 0
        if not known.any():
            return
        run = np.concatenate(([0], np.cumsum(known)))
        for n in self.lengths:
            if len(words) < n:
                continue
            starts = np.flatnonzero(run[n:] - run[:-n] == n)
            if not len(starts):
                continue
            hashed = self._mix([ids[starts + k] for k in range(n)], n)
            at = np.searchsorted(self.hashes[n], hashed)
            at[at == len(self.hashes[n])] = 0
            for start in starts[self.hashes[n][at] == hashed].tolist():
                found = self.exact.get(tuple(ids[start : start + n].tolist()))
                if found:
                    hit[start : start + n] = True
                    items |= found


class _Zeros:
    """Endless zeros, for map()."""

    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Zeros()


def _scan(share, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = share.value
        sole("decontaminate", int)
        for whole in batches:
            for batch in blocks(whole, "text"):
                hits, found = [], []
                old_hits = [None] * batch.num_rows if first else batch.column("hits").to_pylist()
                old_items = [None] * batch.num_rows if first else batch.column("items").to_pylist()
                for raw, hit, items in zip(batch.column("text").to_pylist(), old_hits, old_items):
                    words = words_of(raw)
                    mask = np.zeros(len(words), bool)
                    if hit:
                        mask[hit] = True
                    seen = set(items or ())
                    windows.find(words, mask, seen)
                    hits.append(np.flatnonzero(mask).astype(np.int32))
                    found.append(sorted(seen))
                yield records([batch.column("doc_id"), batch.column("text"), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], ["doc_id", "text", "hits", "items"])

    return run


def _search(docs: DataFrame, benchmark: DataFrame, max_windows: int, window: int) -> DataFrame:
    """doc_id (of any type), text (bytes), hits (numbers of hit words), items (sorted ids)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    bound_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), as_bytes("text").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = 1
    if size // 2 > max_windows:  # a word has a byte and a gap at least
        items = stash(items.mapInArrow(_windows(window), "item string, text binary").distinct(), "windows")
        parts = max(1, -(-items.count() // max_windows))
    found = docs
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        share = spark.sparkContext.broadcast(WindowSet([(r[0], bytes(r[1])) for r in own.collect()], window))
        found = found.mapInArrow(_scan(share, part == 0), f"doc_id {kind}, text binary, hits array<int>, items array<string>")
        if part < parts - 1:
            found = stash(found, "pass")
            share.unpersist()
    return found


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of each item, its words joined by blanks."""
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(raw)
                n = min(window, len(words))
                for first in range(0, len(words) - n + 1 if n else 0, 10_000):
                    own = [b" ".join(words[at : at + n]) for at in range(first, min(first + 10_000, len(words) - n + 1))]
                    yield records([pa.array([item] * len(own)), pa.array(own, pa.binary())], ["item", "text"])

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, hits, items in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "items"))):
            out.append((len(words_of(raw)), len(hits), len(items), hashlib.sha256(",".join(items).encode()).hexdigest()))
        cols = list(zip(*out)) or [()] * 4
        yield records([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", max_windows: int = MAX_WINDOWS, window: int = WINDOW) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for every document row.

    Null and empty texts have no words. Items with null id or text, or no
    word, have no windows; items that share an id count once. An empty
    benchmark hits nothing; an empty table gives no rows. Other columns are
    ignored.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(text_col).alias("text"))
    found = _search(own, benchmark, max_windows, window).mapInArrow(_report, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")
    return found.withColumn("contaminated", F.col("n_items") >= min_items)


def cut_words(raw: bytes, hits: list[int]) -> bytes:
    """The text without the hit words and what stands between neighbours among them."""
    import re

    gone = set(hits)
    out, at, open_since = [], 0, None
    for k, m in enumerate(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)):
        if k in gone:
            if open_since is None:
                open_since = m.start()
                out.append(raw[at:open_since])
            at = m.end()
        else:
            open_since = None
    return b"".join([*out, raw[at:]])


def _clean(min_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep, cut = [], [], []
            for raw, hits, items in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "items"))):
                changed = bool(hits)
                if changed:
                    raw = cut_words(raw, hits)
                keep.append(len(items) < min_items and not (changed and not words_of(raw)))
                cut.append(changed)
                texts.append(raw)
            out = records([batch.column("doc_id"), pa.array(texts, pa.binary()), pa.array(cut, pa.bool_())], ["row", "new_text", "cut"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, text_col: str = "text", max_windows: int = MAX_WINDOWS, window: int = WINDOW) -> DataFrame:
    """docs without contaminated rows, and without hit spans in the others.

    A row that hits `min_items` items or more goes, and so does one of which
    no word is left; else its hit spans are cut out. All columns of docs are
    kept as they are, but for the text of rows with a cut (and n_chars, if
    there is such a column). Nulls and equal rows stay.
    """
    names = docs.columns
    # The other columns travel through the scan as one struct: no join, and no clash of names.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("doc_id"), as_bytes(text_col).alias("text"))
    schema = packed.schema["doc_id"].dataType.simpleString()
    found = _search(packed, benchmark, max_windows, window)
    kept = found.mapInArrow(_clean(min_items), f"row {schema}, new_text binary, cut boolean")
    text = F.col("new_text").cast("string")
    columns = []
    for c in names:
        if c == text_col:
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("cut"), F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return kept.select(*columns)
