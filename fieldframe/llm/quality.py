"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

For each length the characters inside n-grams that occur twice or more (first
included) are measured, and the characters of repeated lines, as shares of all
word characters; and the share of symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, bound_batches, records, sole

#: n-gram length in words: largest share (percent) of word characters inside repeated n-grams.
COVERAGE = {5: 20, 7: 16, 10: 12}
#: Largest share (percent) of word characters in lines that repeat an earlier line.
LINE_COVERAGE = 30
#: Most symbols for 100 words.
SYMBOLS = 30

_SYMBOLS = b"#*$%&|<>"
#: White space and the later bytes of UTF-8 characters: without them, bytes count code points of words.
_NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))

_BASE = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside n-word windows that occur twice or more.

    Windows with equal rolling hashes are compared word by word.
    """
    mask = np.zeros(len(ids), bool)
    k = len(ids) - n + 1
    if k < 2:
        return mask
    wide = ids.astype(np.uint64)
    wide = (wide + np.uint64(1)) * _BASE
    wide ^= wide >> np.uint64(29)
    wide *= np.uint64(0xBF58476D1CE4E5B9)
    hashed = np.zeros(k, np.uint64)
    for j in range(n):
        hashed = hashed * _BASE + wide[j : j + k]
    order = np.argsort(hashed, kind="stable")
    ranked = hashed[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(same):
        return mask
    left, right = order[same], order[same + 1]
    equal = np.ones(len(same), bool)
    for j in range(n):
        equal &= ids[left + j] == ids[right + j]
    if not equal.all():  # two windows share a hash: count these exactly
        seen: dict[tuple, int] = {}
        windows = [tuple(ids[i : i + n].tolist()) for i in range(k)]
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        starts = np.array([i for i, w in enumerate(windows) if seen[w] > 1], np.int64)
    else:
        starts = np.concatenate((left, right))
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[np.unique(starts)] += 1
    edges[np.unique(starts) + n] -= 1
    return np.cumsum(edges[:-1]) > 0


def measure(raw: bytes | None, lengths: tuple[int, ...] = tuple(COVERAGE)) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, chars by length."""
    raw = raw or b""
    words = raw.split()
    chars = len(raw.translate(None, _NOT_COUNTED))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    dup_lines = dup_chars = 0
    if b"\n" in raw:
        seen: set[bytes] = set()
        for line in raw.split(b"\n"):
            if line in seen:
                dup_lines += 1
                dup_chars += len(line.translate(None, _NOT_COUNTED))
            elif line.strip():
                seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    repeat, covered = 0, [0] * len(lengths)
    if len(words) > len(numbers):
        sizes = None
        mask = repeated_words(ids, 5)
        repeat = int(np.count_nonzero(mask))
        if repeat:  # longer repeats lie within repeats of five
            sizes = np.array([len(w.translate(None, _NOT_COUNTED)) for w in words], np.int64)
            for i, n in enumerate(lengths):
                own = mask if n == 5 else repeated_words(ids, n)
                covered[i] = int(sizes[own].sum())
    return (len(words), chars, symbols, dup_lines, repeat, dup_chars, *covered)


def _run(lengths: tuple[int, ...]):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("quality", int)
        for whole in batches:
            for batch in blocks(whole, "text"):
                cols = list(zip(*(measure(t, lengths) for t in batch.column("text").to_pylist()))) or [()] * len(names)
                yield records([batch.column("key"), *(pa.array(c, pa.int64()) for c in cols)], ["key", *names])

    return run


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=None) -> DataFrame:
    """Measures and verdict of every row: id, n_words ... dup_chars_N, base_failed, kept.

    base_failed: under 10 words, or over 20 percent of them in repeated
    five-word windows. kept: not base_failed, and no share over its limit
    (COVERAGE, LINE_COVERAGE, SYMBOLS). A null text has no words and fails.
    Null ids stay. Equal rows are judged each. Other columns are ignored.
    """
    lengths = tuple(n for n in COVERAGE)
    if any(n < 5 for n in lengths):
        raise ValueError("n-grams of at least five words")
    key = F.col(id_col) if key is None else key
    bound_batches(docs.sparkSession)
    own = docs.select(key.alias("key"), as_bytes(text_col).alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    fields = ", ".join(f"{n} bigint" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in lengths)))
    found = own.mapInArrow(_run(lengths), f"key {kind}, {fields}")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    bad = (100 * F.col("dup_line_chars") > LINE_COVERAGE * F.col("word_chars")) | (100 * F.col("n_symbols") > SYMBOLS * F.col("n_words"))
    for n in lengths:
        bad = bad | (100 * F.col(f"dup_chars_{n}") > COVERAGE[n] * F.col("word_chars"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~bad).withColumnRenamed("key", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    judged = quality(docs, id_col="row", text_col=text_col, key=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return judged.where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
