"""Language-model scores by deleted interpolation.

A word's probability mixes three maximum-likelihood estimates: of the pair
with the word before, of the word alone, and uniform over the vocabulary. The
mixture weights depend on how often the context occurs (buckets by powers of
two). They are learned by expectation-maximisation on held-out counts: every
chunk of the training documents is set against the counts of all others.

Counting sends no row per word. Documents are numbered, written once and dealt
by number into chunks of bounded size, so rows that are equal in all columns
are spread too; a chunk asks for the total counts of its
different words and pairs, as sorted hashes cut into ranges, and each range is
summed over all chunks by one task and answered in the order asked. Frequent
words cost no more than rare ones: a chunk asks for each once.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, sole, stash

CHUNK_BYTES = 8 << 20
RANGE_BYTES = 24 << 20
MIN_CHUNKS = 16
BUCKETS = 40
STEPS = 60
#: Weights of pair, word and uniform where no held-out word tells them.
DEFAULT = (0.4, 0.5, 0.1)

_END, _START = b" end", b" start"  # no word has a blank
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Chunk:
    """Words and pairs of a chunk of documents, with the places they stand."""

    def __init__(self, texts: list[bytes | None], learn: list[bool]):
        import xxhash

        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        end, start = numbers[_END], numbers[_START]
        words, sizes = [], []
        for raw in texts:
            own = (raw or b"").lower().split()
            words.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
            sizes.append(len(own) + 1)
        self.sizes = np.array(sizes, np.int64)
        ends = np.cumsum(self.sizes)
        token = np.full(int(ends[-1]) if len(ends) else 0, end, np.int64)
        context = np.full(len(token), start, np.int64)
        for own, at in zip(words, (ends - self.sizes).tolist()):
            token[at : at + len(own)] = own
            context[at + 1 : at + 1 + len(own)] = own
        del words
        self.token = token
        self.learned = np.repeat(np.array(learn, bool), self.sizes)
        pairs, self.pair = np.unique(context * len(numbers) + token, return_inverse=True)
        self.pair_context, self.pair_token = pairs // len(numbers), pairs % len(numbers)
        self.end, self.start = end, start
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in numbers), np.uint64, len(numbers))
        one = np.uint64(1)
        both = _mix(hashes[self.pair_context] * _A + _mix(hashes[self.pair_token] * _B))
        keys = np.concatenate((hashes | one, both & ~one))  # odd: words; even: pairs
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.n_words = len(numbers)
        self.word_counts = np.bincount(token[self.learned], minlength=len(numbers))
        self.pair_counts = np.bincount(self.pair[self.learned], minlength=len(pairs))
        self.counts = np.concatenate((self.word_counts, self.pair_counts))[self.order]

    def take(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals in the order of keys, as totals of words and of pairs."""
        back = np.empty(len(totals), np.int64)
        back[self.order] = totals
        words, pairs = back[: self.n_words], back[self.n_words :]
        words[self.start] = words[self.end]  # each document starts once and ends once
        return words, pairs


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: small numbers take little."""
    import zstandard

    planes = [np.ascontiguousarray(a, f"<u{a.dtype.itemsize}").view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unsqueeze(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def _chunk_of(table: pa.Table) -> Chunk:
    sole("lm", int)
    return Chunk(table.column("text").to_pylist(), table.column("learn").to_pylist())


def _ask(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        """A chunk's keys and its own counts, cut into ranges of keys."""
        chunk = _chunk_of(table)
        edges = [(k << 64) // ranges for k in range(1, ranges)]
        cuts = [0, *np.searchsorted(chunk.keys, np.array(edges, np.uint64)).tolist(), len(chunk.keys)]
        rows = []
        for part in range(ranges):
            keys, counts = chunk.keys[cuts[part] : cuts[part + 1]], chunk.counts[cuts[part] : cuts[part + 1]]
            if len(keys):
                rows.append((part, len(keys), _squeeze(np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint32))))
        parts, sizes, blobs = zip(*rows)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(rows), pa.int32()), "part": pa.array(parts, pa.int32()), "n": pa.array(sizes, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a range of keys, to each chunk in the order it asked; and how many words there are in all."""
    chunks, sizes, blobs = (table.column(c).to_pylist() for c in ("chunk", "n", "blob"))
    keys, counts = [], []
    for n, blob in zip(sizes, blobs):
        steps, own = _unsqueeze(blob, n, "<u8", "<u4")
        keys.append(np.cumsum(steps, dtype=np.uint64))
        counts.append(own)
    every = np.concatenate(keys)
    known, place = np.unique(every, return_inverse=True)
    del every, keys
    totals = np.bincount(place, np.concatenate(counts), len(known)).astype(np.int64)
    words = (known & np.uint64(1)).astype(bool) & (totals > 0)
    answers = np.split(totals[place], np.cumsum(sizes)[:-1])
    part = table.column("part")[0].as_py()
    k = len(chunks) + 1
    return pa.table(
        {
            "chunk": pa.array([*chunks, -1], pa.int32()), "part": pa.array([part] * k, pa.int32()), "n": pa.array([*sizes, 0], pa.int64()), "blob": pa.array([*(_squeeze(a) for a in answers), b""], pa.binary()),
            "tokens": pa.array([0] * (k - 1) + [int(totals[words].sum())], pa.int64()), "words": pa.array([0] * (k - 1) + [int(words.sum())], pa.int64()),
        }
    )


def _totals(chunk: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "n", "blob"))))
    return chunk.take(np.concatenate([_unsqueeze(blob, n, "<i8")[0] for _, n, blob in rows]))


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for contexts not seen; else one more than the power of two."""
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0)


def _held_out(tokens: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """How many held-out words have which bucket and estimates, the chunk's own counts deleted.

        Estimates are kept to a quarter of a power of two; 1 stands for zero.
        """
        if not docs.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "pair", "word", "held")})
        chunk = _chunk_of(docs)
        words, pairs = _totals(chunk, answers)
        own = chunk.word_counts.copy()
        own[chunk.start] = own[chunk.end]
        words, pairs = words - own, pairs - chunk.pair_counts
        rest = max(1, tokens - int(chunk.word_counts.sum()))
        there = np.flatnonzero(chunk.pair_counts)
        context, word = words[chunk.pair_context[there]], words[chunk.pair_token[there]]
        pair, held = pairs[there], chunk.pair_counts[there]
        size = lambda a, b: np.where(a > 0, np.rint(4 * np.log2(np.maximum(a, 1) / np.maximum(b, 1))), 1).astype(np.int64)
        cells = (bucket_of(context) << 20) + (size(pair, context) + 512 << 10) + size(word, np.full(1, rest)) + 512  # sizes are from -252 to 1
        kinds, place = np.unique(cells, return_inverse=True)
        sums = np.bincount(place, held, len(kinds)).astype(np.int64)
        return pa.table({"bucket": pa.array(kinds >> 20), "pair": pa.array((kinds >> 10 & 1023) - 512), "word": pa.array((kinds & 1023) - 512), "held": pa.array(sums)})

    return run


def learn_weights(cells: list[tuple[int, int, int, int]], vocabulary: int, steps: int = STEPS) -> np.ndarray:
    """Weights by bucket (pair, word, uniform) by expectation-maximisation."""
    weights = np.tile(np.array(DEFAULT), (BUCKETS, 1))
    table = np.array(cells, float).reshape(-1, 4)
    for b in range(BUCKETS):
        own = table[table[:, 0] == b]
        if len(own):
            size = lambda q: np.where(q == 1, 0.0, 2.0 ** (q / 4))
            p = np.stack((size(own[:, 1]), size(own[:, 2]), np.full(len(own), 1 / (vocabulary + 1))), axis=1)
            if not b:
                p[:, 0] = 0
            for _ in range(steps):
                parts = weights[b] * p
                share = parts / parts.sum(axis=1, keepdims=True)
                weights[b] = own[:, 3] @ share / own[:, 3].sum()
            weights[b] = (weights[b] + 1e-6) / (1 + 3e-6)
    weights[0, 0] = 0  # a context not seen has no pairs
    return weights / weights.sum(axis=1, keepdims=True)


def _scores(tokens: int, vocabulary: int, weights: np.ndarray):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        chunk = _chunk_of(docs)
        words, pairs = _totals(chunk, answers)
        context = words[chunk.pair_context]
        w = weights[np.minimum(bucket_of(context), BUCKETS - 1)]
        p = w[:, 0] * pairs / np.maximum(context, 1) + w[:, 1] * words[chunk.pair_token] / max(1, tokens) + w[:, 2] / (vocabulary + 1)
        doc = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
        score = np.bincount(doc, np.log10(p)[chunk.pair], len(chunk.sizes))
        base = np.log10((words + 1) / (tokens + 1 * (vocabulary + 1)))
        base_score = np.bincount(doc, base[chunk.token], len(chunk.sizes))
        known = np.bincount(doc, (words > 0)[chunk.token], len(chunk.sizes)).astype(np.int64)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(chunk.sizes), "n_known": pa.array(known), "base_score": pa.array(base_score), "score": pa.array(score)})

    return run


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Words are lower-cased (A-Z), each text has one end after them. Counts are
    of all rows whose crc32(doc_id) mod modulus is not the remainder; rows
    with a null id are scored, not learned from, and not held out. A null
    text is empty: its end alone is scored. Equal rows count each. Without
    training rows every word has probability one. An empty table gives no
    rows. Only doc_id and text are read.

    score is log10 of the text's probability by the mixture, base_score that
    of add-one unigrams. The driver gets two sums, and a table of buckets
    and rounded estimates whose size does not depend on the input.
    """
    fold = crc_mod("doc_id", modulus)
    learn = F.coalesce(fold != remainder, F.lit(False))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint") + 16), F.lit(0))).first()[0]
    chunks, ranges = max(MIN_CHUNKS, -(-size // chunk_bytes)), max(4, -(-size // range_bytes))
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes("text").alias("text"), learn.alias("learn"), F.coalesce(fold == remainder, F.lit(False)).alias("held_out"),
        F.monotonically_increasing_id().alias("at"),
    )
    own = stash(own, "numbered").withColumn("chunk", F.pmod(F.xxhash64("at"), F.lit(chunks)).cast("int")).drop("at")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, m = max(least, chunks), max(least, ranges)  # tasks grow with the input
    asked = own.select("chunk", "text", "learn").repartition(n, "chunk").groupBy("chunk").applyInArrow(_ask(ranges), "chunk int, part int, n bigint, blob binary")
    answers = stash(asked.repartition(m, "part").groupBy("part").applyInArrow(_answer, "chunk int, part int, n bigint, blob binary, tokens bigint, words bigint"), "counts")
    tokens, vocabulary = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    answers = answers.where("chunk >= 0").select("chunk", "part", "n", "blob").repartition(n, "chunk")
    own = own.repartition(n, "chunk")
    cells = own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_held_out(tokens), "bucket bigint, pair bigint, word bigint, held bigint")
    cells = cells.groupBy("bucket", "pair", "word").agg(F.sum("held").alias("held")).collect()
    weights = learn_weights(sorted(tuple(r) for r in cells), vocabulary)
    found = own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(tokens, vocabulary, weights), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(tokens).cast("bigint"))
