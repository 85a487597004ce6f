"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 4 bits apart have a common variant at most 2 bits
from each. So every fingerprint stands for all its variants within 2 bits,
variants are brought together, and fingerprints that meet in a variant are
verified bit by bit and linked: a group of any size needs a star of links
only, never its pairs.

A fingerprint has 2081 such variants, nearly all of them alone. They are
dealt in two steps. The 64 bits are two halves of 32, and at least one half
of a link differs in 2 bits or fewer, so the two meet in a variant whose part
in that half is at most 1 bit from each: the shuffle is on (half, variant of
that half), 66 rows a fingerprint. The other half's variants are made only
where two fingerprints met, next to one another. Where very many met in a
half's variant, they are not held by one task: their whole variants are
shuffled, of which no more than 2081 fingerprints share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, bound_batches, records, sole, spread_join, stash
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Variants that a task holds at once while it compares one group.
VARIANTS_AT_ONCE = 4_000_000
#: Fingerprints of one half variant that a task compares by itself.
GROUP_MOST = 50_000


def fingerprints_of(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is in over half the shingles' XXH64."""
    import xxhash

    hash_of, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, raw in enumerate(texts):
        words = (raw or b"").lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            hashes.append(hash_of(b" ".join(words), SEED))
            counts[i] = 1
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = len(words) - shingle + 1
        hashes.extend([hash_of(joined[a:b], SEED) for a, b in zip(starts[:k].tolist(), ends[shingle - 1 :].tolist())])
        counts[i] = k
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    sums = np.add.reduceat(bits, np.cumsum(counts[full]) - counts[full], axis=0, dtype=np.int32)
    over = 2 * sums > counts[full][:, None]
    out[full] = np.packbits(over, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole("simhash", int)
    for whole in batches:
        for batch in blocks(whole, "text", 1 << 20):
            found = fingerprints_of(batch.column("text").to_pylist())
            yield records([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed integer)."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(_fingerprint, "doc_id bigint, fp bigint")


_ONE = np.concatenate(([0], 1 << np.arange(32, dtype=np.int64))).astype(np.uint32)
_TWO = np.unique(_ONE[:, None] ^ _ONE[None, :]).astype(np.uint32)  # 0, 1 or 2 bits: 529


def _half_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and half, the 33 variants of the half within one bit."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2_000):
            fps = whole.column("fp").slice(at, 2_000).to_numpy(zero_copy_only=False).view(np.uint64)
            low, high = (fps & np.uint64(0xFFFFFFFF)).astype(np.uint32), (fps >> np.uint64(32)).astype(np.uint32)
            keys = [half.astype(np.int64)[:, None] ^ _ONE.astype(np.int64)[None, :] | side << 32 for side, half in ((0, low), (1, high))]
            yield records([pa.array(np.concatenate([k.ravel() for k in keys])), pa.array(np.tile(np.repeat(fps.view(np.int64), 33), 2))], ["key", "fp"])


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member reachable, for members 0..n-1 and links between them."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def group_links(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that share a half's variant: at most one a member.

    fps: different fingerprints, ascending. All variants of the other half
    are made; members that meet in one are within the radius of one another.
    Variants are taken in turns by their low bits, to bound the memory.
    """
    side, part = key >> 32, np.uint32(key & 0xFFFFFFFF)
    low, high = (fps & np.uint64(0xFFFFFFFF)).astype(np.uint32), (fps >> np.uint64(32)).astype(np.uint32)
    own, other = (high, low) if side else (low, high)
    exact = own == part
    wide, narrow = np.flatnonzero(exact), np.flatnonzero(~exact)
    total = len(wide) * len(_TWO) + len(narrow) * len(_ONE)
    turns = 1 << max(0, int(np.ceil(np.log2(max(1, total / VARIANTS_AT_ONCE)))))
    left, right = [], []
    for turn in range(turns):
        values, members = [], []
        for rows, masks in ((wide, _TWO), (narrow, _ONE)):
            step = max(1, VARIANTS_AT_ONCE // len(masks))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                v = other[some][:, None] ^ masks[None, :]
                m = np.broadcast_to(some[:, None], v.shape)
                if turns > 1:
                    mine = (v & np.uint32(turns - 1)) == turn
                    values.append(v[mine]), members.append(m[mine])
                else:
                    values.append(v.ravel()), members.append(m.ravel())
        v, m = np.concatenate(values), np.concatenate(members)
        order = np.argsort(v, kind="stable")
        v, m = v[order], m[order]
        met = np.flatnonzero(v[1:] == v[:-1])
        met = met[np.bitwise_count(fps[m[met]] ^ fps[m[met + 1]]) <= RADIUS]  # verify
        pairs = np.unique(np.stack((m[met], m[met + 1]), axis=1), axis=0)
        left.append(pairs[:, 0]), right.append(pairs[:, 1])
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return fps[:0], fps[:0]
    root = _roots(len(fps), a, b)
    tied = np.flatnonzero(root != np.arange(len(fps)))
    return fps[tied], fps[root[tied]]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return starts, np.concatenate((starts[1:], [len(keys)]))


def _links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key: groups follow one another, over batch borders too.

        Gives links (a, b, null). Members of groups over `most` are passed on
        as (fingerprint, null, key).
        """
        held: list[np.ndarray] = []  # the group that may go on
        key, n, over = None, 0, False

        def settle() -> tuple[np.ndarray, np.ndarray] | None:
            return group_links(key, np.unique(np.concatenate(held))) if n > 1 and not over else None

        def rows(a: np.ndarray, b: np.ndarray | None, key: int | None) -> pa.RecordBatch:
            other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(np.full(len(a), key, np.int64))
            return records([pa.array(a.view(np.int64)), other, keys], ["a", "b", "key"])

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            found = []
            for i, j in zip(*(x.tolist() for x in _runs(keys))):
                if keys[i] != key:
                    found.append(settle())
                    held, key, n, over = [], int(keys[i]), 0, False
                held.append(fps[i:j])
                n += j - i
                if n > most:
                    over = True
                    yield rows(np.concatenate(held), None, key)
                    held = []
            found = [x for x in found if x is not None and len(x[0])]
            if found:
                yield rows(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), None)
        last = settle()
        if last is not None and len(last[0]):
            yield rows(*last, None)

    return run


def _whole_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For members of a half variant's group, all variants within two bits that have this half."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1_000):
            some = whole.slice(at, 1_000)
            keys = some.column("key").to_numpy(zero_copy_only=False)
            fps = some.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            side, part = keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint64)
            shift = np.where(side == 1, 0, 32).astype(np.uint64)  # where the other half stands
            own = fps >> (np.uint64(32) - shift) & np.uint64(0xFFFFFFFF)
            for rows, masks in ((own == part, _TWO), (own != part, _ONE)):
                if rows.any():
                    base = fps[rows] & np.uint64(0xFFFFFFFF) << shift[rows] | part[rows] << (np.uint64(32) - shift[rows])
                    v = base[:, None] ^ masks.astype(np.uint64)[None, :] << shift[rows][:, None]
                    yield records([pa.array(v.ravel().view(np.int64)), pa.array(np.repeat(fps[rows], len(masks)).view(np.int64))], ["key", "fp"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by whole variant: each fingerprint is linked to the one before that met it there."""
    last_key = last = None
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        if last_key is not None:
            keys, fps = np.concatenate(([last_key], keys)), np.concatenate((np.array([last], np.uint64), fps))
        met = np.flatnonzero(keys[1:] == keys[:-1])
        met = met[(np.bitwise_count(fps[met] ^ fps[met + 1]) <= RADIUS) & (fps[met] != fps[met + 1])]
        last_key, last = int(keys[-1]), int(fps[-1])
        if len(met):
            yield records([pa.array(fps[met].view(np.int64)), pa.array(fps[met + 1].view(np.int64))], ["a", "b"])


def links(fps: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """a, b: links between different fingerprints that connect all within RADIUS bits.

    fps: one row for each different fingerprint (fp). Not every pair is
    listed; every pair is connected.
    """
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select("fp").mapInArrow(_half_variants, "key bigint, fp bigint")
    met = stash(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links(group_most), "a bigint, b bigint, key bigint"), "met")
    found = met.where("b is not null").select("a", "b")
    large = met.where("b is null").select("key", F.col("a").alias("fp"))
    if large.limit(1).count():
        variants = large.repartition(n, "fp", "key").mapInArrow(_whole_variants, "key bigint, fp bigint")
        found = found.union(variants.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_verify, "a bigint, b bigint"))
    return found.distinct()


def _grouped(least: DataFrame, group_most: int) -> tuple[DataFrame, DataFrame]:
    """From fp, best, n (one row a fingerprint): these with their component, and the least best of each component."""
    joined = components(links(least, group_most))
    found = stash(least.join(joined, least["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "best", "n"), "grouped")
    return found, found.groupBy("component").agg(F.min("best").alias("component_best"), F.count(F.lit(1)).alias("n"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_most: int = GROUP_MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest id reachable over links of at most RADIUS
    differing bits, the row's own included. Null and empty texts have
    fingerprint zero and are linked like any other. Rows with equal
    fingerprints are one group; equal rows stay rows. A null id is passed
    over as a smallest id unless all of a group are null. An empty table
    gives no rows. Other columns are ignored. A fingerprint or a component
    that holds most rows is not gathered in one task.
    """
    rows = stash(fingerprint(docs, id_col, text_col), "fingerprints")
    least = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("best"), F.count(F.lit(1)).alias("n")), "least")
    found, ids = _grouped(least, group_most)
    classes = spread_join(found.select("fp", "component", F.col("n").alias("rows")), ids, "component", found.count())
    classes = stash(classes.select("fp", F.col("rows").alias("n"), F.col("component_best").alias("component_id")), "classes")
    whole = spread_join(rows, classes, "fp", rows.count())
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole("simhash", int)
    for whole in batches:
        for batch in blocks(whole, "text", 1 << 20):
            found = fingerprints_of(batch.column("text").to_pylist())
            yield records([batch.column("row"), batch.column("text"), pa.array(found.view(np.int64))], ["row", "text", "fp"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_most: int = GROUP_MOST) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns kept.

    Rows are told apart by a number of their own, so an id that is repeated
    over different texts, or missing, loses none. The row with the group's
    smallest id stays; rows without an id come after all others, and rows
    with equal ids are in the order of a hash of all columns, so the order
    of rows does not matter. Null and empty texts are one group. An empty
    table gives no rows.
    """
    bound_batches(docs.sparkSession)
    names = docs.columns
    # All columns but the text travel as one struct: no clash of names.
    row = F.struct(F.lit(0).alias("__pad"), *[F.col(f"`{c}`") for c in names if c != text_col])
    own = docs.select(row.alias("row"), as_bytes(text_col).alias("text"))
    found = own.mapInArrow(_fingerprint_rows, f"row {own.schema['row'].dataType.simpleString()}, text binary, fp bigint")
    held = stash(found.withColumn("at", F.monotonically_increasing_id()), "numbered")
    hashed = ["text"] if "map<" in own.schema["row"].dataType.simpleString() else ["row", "text"]
    best = F.struct(F.col(f"row.`{id_col}`").isNull().alias("late"), F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(*hashed).alias("hash"), F.col("at"))
    least = stash(held.groupBy("fp").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n")), "least")
    keep = _grouped(least, group_most)[1].select(F.col("component_best.at").alias("at"))
    text = F.col("text").cast(docs.schema[text_col].dataType)
    return held.join(keep, "at", "left_semi").select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names])
