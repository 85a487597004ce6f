"""Best-fit packing of documents into sequences of bounded length.

Bulk-synchronous best fit, longest pieces first. Pieces and gaps are rows.
Pieces are gone through in bands of length, each a quarter of the one before.
A round range-sorts a band's pieces and the gaps that may hold one together,
by falling size, gaps before pieces. Every task sweeps its range: a piece's
successor is the smallest gap of the range that holds it, so of pieces that
want the same gap the first by rank gets it; the gap goes on with what is left
of it. Pieces and gaps that a range leaves are matched over the ranges by
their counts, each piece with the last gap before. Gaps shrink by what they
took, and the round is repeated with the pieces that are left; where gaps hold
no more, as many sequences are opened as those pieces need at least. The
driver sees counts by range and by band only.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, blocks, bound_batches, records, sole, stash
from .wordcodes import default_tokenizer, encoder

MAX_TOKENS = 2048
#: Rows that a task of a round sweeps.
ROWS_A_TASK = 100_000
#: A round that places a smaller share of the pieces is followed by opening sequences.
STALL = 0.02


def _pieces(tokenizer: str, end_id: int, max_tokens: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for whole in batches:
            for batch in blocks(whole, "text", 2 << 20):
                out: list[tuple] = []
                for doc, found in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist())):
                    ids = found + tail
                    for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                        part = ids[at : at + 4 * max_tokens]
                        out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                if out:
                    cols = list(zip(*out))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield records([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; only documents over max_tokens are cut."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(
        _pieces(tokenizer or default_tokenizer(), end_id, max_tokens), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def bands(max_tokens: int) -> list[tuple[int, int]]:
    """(largest, next smaller band's largest) length of each band."""
    edges = [max_tokens, max_tokens // 2]
    while edges[-1]:
        edges.append(edges[-1] // 4)
    return list(zip(edges, edges[1:]))


_SWEPT = "kind int, part int, pos bigint, rank bigint, length bigint, seq bigint, slot int"
_MATCHED, _PIECE, _GAP = 0, 1, 2


def _rows(kind: int, part: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (pos, rank, length, seq, slot)."""
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    head = [pa.array(np.full(len(rows), x, np.int32)) for x in (kind, part)]
    return records(head + [pa.array(c, k) for c, k in zip(cols, kinds)], ["kind", "part", "pos", "rank", "length", "seq", "slot"])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, kind, a, b) by falling size: each piece takes the smallest gap that holds it, what is left of it stays.

    Gaps are (seq, slot), pieces (rank, 0). Pieces that found none are
    numbered in order; so are the gaps that hold any piece of the ranges
    after, from the largest.
    """
    sole("packing", int)  # the tokenizer's dictionaries are not needed any more
    part = TaskContext.get().partitionId()
    free: list[tuple[int, int, int]] = []  # ascending: size, seq, slot
    n, least = 0, 0
    for batch in batches:
        matched, alone = [], []
        for size, kind, a, b in zip(*(batch.column(c).to_pylist() for c in ("size", "kind", "a", "b"))):
            if kind == _GAP:
                bisect.insort(free, (size, a, b))
            else:
                at = bisect.bisect_left(free, (size,))
                if at < len(free):
                    room, seq, slot = free.pop(at)
                    matched.append((None, a, size, seq, slot))
                    if room > size:
                        bisect.insort(free, (room - size, seq, slot))
                else:
                    alone.append((n, a, size, None, None))
                    n += 1
            least = size
        if matched:
            yield _rows(_MATCHED, part, matched)
        if alone:
            yield _rows(_PIECE, part, alone)
    left = free[bisect.bisect_left(free, (least,)) :][::-1]
    for at in range(0, len(left), ROWS_A_TASK):
        yield _rows(_GAP, part, [(at + i, None, None, seq, slot) for i, (_, seq, slot) in enumerate(left[at : at + ROWS_A_TASK])])


def meet(sums: list[tuple[int, int, int]]) -> tuple[dict, dict, int]:
    """Which left pieces and gaps of the ranges meet: from (range, pieces, gaps) in order of falling size.

    A range's pieces take the last gaps of the ranges before that are free.
    Gives for each range intervals (first, end, number of the first's match)
    of pieces, the same of gaps (numbers fall there), and how many meet.
    """
    stack: list[tuple[int, int]] = []
    pieces, gaps, met = {}, {}, 0
    for part, n, m in sums:
        at = 0
        while at < n and stack:
            other, top = stack.pop()
            k = min(n - at, top)
            pieces.setdefault(part, []).append((at, at + k, met))
            gaps.setdefault(other, []).append((top - k, top, met + k - 1))
            met, at = met + k, at + k
            if top > k:
                stack.append((other, top - k))
        if m:
            stack.append((part, m))
    return pieces, {part: own[::-1] for part, own in gaps.items()}, met


def _carry(pieces: dict, gaps: dict):
    """Adds met, the number of the match over ranges, to the rows that the sweeps left; null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, part, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "part", "pos"))
            met = np.full(len(kind), -1, np.int64)
            for k, plan, step in ((_PIECE, pieces, 1), (_GAP, gaps, -1)):
                for p in np.unique(part[kind == k]).tolist():
                    if p in plan:
                        first, end, number = np.array(plan[p], np.int64).T
                        own = np.flatnonzero((kind == k) & (part == p))
                        at = np.searchsorted(first, pos[own], side="right") - 1
                        good = (at >= 0) & (pos[own] < end[at])
                        own, at = own[good], at[good]
                        met[own] = number[at] + step * (pos[own] - first[at])
            yield records([pa.array(met, mask=met < 0), *(batch.column(c) for c in ("kind", "rank", "length", "seq", "slot"))], ["met", "kind", "rank", "length", "seq", "slot"])

    return run


def _place(ranked: DataFrame, max_tokens: int) -> DataFrame:
    """seq, turn, slot, rank, length: the sequence of each piece, with its turn and slot there."""
    spark = ranked.sparkSession
    edges = bands(max_tokens)
    band = F.lit(0)
    for k, (_, low) in enumerate(edges):
        band = F.when(F.col("length") <= low, k + 1).otherwise(band)
    sizes = {r[0]: (r[1], r[2]) for r in ranked.groupBy(band).agg(F.count(F.lit(1)), F.sum("length")).collect()}
    # Over half a sequence: no two fit together, each opens its own.
    own = ranked.where(F.col("length") > max_tokens // 2)
    placed = [own.select(F.col("rank").alias("seq"), F.lit(-1).alias("turn"), F.lit(0).alias("slot"), "rank", "length")]
    gaps = own.where(F.col("length") < max_tokens).select(F.col("rank").alias("seq"), (max_tokens - F.col("length")).alias("free"))
    opened = 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k, (high, low) in enumerate(edges[1:], 1):
        count, tokens = sizes.get(k, (0, 0))
        left = ranked.where((F.col("length") <= high) & (F.col("length") > low)).select("rank", "length")
        most = max_tokens // (low + 1)  # pieces of this band in a sequence
        first, stalled, turns = True, False, []
        while count:
            room = (0, 0, 0)
            if first:
                room = gaps.where(F.col("free") > low).agg(F.count(F.lit(1)), F.coalesce(F.sum("free"), F.lit(0)), F.coalesce(F.sum(F.floor(F.col("free") / (low + 1))), F.lit(0))).first()
                usable = room[0]
            if first or stalled:
                held = 0 if first else sum(t.agg(F.coalesce(F.sum("got"), F.lit(0))).first()[0] for t in turns)
                new = max(int(stalled), -(-(tokens - held - room[1]) // max_tokens), -(-(count - room[2]) // most))
                if new:
                    gaps = gaps.union(spark.range(new).select((-1 - opened - F.col("id")).alias("seq"), F.lit(max_tokens).cast("bigint").alias("free")))
                    opened, usable = opened + new, usable + new
            # A gap is several where each holds any piece of the band, so that ranges share it; no more than can be needed.
            several = F.floor(F.col("free") / high)
            offered = F.greatest(F.lit(1), F.when(F.col("free") == max_tokens, several).otherwise(F.least(several, F.lit(-(-4 * count // max(1, usable)))))).cast("int")
            slots = gaps.where(F.col("free") > low).select("seq", "free", offered.alias("k"), F.explode(F.sequence(F.lit(0), offered - 1)).alias("slot"))
            slots = slots.select("seq", "slot", F.when(F.col("slot") < F.col("k") - 1, F.lit(high).cast("bigint")).otherwise(F.col("free") - high * (F.col("k") - 1)).alias("size"))
            both = slots.select("size", F.lit(-_GAP).alias("kind"), F.col("seq").alias("a"), F.col("slot").alias("b")).union(left.select("length", F.lit(_PIECE), "rank", F.lit(0)))
            order = [F.col("size").desc(), F.col("kind").asc(), F.col("a").asc(), F.col("b").asc()]
            n = max(1, min(tasks, -(-(count + usable) // ROWS_A_TASK)))
            together = (lambda df: df.coalesce(1)) if n == 1 else (lambda df: df)  # a range that one task sweeps needs no shuffle
            dealt = together(both) if n == 1 else both.repartitionByRange(n, *order)
            swept = stash(dealt.sortWithinPartitions(*order).withColumn("kind", F.abs("kind")).mapInArrow(_sweep, _SWEPT), "swept")
            kinds = together(swept).groupBy("part").agg(*[F.sum((F.col("kind") == x).cast("bigint")) for x in (_PIECE, _GAP, _MATCHED)]).collect()
            pieces, open_gaps, met = meet(sorted((r[0], r[1], r[2]) for r in kinds))
            rest = swept.where(F.col("kind") != _MATCHED).mapInArrow(_carry(pieces, open_gaps), "met bigint, kind int, rank bigint, length bigint, seq bigint, slot int")
            taken = swept.where(F.col("kind") == _MATCHED).select("seq", "slot", "rank", "length")
            if met:
                pairs = rest.where("met is not null").groupBy("met").agg(*[F.max(c).alias(c) for c in ("seq", "slot", "rank", "length")])
                taken = taken.union(pairs.select("seq", "slot", "rank", "length"))
            place = F.struct("slot", "rank", "length")
            rows = gaps.select("seq", "free", F.lit(None).cast("struct<slot:int,rank:bigint,length:bigint>").alias("p")).union(taken.select("seq", F.lit(None).cast("bigint"), place))
            turn = together(rows).groupBy("seq").agg(F.max("free").alias("free"), F.coalesce(F.sum("p.length"), F.lit(0)).alias("got"), F.collect_list("p").alias("places"))  # max_tokens places at most
            turn = stash(turn, "turn")
            turns.append(turn)
            placed.append(turn.where("got > 0").select("seq", F.lit(len(placed)).alias("turn"), F.explode("places").alias("p")).select("seq", "turn", "p.slot", "p.rank", "p.length"))
            gaps = turn.where(F.col("free") > F.col("got")).select("seq", (F.col("free") - F.col("got")).alias("free"))
            left = rest.where((F.col("kind") == _PIECE) & F.col("met").isNull()).select("rank", "length")
            done = met + sum(r[3] for r in kinds)
            stalled, count, first = done < STALL * count + 1, count - done, False
    whole = placed[0]
    for p in placed[1:]:
        whole = whole.union(p)
    return whole


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A null or empty text is its end id alone. Rows that share an id, or are
    equal in all columns, are packed each. An empty table gives no rows.
    Other columns are ignored. What reaches the driver: counts for each range
    of a round, and for each band of lengths.
    """
    spark = docs.sparkSession
    found = stash(pieces(docs, tokenizer, end_id, max_tokens, id_col, text_col), "pieces")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("piece").asc()]
    ranked = stash(found.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "ranked")
    spots = _place(ranked.select("rank", "length"), max_tokens)
    before = Window.partitionBy("seq").orderBy("turn", "slot", "rank").rowsBetween(Window.unboundedPreceding, -1)  # max_tokens rows at most
    spots = spots.select(F.col("rank").alias("r"), F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return ranked.join(spots, F.col("rank") == F.col("r")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
