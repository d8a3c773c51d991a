"""Best-fit packing of token sequences by exact complements.

Only how many pieces have each length decides a packing, and there are as many lengths
as tokens in a sequence.  So the plan is made from that histogram, whatever the corpus:

1. For each length, longest first, the gap it leaves is looked up among single lengths,
   sums of two and sums of three lengths that are still available; a combination that
   fills the gap exactly is used as often as its counts allow.
2. What has no exact complement goes by best fit, longest first, again by counts.

The plan says which ranks of a length go to which sequences and where.  A piece's rank
is its number in its task plus what earlier tasks have of that length, so pieces are
placed by an equal join and a binary search; nothing is sorted or gathered.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import saved, table
from barloom.llm.tokens import ChunkTokenizer, default_tokenizer
from barloom.llm.words import row_slices


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    """Documents to pieces, each numbered in its task among those of its length."""

    def run(batches):
        tokenizer = ChunkTokenizer(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            texts = texts.fill_null("") if texts.null_count else texts
            for a, b in row_slices(texts):
                tokens, at = tokenizer.encode(texts.slice(a, b - a))
                out = defaultdict(list)
                for k in range(b - a):
                    own = np.append(tokens[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    first = (len(own) - 1) % size + 1
                    cuts = [0, *range(first, len(own) + 1, size)]
                    for piece, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        out["row"].append(a + k)
                        out["piece"].append(piece)
                        out["start"].append(x)
                        out["length"].append(y - x)
                        out["crc"].append(zlib.crc32(own[x:y]))
                        out["nth"].append(int(seen[y - x]))
                        seen[y - x] += 1
                        if with_ids:
                            out["ids"].append(own[x:y].astype(np.int64))
                columns = [ids.take(pa.array(out["row"])), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()), pa.array([task] * len(out["row"]), pa.int64()), pa.array(out["nth"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def plan_packing(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, how many such sequences), for all pieces."""
    have = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(have[x]) // n for x, n in need.items())
        for x, n in need.items():
            have[x] -= times * n
        plan.append((lengths, times))

    pair_index: dict[int, list[int]] = {}
    triple_index: dict[int, list[int]] = {}

    def two(total: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available lengths of that sum beside ``used``, the longest first.

        The index has, for each sum asked for, the shorter lengths of its pairs.  Counts
        only fall, so pairs that are used up leave it for good.
        """
        if total < 2:
            return None
        if total not in pair_index:
            short = np.arange(1, total // 2 + 1)
            pair_index[total] = short[(have[short] > 0) & (have[total - short] > 0)][::-1].tolist()
        shorts = pair_index[total]
        while shorts and not (have[shorts[-1]] > (2 * shorts[-1] == total) and have[total - shorts[-1]]):
            shorts.pop()
        for short in reversed(shorts):
            long = total - short
            if have[short] - used.count(short) > (short == long) and have[long] - used.count(long) > 0:
                return long, short
        return None

    def three(total: int, used: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Three available lengths of that sum: the index has the lengths to which a pair may be found."""
        if total not in triple_index:
            triple_index[total] = np.flatnonzero(have[: max(0, total - 1)]).tolist()
        firsts = triple_index[total]
        while firsts and not (have[firsts[-1]] and two(total - firsts[-1], ())):
            firsts.pop()
        for first in reversed(firsts):
            if have[first] - used.count(first) > 0 and (pair := two(total - first, (*used, first))):
                return (first, *pair)
        return None

    if have[size]:
        take((size,))
    left: dict[int, int] = {}
    for length in range(size - 1, 0, -1):
        while have[length]:
            gap = size - length
            found: tuple[int, ...] | None = None
            if have[gap] > (gap == length):
                found = (gap,)
            elif pair := two(gap, (length,)):
                found = pair
            else:
                found = three(gap, (length,))
            if found is None:
                left[length] = int(have[length])
                have[length] = 0
            else:
                take((length, *found))

    # Best fit: sequences with the same gap and content are counted, not listed.
    open_: dict[int, list[list]] = defaultdict(list)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            gap = min((g for g, x in open_.items() if x and g >= length), default=None)
            if gap is None:
                each = size // length
                if n >= each:
                    times, held = n // each, (length,) * each
                else:
                    times, held = 1, (length,) * n
                n -= times * len(held)
                open_[size - sum(held)].append([held, times])
            else:
                group = open_[gap][-1]
                times = min(n, group[1])
                n -= times
                group[1] -= times
                if not group[1]:
                    open_[gap].pop()
                open_[gap - length].append([(*group[0], length), times])
    plan += [(held, times) for groups in open_.values() for held, times in groups]
    return [p for p in plan if p[1]]


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted; ranks follow the plan's order."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


_RANK_BITS = 50


def _place(slots):
    def run(batches):
        rows = slots.value
        keys = (rows[:, 0] << _RANK_BITS) + rows[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << _RANK_BITS) + rank, side="right") - 1
            rest = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in rest] + [pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], names=[*rest, "sequence_id", "offset"]
            )

    return run


def pack_documents(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and ``end_id``.  Only documents of more than ``size`` ids
    are cut: the first piece has the remainder, all others ``size``.  Pieces of a
    sequence stand gapless from offset 0 and never exceed ``size``.

    Null texts count as empty: one piece, the end id alone.  Rows that repeat, also with
    the same or a null id, are packed each.  An empty table gives no rows.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids array<long>" * with_ids
    pieces = saved(docs.mapInArrow(_pieces(tokenizer or default_tokenizer(), size, end_id, with_ids), schema))
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    slots = spark.sparkContext.broadcast(slots_of(plan_packing(histogram, size)))
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth")).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "rank")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    placed = ranked.mapInArrow(_place(slots), out)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
