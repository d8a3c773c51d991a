"""Statistics of sliding windows whose cost does not grow with the window.

Rows come as Arrow batches ordered by group and time; what is computed is one vector pass
over all groups of a batch.  Sums, products and extrema combine a prefix and a suffix of
blocks as long as the window, so nothing is subtracted and no digits are lost.  Ranks count
smaller values by a wavelet matrix over the batch.  A task holds one batch and the group
that is not yet complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def _blocks(x: np.ndarray, n: int, fill) -> np.ndarray:
    out = np.full(-(-len(x) // n) * n, fill, dtype=x.dtype)
    out[: len(x)] = x
    return out.reshape(-1, n)


def _ends(size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last rows t of the windows, their first rows s, and whether a window is more than one block's beginning."""
    t = np.arange(n - 1, size)
    s = t - n + 1
    return t, s, s % n > 0


def fold(x: np.ndarray, n: int, op: np.ufunc, unit) -> np.ndarray:
    """``op`` over every run of n values, for the rows from n - 1 on."""
    t, s, split = _ends(len(x), n)
    rows = _blocks(x, n, unit)
    before = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    upto = op.accumulate(rows, axis=1).ravel()
    return np.where(split, op(before[s], upto[t]), upto[t])


def decay(x: np.ndarray, n: int) -> np.ndarray:
    """Weighted means of every run, the first value of a run with weight n, the last with 1."""
    t, s, split = _ends(len(x), n)
    rows = _blocks(x, n, 0.0)
    from_end = lambda x: np.cumsum(x[:, ::-1], axis=1)[:, ::-1].ravel()
    suffix, falling = from_end(rows), from_end(rows * np.arange(n, 0, -1))  # the latter with weight 1 at the block's end, one more each step back
    growing = np.cumsum(np.cumsum(rows, axis=1), axis=1).ravel()  # weight 1 at t, one more each step back to the block's start
    total = growing[t] + np.where(split, falling[s] + (t % n + 1) * suffix[s], 0.0)
    return total / (n * (n + 1) / 2)


def first_largest(x: np.ndarray, n: int) -> np.ndarray:
    """Place in its run of the first of the largest values."""
    t, s, _ = _ends(len(x), n)
    order = np.lexsort((-np.arange(len(x)), x))
    code = np.empty(len(x), dtype=np.int64)
    code[order] = np.arange(len(x))
    return (order[fold(code, n, np.maximum, -1)] - s).astype(np.float64)


def below_and_equal(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of codes[lo:hi] are smaller than c, and how many equal it: one step for each bit of the codes."""
    less, row = np.zeros(len(c), dtype=np.int64), codes
    for bit in range(int(codes.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (row >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - ones)])
        a, b, one = zeros[lo], zeros[hi], ((c >> bit) & 1).astype(bool)
        less += np.where(one, b - a, 0)
        lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        row = np.concatenate([row[ones == 0], row[ones == 1]])
    return less, hi - lo


def rank(x: np.ndarray, n: int) -> np.ndarray:
    """Average rank of each run's last value in the run, divided by n."""
    t, s, _ = _ends(len(x), n)
    _, codes = np.unique(x, return_inverse=True)
    less, same = below_and_equal(codes, s, t + 1, codes[t])
    return (less + (same + 1) * 0.5) / n


STATISTICS = {
    "product": lambda x, n: fold(x, n, np.multiply, 1.0), "decay": decay, "rank": rank,
    "argmax": first_largest, "argmin": lambda x, n: first_largest(-x, n),
}


def strict(op: str, x: np.ndarray, missing: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether NULL) of a statistic for every row; NULL unless n rows of the group have a value."""
    size = len(x)
    out, null = np.zeros(size), np.ones(size, dtype=bool)
    if size >= n:
        holes = np.concatenate([[0], np.cumsum(missing)])
        t = np.arange(n - 1, size)
        null[t] = (holes[t + 1] > holes[t - n + 1]) | (t - start[t] < n - 1)
        out[t] = STATISTICS[op](np.where(missing, 0.0, x), n)
    return out, null


def _added(rows: pa.Table, by: list[str], columns: list[tuple[str, str, str, int]]) -> pa.Table:
    start = np.zeros(rows.num_rows, dtype=np.int64)
    new = _begins(rows, by)
    start[new] = new
    start = np.maximum.accumulate(start)
    for name, op, of, n in columns:
        x = rows.column(of).combine_chunks()
        x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        out, null = strict(op, x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False), start, n)
        rows = rows.append_column(name, pa.array(out, mask=null))
    return rows


def _begins(rows: pa.Table, by: list[str]) -> np.ndarray:
    """Rows at which a group begins."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for c in by:
        column = rows.column(c)
        if len(column) > 1:
            here, before = column.slice(1), column.slice(0, len(column) - 1)
            differs = pc.or_kleene(pc.not_equal(here, before), pc.xor(pc.is_null(here), pc.is_null(before)))
            new[1:] |= pc.fill_null(differs, False).to_numpy()
    return np.flatnonzero(new)


def _run(by: list[str], columns: list[tuple[str, str, str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = int(_begins(rows, by)[-1]) if rows.num_rows else 0
            held = rows.slice(last)  # a group that may go on
            if last:
                yield from _added(rows.slice(0, last), by, columns).to_batches()
        if held is not None and held.num_rows:
            yield from _added(held, by, columns).to_batches()

    return run


def sliding(rows: DataFrame, by: list[str], order: str, columns: list[tuple[str, str, str, int]]) -> DataFrame:
    """``rows`` with strict sliding statistics: (name, statistic, column, n) each.

    Rows have to be dealt out by ``by`` or a part of it; they are sorted here.  Statistics
    are product, decay, rank, argmax and argmin.
    """
    schema = StructType([*rows.schema.fields, *[StructField(name, DoubleType()) for name, *_ in columns]])
    return rows.sortWithinPartitions(*by, order).mapInArrow(_run(by, columns), schema)
