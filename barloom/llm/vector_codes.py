"""Vector code compression with Drake and Hamerly's adaptive bounds.

Vectors become integers and are cut into parts; each part has a codebook that a few rounds
of assigning and averaging improve.  All that is decided, summed and returned are integers.

Between the rounds every part keeps, besides its entry, the b entries closest after it
with ordered lower bounds of their distances, and one outer bound for all others.  When
entries move, the bounds shrink by the moves.  The distance to the own entry is taken
anew; where it lies below all bounds the entry stays.  Otherwise only the entries whose
bounds it reaches are compared, in integers, and all of them only where it reaches the
outer bound.  Bounds are floats, rounded down; they never decide between two entries.
b follows the depth to which the bounds were used in the round before.

A round is one pass over the rows in Arrow batches, written to the shared folder, and a
sum by part and entry.  The driver holds the codebooks: entries x dimension integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import release, saved, table

#: Components from this size on are treated as if not finite: squared distances of 64 components stay below 2**63.
MOST = float(2**19)
#: b at the start, its bounds, and the share of the parts that were settled by their bounds which b is to cover.
B_START, B_LEAST, B_MOST, B_COVERS = 8, 2, 16, 0.98
#: A part's depth when all entries were compared.
ALL = 255
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9


def _lower(d: np.ndarray) -> np.ndarray:
    """Float32 below ``d``."""
    return np.nextafter((d * np.where(d > 0, _DOWN, _UP)).astype(np.float32), np.float32(-np.inf))


def all_squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, width) to the entries (k, width) of one part."""
    out = np.zeros((len(x), len(book)), dtype=np.int64)
    for a, b in zip(x.T, book.T):
        gap = a[:, None] - b[None, :]
        out += gap * gap
    return out


def settle_all(x: np.ndarray, book: np.ndarray, b: int):
    """entry, squared distance, near, low, outer of rows compared with every entry of a part; ties go to the lower index."""
    squares = all_squares(x, book)
    order = np.argsort(squares, axis=1, kind="stable")
    sorted_ = np.take_along_axis(squares, order[:, : b + 2], 1)
    low = _lower(np.sqrt(sorted_[:, 1 : b + 1].astype(np.float64)))
    outer = _lower(np.sqrt(sorted_[:, b + 1].astype(np.float64))) if len(book) > b + 1 else np.full(len(x), np.inf, np.float32)
    return order[:, 0], sorted_[:, 0], order[:, 1 : b + 1], low, outer


def settle_bounded(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, b: int):
    """The same from the bounds of the round before, after entries have moved by at most ``moved``; also the depth to which bounds were reached.

    ``b`` entries are kept for the next round: fewer than before fold into the outer
    bound, more arise where all are compared.
    """
    n, width = near.shape
    gap = x - book[entry]
    square = (gap * gap).sum(axis=1)
    reach = np.sqrt(square.astype(np.float64)) * _UP
    bounds = np.concatenate([low.astype(np.float64) - moved[near], outer.astype(np.float64)[:, None] - moved.max(initial=0.0)], axis=1)
    bounds = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]  # ordered: none above those behind it
    depth = (bounds <= reach[:, None]).sum(axis=1)
    near, bounds = near.copy(), bounds.copy()
    for z in range(1, width + 1):
        some = np.flatnonzero(depth == z)
        if not len(some):
            continue
        cand = np.concatenate([entry[some, None], near[some, :z]], axis=1)
        gap = x[some, None, :] - book[cand]
        squares = (gap * gap).sum(axis=2)
        order = np.lexsort((cand, squares), axis=-1)
        cand, squares = np.take_along_axis(cand, order, 1), np.take_along_axis(squares, order, 1)
        entry[some], square[some], near[some, :z] = cand[:, 0], squares[:, 0], cand[:, 1:]
        bounds[some, :z] = np.sqrt(squares[:, 1:].astype(np.float64)) * _DOWN
    bounds = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
    keep = min(b, width)
    new_near, new_low, new_outer = np.zeros((n, min(b, len(book) - 1)), dtype=near.dtype), np.full((n, min(b, len(book) - 1)), -np.inf, np.float32), _lower(bounds[:, keep])
    new_near[:, :keep], new_low[:, :keep] = near[:, :keep], _lower(bounds[:, :keep])
    if new_near.shape[1] > width:  # no entry is known for the places behind: they repeat the last under the outer bound
        new_near[:, width:], new_low[:, width:] = near[:, -1:] if width else entry[:, None], new_outer[:, None]
    every = np.flatnonzero(depth == width + 1)
    if len(every):
        entry[every], square[every], new_near[every], new_low[every], new_outer[every] = settle_all(x[every], book, new_near.shape[1])
    return entry, square, new_near, new_low, new_outer, np.where(depth == width + 1, ALL, depth)


_STATE = "x array<int>, code binary, near binary, low binary, outer binary, depth binary, error long"


def _cells(column: pa.Array, rows: int, dtype, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(rows, *shape)


def _assign(books: np.ndarray, moved: np.ndarray | None, b: int, width: int):
    """Batches of rows, without or with the state of the round before, to rows with their new state."""
    parts, k, size = books.shape

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(rows, parts, size)
            made = {n: [] for n in ("code", "near", "low", "outer", "depth")}
            error = np.zeros(rows, dtype=np.int64)
            if moved is not None:
                code, outer = _cells(batch.column("code"), rows, np.uint8, parts), _cells(batch.column("outer"), rows, np.float32, parts)
                near, low = _cells(batch.column("near"), rows, np.uint8, parts, width), _cells(batch.column("low"), rows, np.float32, parts, width)
            for p in range(parts):
                if moved is None:
                    found = (*settle_all(x[:, p], books[p], b), np.full(rows, ALL))
                else:
                    found = settle_bounded(x[:, p], books[p], moved[p], code[:, p].astype(np.int64), near[:, p].astype(np.int64), low[:, p], outer[:, p], b)
                error += found[1]
                for name, cells, kind in zip(made, (found[0], *found[2:]), (np.uint8, np.uint8, np.float32, np.float32, np.uint8)):
                    made[name].append(cells.astype(kind).reshape(rows, -1))
            columns = [np.concatenate(cells, axis=1) for cells in made.values()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "x")), *(pa.array([r.tobytes() for r in c], pa.binary()) for c in columns), pa.array(error)], names=["vec_id", "label", "x", *made, "error"]
            )

    return run


def _sums(parts: int, k: int, size: int):
    """Sums and counts by part, entry and place of a batch; part -1 has how many parts went to which depth."""

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(rows, parts, size)
            code, depth = _cells(batch.column("code"), rows, np.uint8, parts), _cells(batch.column("depth"), rows, np.uint8, parts)
            total, n = np.zeros((parts, k, size), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                n[p] = np.bincount(code[:, p], minlength=k)
            p, e, j = np.nonzero(np.broadcast_to(n[:, :, None] > 0, total.shape))
            deep = np.bincount(depth.ravel(), minlength=256)
            d = np.flatnonzero(deep)
            columns = [np.concatenate([p, np.full(len(d), -1)]), np.concatenate([e, d]), np.concatenate([j, np.zeros(len(d), np.int64)]), np.concatenate([total[p, e, j], np.zeros(len(d), np.int64)]), np.concatenate([n[p, e], deep[d]])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "place", "total", "n"])

    return run


def averaged(books: np.ndarray, rows: list) -> tuple[np.ndarray, dict[int, int]]:
    """Codebooks with used entries replaced by floored means, and the counts by depth."""
    out, depths = books.copy(), {}
    for r in rows:
        if r["part"] < 0:
            depths[r["entry"]] = r["n"]
        else:
            out[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out, depths


def next_b(depths: dict[int, int], b: int) -> int:
    """b for the next round: deep enough for nearly all parts that bounds settled; doubled if a tenth and more had to be compared with all entries."""
    settled = {d: n for d, n in depths.items() if d != ALL}
    total, full = sum(settled.values()), depths.get(ALL, 0)
    if not total:
        return b  # the first round compares all
    if 10 * full >= total + full:
        return min(B_MOST, 2 * b)
    need, upto = 0, 0
    for d in sorted(settled):
        need, upto = d, upto + settled[d]
        if upto >= B_COVERS * total:
            break
    return max(B_LEAST, min(B_MOST, need + 1))


def integer_vectors(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and x, the floors of the scaled components, of rows whose vector is usable."""
    v = F.col(embedding).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= MOST)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v")).where("v is not null and size(v) > 0")
    return rows.where(~F.exists("v", bad)).select("vec_id", "label", F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("x"))


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code as ``parts`` bytes, error) and the codebooks (parts, entries, width).

    Codebooks start as the vectors of the smallest ids (null ids last, ties by vector).
    Vectors that are null or empty or hold null or non-finite components are dropped, as
    are components of 2**19 and more, whose squares pass 64 bits, and vectors of another
    length than the first id's.  A length that parts do not divide is filled up with
    zeros.  Repeated rows and rows that share an id are coded each.  Fewer rows than
    entries give a smaller codebook, an empty table no rows.  Other columns are ignored,
    whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    rows = integer_vectors(vectors, scale, vec_id, embedding, label)
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    first = rows.orderBy(*order).select("x").first()
    dim = len(first["x"]) if first else parts
    rows = rows.where(F.size("x") == dim)
    if dim % parts:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), parts - dim % parts)))
    start = [r["x"] for r in rows.orderBy(*order).select("x").limit(entries).collect()]  # one codebook
    size = -(-dim // parts)
    books = np.array(start, dtype=np.int64).reshape(len(start), parts, size).transpose(1, 0, 2)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("vec_id", "label").schema)
    b = width = min(B_START, max(0, len(start) - 1))
    state = saved(rows.mapInArrow(_assign(books, None, b, width), f"{kept}, {_STATE}"))
    for _ in range(rounds):
        sums = state.select("x", "code", "depth").mapInArrow(_sums(parts, len(start), size), "part long, entry long, place long, total long, n long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # the codebooks, whatever the input
        books, before = books.copy(), books
        books, depths = averaged(books, sums)
        moved = np.sqrt(((books - before) ** 2).sum(axis=2).astype(np.float64)) * _UP
        b, width = min(next_b(depths, b), max(0, len(start) - 1)), b
        old, state = state, saved(state.mapInArrow(_assign(books, moved, b, width), f"{kept}, {_STATE}"))
        release(old)
    return state.select("vec_id", "label", "code", "error"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``: 16 parts, 64 entries, two rounds, and the error by label."""
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    by_label = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "its_label")
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("its_label")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignments to codebook k, and codebook k + 1."""
    return f"""d{k} AS (SELECT row_, c.part, e, sum((c.val - b.val) * (c.val - b.val)) AS d2 FROM c JOIN b{k} b ON b.part = c.part AND b.pos = c.pos GROUP BY 1, 2, 3),
a{k} AS (SELECT row_, part, e, d2 FROM d{k} QUALIFY row_number() OVER (PARTITION BY row_, part ORDER BY d2, e) = 1),
m{k} AS (SELECT a.part, e, pos, CAST(floor(CAST(sum(val) AS DOUBLE) / count(*)) AS BIGINT) AS val FROM a{k} a JOIN c ON c.row_ = a.row_ AND c.part = a.part GROUP BY 1, 2, 3),
b{k + 1} AS (SELECT part, e, pos, coalesce(m.val, b.val) AS val FROM b{k} b LEFT JOIN m{k} m USING (part, e, pos))"""


#: The same codes by comparing every part with every entry in every round.
ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row_, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT row_, i // (len(x) // 16) AS part, i % (len(x) // 16) AS pos, x[i + 1] AS val FROM (SELECT *, unnest(range(len(x))) AS i FROM v)),
b0 AS (SELECT part, row_ AS e, pos, val FROM c WHERE row_ < 64),
{_round_sql(0)},
{_round_sql(1)},
{_round_sql(2)},
o AS (SELECT row_, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d2) AS BIGINT) AS error FROM a2 GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, e, pos)) AS s FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM o JOIN v USING (row_), h
"""
