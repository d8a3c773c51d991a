"""Near-duplicate groups by HyperMinHash.

Sketch.  A document's set of word shingles is hashed into 128 buckets.  A bucket keeps
the least hash in it as a compressed register: 6 bits for its leading zeros and 10
mantissa bits (Yu and Weber 2017).  Empty buckets borrow from full ones by fixed random
probes, the same for all documents, so that two registers agree with probability J
also for short texts.

Candidates.  Bands of 4 registers are hashed; documents that agree in one of the 32
bands meet.  At a similarity of 0.75 a pair misses all bands with probability 5e-6.

Verification.  Documents that meet are put into chunks of bounded size, and pairs of
chunks that share a band are compared in blocks: the collision-corrected estimate
drops hopeless pairs, the full shingle sets decide the others.  A block returns only
the links that join two of its groups, never all pairs; no group has a cap.

Exact copies of a set are folded into one class first, with a combined minimum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import connected_components, saved, table
from barloom.llm.words import NON_SPACE, U64, Words, mix, ragged_ranges, row_slices, sequence_keys, signed, split_words, window_hashes

BUCKETS, ROWS = 128, 4
MANTISSA = 10
_EMPTY = np.uint16(0xFFFF)
#: Chance that registers of different hashes agree: sum of 4**-(z + 1) over leading zeros z, times 2**-10.
COLLISION = 1 / 3 / 2**MANTISSA
#: Estimates this far below the threshold (five standard errors) are not verified.
SLACK = 0.2
CHUNK_SHINGLES, CHUNK_DOCS = 1 << 16, 256

_probe_rng = np.random.Generator(np.random.PCG64(7))
_PROBES = _probe_rng.integers(0, BUCKETS, size=(64, BUCKETS))
_WALK = _probe_rng.permutation(BUCKETS)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and their counts."""
    starts, hashes = window_hashes(words, n)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    first, last = words.first[short], words.first[short + 1]
    doc = np.concatenate([np.searchsorted(words.first, starts, side="right") - 1, short])
    hashes = np.concatenate([hashes, sequence_keys(words.hash, first, last)[0]])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(counts)).astype(np.int64)


def registers(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, one row of 128 for each set; sets must not be empty."""
    docs = len(counts)
    x = mix(hashes ^ U64(0xA0761D6478BD642F))
    at = np.repeat(np.arange(docs), counts) * BUCKETS + (x >> U64(57)).astype(np.int64)
    rest = x & U64((1 << 57) - 1)
    least = np.full(docs * BUCKETS, (1 << 57) - 1, dtype=U64)
    np.minimum.at(least, at, rest)
    full = np.zeros(docs * BUCKETS, dtype=bool)
    full[at] = True
    length = np.frexp(np.maximum(least, U64(1)).astype(np.float64))[1].astype(np.int64)  # bits below the leading zeros
    length = np.where(least >> np.maximum(length - 1, 0).astype(U64) == 0, length - 1, length)  # rounding up to a power of two
    zeros = np.minimum(57 - length, 62)
    tail = length - 1 - MANTISSA
    mantissa = np.where(tail >= 0, least >> np.maximum(tail, 0).astype(U64), least << np.maximum(-tail, 0).astype(U64)) & U64((1 << MANTISSA) - 1)
    packed = ((zeros.astype(U64) << U64(MANTISSA)) | mantissa).astype(np.uint16)
    packed[~full] = _EMPTY
    packed = packed.reshape(docs, BUCKETS)
    out, empty = packed.copy(), packed == _EMPTY
    for probes in [*_PROBES, *(np.roll(_WALK, k) for k in range(BUCKETS))]:
        if not empty.any():
            break
        row, col = np.nonzero(empty)
        got = packed[row, probes[col]]
        out[row, col] = got
        empty[row, col] = got == _EMPTY
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of register rows, corrected for chance agreement."""
    return np.maximum((a == b).mean(axis=-1) - COLLISION, 0) / (1 - COLLISION)


def _sketch(shingle: int):
    def run(batches):
        for batch in batches:
            ids, tkeys, texts = (batch.column(c) for c in ("id", "tkey", "text"))
            for a, b in row_slices(texts):
                hashes, counts = shingle_sets(split_words(texts.slice(a, b - a), NON_SPACE, lower=True), shingle)
                ends = np.cumsum(counts)
                keys = [signed(k) for k in sequence_keys(hashes, ends - counts, ends)]
                some = np.flatnonzero(counts)
                rows = [None] * (b - a)
                for k, packed in zip(some, registers(hashes, counts[some])):
                    rows[k] = packed.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), tkeys.slice(a, b - a), pa.array(counts), pa.array(keys[0]), pa.array(keys[1]), pa.array(rows, pa.binary())], names=["id", "tkey", "n", "k1", "k2", "regs"])

    return run


def _full_sets(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in row_slices(texts):
                hashes, counts = shingle_sets(split_words(texts.slice(a, b - a), NON_SPACE, lower=True), shingle)
                ends = np.cumsum(counts)
                sets = [hashes[e - c : e].tobytes() for e, c in zip(ends, counts)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("chunk"), part.column("rep"), part.column("regs"), pa.array(sets, pa.binary())], names=["chunk", "rep", "regs", "shingles"])

    return run


def _verify(percent: int):
    """Blocks (members of one chunk, or of two) to links that join groups of the block."""

    def run(batches):
        for batch in batches:
            u, v = [], []
            for k in range(batch.num_rows):
                left = batch.column("left")[k].values
                right = batch.column("right")[k].values if batch.column("right")[k].is_valid else None
                links = block_links(left, right, percent)
                u += [x for x, _ in links]
                v += [y for _, y in links]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def block_links(left: pa.StructArray, right: pa.StructArray | None, percent: int) -> list[tuple[int, int]]:
    parts = [left] if right is None else [left, right]
    reps = np.concatenate([p.field("rep").to_numpy() for p in parts])
    regs = np.frombuffer(b"".join(x for p in parts for x in p.field("regs").to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
    sets = [np.frombuffer(x, dtype=U64) for p in parts for x in p.field("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    inner = len(left)
    bands = np.ascontiguousarray(regs).view(np.uint64)  # four registers of 16 bits are one band
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    group = np.arange(len(reps))
    flag = np.zeros(int(code.max()) + 1, dtype=np.int64)
    links = []
    for i in range(inner):
        others = np.arange(i + 1, len(reps)) if right is None else np.arange(inner, len(reps))
        others = others[group[others] != group[i]]
        if not len(others):
            continue
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * low >= percent * high]
        others = others[(bands[others] == bands[i]).any(axis=1)]
        others = others[estimate(regs[others], regs[i]) >= percent / 100 - SLACK]
        if not len(others):
            continue
        flag[code[starts[i] : ends[i]]] = 1
        shared = np.add.reduceat(flag[code[ragged_ranges(starts[others], sizes[others])]], np.cumsum(sizes[others]) - sizes[others])
        flag[code[starts[i] : ends[i]]] = 0
        union = sizes[i] + sizes[others] - shared
        for j in others[100 * shared >= percent * union]:
            if group[j] != group[i]:
                links.append((int(max(reps[i], reps[j])), int(min(reps[i], reps[j]))))
                group[group == group[j]] = group[i]
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but space and 0x09-0x0D, with A-Z lower-cased.  A text of
    fewer than ``shingle`` words has its whole sequence as the only shingle.  Documents
    link if 100 * intersection >= percent * union; component_id is the smallest doc_id
    that links reach, kept is doc_id = component_id.

    Null and empty texts have no shingles, link with nothing and are kept.  Rows that
    repeat share a class.  Rows that share only the id are judged each by its own text.
    A null id is its own component and links nothing.  Other columns are ignored,
    whatever their names.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("tkey"), "text")
    sketched = saved(docs.mapInArrow(_sketch(shingle), "id long, tkey long, n long, k1 long, k2 long, regs binary"))
    usable = sketched.where("n > 0 and id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min(F.struct("id", "tkey")).alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "least.id", "least.tkey", "n", "regs"))  # numbers that stay, as they are written
    component = saved(connected_components(_links(docs, classes, shingle, percent)).withColumnRenamed("node", "rep"))
    least = component.join(classes.select("rep", "id"), "rep").groupBy("component").agg(F.min("id").alias("least"))
    linked = component.join(least, "component").select("rep", "least")
    root = classes.select("rep", "k1", "k2", "id").join(linked, "rep", "left").select("k1", "k2", F.coalesce("least", "id").alias("component_id"))
    found = usable.select("id", "n", "k1", "k2").join(root, ["k1", "k2"]).select("id", "n", "component_id")
    alone = sketched.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return found.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // ROWS - 1)), lambda i: F.substring(F.col("regs"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = classes.select("rep", band.alias("band", "part")).select(F.xxhash64("band", "part").alias("key"), "rep")
    buckets = bands.groupBy("key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "center")
    members = saved(bands.join(buckets, "key"))

    # Chunks of bounded size; documents with the same smallest partner lie together.
    anchors = members.groupBy("rep").agg(F.min("center").alias("anchor")).join(classes.select("rep", "n"), "rep")
    sizes = anchors.groupBy("anchor").agg(F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), F.ceil(F.count(F.lit(1)) / CHUNK_DOCS)).alias("chunks"))
    placed = saved(anchors.join(sizes, "anchor").select("rep", F.xxhash64("anchor", F.pmod(F.xxhash64("rep"), "chunks")).alias("chunk")))

    wanted = placed.join(classes.select("rep", "id", "tkey", "regs"), "rep")
    texts = docs.join(wanted.hint("shuffle_hash"), ["id", "tkey"]).select("chunk", "rep", "regs", "text")
    full = texts.mapInArrow(_full_sets(shingle), "chunk long, rep long, regs binary, shingles binary").groupBy("chunk", "rep").agg(F.first("regs").alias("regs"), F.first("shingles").alias("shingles"))  # rows that repeat
    chunks = saved(full.groupBy("chunk").agg(F.collect_list(F.struct("rep", "regs", "shingles")).alias("members")))

    shared = members.select("key", "rep").join(placed, "rep").groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("c"))
    shared = shared.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", "c"))).alias("all"))
    pairs = shared.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.chunk < b.chunk or (a.chunk = b.chunk and a.c > 1)")
    pairs = pairs.select(F.col("a.chunk").alias("i"), F.col("b.chunk").alias("j")).distinct()
    within = pairs.where("i = j").join(chunks, F.col("i") == F.col("chunk")).select(F.col("members").alias("left"), F.lit(None).cast(chunks.schema["members"].dataType).alias("right"))
    across = (
        pairs.where("i < j").join(chunks.select(F.col("chunk").alias("i"), F.col("members").alias("left")), "i")
        .join(chunks.select(F.col("chunk").alias("j"), F.col("members").alias("right")), "j").select("left", "right")
    )
    return within.union(across).mapInArrow(_verify(percent), "u long, v long")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of whole ``documents``: five words, similarity 0.75."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same groups by joining all shingles.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
