"""Exact substring dedup with a compressed FM-index per shard.

A repeated run of ``window`` words is found in shards of bounded size instead of one
index of the corpus.  The minimum gram hash of each window picks the shard, so equal
windows always meet: the windows with one minimum form a short passage around it.

1. Minima of all documents are counted; only those of two documents go on.
2. Their passages are cut out; equal passages are folded to the smallest doc_id.
3. Where a minimum has several different passages, the shard builds an FM-index (wavelet
   matrix) of all but the passage with the largest doc_id, and streams all but the one
   with the smallest through backward search.  The matching statistic of each word is how
   much of the passage up to it stands in the index, up to ``window``; where it reaches
   the window, the suffix interval tells the smallest doc_id that has it.
4. Passages go back to all occurrences; a window with a smaller owner is removed.

A minimum with more than FP_PASSAGES different passages would be a shard that grows with
the corpus; its windows are grouped one by one instead, by 128 bits of their words.

Word ids in a shard come from 64-bit word hashes; 13 of them must agree in order.
Documents whose words are all the same are folded before step 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bitmap_of, in_bitmap, release, saved, table
from barloom.llm.fm_index import FMIndex
from barloom.llm.words import NON_SPACE, U64, mix, ragged_ranges, row_slices, run_hashes, sequence_keys, signed, split_words, window_hashes

#: Passages of a shard on average, and at most of one minimum.
SHARD_PASSAGES, FP_PASSAGES = 20_000, 2_000
#: A passage that more than one in so many rows has is joined by broadcast; there are fewer of them than this.
OFTEN = 4096


def _minima(words, window: int, gram: int):
    """Of every window: its first word and the word at which its minimum gram starts (leftmost)."""
    width = window - gram + 1
    starts, hashes = window_hashes(words, gram)
    counts = np.maximum(words.counts - gram + 1, 0)
    runs = np.maximum(counts - width + 1, 0)
    at = ragged_ranges(np.cumsum(counts) - counts, runs)  # first gram of each window
    best, least = at.copy(), hashes[at]
    for k in range(1, width):
        lower = hashes[at + k] < least
        least = np.where(lower, hashes[at + k], least)
        best = np.where(lower, at + k, best)
    return starts[at], starts[best], least


def _anchors(window: int, gram: int, bitmap=None):
    """Rows (fp, id): the distinct window minima of each document."""

    def run(batches):
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in row_slices(texts):
                words = split_words(texts.slice(a, b - a), NON_SPACE)
                _, at, fp = _minima(words, window, gram)
                first = np.ones(len(at), dtype=bool)
                first[1:] = at[1:] != at[:-1]
                at, fp = at[first], fp[first]
                if bits is not None:
                    passed = in_bitmap(bits, fp)
                    at, fp = at[passed], fp[passed]
                doc = np.searchsorted(words.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(fp)), ids.slice(a, b - a).take(pa.array(doc))], names=["fp", "id"])

    return run


def _packed(batches):
    """Rows (id, tkey, body): the text in zstd, since it is shuffled."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.binary())
        body = pa.array([pack.compress(x.as_buffer() or b"") for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tkey"), body], names=["id", "tkey", "body"])


def _keyed(batches):
    """Rows (id, tkey, k1, k2): 128 bits that stand for all words of a document."""
    for batch in batches:
        ids, tkeys, texts = (batch.column(c) for c in ("id", "tkey", "text"))
        for a, b in row_slices(texts):
            words = split_words(texts.slice(a, b - a), NON_SPACE)
            k1, k2 = (signed(k) for k in sequence_keys(words.hash, words.first[:-1], words.first[1:]))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), tkeys.slice(a, b - a), pa.array(k1), pa.array(k2)], names=["id", "tkey", "k1", "k2"])


def _unpacked(batch):
    """(first row, rows, their words) for parts of a batch that has packed texts."""
    unpack = zstandard.ZstdDecompressor()
    texts = [unpack.decompress(x) for x in batch.column("body").to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(b"".join(texts))])
    for a, b in row_slices(texts):
        yield a, b - a, split_words(texts.slice(a, b - a), NON_SPACE)


def _passages(window: int, gram: int):
    """Documents with their shared minima to the passages around them; n is the number of windows."""

    def run(batches):
        for batch in batches:
            wanted = batch.column("fps")
            for a, rows, words in _unpacked(batch):
                part = batch.slice(a, rows)
                window_at, at, fp = _minima(words, window, gram)
                first = np.ones(len(at), dtype=bool)
                first[1:] = at[1:] != at[:-1]
                heads = np.flatnonzero(first)
                tails = np.append(heads[1:], len(at)) - 1
                doc = np.searchsorted(words.first, at[heads], side="right") - 1
                lists = wanted.slice(a, rows)
                sizes = np.diff(lists.offsets.to_numpy())
                keep = np.isin(_pair_key(doc, fp[heads]), _pair_key(np.repeat(np.arange(rows), sizes), lists.flatten().to_numpy().view(U64)))
                heads, tails, doc = heads[keep], tails[keep], doc[keep]
                lo, hi = window_at[heads], window_at[tails] + window
                text = words.data.tobytes()
                said = [text[s:e] for s, e in zip(words.start[lo].tolist(), words.end[hi - 1].tolist())]
                p1, p2 = (signed(k) for k in sequence_keys(words.hash, lo, hi))
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(fp[heads])), pa.array(p1), pa.array(p2), pa.array((hi - lo - window + 1).astype(np.int32)), pa.array(said, pa.binary()), part.column("id").take(take), part.column("tkey").take(take), pa.array((lo - words.first[doc]).astype(np.int64))],
                    names=["fp", "p1", "p2", "n", "words", "id", "tkey", "at"],
                )

    return run


def _pair_key(doc: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return mix(fp + mix(doc.astype(U64)))


def _filtered(bitmap):
    """Passages whose minimum may be in the bitmap."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap.value, batch.column("fp").to_numpy().view(U64))))

    return run


def _owned(window: int):
    """One shard: its passages to the windows that a document with a smaller doc_id has."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        fp, ids = rows.column("fp").to_numpy(), rows.column("id").to_numpy()
        order = np.lexsort((ids, fp))
        new = np.append(True, fp[order][1:] != fp[order][:-1])
        first, last = order[new], order[np.append(new[1:], True)]
        indexed, streamed = np.ones(len(fp), dtype=bool), np.ones(len(fp), dtype=bool)
        indexed[last], streamed[first] = False, False
        words = split_words(rows.column("words"), NON_SPACE)
        values, at = signed(words.hash), words.first
        text, count = _laid_out(values, at, np.flatnonzero(indexed))
        known = np.unique(text[text != 0])
        index = FMIndex(np.where(text == 0, 0, np.searchsorted(known, text) + 1), window, np.repeat(ids[indexed], count + 1))
        queries = np.flatnonzero(streamed)
        for a in range(0, len(queries), 4096):
            some = queries[a : a + 4096]
            text, count = _laid_out(values, at, some)
            code = np.minimum(np.searchsorted(known, text), len(known) - 1)
            symbols = np.where(text == 0, 0, np.where(known[code] == text, code + 1, len(known) + 1))
            begin = np.cumsum(count + 1) - count - 1
            windows = count - window + 1
            ends = ragged_ranges(begin + window, windows)
            length, low, _ = index.search(symbols, ends, window)
            row = np.repeat(np.arange(len(some)), windows)
            hit = np.flatnonzero(length >= window)
            hit = hit[index.least_of(low[hit]) < ids[some][row[hit]]]
            found = np.bincount(row[hit], minlength=len(some))
            offsets = np.concatenate([[0], np.cumsum(found)]).astype(np.int32)
            starts = ends[hit] - window - begin[row[hit]]
            out = rows.select(["fp", "p1", "p2"]).take(pa.array(some)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(starts.astype(np.int32)))], names=["fp", "p1", "p2", "windows"])

    return run


def _laid_out(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of some passages, 0 after each, and how many each has."""
    count = at[which + 1] - at[which]
    text = np.zeros(int(count.sum()) + len(which), dtype=np.int64)
    word = values[ragged_ranges(at[which], count)]
    text[ragged_ranges(np.cumsum(count + 1) - count - 1, count)] = np.where(word == 0, 1, word)
    return text, count


def _windows(window: int):
    """Passages to their windows, each by 128 bits of its words."""

    def run(batches):
        for batch in batches:
            words = split_words(batch.column("words"), NON_SPACE)
            hashes, at = words.hash, words.first
            sizes = np.maximum(np.diff(at) - window + 1, 0)
            lo = ragged_ranges(at[:-1], sizes)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            w1, w2 = (signed(run_hashes(hashes, window, salt)[lo]) for salt in (1, 2))
            part = batch.select(["fp", "p1", "p2", "id"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array((lo - at[row]).astype(np.int32)), pa.array(w1), pa.array(w2)], names=["fp", "p1", "p2", "id", "at", "w1", "w2"])

    return run


def _owned_windows(distinct: DataFrame, window: int) -> DataFrame:
    """What :func:`_owned` finds, without shards: a grouped minimum per window, combined before the shuffle."""
    windows = saved(distinct.select("fp", "p1", "p2", "id", "words").mapInArrow(_windows(window), "fp long, p1 long, p2 long, id long, at int, w1 long, w2 long"))
    least = windows.groupBy("w1", "w2").agg(F.min("id").alias("owner"))
    owned = windows.join(least, ["w1", "w2"]).where("owner < id")
    return owned.groupBy("fp", "p1", "p2").agg(F.sort_array(F.collect_list("at")).alias("windows"))


def _often(known: DataFrame, rows: int, parts: int) -> DataFrame:
    """The passages that so many of all rows have that a task of the join would be uneven, up to a thousand tasks or the ``parts`` there are."""
    return known.where(F.col("copies") * F.lit(max(OFTEN, 4 * parts)) > F.lit(rows))


def _cut(window: int):
    """Documents and their owned windows to what is left of them."""

    def run(batches):
        for batch in batches:
            for a, rows, words in _unpacked(batch):
                part = batch.slice(a, rows)
                copied = part.column("copied").fill_null(False).to_numpy(zero_copy_only=False) & (words.counts >= window)
                finds = part.column("finds")
                find, of = finds.flatten(), np.repeat(np.arange(rows), finds.value_lengths().fill_null(0).to_numpy())
                lists = find.field("windows")
                base = words.first[of] + find.field("at").to_numpy()
                at = np.repeat(base, lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()
                total = len(words.hash) + 1
                steps = np.bincount(at, minlength=total) - np.bincount(at + window, minlength=total)
                np.add.at(steps, words.first[:-1][copied], 1)
                np.add.at(steps, words.first[1:][copied], -1)
                gone = np.cumsum(steps)[:-1] > 0
                kept = _joined(words, ~gone)
                count = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words.counts.astype(np.int64)), pa.array(count[words.first[1:]] - count[words.first[:-1]]), kept], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def _joined(words, kept: np.ndarray) -> pa.Array:
    """The kept words of each document, with one space between them."""
    at = np.flatnonzero(kept)
    doc = np.searchsorted(words.first, at, side="right") - 1
    inside = np.zeros(len(words.data) + 1, dtype=np.int8)
    inside[words.start[at]] += 1
    inside[words.end[at]] -= 1
    mask = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    follows = at[:-1][doc[1:] == doc[:-1]]  # words behind which another kept one of the document stands
    data = words.data.copy()
    data[words.end[follows]] = 0x20
    mask[words.end[follows]] = True
    offsets = np.concatenate([[0], np.cumsum(mask)])[words.text_at]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[mask])])


def dedup_substrings(docs: DataFrame, window: int = 13, gram: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (words joined by a space).

    Words are runs of anything but space and 0x09-0x0D, unchanged.  A word is removed if
    it is covered by a window of ``window`` words whose sequence also starts in a
    document with a smaller doc_id; windows are judged on the input.

    Null and empty texts have no words.  A text of fewer words than a window keeps all.
    Equal doc_ids never remove each other's words, so repeated rows stay alike.  A row
    with a null id loses nothing and removes nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("tkey"), "text")
    named = docs.where("id is not null")
    rows = saved(named.mapInArrow(_keyed, "id long, tkey long, k1 long, k2 long"))
    first = rows.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copies = saved(rows.join(first.where("rep < last"), ["k1", "k2"]).where("id > rep").select("id", "tkey").distinct())
    release(rows)

    anchors = named.select("id", "text")
    shared = anchors.mapInArrow(_anchors(window, gram), "fp long, id long").groupBy("fp").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    shared = saved(shared.where("a < b").select("fp"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(shared, "fp"))
    lists = anchors.mapInArrow(_anchors(window, gram, bitmap), "fp long, id long").join(shared, "fp").groupBy("id").agg(F.collect_set("fp").alias("fps"))

    packed = docs.mapInArrow(_packed, "id long, tkey long, body binary")
    passages = packed.join(lists, "id").join(copies, ["id", "tkey"], "left_anti").select("id", "tkey", "body", "fps")
    passages = saved(passages.mapInArrow(_passages(window, gram), "fp long, p1 long, p2 long, n int, words binary, id long, tkey long, at long"))
    release(shared)

    key = ["fp", "p1", "p2"]
    firsts = saved(passages.groupBy(*key).agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("copies")))
    several = saved(firsts.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(several, "fp"))
    texts = passages.select(*key, "id", "words").mapInArrow(_filtered(bitmap), "fp long, p1 long, p2 long, id long, words binary")
    distinct = saved(texts.join(several, "fp").groupBy(*key, "c").agg(F.min("id").alias("id"), F.first("words").alias("words")))
    shards = max(1, -(-distinct.count() // SHARD_PASSAGES))
    owned = distinct.where(F.col("c") <= FP_PASSAGES).repartition(shards, "fp").mapInArrow(_owned(window), "fp long, p1 long, p2 long, windows array<int>")
    frequent = distinct.where(F.col("c") > FP_PASSAGES)
    if not frequent.isEmpty():
        owned = owned.union(_owned_windows(frequent, window))
    owned = saved(owned.where(F.size("windows") > 0))
    release(distinct)

    # A passage that very many documents have would be one task of the join.
    known = firsts.join(owned, key, "left")
    often = _often(known, passages.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    often = saved(often.select(*key, F.struct("pid", "windows").alias("often")))
    tried = passages.select(*key, "n", "id", "tkey", "at").join(F.broadcast(often), key, "left")
    marked = tried.where("often is null").drop("often").join(known.select(*key, "pid", "windows"), key)
    marked = marked.unionByName(tried.where("often is not null").select(*key, "n", "id", "tkey", "at", "often.pid", "often.windows"))
    windows = F.when(F.col("id") > F.col("pid"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.col("windows"))
    finds = marked.select("id", "tkey", F.struct("at", windows.alias("windows")).alias("find")).where("find.windows is not null").groupBy("id", "tkey").agg(F.collect_set("find").alias("finds"))
    marks = finds.withColumn("copied", F.lit(False)).unionByName(copies.select("id", "tkey", F.lit(None).cast(finds.schema["finds"].dataType).alias("finds"), F.lit(True).alias("copied")))
    marks = saved(marks)
    release(passages, firsts, several, owned, often)
    return packed.join(marks, ["id", "tkey"], "left").select("id", "body", "copied", "finds").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract columns of :func:`dedup_substrings` over whole ``documents``."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows by joining all windows.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS o FROM x GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS q FROM x JOIN m USING (s) WHERE o < doc_id),
g AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(generate_series(1, len(w)), lambda q: NOT list_contains(gone, q)), lambda q: w[q]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
