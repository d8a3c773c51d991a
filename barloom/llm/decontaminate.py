"""Benchmark decontamination by winnowing.

Documents and benchmark items are split into words; the minimum k-gram hash of every
``w = window - k + 1`` consecutive k-grams is a fingerprint.  Two texts that share
``window`` words share a whole run of w k-grams, keep the same minimum of it, and so
share a fingerprint: no span of ``window`` words or more is missed.  Each fingerprint
carries the words around it, so a hit is extended to both sides right after the join,
word by word and without fetching either text again.

Documents are read once.  Fingerprints that no item has are dropped in the scan by a
bitmap of fixed size; it only saves shuffle, the join decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import bitmap_of, in_bitmap, saved, spread, winnow
from barloom.llm.words import ALNUM, U64, row_slices, signed, split_words, window_hashes

_MARK = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("at", T.LongType()),
    T.StructField("left", T.IntegerType()), T.StructField("words", T.StringType()),
])
_MARKED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("marks", T.ArrayType(_MARK)),
])
_ARROW_MARK = pa.struct([("kind", pa.int32()), ("fp", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("words", pa.string())])


def _marker(window: int, gram: int, lengths, bitmap, items: bool):
    """Arrow batches of (id, text) to rows of marks.

    kind 0 is a winnowed fingerprint; kind n is a run of n words, for items shorter
    than a window.  An item gives its one short run, a document all runs of the
    lengths that items have.
    """
    width = window - gram + 1

    def run(batches):
        context = TaskContext.get()
        row = context.partitionId() << 40
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in row_slices(texts):
                words = split_words(texts.slice(a, b - a), ALNUM, lower=True)
                counts = words.counts
                found = []
                starts, hashes = window_hashes(words, gram)
                at = winnow(hashes, np.maximum(counts - gram + 1, 0), width)
                found.append((0, starts[at], hashes[at]))
                for n in lengths:
                    starts, hashes = window_hashes(words, n)
                    if items:
                        short = counts[np.searchsorted(words.first, starts, side="right") - 1] == n
                        starts, hashes = starts[short], hashes[short]
                    found.append((n, starts, hashes ^ spread(n)))
                marks = [[] for _ in range(b - a)]
                text = words.data.tobytes()
                for kind, starts, hashes in found:
                    if bits is not None:
                        passed = in_bitmap(bits, hashes)
                        starts, hashes = starts[passed], hashes[passed]
                    docs = np.searchsorted(words.first, starts, side="right") - 1
                    first, last = words.first[docs], words.first[docs + 1]
                    lo = starts if kind else np.maximum(first, starts - (width - 1))
                    hi = starts + kind if kind else np.minimum(last, starts + gram + width - 1)
                    for d, f, s, x, y, fp in zip(docs, first, starts, lo, hi, signed(hashes)):
                        said = b" ".join(text[words.start[i] : words.end[i]] for i in range(x, y)).decode("utf-8", "surrogateescape")
                        marks[d].append({"kind": kind, "fp": fp, "at": s - f, "left": s - x, "words": said})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + b - a), pa.int64()), ids.slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(marks, pa.list_(_ARROW_MARK))],
                    names=["row", "id", "n_words", "marks"],
                )
                row += b - a

    return run


def _extend(window: int, gram: int):
    """Joined fingerprints to the span of the document that the item shares."""

    def run(batches):
        for batch in batches:
            kept, known = {"row": [], "lo": [], "hi": [], "item": []}, {}
            for x in batch.to_pylist():
                key = (x["kind"], x["words"], x["left"], x["item_words"], x["item_left"])
                if key not in known:
                    known[key] = _shared(*key, window, gram)
                if known[key]:
                    before, after = known[key]
                    kept["row"].append(x["row"])
                    kept["lo"].append(x["at"] - before)
                    kept["hi"].append(x["at"] + after)
                    kept["item"].append(x["item"])
            yield pa.RecordBatch.from_arrays([pa.array(kept[k], pa.int64()) for k in kept], names=list(kept))

    return run


def _shared(kind: int, words: str, left: int, item_words: str, item_left: int, window: int, gram: int):
    """(words before the anchor, words from it on) that both have, or None below a window."""
    if kind:
        return (0, kind) if words == item_words else None
    a, b = words.split(" "), item_words.split(" ")
    before = after = 0
    while before < min(left, item_left) and a[left - before - 1] == b[item_left - before - 1]:
        before += 1
    while left + after < len(a) and item_left + after < len(b) and a[left + after] == b[item_left + after]:
        after += 1
    return (before, after) if after >= gram and before + after >= window else None


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, spans, items.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z
    lower-cased.  A window is ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window.  A word of the document inside any occurrence
    of a window is hit; ``spans`` are the merged-free hit spans (first word, word after
    the last), ``items`` the ids of the items that have an occurring window.

    Null and empty texts have no words and no hits.  Rows that repeat are judged one by
    one.  Null item ids hit words but are not listed.  Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    known = saved(items.mapInArrow(_marker(window, gram, range(1, window), None, True), _MARKED))
    prints = known.select(F.col("id").alias("item"), F.explode("marks").alias("m")).select(
        "item", "m.kind", "m.fp", F.col("m.left").alias("item_left"), F.col("m.words").alias("item_words")
    )
    lengths = sorted(r[0] for r in prints.select("kind").distinct().collect() if r[0])  # below `window` values
    bitmap = spark.sparkContext.broadcast(bitmap_of(prints, "fp"))
    marked = saved(docs.mapInArrow(_marker(window, gram, lengths, bitmap, False), _MARKED))
    hits = (
        marked.select("row", F.explode("marks").alias("m"))
        .select("row", "m.*")
        .join(prints.distinct(), ["kind", "fp"])
        .select("row", "at", "kind", "words", "left", "item", "item_words", "item_left")
        .mapInArrow(_extend(window, gram), "row long, lo long, hi long, item long")
    )
    found = hits.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(s["lo"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["hi"]).alias("end")),
    )["n"]
    found = found.select("row", covered.alias("n_hit"), F.array_sort("spans").alias("spans"), "items")
    return marked.select("row", "id", "n_words").join(found, "row", "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract columns of :func:`decontaminate` over whole ``documents`` and ``benchmark``."""
    from barloom.llm.common import table

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same rows by plain windows.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT r, p, n, item_id FROM dw JOIN iw USING (n, s)),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
