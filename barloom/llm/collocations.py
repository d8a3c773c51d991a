"""Phrase collocations by marginalising the longest windows.

Every word of a piece leads one window of the longest phrase's length, padded at the
piece's end.  Only these windows are counted: a ROLLUP over their columns sums ever
shorter prefixes, and as each occurrence of a phrase leads exactly one window, the sum of
a prefix is the phrase's count.  The roll-up gives the words of a language, the counts of
single words and those of all phrases in one aggregation.

A window may end early without changing any count that matters, namely before a pair of
words that is rarer than a phrase has to be.  Such pairs are told by a bitmap of hashes
with a fixed largest size.  It is a filter only: a collision lets a window run on, and
what is too rare falls to the exact count.  The same holds for
triples of words, which are looked at where both of their pairs passed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import bitmap_of, in_bitmap, release, saved, table
from barloom.llm.words import _STEP, U64, Words, _byte_class, mix, ragged_ranges, row_slices, signed, split_words

#: What ends a piece, and what stands between its words.
BREAKS = _byte_class((0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
WORD = ~(BREAKS | _byte_class((0x20, 0x20), (0x09, 0x09)))
#: Text of one vector pass that counts hashes, and of one that makes windows; what is counted is pre-counted within it.
SLICE_BYTES, WINDOW_BYTES = 1 << 22, 1 << 20
#: Bits of the filter for each frequent word or pair, and its bounds: 128 kB and 32 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 28


def _slices(batches, most_bytes: int = SLICE_BYTES):
    """(language codes by word, language names, words, whether a word follows its neighbour in one piece, hashes with the language)."""
    for batch in batches:
        langs, texts = batch.column("lang"), batch.column("text")
        for a, b in row_slices(texts, most_bytes):
            words = split_words(texts.slice(a, b - a), WORD, lower=True)
            if not len(words.start):
                continue
            coded = langs.slice(a, b - a).dictionary_encode()
            names = coded.dictionary
            lang = coded.indices.to_numpy()[words.doc]
            salt = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names.to_pylist()], dtype=U64)
            breaks = np.cumsum(BREAKS[words.data])[words.start]
            follows = np.zeros(len(words.start), dtype=bool)
            follows[1:] = (breaks[1:] == breaks[:-1]) & (words.doc[1:] == words.doc[:-1])
            yield lang, names, words, follows, mix(words.hash ^ salt[lang])


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash for each pair of hashes."""
    return mix(left * U64(3) + mix(right + _STEP))


def _links(bits: np.ndarray, follows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that pass the filter together with the next word, and hashes of the triples that begin at each word but the last two."""
    live, linked = in_bitmap(bits, hashes), np.zeros(len(hashes), dtype=bool)
    pairs = _joined(hashes[:-1], hashes[1:])
    linked[:-1] = follows[1:] & live[:-1] & live[1:] & in_bitmap(bits, pairs)
    return linked, _joined(pairs[:-1], hashes[2:])


def _counted(hashes: np.ndarray) -> pa.RecordBatch:
    keys, counts = np.unique(hashes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], names=["h", "n"])


def _short_runs(batches):
    """Hashes of words and of neighbours with their counts in a slice."""
    for _, _, _, follows, hashes in _slices(batches):
        yield _counted(np.concatenate([hashes, _joined(hashes[:-1], hashes[1:])[follows[1:]]]))


def _triples(bitmap):
    """Hashes of triples whose pairs pass the filter."""

    def run(batches):
        for _, _, _, follows, hashes in _slices(batches):
            linked, triples = _links(bitmap.value, follows, hashes)
            yield _counted(triples[linked[:-2] & linked[1:-1]])

    return run


def _leading(longest: int, bitmap):
    """Padded windows, one for each word, counted within a slice."""

    def run(batches):
        bits = bitmap.value
        for lang, names, words, follows, hashes in _slices(batches, WINDOW_BYTES):
            linked, triples = _links(bits, follows, hashes)
            tripled = np.zeros(len(linked) + longest, dtype=bool)
            tripled[: len(triples)] = linked[:-2] & linked[1:-1] & in_bitmap(bits, triples)
            said = word_strings(words).dictionary_encode()
            code = np.zeros(len(linked) + longest, dtype=np.int64)  # 0 is padding
            code[: len(linked)] = said.indices.to_numpy() + 1
            dictionary = pa.concat_arrays([pa.array([""], said.dictionary.type), said.dictionary])
            for which in (np.flatnonzero(~linked), np.flatnonzero(linked)):  # windows of one word, and longer ones
                runs, group, columns = linked[which], lang[which].astype(np.int64), [code[which]]
                _, group = np.unique(group * len(dictionary) + columns[0], return_inverse=True)
                for k in range(1, longest):
                    columns.append(np.where(runs, code[which + k], 0))
                    if runs.any():
                        _, group = np.unique(group * len(dictionary) + columns[k], return_inverse=True)
                        runs = runs & tripled[which + k - 1]
                _, first, counts = np.unique(group, return_index=True, return_counts=True)
                strings = [dictionary.take(pa.array(c[first])) for c in columns]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[which[first]])), *strings, pa.array(counts)], names=["lang", *_columns(longest), "n"])

    return run


def _columns(longest: int) -> list[str]:
    return [f"w{k + 1}" for k in range(longest)]


def word_strings(words: Words) -> pa.StringArray:
    """The words as an Arrow array."""
    size = words.end - words.start
    data = words.data[ragged_ranges(words.start, size)]
    offsets = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes, of a size that follows their number up to the bound."""
    return bitmap_of(hashes, "h", min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * hashes.count()).bit_length())))


def phrase_counts(docs: DataFrame, longest: int = 5, least: int = 100, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, k, phrase, n: the words of each language (k = 0, phrase empty), and every phrase of up to ``longest`` words found ``least`` times or more."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spark, often = docs.sparkSession, lambda counted: saved(counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"))
    short = often(rows.mapInArrow(_short_runs, "h long, n long"))
    bitmap = spark.sparkContext.broadcast(_filter(short))
    triples = often(rows.mapInArrow(_triples(bitmap), "h long, n long"))
    bitmap = spark.sparkContext.broadcast(_filter(short.union(triples)))
    release(short, triples)
    names = _columns(longest)
    windows = rows.mapInArrow(_leading(longest, bitmap), f"lang string, {', '.join(f'{w} string' for w in names)}, n long")
    summed = windows.rollup("lang", *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    level = F.element_at(F.array(*[F.lit(longest - j) for j in range(longest + 1)]), F.round(F.log2(F.col("gid") + 1)).cast("int") + 1)
    summed = summed.where(F.col("gid") < 2 ** (longest + 1) - 1).select("lang", level.alias("k"), F.array(*names).alias("w"), "n")
    whole = (F.col("k") == 0) | ((F.col("n") >= least) & (F.get("w", F.col("k") - 1) != ""))
    return summed.where(whole).select("lang", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("phrase"), "n")


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) of four counts, exact below 10**16 each."""
    return F.expr(f"1000BD * cast({a} as decimal(16,0)) * cast({n} as decimal(16,0)) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts, with A-Z lower-cased, are cut at ``.,;:!?`` and line ends into pieces and these
    at spaces and tabs into words.  A candidate is a phrase of 2 to ``longest`` words found
    a >= ``least`` times; its lowest-scoring cut counts, with floor(1000 * a * n / (l * r))
    in exact arithmetic and ties to the earlier cut.  Candidates inside a longer one with
    at least ``percent`` hundredths of their count are dropped.

    A null language is ``und``.  Null and empty texts have no words; texts of any length
    are read whole; repeated rows count each.  An empty table gives no rows.  Other columns
    are ignored, whatever their names.
    """
    found = saved(phrase_counts(docs, longest, least, lang, text))
    totals = found.where("k = 0").select("lang", F.col("n").alias("total"))
    known, cands = found.where("k > 0"), found.where("k > 1")
    words, inside = F.split("phrase", " "), F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = cands.select("lang", "k", "phrase", F.col("n").alias("a"), words.alias("w"), inside.alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    scored = cuts.join(totals, "lang").withColumn("score", score("a", "total", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.first("total").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = cands.where("k > 2").select("lang", F.split("phrase", " ").alias("w"), "k", "n").select("*", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    longer = longer.select("lang", "w", "n", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at")).select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "n")
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # each task cuts to the first ones before the shuffle
    return kept.withColumn("rank", place).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """Collocations of whole ``documents``: 2 to 5 words, 100 times or more, 2000 a language."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same phrases by unnesting every length.
ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, k, w[p : p + k - 1] AS ws FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS n FROM o GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w)) AS total FROM w GROUP BY 1),
cuts AS (SELECT lang, phrase, n AS a, cut, array_to_string(ws[1:cut], ' ') AS lw, array_to_string(ws[cut + 1:k], ' ') AS rw FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1)),
s AS (SELECT c.lang, c.phrase, a, cut, x.n AS l, y.n AS r, CAST(total AS BIGINT) AS n, CAST(CAST(1000 AS HUGEINT) * a * total // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
      FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lw JOIN f y ON y.lang = c.lang AND y.phrase = rw JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT DISTINCT lang, array_to_string(ws[p : p + z - 1], ' ') AS phrase, n FROM (SELECT *, unnest(generate_series(1, k - z + 1)) AS p FROM (SELECT *, unnest(generate_series(2, k - 1)) AS z FROM f WHERE k > 2))),
g AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.n >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM g QUALIFY rank <= 2000
"""
