"""Quality rules whose cutoffs adapt to each language and source.

Every document gets integer measures.  Their distribution in each (lang, source) is kept
in a quantile sketch: counts per logarithmic bucket with 16 steps an octave, so a
quantile is off by 1/16 at most.  Sketches merge by adding counts, which gives those of
a language and of everything.  A group's sketch is drawn towards its language's, and that
towards everything's, by the weight of PRIOR documents, so small groups lean on their
parents and large ones hardly do.

Measures with a spread (FENCES) are cut some spreads of the quartiles beyond a quartile.
Measures that are zero in most documents have equal quartiles; they are cut in the first
gap of the sketch above the upper quartile: where the quantile of a level and that of a
thousandth more lie two octaves apart, the cutoff is their geometric middle.  A source
whose good texts all have some symbols thus gets another cutoff than one of plain prose,
and one with an even tail is cut where the tail ends.  Documents are then filtered by a
join with the cutoffs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import saved, table
from barloom.llm.words import NON_SPACE, byte_hashes, row_slices, split_words, window_hashes

#: Measure to how many spreads beyond the quartile its cutoff lies, and the least spread; shares are in thousandths, the length of words in tenths of a character.
FENCES = {"upper_pm": (6, 3), "word_len": (4, 2)}
#: Measures cut in a gap, to the thousandths added before octaves are counted (differences below them mean little).
GAPS = {"symbols_pm": 5, "dup_lines_pm": 50, "repeats_pm": 20, "bangs_pm": 5}
#: Quotient of the two ends of a gap, and the millionths of a group that may lie in it.
GAP_WIDTH, GAP_MASS = 4, 1_000
#: Measures that have a lower cutoff too.
BOTH_SIDES = ["word_len"]
#: Documents that a parent's sketch counts for in a group's.
PRIOR = 50
_RULES = [*GAPS, *FENCES]

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_chars")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _UPPER, _BANG = _table(b"#*$%&|<>"), _table(bytes(range(0x41, 0x5B))), _table(b"!")
_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)], dtype=np.int64)


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def document_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text; null counts as no text."""
    words = split_words(texts, NON_SPACE)
    data, at, docs = words.data, words.text_at, len(words.text_at) - 1
    points = _sums(_POINT[data])
    in_words = _sums(points[words.end] - points[words.start])
    out = {"n_words": words.counts, "word_chars": in_words[words.first[1:]] - in_words[words.first[:-1]]}
    out["n_chars"] = points[at[1:]] - points[at[:-1]]
    for name, chars in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_bangs", _BANG)):
        total = _sums(chars[data])
        out[name] = total[at[1:]] - total[at[:-1]]

    # Lines with a word, and how many equal an earlier one of the same text.
    breaks = np.flatnonzero(data == 0x0A)
    doc_of_break = np.searchsorted(at, breaks, side="right") - 1
    start = np.sort(np.concatenate([at[:-1], breaks + 1]))
    doc = np.sort(np.concatenate([np.arange(docs), doc_of_break]))
    end = np.sort(np.concatenate([breaks, at[1:]]))
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[worded], end[worded], doc[worded]
    lines = byte_hashes(data, start, end)
    out["n_lines"] = np.bincount(doc, minlength=docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[_first_of(doc, lines)], minlength=docs)

    # Words in three-word windows that the text has twice or more.
    at3, hashes = window_hashes(words, 3)
    doc3 = np.searchsorted(words.first, at3, side="right") - 1
    twice = at3[_count_of(doc3, hashes) > 1]
    cover = np.zeros(len(words.hash) + 4, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 3, -1)
    covered = _sums(np.cumsum(cover)[: len(words.hash)] > 0)
    out["n_repeat_words"] = covered[words.first[1:]] - covered[words.first[:-1]]
    return out


def _first_of(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    order = np.lexsort((value, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1])
    return order[new]


def _count_of(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    order = np.lexsort((value, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.bincount(group)[group] if len(group) else 0
    return out


def _count(batches):
    for batch in batches:
        texts = batch.column("text")
        for a, b in row_slices(texts):
            part, counts = batch.slice(a, b - a), document_counts(texts.slice(a, b - a))
            yield pa.RecordBatch.from_arrays(
                [part.column(n) for n in ("doc_id", "lang", "source")] + [pa.array(counts[n].astype(np.int64)) for n in _COUNTS], names=["doc_id", "lang", "source", *_COUNTS]
            )


def measures() -> dict[str, F.Column]:
    """Integer measures from the base counts."""
    share = lambda a, b: F.expr(f"{a} * 1000 div greatest({b}, 1)")
    return {
        "symbols_pm": share("n_symbols", "word_chars"), "dup_lines_pm": share("n_dup_lines", "n_lines"), "repeats_pm": share("n_repeat_words", "n_words"),
        "upper_pm": share("n_upper", "word_chars"), "bangs_pm": share("n_bangs", "word_chars"), "word_len": F.expr("word_chars * 10 div greatest(n_words, 1)"),
    }


def sketch_bucket(value: str) -> F.Column:
    """Least value of the bucket: exact below 32, then the five leading bits."""
    return F.expr(f"if({value} < 32, {value}, shiftleft(shiftright({value}, length(bin({value})) - 5), length(bin({value})) - 5))")


def quantile_sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """Counts per bucket for each group and measure: (by..., measure, bucket, n)."""
    names = list(measures())
    stacked = measured.select(*by, F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) as (measure, value)"))
    return stacked.select(*by, "measure", sketch_bucket("value").alias("bucket")).groupBy(*by, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def drawn_sketches(sketches: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket) to the millionths of the group, drawn towards the parents; no bucket of zero.

    The sketch of everything has every bucket that any group has, at most 16 an octave; as
    one list per measure it is dealt to the languages, and theirs to the groups.
    """
    totals = lambda rows, by: rows.groupBy(*by, "measure").agg(F.sum("n").alias("docs"))
    listed = lambda rows, by, part: rows.groupBy(*by, "measure").agg(F.collect_list(F.struct("bucket", part.alias("part"))).alias("parent"))
    same = lambda a, b, by: [a[c].eqNullSafe(b[c]) for c in by]

    def level(rows: DataFrame, parent: DataFrame, by: list[str], shared: list[str]) -> DataFrame:
        groups = totals(rows, by)
        joined = groups.join(parent, [*same(groups, parent, shared), groups["measure"] == parent["measure"]]).select(*[groups[c] for c in [*by, "measure"]], "docs", F.inline("parent"))
        found = joined.join(rows, [*same(joined, rows, by), joined["measure"] == rows["measure"], joined["bucket"] == rows["bucket"]], "left")
        part = F.expr(f"(coalesce(n, 0) * 1000000 + {PRIOR} * part) div (docs + {PRIOR})")
        return found.select(*[joined[c] for c in [*by, "measure", "bucket"]], part.alias("part"))

    whole = merge_sketches(sketches, [])
    start = listed(whole.join(F.broadcast(totals(whole, [])), "measure"), [], F.expr("n * 1000000 div docs"))  # totals: one row per measure
    langs = level(merge_sketches(sketches, ["lang"]), F.broadcast(start), ["lang"], [])  # start: one row per measure
    return level(sketches, listed(langs, ["lang"], F.col("part")), ["lang", "source"], ["lang"]).where("part > 0")


def cutoffs(sketches: DataFrame) -> DataFrame:
    """(g_lang, g_source) to the struct cut: upper_<measure>, and lower_<measure> where there is one."""
    group = ["lang", "source", "measure"]
    run = Window.partitionBy(*group).orderBy("bucket")
    steps = drawn_sketches(sketches).withColumns({"upto": F.sum("part").over(run), "total": F.sum("part").over(Window.partitionBy(*group))})
    beyond = Window.partitionBy(*group).orderBy("upto").rangeBetween(GAP_MASS + 1, Window.unboundedFollowing)
    steps = steps.withColumn("next", F.min("bucket").over(beyond))
    least = lambda m, when, what: F.min(F.when((F.col("measure") == m) & F.expr(when), what))
    quartile = {f"q{q}_{m}": least(m, f"upto * 4 >= total * {q}", F.col("bucket")) for m in FENCES for q in (1, 3)}
    gap = {m: least(m, f"upto * 4 >= total * 3 and (next is null or next + {o} >= {GAP_WIDTH} * (bucket + {o}))", F.struct("bucket", "next")) for m, o in GAPS.items()}
    found = steps.groupBy("lang", "source").agg(*[c.alias(name) for name, c in {**quartile, **gap}.items()])
    reach = {m: k * F.greatest(F.col(f"q3_{m}") - F.col(f"q1_{m}"), F.lit(least_)) for m, (k, least_) in FENCES.items()}
    middle = lambda m, o: F.expr(f"coalesce(cast(floor(sqrt(({m}.bucket + {o}) * ({m}.next + {o}))) as bigint), 2 * ({m}.bucket + {o})) - {o}")
    cuts = [middle(m, o).alias(f"upper_{m}") for m, o in GAPS.items()] + [(F.col(f"q3_{m}") + reach[m]).alias(f"upper_{m}") for m in FENCES]
    cuts += [(F.col(f"q1_{m}") - reach[m]).alias(f"lower_{m}") for m in BOTH_SIDES]
    return found.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.struct(*cuts).alias("cut"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, base_failed, kept, failed_rule.

    base_failed: fewer than 50 words, or more than half of the words in repeated
    three-word windows.  Others are kept if no measure is beyond its cutoff; failed_rule
    names the first that is.  Quantiles are of all documents that pass the base.

    Null texts have no words and fail the base.  A null lang or source is a group of its
    own.  Rows that repeat are judged, and counted, each.  Empty tables give no rows.
    Other columns are ignored, whatever their names.
    """
    docs = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")
    )
    counted = saved(docs.mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in _COUNTS)))
    judged = counted.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).withColumns(measures())
    sketches = saved(quantile_sketches(judged.where(~F.col("base_failed")), ["lang", "source"]))
    chosen = saved(cutoffs(sketches))
    joined = judged.join(chosen, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    failed = F.coalesce(F.when(F.col("base_failed"), F.lit("base")), *[F.when(F.col(m) > F.col(f"cut.upper_{m}"), F.lit(m)) for m in _RULES], *[F.when(F.col(m) < F.col(f"cut.lower_{m}"), F.lit(m)) for m in BOTH_SIDES])
    return joined.select("doc_id", *_COUNTS, "base_failed", failed.isNull().alias("kept"), failed.alias("failed_rule"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract columns of :func:`quality_rules` over whole ``documents``."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def _cuts_sql() -> str:
    """Sketches drawn towards the parents by plain joins on every bucket, then the cutoffs."""
    upper = [f"coalesce(CAST(floor(sqrt((g_{m}[1] + {o}) * (g_{m}[2] + {o}))) AS BIGINT), 2 * (g_{m}[1] + {o})) - {o} AS upper_{m}" for m, o in GAPS.items()]
    upper += [f"q3_{m} + {k} * greatest(q3_{m} - q1_{m}, {least}) AS upper_{m}" for m, (k, least) in FENCES.items()]
    lower = [f"q1_{m} - {FENCES[m][0]} * greatest(q3_{m} - q1_{m}, {FENCES[m][1]}) AS lower_{m}" for m in BOTH_SIDES]
    quart = [f"min(bucket) FILTER (measure = '{m}' AND upto * 4 >= total * {q}) AS q{q}_{m}" for m in FENCES for q in (1, 3)]
    gap = [f"arg_min([bucket, nxt], bucket) FILTER (measure = '{m}' AND upto * 4 >= total * 3 AND (nxt IS NULL OR nxt + {o} >= {GAP_WIDTH} * (bucket + {o}))) AS g_{m}" for m, o in GAPS.items()]
    return f"""s0 AS (SELECT measure, bucket, CAST(count(*) AS BIGINT) * 1000000 // (SELECT count(*) FROM b z WHERE z.measure = b.measure) AS part FROM b GROUP BY measure, bucket),
s1 AS (SELECT k.lang, s0.measure, s0.bucket, ((SELECT count(*) FROM b z WHERE z.lang IS NOT DISTINCT FROM k.lang AND z.measure = s0.measure AND z.bucket = s0.bucket) * 1000000 + {PRIOR} * part) // (k.docs + {PRIOR}) AS part
      FROM (SELECT lang, count(*) AS docs FROM j WHERE NOT base_failed GROUP BY lang) k, s0),
s2 AS (SELECT k.lang, k.source, s1.measure, s1.bucket, (coalesce(c.n, 0) * 1000000 + {PRIOR} * part) // (k.docs + {PRIOR}) AS part
      FROM (SELECT lang, source, count(*) AS docs FROM j WHERE NOT base_failed GROUP BY ALL) k JOIN s1 ON k.lang IS NOT DISTINCT FROM s1.lang
      LEFT JOIN (SELECT lang, source, measure, bucket, count(*) AS n FROM b GROUP BY ALL) c ON c.lang IS NOT DISTINCT FROM k.lang AND c.source IS NOT DISTINCT FROM k.source AND c.measure = s1.measure AND c.bucket = s1.bucket),
u AS (SELECT *, CAST(sum(part) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS BIGINT) AS upto, CAST(sum(part) OVER (PARTITION BY lang, source, measure) AS BIGINT) AS total FROM s2 WHERE part > 0),
u2 AS (SELECT *, (SELECT min(v.bucket) FROM u v WHERE v.lang IS NOT DISTINCT FROM u.lang AND v.source IS NOT DISTINCT FROM u.source AND v.measure = u.measure AND v.upto > u.upto + {GAP_MASS}) AS nxt FROM u),
z AS (SELECT lang, source, {", ".join(quart + gap)} FROM u2 GROUP BY ALL), x AS (SELECT lang, source, {", ".join(upper + lower)} FROM z)"""


#: The same rows in one statement.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
l2 AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS p FROM d WHERE len(w) >= 3)),
g2 AS (SELECT r, s FROM g GROUP BY r, s HAVING count(*) > 1),
g3 AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g JOIN g2 USING (r, s)) GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
      CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
      CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN l2 USING (r) LEFT JOIN g3 USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 1000 // greatest(word_chars, 1) AS symbols_pm, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines_pm,
      n_repeat_words * 1000 // greatest(n_words, 1) AS repeats_pm, n_upper * 1000 // greatest(word_chars, 1) AS upper_pm, n_bangs * 1000 // greatest(word_chars, 1) AS bangs_pm, word_chars * 10 // greatest(n_words, 1) AS word_len FROM c),
v AS (SELECT lang, source, unnest({_RULES}) AS measure, unnest([{", ".join(_RULES)}]) AS value FROM j WHERE NOT base_failed),
b AS (SELECT lang, source, measure, CASE WHEN value < 32 THEN value ELSE (value >> (length(bin(value)) - 5)) << (length(bin(value)) - 5) END AS bucket FROM v),
{_cuts_sql()},
y AS (SELECT j.*, CASE WHEN base_failed THEN 'base' {" ".join(f"WHEN {m} > upper_{m} THEN '{m}'" for m in _RULES)} {" ".join(f"WHEN {m} < lower_{m} THEN '{m}'" for m in BOTH_SIDES)} END AS failed_rule
      FROM j LEFT JOIN x ON j.lang IS NOT DISTINCT FROM x.lang AND j.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM y
"""
