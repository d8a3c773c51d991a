"""Collocations, nearest neighbours and vector codes against brute force."""

import collections
import math
import re

import numpy as np
import pytest
from helpers import SF

from barloom.llm import collocations, neighbours, vector_codes
from barloom.llm.common import table


def brute_collocations(rows, longest, least, percent, top):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: n for p, n in counts.items() if n >= least and len(p) > 2}
    out, longer = [], collections.Counter()
    for q, f in found.items():
        for k in range(2, len(q) - 1):
            for i in range(1, len(q) - k + 1):
                longer[(q[0], *q[i : i + k])] = max(longer[(q[0], *q[i : i + k])], f)
    for p, a in found.items():
        lang, words = p[0], p[1:]
        score, _, l, r = min((1000 * a * totals[lang] // (counts[p[: k + 1]] * counts[(lang, *words[k:])]), k, counts[p[: k + 1]], counts[(lang, *words[k:])]) for k in range(1, len(words)))
        if p not in longer or 100 * longer[p] < percent * a:
            out.append((lang, -score, -a, " ".join(words), l, r, totals[lang]))
    out.sort(key=lambda x: (*x[:3], x[3].encode()))
    place, ranked = collections.Counter(), []
    for lang, score, a, phrase, l, r, n in out:
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase, -a, l, r, n, -score))
    return sorted(ranked)


def test_collocations_of_odd_rows_equal_brute_force(spark, odd_docs, no_docs):
    more = [(30, "New York, New York! new york city\tnew york city; día\x0bdía été día été", "es"), (31, "a a a a a a a a. a a a a", "xx"), (32, "b b\x1db \x00 \x00 \x00 c " * 3, None)]
    docs = odd_docs.select("doc_id", "text", "lang", "row", "words", "n").union(spark.createDataFrame([(i, t, x, 0, "clash", 1) for i, t, x in more], "doc_id long, text string, lang string, row long, words string, n long"))
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    for longest, least, percent, top in ((5, 2, 100, 2000), (5, 3, 60, 5), (3, 1, 100, 40), (2, 2, 100, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, longest, least, percent, top).collect())
        assert got == brute_collocations(rows, longest, least, percent, top) and got
    assert collocations.collocations(no_docs).count() == 0


def test_collocation_counts_past_64_bits_stay_exact(spark):
    """1000 * a * n is about 10**30 here."""
    rows = spark.createDataFrame([(10**13, 10**14, 3 * 10**13, 7 * 10**13)], "a long, total long, l long, r long")
    assert rows.select(collocations.score("a", "total", "l", "r").alias("s")).first()["s"] == 1000 * 10**13 * 10**14 // (3 * 10**13 * 7 * 10**13)


def brute_neighbours(rows, k, every):
    """(query, rank, id, distance) by comparing all pairs; of rows that share an id the smallest vector counts."""
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    out = []
    for q in ok:
        if q % every == 0:
            near = []
            for i, v in ok.items():
                if i != q and len(v) == len(ok[q]):
                    total = 0.0
                    for a, b in zip(ok[q], v):
                        total += (a - b) * (a - b)
                    near.append((math.sqrt(total), i))
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Clusters, equal vectors, ties, repeated ids, and all kinds of vectors that take no part."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(i % 7, 0.4, 6), 1)]) for i in range(700)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(700, 1000)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [1.0, None, 0.0, 0.0, 0.0, 1.0]), (1004, [math.nan] + [1.0] * 5), (1005, [math.inf] + [1.0] * 5), (None, [1.0] * 6), (-20, [0.5] * 6), (20, [9.0] * 6), (20, [9.0] * 6)]
    rows += [(1100 + i, [float(i), 1.0]) for i in range(4)] + [(1200, [3.0] * 9)]
    return spark.createDataFrame([(i, v, "clash", 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, shard string, kind int, v double")


def test_neighbours_with_factor_one_equal_brute_force(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", (150, 150))  # several shards, so that results are merged
    rows = [(r["vec_id"], r["embedding"]) for r in odd_vectors.select("vec_id", "embedding").collect()]
    for k, leaf in ((10, 8), (3, 64)):
        got = neighbours.nearest_neighbours(odd_vectors, odd_vectors.where("vec_id % 20 = 0"), k=k, factor=1.0, leaf=leaf)
        assert sorted(tuple(r) for r in got.collect()) == brute_neighbours(rows, k, 20)
    assert neighbours.nearest_neighbours(odd_vectors.limit(0), odd_vectors).count() == 0
    assert neighbours.nearest_neighbours(odd_vectors, odd_vectors.limit(0)).count() == 0


def test_neighbours_of_the_query_reach_the_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    want = brute_neighbours(rows, 10, 100)
    got = [tuple(r) for r in neighbours.op12_neighbours(spark, SF).collect()]
    dist = {(q, i): d for q, _, i, d in got}
    assert len(got) == len(want) and [(q, r) for q, r, *_ in sorted(got)] == [(q, r) for q, r, *_ in want]
    assert len({(q, i) for q, _, i, _ in want} & set(dist)) >= 0.9 * len(want)
    assert all(dist[q, i] == d for q, _, i, d in want if (q, i) in dist)


def test_larger_factors_take_fewer_distances():
    rng = np.random.default_rng(1)
    rows, asked = rng.normal(size=(4000, 8)), rng.normal(size=(50, 8))
    tree = neighbours.VantageTree(np.arange(4000), rows)
    exact, ids = np.argsort(neighbours.distances(asked, rows), axis=1)[:, :10], np.arange(50) - 100
    recall, seen = {}, {}
    for factor in (1.0, 1.5, 3.0):
        near, _, seen[factor] = tree.nearest(ids, asked, 10, factor)
        recall[factor] = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, exact)])
    assert recall[1.0] == 1.0 and recall[1.5] >= 0.9 and seen[1.0] > seen[1.5] > seen[3.0] and seen[1.0] < 50 * 4000


def brute_codes(rows, parts, entries, rounds):
    """(vec_id, label, code, error) and the codebooks in plain integers."""
    ok = sorted(((i is None, i or 0, tuple(math.floor(x * 256) for x in v), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)), key=lambda r: r[:3])
    ok = [r for r in ok if len(r[2]) == len(ok[0][2])]
    size = -(-len(ok[0][2]) // parts)
    cut = [[(*v, *[0] * (size * parts - len(v)))[p * size : (p + 1) * size] for p in range(parts)] for _, _, v, _ in ok]
    books = [[cut[e][p] for e in range(min(entries, len(ok)))] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((square(v[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    coded = [(None if unnamed else i, label, bytes(e for _, e in f), sum(d for d, _ in f)) for (unnamed, i, _, label), f in zip(ok, assign())]
    return sorted(coded, key=str), [[list(c) for c in book] for book in books]


def test_vector_codes_of_odd_rows_equal_brute_force(spark, odd_vectors):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    more = [(5000 + i, [float(x) for x in rng.normal(0, 20 if i % 3 else 0.01, 6)]) for i in range(150)] + [(6000, [6e5] * 6), (6001, [-5e5] * 6)]
    vectors = odd_vectors.select("vec_id", "embedding").union(spark.createDataFrame(more, "vec_id long, embedding array<double>")).withColumns({"label": F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") % 3).cast("int")), "x": F.lit("clash"), "error": F.lit(1)})
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    for parts, entries, rounds in ((3, 64, 2), (4, 5, 3), (6, 1, 1), (2, 256, 4)):
        coded, books = vector_codes.compress_vectors(vectors, parts, entries, rounds)
        want, want_books = brute_codes(rows, parts, entries, rounds)
        assert books.tolist() == want_books
        assert sorted(((r["vec_id"], r["label"], bytes(r["code"]), r["error"]) for r in coded.collect()), key=str) == want
    assert vector_codes.compress_vectors(vectors.limit(0))[0].count() == 0
    few = vector_codes.compress_vectors(vectors.where("vec_id between 5000 and 5002"), 3, 64, 2)[0]
    assert [r["error"] for r in few.collect()] == [0, 0, 0]


def test_bounds_settle_most_parts_without_all_entries():
    """Entries that barely move; results equal a full comparison, and b shrinks and grows without a loss."""
    rng = np.random.default_rng(2)
    x, book = rng.integers(-500, 500, (3000, 4)), rng.integers(-500, 500, (64, 4))
    entry, _, near, low, outer = vector_codes.settle_all(x, book, 8)
    compared = []
    for b in (8, 3, 3, 12, 16, 2, 8):
        new = book + rng.integers(-6, 7, book.shape)
        moved = np.sqrt(((new - book) ** 2).sum(axis=1)) * 1.000001
        entry, square, near, low, outer, depth = vector_codes.settle_bounded(x, new, moved, entry, near, low, outer, b)
        book = new
        squares = vector_codes.all_squares(x, book)
        assert (entry == squares.argmin(axis=1)).all() and (square == squares.min(axis=1)).all() and near.shape == (3000, b)
        compared.append((depth == vector_codes.ALL).mean())
    assert compared[0] < 0.2 and min((depth == d).sum() for d in (0, 1)) > 0


def test_a_long_text_does_not_end_the_training_set_and_copies_count_once(spark):
    from pyspark.sql import functions as F

    from barloom.llm import quality_cnn

    rows = [(i, f"text {i} " * 20) for i in range(200)] + [(1000 + i, "copy " * 30) for i in range(500)] + [(2000 + i, f"{i} very long " * 40000) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    most = 150 * (quality_cnn.CHUNK + 400)
    found = quality_cnn.training_rows(docs, labels, "quality", most_bytes=most).collect()
    assert len({r["place"] for r in found}) == len(found) > 100
    assert sum(len(r["chunks"]) for r in found) <= 2 * most
    assert 0 < len(quality_cnn.training_rows(docs, labels, "quality", most=10).collect()) <= 10
