"""The join over count vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamill.llm import ngram_join
from stratamill.llm._shared import heavy_join
from stratamill.llm.queries import QUERIES

WORDS = [f"w{i}" for i in range(400)]


def shingles(t, n=3):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def expected(rows, percent=90, n=3):
    sets = [shingles(t, n) for _, t in rows]
    comp = list(range(len(rows)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min([x for x in (least.get(top(i)), doc_id) if x is not None], default=None)
    return sorted(((doc_id, len(sets[i]), least[top(i)]) for i, (doc_id, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    texts, passage = [], prose(120)
    for n in (5, 9, 10, 11, 12, 13, 20, 30, 60, 61, 100, 150, 300, 700):
        for _ in range(3):
            base = prose(n)
            texts.append(base)
            for _ in range(5):  # copies at and about the threshold, and of these again
                t = list(rng.choice(texts[-4:]))
                for _ in range(rng.randint(0, 1 + n // 40)):
                    k = rng.randrange(len(t))
                    t[k : k + rng.randint(0, 1)] = rng.choice([[], ["zz"], prose(2)])
                texts.append(t)
    texts += [passage + prose(rng.randint(1, 60)) for _ in range(30)]
    chain = prose(80)
    for _ in range(40):  # a long chain of copies, whose ends have little in common
        chain = chain[1:] + prose(1)
        texts.append(chain)
    out = [(i * 3 - 40, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out + [(None, texts[0][0]), (None, out[3][1]), (None, None), (7000, None), (7001, ""), (7002, " \t"), (7003, "one Two"), (7004, "ONE  two"), (5, out[9][1]), (5, out[9][1]), (5, out[11][1])]


@pytest.mark.parametrize("block_bytes", [8_000_000, 3_000])
def test_similar_documents(spark, rows, block_bytes):
    df = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in rows], "doc_id long, text string, cls int, cells string, n int").repartition(6)
    found = ngram_join.similar_documents(df, block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_other_thresholds(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, words in ((60, 2), (97, 1)):
        assert sorted(map(tuple, ngram_join.similar_documents(df, words=words, percent=percent).collect()), key=repr) == expected(rows, percent, words)


def test_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["op12_count_vector_join"](spark, str(tmp_path)).collect()), key=repr) == expected(rows)


def test_cells_of_links_meet():
    """Sets at the threshold share a cell, whichever is larger."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(9, 900))
        a = rng.choice(2**62, n, replace=False).astype(np.uint64)
        gone = int(rng.integers(0, n // 10 + 1))
        new = (n - gone) * 10 // 9 - n  # as many as the union may still have
        b = np.concatenate([a[gone:], rng.choice(2**62, new, replace=False).astype(np.uint64)])
        both = n - gone
        assert 100 * both >= 90 * (n + len(b) - both)
        one, many = ngram_join.cells_of(np.concatenate([a, b]), np.array([len(a), len(b)]), 90)
        assert set(one[: many[0]].tolist()) & set(one[many[0] :].tolist()) or len(a) == len(b) == both


def test_tree_join_passes_by_no_pair():
    rng = np.random.default_rng(6)
    n = rng.integers(20, 60, 400)
    points = np.array([np.bincount(rng.integers(0, 8, k), minlength=8) for k in n])
    comp = rng.integers(0, 300, 400)
    for left, right in ((np.arange(400),) * 2, (np.arange(150), np.arange(150, 400))):
        met = set()
        ngram_join.tree_join(points, n, comp, left, left if len(left) == len(right) else right, 80, lambda x, y: x == y, lambda i, j: met.add((min(i, j), max(i, j))))
        told = {(min(i, j), max(i, j)) for i in left for j in right if i != j and comp[i] != comp[j] and 180 * np.minimum(points[i], points[j]).sum() >= 80 * (n[i] + n[j])}
        assert met == told and told


def test_heavy_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    values = rows.groupBy("k").agg(F.count("*").alias("rows"), F.max("id").alias("top"))
    assert sorted(map(tuple, heavy_join(rows, values, "k").select("id", "top").collect())) == [(i, 4998 if i % 3 == 0 else i) for i in range(5000)]


def test_empty_tables(spark):
    assert ngram_join.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in ngram_join.similar_documents(spark.createDataFrame([(4, None)], "doc_id long, text string")).collect()] == [(4, 0, 4)]
