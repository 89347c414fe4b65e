"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest

from stratamill.llm import spelling
from stratamill.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def counted(rows, every=97):
    n = collections.Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % every else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows):
    n = counted(rows)
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def told(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    """Words with edits of edits, of few letters, so that blocks are full, and with runs of one letter."""
    rng = random.Random(4)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "×÷ÿÀÉa", "straße", "q" * 5000, "q" * 4999, "q" * 2500 + "r" + "q" * 2499]
    stems += [s[:k] + c + s[k:] for s in stems[:40] for k in (0, len(s) // 2, len(s)) for c in "aé"]
    stems = [s.upper() if rng.random() < 0.1 and "ß" not in s and "ÿ" not in s else s for s in stems]
    out = []
    for i in range(400):
        out.append((i, rng.choice([" ", "\n", "1", "Ā", "_"]).join(rng.choice(stems[: 1 + int(len(stems) * rng.random() ** 2)]) for _ in range(rng.randint(0, 60)))))
    return out + [(None, "null null ids words words words"), (None, None), (7, None), (8, ""), (3, out[3][1]), (3, out[3][1]), (-4, "abcde Abcde aBCDE ÀBCDE àbcde")]


@pytest.mark.parametrize("block", [256, 8, 2])
def test_spelling_forms(spark, rows, block):
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id long, text string, word string, n int, form string").repartition(5)
    assert told(spelling.spelling_forms(df, block=block)) == expected(rows)


def test_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = told(QUERIES["op11_spelling_forms"](spark, str(tmp_path)))
    assert found == expected(rows) and len(found) > 200 and sum(r[1] is not None for r in found) > 50 and sum(r[1] != r[2] for r in found if r[1]) > 5


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert told(QUERIES["op11_spelling_forms"](spark, "/root/testdata/sf0.001")) == expected(rows)


def test_long_chains_of_forms(spark):
    links = [(i, i + 1) for i in range(37)] + [(100, 36), (101, 100)]
    df = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in links], "word string, form string")
    assert {tuple(r) for r in spelling.roots(df).collect()} == {(f"{a:03}", "037") for a, _ in links}


def test_empty_tables(spark):
    assert spelling.spelling_forms(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_forms(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0
