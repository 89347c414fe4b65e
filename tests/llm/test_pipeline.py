"""Stages of the pipeline against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from stratamill.llm import toxicity
from stratamill.llm.queries import QUERIES

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS, LABELS, ITEMS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int", "item_id long, text string"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def stored(spark, at, docs=(), labels=(), items=()):
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("benchmark", items, ITEMS)):
        spark.createDataFrame(list(rows), schema).write.parquet(f"{at}/{name}.parquet")
    return str(at), spark.read.parquet(f"{at}/documents.parquet")


@pytest.mark.parametrize("labels", ["none", "clean", "toxic"])
def test_labels_of_less_than_two_classes(spark, tmp_path, labels):
    docs = [(i, prose(30), "x") for i in range(40)] + [(100, None, "x"), (101, "", "x"), (None, "no id", "x")]
    given = {"none": [], "clean": [(i, 1, 0) for i in range(40)], "toxic": [(i, 0, 1) for i in range(40)]}[labels]
    at, df = stored(spark, tmp_path, docs, given)
    assert rows_of(corpus_pipeline.drop_toxic(spark, df, at)) == sorted(docs, key=repr)
    assert [r.predicted for r in QUERIES["op8_segments"](spark, at).collect()] == [0] * len(docs)


def similar(a, b, n=5):
    """Whether texts are copies by the definition: five-word runs, 75 hundredths of their union in common."""
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    both = len(sets[0] & sets[1])
    return bool(both) and 100 * both >= 75 * len(sets[0] | sets[1])


def one_of_each(rows):
    """For each component of copies its row of smallest id, null last; other rows once for an id and text."""
    rows, left, out = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, str(r[1]))), [], []
    left = list(rows)
    while left:
        group, at = [left.pop(0)], 0
        while at < len(group):
            more = [r for r in left if similar(group[at][1], r[1])]
            left = [r for r in left if r not in more]
            group, at = group + more, at + 1
        out.append(group)
    return out


A, B, C, D = (prose(60) for _ in range(4))
ITEM = prose(20)
#: ids that are null or repeat, with texts that differ, are near or are equal.
MIXED = [(7, A, "x"), (9, A + " end", "x"), (7, B, "x"), (3, B + " end", "x"), (None, C, "x"), (None, C, "x"), (None, C + " end", "x"), (None, D, "x"), (None, prose(50), "x"), (5, prose(50), "x"), (5, prose(50), "x"), (6, None, "x"), (None, None, "x"), (8, "", "x"), (None, "", "x"), (11, D, "x"), (11, D, "x"), (1, "two words", "x")]


def test_one_row_of_each_group_stays(spark, tmp_path):
    at, df = stored(spark, tmp_path, MIXED)
    kept = rows_of(corpus_pipeline.drop_near_duplicates(spark, df, at))
    groups = one_of_each(MIXED)
    assert len(kept) == len(groups) and len(set(kept)) == len(kept)
    for group in groups:
        found = [r for r in kept if r in group]
        assert len(found) == 1 and found[0][0] == group[0][0]


def test_only_rows_with_leaks_go(spark, tmp_path):
    leaks = [(None, "before " + ITEM + " after", "x"), (7, ITEM.upper(), "x"), (20, ITEM, "x"), (20, ITEM, "x")]
    at, df = stored(spark, tmp_path, MIXED + leaks, items=[(1, ITEM), (2, None), (3, "too short")])
    assert rows_of(corpus_pipeline.drop_leaks(spark, df, at)) == sorted(MIXED, key=repr)


def test_stage_rejects_what_op8_predicts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *_, **__: None)
    by_id = lambda df, model, text_col="text", score_col="score", passages_col="passages": df.withColumn(score_col, F.col("doc_id") / 100)
    monkeypatch.setattr(toxicity, "score", by_id)
    at, df = stored(spark, tmp_path, [(i, f"text {i}", "x") for i in range(101)])
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, df, at).collect()}
    assert kept == {r.doc_id for r in QUERIES["op8_segments"](spark, at).collect() if r.predicted == 0} == set(range(30))


def test_columns_of_a_callers_stay(spark, tmp_path):
    at, df = stored(spark, tmp_path, MIXED, items=[(1, ITEM)])
    odd = df.select("*", *(F.coalesce("text", F.lit("-")).alias(c) for c in ("_KEY", "_toxic", "_passages", "_found", "_toxic_0")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain = stage(spark, odd, at), stage(spark, df, at)
        assert out.columns == odd.columns, name
        told = [r for r in out.collect()]
        assert len(told) == plain.count() and all(len(set(r[3:])) == 1 and len(r[3]) == len("-" if r.text is None else r.text) for r in told), name


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    from stratamill.llm.queries import vocabulary

    docs = [*MIXED, (30, "before " + ITEM, "x"), (None, ITEM, "x"), (31, "mail to a.b7@x.org now", "x")]
    at, _ = stored(spark, tmp_path, docs, items=[(1, ITEM)])
    out = corpus_pipeline.run(spark, at).collect()
    expected = [g[0] for g in one_of_each(docs) if ITEM not in (g[0][1] or "")]
    assert sorted(map(repr, (r.doc_id for r in out))) == sorted(repr(r[0]) for r in expected)
    whole = Tokenizer.from_file(vocabulary())
    for r in out:
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert len(r.text or "") in {len(t or "") for i, t, _ in docs if i == r.doc_id}
        if r.doc_id == 31:
            assert "a.b7@x.org" not in r.text
        else:
            assert any(i == r.doc_id and similar(t, r.text) or t == r.text for i, t, _ in docs)


def test_run_of_nothing(spark, tmp_path):
    at, _ = stored(spark, tmp_path)
    assert corpus_pipeline.run(spark, at).count() == 0
