"""Fill-in-middle against a plain version."""

import hashlib
import random

import pytest

from stratamill.llm import infilling
from stratamill.llm.queries import ORACLE, QUERIES

hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain(i, t, moved=90, spm=20, seed="1"):
    t, h = t or "", hexed(f"{seed}:{'' if i is None else i}")
    x = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(t)
    if not t or any(m in t for m in infilling.MARKERS) or x[2] % 100 >= moved:
        return n, "plain", None, None, t
    a, b = sorted((x[0] % (n + 1), x[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if x[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    some = ["", None, "a", "a\nb\r\n", "é日\U0001f926‍́", "x <P> y", "<S>", "<M", "P>", "<<P", "a\0b", " \t ", "z" * 300_000, "日" * 120_000]
    some += ["".join(rng.choice("ab<>PSM \né日") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [(i - 5, t) for i, t in enumerate(some)] + [(None, "null id"), (None, None), (7, "again"), (7, "again"), (-(2**63), "least"), (2**63 - 1, "most")]


def test_fill_in_middle(spark, rows):
    df = spark.createDataFrame([(i, t, "f", "o", 5) for i, t in rows], "doc_id long, text string, form string, row string, n int")
    for slice_bytes in (1_000_000, 50):
        out = infilling.restored(infilling.fill_in_middle(df, slice_bytes=slice_bytes), slice_bytes=slice_bytes).collect()
        found = sorted(((r.doc_id, r.text, r.row, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out), key=repr)
        assert found == sorted(((i, t, "o", *plain(i, t), t or "") for i, t in rows), key=repr)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_other_units_and_markers(spark):
    df = spark.createDataFrame([(i, "one two  three four " * 3 + str(i)) for i in range(50)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    out = infilling.fill_in_middle(df, unit=r"\S+\s*|\s+", moved=100, spm=50, markers=marks)
    back = infilling.restored(out, markers=marks).collect()
    assert all(r.restored == r.text and r.n == 13 and r.form != "plain" and r.prefix_chars + r.middle_chars <= 13 for r in back)
    for bad in (("<>", "<>x", "m"), ("ab", "ba", "m"), ("aba", "q", "r"), ("", "q", "r"), ("s", "q", "s")):
        with pytest.raises(ValueError):
            infilling.fill_in_middle(df, markers=bad)


def test_query_as_sql(spark, tmp_path, rows):
    import duckdb

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for at in (str(tmp_path), "/root/testdata/sf0.001"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet{'/*.parquet' if at == str(tmp_path) else ''}'")
        found = QUERIES["op13_fill_in_middle"](spark, at)
        told = con.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLE['op13_fill_in_middle']})").fetchall()
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(told, key=repr)


def test_empty_table(spark):
    assert infilling.restored(infilling.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
