"""Operators against brute force, with nulls, empty and repeated rows, and columns of clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamill.llm import bpe, bsi_topk, decontaminate, near_dedup, ppm, pseudonyms, quality, secrets, substring_dedup, toxicity
from stratamill.llm._grams import chunked
from stratamill.llm.components import components
from stratamill.llm.queries import ORACLE, QUERIES, vocabulary

SCHEMA = "doc_id long, text string, ids string, score string, spans int, n int, cls int, words string"
rng = random.Random(5)
VOCABULARY = ["the", "of", "ander", "ing", "Thou", "eß", "çx", "a.", "|", "x1"]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [sentence(rng.randint(0, 80)) for _ in range(30)]
    near = [" ".join(w if rng.random() > 0.03 else "zz" for w in t.split()) for t in base for _ in range(2)]
    return dict(enumerate([*base, *near, "", None, " \t\n", "one two", "One  Two", "\x1c a\xa0b \x0b c", base[3] + " " + base[4] + "\n" + base[3], "q" * 3000]))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, "z") for i, t in texts.items()], SCHEMA).repartition(3)


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def test_substring_dedup(docs, texts):
    for size, chunk in ((20, 4_000_000), (20, 500), (3, 500)):
        seen, expected = set(), {}
        for i, t in texts.items():
            w, gone = words(t), set()
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                if key in seen:
                    gone |= set(range(k, k + size))
                seen.add(key)
            expected[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
        found = substring_dedup.deduplicated(docs, words=size, chunk_bytes=chunk).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == expected


def test_substring_dedup_of_repeated_and_null_ids(spark):
    texts = [sentence(60) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0] + " end"), (None, None), (7, texts[1]), (7, texts[1]), (7, texts[2]), (9, texts[3]), (9, "x " + texts[3]), (9, texts[3])] * 3
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 19):
            at = (-1 if i is None else i, p)
            first[tuple(w[p : p + 20])] = min(first.get(tuple(w[p : p + 20]), at), at)

    def kept(i, t):
        w = words(t)
        gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] != (-1 if i is None else i, p) for q in range(p, p + 20)}
        return " ".join(x.decode() for q, x in enumerate(w) if q not in gone)

    found = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=300).collect()
    assert collections.Counter((r.doc_id, r.kept) for r in found) == collections.Counter((i, kept(i, t)) for i, t in rows)


def test_rows_of_one_id_are_dealt_over_chunks(spark):
    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    dealt, n = chunked(rows, "doc_id", "text", 1000)
    assert max(r["count"] for r in dealt.groupBy("chunk").count().collect()) < 8 * 2000 / n


def test_null_ids_are_not_held_out(spark, tmp_path):
    text = [(i, sentence(30) + " bad" * (i % 2)) for i in range(40)] + [(None, "the of"), (None, None)]
    spark.createDataFrame(text, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op7_attention_quality", "op8_segments", "op9_ppm"):
        held = [(r.doc_id, r.held_out) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(held) == 42 and [x for i, x in held if i is None] == [False, False]
        assert {x for _, x in held} == {True, False}


def test_texts_learned_from_are_bounded_whole():
    assert quality.fitting([("c", 4), ("a", 5), ("b", 9), (None, None), ("d", 1)], 10) == ["b"]
    assert quality.fitting([("a", 11), ("b", 10)], 10) == ["a"] and quality.fitting([], 10) == []


def test_attention_learns_by_parts_as_by_all_at_once():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 30, 40)
    first = np.concatenate([[0], np.cumsum(sizes)])
    x, y = rng.normal(size=(first[-1], quality.FEATURES)).astype(np.float32), rng.integers(0, 2, 40).astype(float)
    found = []
    for together in (10**6, 50, 1):
        model = quality.Attention()
        model.fit(x, first, y, steps=20, together=together)
        found.append(model.score(x.astype(np.float64), first)[0])
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])


def test_attention_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    first = np.array([0, 2, 3, 7])
    x, y = rng.normal(size=(7, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    model = quality.Attention()

    def loss():
        p = model.forward(x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    for name, g in model.gradient(x, first, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, ends = model.w[name][at], []
        for step in (1e-5, -1e-5):
            model.w[name][at] = was + step
            ends.append(loss())
        model.w[name][at] = was
        assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-5


def test_grades_give_what_each_level_gives_alone():
    rng = random.Random(8)
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    odds = {w if rng.random() < 0.5 else w[:4] + b"*": (rng.uniform(-3, 3), rng.uniform(-6, 6)) for w in words[:150]}
    text = [rng.choice(words) for _ in range(2000)]
    graded = toxicity._Graded(odds)
    for level, found in zip(toxicity.LEVELS, graded.found(graded.grades(text)), strict=True):
        assert found == toxicity.Model({w: x for w, x in odds.items() if abs(x[1]) >= level}).found(text)
    assert any(graded.found(graded.grades(text)))


def test_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def shingles(t, n=5):
    w = words(t, lower=True)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def linked(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates(docs, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    expected = {i: (len(sets[i]), c, c == i) for i, c in linked(sets).items()}
    found = near_dedup.near_duplicates(docs.union(docs.where("doc_id = 3"))).distinct().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == expected


def test_components(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(100, 130)] + [(5, 5), (7, 3), (3, 7), (3, 130)], "a long, b long")
    found = {r.node: r.component for r in components(rows).collect()}
    assert set(found.values()) == {3} and len(found) == 33
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    rows = spark.createDataFrame(pairs, "a long, b long").repartition(40)
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.node: r.component for r in components(rows).collect()} == {x: find(x) for x in list(parent)}


def test_rest_joins_components(spark):
    """Links between sets that no star has shown are found by the exact join of what stars left apart."""
    sets = [np.sort(np.array(rng.sample(range(10**6), 40), np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate([s[:37], [np.uint64(i + 2 * 10**6)]])) for i, s in enumerate(sets)]
    rows = [(i, len(s), s.astype(np.int64).tolist(), i) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "cls long, n long, set array<long>, comp long")
    for block in (8_000_000, 600):
        assert {tuple(r) for r in near_dedup._rest(df, 75, block).collect()} == {(i, i + 20) for i in range(20)}


def test_secrets(spark, docs, texts):
    hexes = "0123456789abcdef" * 2
    more = {1000: f'é API_KEY: "abcDEF12" token=short AKIA{"A" * 12} {hexes}g {hexes[:31]}', 1001: "key Zk8Jq2Lw9Xv4Tn7Rb1Yc6Md3 end", 1002: None, 1003: "", 1004: "ſecret=abcdefgh1"}
    df = docs.select("doc_id", "text", "spans").union(spark.createDataFrame([(i, t, 0) for i, t in more.items()], "doc_id long, text string, spans int"))
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secrets.train(secrets.samples(spark, corpus, random_strings=500))
    found = {r.doc_id: r for r in secrets.digests(secrets.scan(df, model)).collect()}
    assert len(found) == len(texts) + 5
    row, t = found[1000], more[1000]
    spans = [(m.start(), m.end()) for m in (re.search(r'API_KEY: "abcDEF12', t), re.search("AKIAA+", t), re.search(hexes, t))]
    base = ",".join(f"{k}:{a}:{b}" for k, (a, b) in zip(("assign", "access", "hex"), spans))
    assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256) == (1, 1, 1, hashlib.sha256(base.encode()).hexdigest())
    assert found[1001].n_markov == 1 and found[1004].n_assign == 0
    assert found[1002].spans == found[1003].spans == "" and found[1].n_markov == 0


def test_secrets_as_plain_version(spark, tmp_path):
    """The registered query against a plain one that holds each run against all spans, on texts with many keys."""
    import time

    own = random.Random(31)
    key = lambda n: "".join(own.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    forms = [lambda: key(24), lambda: f"token={key(9)}", lambda: "AKIA" + key(14).upper(), lambda: own.randbytes(16).hex(), lambda: f"a/{key(20)}/b-{key(17)}", lambda: "some_ordinary_identifier_name", lambda: "word", lambda: f"passwd: '{key(20)}'/{key(22)}", lambda: "é"]
    rows = [(i, " ".join(own.choice(forms)() for _ in range(own.randint(0, 12)))) for i in range(200)] + [(900, None), (901, ""), (None, "secret=abcdefgh"), (902, " ".join(key(24) for _ in range(20_000)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")
    model = secrets.train(secrets.samples(spark, docs))
    began = time.time()
    found = {r.doc_id: r for r in QUERIES["op3_markov_secrets"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 60 and len(found) == len(rows)
    for i, t in rows[:-1]:
        spans, t = [], t or ""
        for kind, pattern, group, least in (("assign", secrets.ASSIGN, 2, 8), ("access", secrets.ACCESS, 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)):
            spans += [(m.start(), m.end(), kind) for m in pattern.finditer(t) if len(m[group]) >= least]
        base = sorted(spans, key=lambda x: (x[0], secrets.KINDS.index(x[2])))
        runs = 0
        for m in secrets.CANDIDATE.finditer(t):
            runs += 1
            for a, b in [m.span(), *(x.span() for x in secrets.PIECE.finditer(t, *m.span()))]:
                total, mean = model.score(t[a:b])
                if total >= 12 and mean >= 0.35 and not any(x <= a and b <= y for x, y, _ in spans):
                    spans.append((a, b, "markov"))
        shown = lambda s: ",".join(f"{k}:{a}:{b}" for a, b, k in s)
        told = found[i]
        assert told.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest() and told.spans == shown(secrets.ordered(spans))
        assert (told.n_assign, told.n_access, told.n_hex, told.n_markov) == tuple(sum(k == kind for *_, k in spans) for kind in secrets.KINDS)
        assert told.n_runs == runs and (told.best_per_char is None) == (runs == 0) and told.n_likely <= runs
    assert found[902].n_markov > 10_000 and sum(r.n_markov > 0 for r in found.values()) > 50


def test_markov_pair_on_held_out_strings(spark):
    """Random strings are found, identifiers of a language and of styles that were not learned from are left alone."""
    import base64

    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secrets.train(secrets.samples(spark, corpus))
    r = random.Random(77)
    keys = [base64.b64encode(r.randbytes(24)).decode() for _ in range(300)] + [r.randbytes(14).hex() for _ in range(300)]
    keys += ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20)) for _ in range(300)]
    english = "get set elements by class name and attribute abstract singleton proxy factory bean request context handler listener default value string builder input output stream reader writer manager service controller internal frame painter window state property".split()
    names = []
    for _ in range(900):
        w = [r.choice(english) for _ in range(r.randint(3, 6))]
        names.append(r.choice(["_".join(w), "-".join(w), "/".join(w), "".join(x.title() for x in w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper(), "".join(x.title() for x in w) + "2"]))
    names = [x for x in names if len(x) >= secrets.CANDIDATE_CHARS] + ["AbstractSingletonProxyFactoryBean2", "getElementsByClassNameAndAttribute"]
    names = ["".join(r.choice("0123456789") for _ in range(16)) for _ in range(100)] + names
    rows = [(i, f"x {t} y") for i, t in enumerate(keys + names)]
    found = {x.doc_id: len(x.spans) > 0 for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    recall = sum(found[i] for i in range(len(keys))) / len(keys)
    alarms = sum(found[i] for i in range(len(keys), len(rows))) / len(names)
    assert recall > 0.95 and alarms < 0.01, (recall, alarms)
    assert not found[len(rows) - 1] and not found[len(rows) - 2]
    path = [(0, "see src/main/java/org/" + keys[700] + "/index for it")]
    assert secrets.scan(spark.createDataFrame(path, "doc_id long, text string"), model).first().spans


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 1, 5)]) for i in range(60)]
    rows += [(100, rows[0][1]), (120, rows[0][1]), (140, [1.0, None, 0.0, 0.0, 0.0]), (160, [float("nan")] * 5), (180, None), (200, []), (201, []), (None, rows[1][1]), (220, [0.5] * 3), (240, [0.25] * 3), (101, rows[3][1]), (101, rows[4][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ok = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    expected = []
    for q, v in ok:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:7]
            expected += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    found = bsi_topk.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    import duckdb

    embeddings = df.toPandas()  # noqa: F841
    told = duckdb.sql(ORACLE["op2_bit_sliced_topk"]).fetchall()
    assert sorted(told) == sorted(map(tuple, bsi_topk.top_k(df, df.where("vec_id % 20 = 0")).collect()))


def test_decontamination(spark, docs, texts):
    items = [(1, "Ab cd, ef gh ij kl mn op qr st uv wx"), (2, "too short"), (3, None), (4, "a b a b a b a b a b a b c")]
    leaks = {2000: "before words " + items[0][1].upper() + "!! after", 2001: items[0][1].replace("wx", "other"), 2002: items[3][1], 2003: "ab cd ef gh ij", 2004: None, 2005: "x y z " + items[0][1]}
    df = docs.select("doc_id", "text", "cls").union(spark.createDataFrame([(i, t, 0) for i, t in leaks.items()], "doc_id long, text string, cls int"))
    found = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 6)) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(2000, 1): (2, 1.0), (2001, 1): (0, round(7 / 9, 6)), (2002, 4): (0, 1.0), (2005, 1): (3, 1.0)}


def test_decontamination_as_brute_force(spark, docs, texts, tmp_path):
    """The registered query against all windows of all sizes, with items whose shingles repeat."""
    letters = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    runs = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    own = random.Random(61)
    sentence = lambda n: " ".join(own.choice(VOCABULARY) for _ in range(n))
    common = sentence(40)
    items = {1: common, 2: sentence(25), 3: None, 4: "a b " * 12, 5: " ".join(common.split()[:30]), 6: "of the x"}
    more = dict(texts)
    for k in range(80):
        w = (items[own.choice([1, 2, 4, 5])]).split()
        for _ in range(own.randint(0, 2)):
            w[own.randrange(len(w))] = own.choice(["zz", "the"])
        more[500 + k] = " ".join([sentence(own.randint(0, 20)), *w, sentence(own.randint(0, 20))])
    spark.createDataFrame(list(more.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = {}
    for i, t in more.items():
        d = runs(letters(t))
        for j, item in items.items():
            if not (h := runs(letters(item))) or not d:
                continue
            b, best = collections.Counter(h), (0, 0)
            for k in range(max(1, len(d) - len(h) + 1)):
                a = collections.Counter(d[k : k + len(h)])
                best = max(best, (sum((a & b).values()) / sum((a | b).values()), -k))
            if best[0] >= 0.75:
                expected[i, j] = (-best[1], round(best[0], 9))
    found = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 9)) for r in QUERIES["op6_simhash_decontamination"](spark, str(tmp_path)).collect()}
    assert found == expected and len(expected) > 20


def test_pseudonyms(spark):
    t = "a.b7@x.org +1 (017) 555-7713 017-555-7713 4539578763621486 4539578763621487 97.51.17.173 300.1.1.1 2001-02-28 28.02.2001 2001-02-30 123-45-6789 GB82 WEST 1234 5698 7654 32"
    df = spark.createDataFrame([(1, t, "x"), (2, None, "x"), (3, "", "x"), (4, t, "x")], "doc_id long, text string, found string")
    out = pseudonyms.pseudonymised(df, b"key")
    rows = {r.doc_id: r for r in out.collect()}
    new = rows[1].text
    assert rows[4].text == new and rows[2].text is None and rows[3].text == "" and len(new) == len(t)
    assert rows[1].found == {"email": 1, "phone": 2, "card": 1, "ip": 1, "date": 2, "ssn": 1, "iban": 1}
    old, fresh = t.split(), new.split()
    assert "4539578763621487" in fresh and "300.1.1.1" in fresh and "2001-02-30" in fresh
    assert fresh[2] + fresh[3] == f"({fresh[4][:3]}){fresh[4][4:]}" and fresh[4] != old[4] and not pseudonyms.luhn(fresh[5])
    back = pseudonyms.pseudonymised(out, b"key", restore=True)
    assert {r.doc_id: r.text for r in back.collect()} == {1: t, 2: None, 3: "", 4: t}
    others = ["иван.Петр7", "łżś", "日本", "a" * 416 + "b", "x" * 70, "ñandú"]
    df = spark.createDataFrame([(i, f"<{x}@x.org>") for i, x in enumerate([*others, "..__"])], "doc_id long, text string")
    out = pseudonyms.pseudonymised(df, b"key")
    for r in out.collect():
        local = r.text[1:-7]
        if r.doc_id == len(others):
            assert local == "..__" and not r.found
        else:
            old = others[r.doc_id]
            assert r.found == {"email": 1} and len(local) == len(old) and local[:40] != old[:40] and local[-40:] != old[-40:]
            assert all(pseudonyms.alphabet(x) == pseudonyms.alphabet(y) for x, y in zip(old, local))
    assert {r.text for r in pseudonyms.pseudonymised(out, b"key", restore=True).collect()} == {r.text for r in df.collect()}
    for n in (2, 9, 100):
        p = pseudonyms.Permutation(b"z")
        image = [p.next("t", n, x) for x in range(n)]
        assert sorted(image) == list(range(n)) and all(x != y for x, y in enumerate(image)) and [p.next("t", n, y, -1) for y in image] == list(range(n))


def test_bpe(docs, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    for part in (bpe.PART, 100):
        rows = bpe.decode(bpe.encode(docs, vocabulary(), leaf=16, part=part, decoded_col="score"), vocabulary()).collect()
        assert sorted(r.doc_id for r in rows) == sorted(texts)
        for r in rows:
            ids = whole.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == r.score == whole.decode(ids, skip_special_tokens=False)
    tree = bpe.TreeEncoder(vocabulary(), leaf=8)
    for alphabet in ("abcdefgh", "aab", "éèab", "A1é!?.", "'st", "日本 İΣ", "<|endoftext|> x", "ab c\t\n", "e\u0301 \u00a0\x1c"):
        some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) + rng.choice(["", "<|endoftext|>"]) for _ in range(40)]
        ids, begin = tree.texts(some)
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in some]


def test_bpe_joins_long_texts(spark, tmp_path):
    """The registered query on texts of many leaves, and of pieces far over one, that no white space cuts."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    letters = "".join(rng.choice("abcdeilnorst") for _ in range(60_000))
    rows = [(0, letters), (1, sentence(30_000)), (2, "A1é!" * 5000), (3, " ".join(letters[k : k + 9000] for k in range(0, 60_000, 9000))), (4, None), (5, " \t" * 4000 + "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = {}
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        expected[i] = (len(ids), hexed(" ".join(map(str, ids))), hexed(whole.decode(ids, skip_special_tokens=False)))
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_tree_bpe"](spark, str(tmp_path)).collect()}
    assert found == expected


def test_bpe_of_long_runs(spark, tmp_path):
    """The registered query on words of one character, or of few that come again and again, up to a million of them."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    assert bpe.TreeEncoder(vocabulary()).merges.in_order
    rows = [(k, unit * (n // len(unit)) + unit[: n % len(unit)]) for k, (unit, n) in enumerate([("a", 1_000_001), ("=", 100_003), ("-", 16_411), ("ab", 99_999), ("A1b/+", 50_001), ("é", 20_001), ("aab", 4097), ("ha", 8195), ("<|endoftext|>", 9_001)])]
    rows += [(100, "word " + "a" * 12_345 + " word"), (101, ("x" * 5001 + " ") * 3), (102, "a" * 2_000_003)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_tree_bpe"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = whole.encode(t, add_special_tokens=False).ids
        assert found[i] == (len(ids), hexed(" ".join(map(str, ids))), hexed(whole.decode(ids, skip_special_tokens=False)))


def test_ppm(spark, docs, texts):
    order, counts = 2, collections.defaultdict(collections.Counter)
    packed = lambda t: [256] * order + list((t or "").encode()) + [256]
    for t in texts.values():
        q = packed(t)
        for p in range(order, len(q)):
            for k in range(order + 1):
                counts[tuple(q[p - k : p])][q[p]] += 1

    def log10(context, symbol):
        excluded, out = set(), 0.0
        for k in range(order, -1, -1):
            if seen := counts.get(tuple(context[order - k :])):
                left = {s: n for s, n in seen.items() if s not in excluded}
                total = sum(left.values()) + len(left)
                if symbol in left:
                    return out + np.log10(left[symbol] / total)
                if left:
                    out += np.log10(len(left) / total)
                excluded |= set(seen)
        return out - np.log10(257 - len(counts[()]))

    trie = ppm.Trie(ppm.train(docs, order=order, max_edges=10**6))
    tests = ["the of", "", None, "zebra ñ", "the ander\n\0"]
    assert np.allclose(trie.score(tests), [sum(log10(packed(t)[p - order : p], packed(t)[p]) for p in range(order, len(packed(t)))) for t in tests])
    assert abs(sum(10 ** log10([101, 102], s) for s in range(257)) - 1) < 1e-9
    df = docs.withColumn("train", F.col("doc_id") % 3 != 0)
    c = collections.Counter()
    for i, t in texts.items():
        if i % 3:
            c.update([*words(t, lower=True), None])
    size = sum(c.values()) + len(c) + 1
    for r in ppm.unigram(df, "train", chunk_bytes=700).collect():
        tokens = [*words(texts[r.doc_id], lower=True), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), sum(c.values()))
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / size) for w in tokens)) < 1e-6


def test_segments():
    for _ in range(200):
        s = [rng.choice([-0.2, -0.2, -1.0, 1.5, 3.0]) for _ in range(rng.randint(1, 40))]

        def split(a, b):  # all maximal segments by their definition
            best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return [] if best[0] <= 1e-12 else [*split(a, best[3]), (best[3], best[4] - 1), *split(best[4], b)]

        at = [i for i, x in enumerate(s) if x != -0.2]
        found = toxicity.segments(at, [s[i] for i in at])
        assert abs(max((x for *_, x in found), default=0) - max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])) < 1e-9
        assert sum(b - a + 1 for a, b, _ in found) == sum(b - a + 1 for a, b in split(0, len(s)))


def auc(score, label):
    pairs = [(a > b) + (a == b) / 2 for a, x in zip(score, label) if x for b, y in zip(score, label) if not y]
    return sum(pairs) / len(pairs)


def test_classifiers(spark):
    texts = [(i, sentence(120) + (" idiot scum" * 3 if i % 4 == 0 else ""), int(i % 4 == 0), int(i % 3 > 0)) for i in range(240)]
    texts = [(i, t if q else t.upper().replace(" ", "!! "), x, q) for i, t, x, q in texts]
    rows = [(i, t, "x", "y") for i, t, *_ in texts] + [(900, None, "x", "y"), (901, "", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, attention string")
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in texts] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module, column, at in ((toxicity, "toxic", 2), (quality, "quality", 3)):
        model = module.train(docs.drop("score"), labels.where("doc_id % 5 > 0 or doc_id is null"), label_col=column)
        found = {r.doc_id: r.score for r in module.score(docs, model).collect()}
        held = [x for x in texts if x[0] % 5 == 0]
        assert auc([found[x[0]] for x in held], [x[at] for x in held]) > 0.95
        assert len(found) == 242 and all(0 <= x <= 1 for x in found.values())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_dedup.near_duplicates(docs).count() == 0
    assert substring_dedup.deduplicated(docs).count() == 0
    assert ppm.unigram(docs.withColumn("train", F.lit(True)), "train").count() == 0
    assert ppm.score(docs, ppm.train(docs)).count() == 0
    assert decontaminate.contaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert bpe.encode(docs, vocabulary()).count() == 0
    assert pseudonyms.pseudonymised(docs, b"k").count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 0
    assert quality.score(docs, quality.train(docs, labels)).count() == 0
    assert secrets.scan(docs, secrets.train(secrets.samples(spark, docs, 50))).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bsi_topk.top_k(vectors, vectors).count() == 0
    # models of nothing still score
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ppm.score(some, ppm.train(docs)).first().score < 0


def test_sql(spark):
    import duckdb

    for name, sql in ORACLE.items():
        con = duckdb.connect()
        for table in ("documents", "embeddings"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
        assert sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=repr) == sorted(con.sql(sql).fetchall(), key=repr)
