"""Operators do their whole job: cases that a cut of models, rows or texts would get wrong."""

import collections
import math
import random

from stratamill.llm import toxicity
from stratamill.llm.queries import QUERIES


def test_ppm_keeps_all_edges(spark, tmp_path):
    """Scores of a corpus of far over 500,000 edges, most of them seen once, against counts of all contexts."""
    rng, order = random.Random(3), 4
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789é日"
    rows = [(i, "".join(rng.choice(letters) for _ in range(900))) for i in range(400)] + [(400, None), (401, ""), (None, "null id"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op9_ppm"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    out = {r.doc_id for r in found if r.held_out}
    counts = collections.defaultdict(collections.Counter)
    coded = lambda t: [256] * order + list((t or "").encode()) + [256]
    for i, t in rows:
        if i is not None and i not in out:
            q = coded(t)
            for p in range(order, len(q)):
                for k in range(order + 1):
                    counts[tuple(q[p - k : p])][q[p]] += 1
    assert sum(map(len, counts.values())) > 600_000

    def log10(context, symbol):
        excluded, total = set(), 0.0
        for k in range(order, -1, -1):
            if seen := counts.get(tuple(context[order - k :])):
                left = {s: c for s, c in seen.items() if s not in excluded}
                n = sum(left.values()) + len(left)
                if symbol in left:
                    return total + math.log10(left[symbol] / n)
                total += math.log10(len(left) / n) if left else 0
                excluded |= set(seen)
        return total - math.log10(257 - len(counts[()]))

    score = lambda t: sum(log10(coded(t)[p - order : p], coded(t)[p]) for p in range(order, len(coded(t))))
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(score(t) if i is None or i % 20 == 0 or i in (7, 401) or i in out else None)
    for r in found:
        if None not in texts[r.doc_id]:
            assert any(abs(r.score - s) < 1e-6 for s in texts[r.doc_id])


def test_toxicity_gathers_no_texts(spark, monkeypatch):
    """Training sends no texts to the driver, and tells toxic texts apart."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(150)) + (" vilescum" * 4 if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sent, kinds = [], []
    for name in ("toArrow", "collect"):
        plain = getattr(type(df), name)

        def told(self, *args, plain=plain, **kwargs):
            kinds.extend(k for _, k in self.dtypes)
            sent.append(plain(self, *args, **kwargs))
            return sent[-1]

        monkeypatch.setattr(type(df), name, told)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert sent and "string" not in kinds and not any("array" in k for k in kinds)
    probabilities = [model.score(toxicity.tokens(t))[0] for _, t, _ in rows]
    assert abs(sum(probabilities) - sum(y for *_, y in rows)) < 5
    assert min(p for p, (*_, y) in zip(probabilities, rows) if y) > max(p for p, (*_, y) in zip(probabilities, rows) if not y)


def test_toxicity_is_calibrated_out_of_sample(spark):
    """Labels that no word tells of give no confident scores, though words that happen to go with them are found."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), int(rng.random() < 0.2)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    fresh = [toxicity.tokens(" ".join(rng.choice(words) for _ in range(60))) for _ in range(200)]
    assert sum(model.score(t)[0] for t in fresh) / len(fresh) < 0.35


def test_words_of_structure_are_told_apart(spark, tmp_path):
    """A Thue-Morse word and its complement, which sums of powers modulo a power of two take for one another."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    # ids of rows that train and that don't
    rows = [(0, word), (1, other), (2, " ".join([word] * 19 + ["end"])), (3, " ".join([other] * 19 + ["end"])), (4, " ".join(word)), (5, " ".join(other))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    removed = {r.doc_id: r.n_removed for r in QUERIES["op4_anchor_dedup"](spark, str(tmp_path)).collect()}
    seen, expected = set(), {}
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 19):
            if (key := tuple(w[k : k + 20])) in seen:
                gone |= set(range(k, k + 20))
            seen.add(key)
        expected[i] = len(gone)
    assert removed == expected
    # the letters of both words have the same runs of five, so only documents 4 and 5 are copies
    assert {r.doc_id: r.component_id for r in QUERIES["op5_tensored_minhash"](spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    found = {r.doc_id: r for r in QUERIES["op9_ppm"](spark, str(tmp_path)).collect()}
    counts = collections.Counter(w for i, t in rows if not found[i].held_out for w in [*t.split(), None])
    assert {i: r.n_known for i, r in found.items()} == {i: sum(counts[w] > 0 for w in [*t.split(), None]) for i, t in rows}
