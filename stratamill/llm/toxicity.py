"""Toxicity: maximum-scoring segments of token log-odds, calibrated as extreme values.

A token is a word, letters and digits only, A-Z lowered. Its score comes from the log-odds of toxic against other
documents with an informative Dirichlet prior, taken for the word and for its beginnings of 4 to 10 bytes; the most
significant of these counts, if it reaches a level that is chosen out of sample; other tokens count as slightly clean. One linear scan finds all
maximal segments of a text's scores. Under chance, the best score S of n tokens of clean text follows an extreme-value
law, P(S < x) = exp(-K n exp(-lambda x)); lambda and K are fitted to clean documents. Segments are significant by
their expected number under that law; the sum of a document's normalised scores, with its own law for the number of
segments, is the evidence that a logistic curve turns into a probability.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm._shared import checkpointed, drawn, field, lean, map_texts

#: At most about this many labelled documents are learned from, drawn by a hash of their id.
TRAIN_DOCS = 10_000
#: Pseudo-documents: so many of each token, and so many shared out by how frequent tokens are.
LEAST_PRIOR, PRIOR = 0.5, 500.0
LEAST_DOCS = 4
#: Significances from which tokens count; the level is chosen by what one half of the texts teaches of the other.
LEVELS = (2.5, 3.0, 3.5, 4.0, 4.5)
BACKGROUND = -0.2
#: A document counts as toxic if it is with at least this probability.
TOXIC = 0.3
#: Log-odds of all texts under a model that has learned of no toxic or no clean text.
UNKNOWN = -30.0
BEGINNINGS = range(4, 11)
FOLD = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def segments(at: list[int], scores: list[float], background: float = BACKGROUND) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, first and last token and score, in one pass over the positive tokens; those
    between have the background score or, where they are listed too, their own."""
    out: list[list] = []  # first, last, sum before, sum after
    total, then = 0.0, -1
    for i, s in zip(at, scores, strict=True):
        total += background * (i - then - 1)
        then = i
        if s <= 0:
            total += s
            continue
        new = [i, i, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(a, b, high - low) for a, b, low, high in out]


def strongest(odds: dict[bytes, tuple[float, float]], w: bytes) -> tuple[float, float]:
    """A token's score and its significance: of its own odds and those of its beginnings the most significant count."""
    found = [x for n in BEGINNINGS if n <= len(w) and (x := odds.get(w[:n] + b"*"))]
    if x := odds.get(w):
        found.append(x)
    if not found:
        return BACKGROUND, 0.0
    best, z = max(found, key=lambda x: abs(x[1]))
    return best if best > 0 else BACKGROUND + max(best, -2.0) / 4, abs(z)


class Model:
    def __init__(self, odds: dict[bytes, tuple[float, float]]):
        self.odds = odds  # token: log-odds and significance; beginnings end in a star
        self.rate, self.k, self.slope, self.shift = 1.0, 1.0, 1.0, 0.0
        self.memo: dict[bytes, float] = {}

    def token(self, w: bytes) -> float:
        s = self.memo.get(w)
        if s is None:
            s = strongest(self.odds, w)[0]
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[w] = s
        return s

    def found(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        scores = [self.token(w) for w in words]
        at = [i for i, s in enumerate(scores) if s != BACKGROUND]
        return segments(at, [scores[i] for i in at]) if at else []

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """Minus the log of the chance of a sum of normalised scores so high, for the best number of segments."""
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted((s for *_, s in found), reverse=True), 1):
            x = self.rate * s - math.log(max(1e-9, self.k * n))
            if x <= 0:
                break
            total += x
            # Karlin and Altschul's law for sums, with the orders of segments left free
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def law(self, values: np.ndarray, times: np.ndarray, tops: list[tuple[float, int]]) -> None:
        """The law of clean texts, from the different scores of their tokens, how often these occur, and of each text
        its best segment's score and its number of tokens."""
        each, of = values, times / max(1, times.sum())
        mean = lambda x: float((x * of).sum())
        if (each > 0).any() and mean(each) < 0:
            low, high = 1e-6, 1.0
            while mean(np.exp(high * each)) < 1 and high < 64:
                high *= 2
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if mean(np.exp(np.minimum(mid * each, 700))) < 1 else (low, mid)
            self.rate = low
        waits = [n * math.exp(-self.rate * s) for s, n in tops if n]
        self.k = 1 / max(1.0, float(np.mean(waits))) if waits else 1.0

    def curve(self, x: np.ndarray, y: np.ndarray) -> None:
        """The curve from evidence to probability, from texts' evidence and labels."""
        x = np.log1p(x)
        a, b = 1.0, -2.0
        for _ in range(50):  # Newton's steps with a little ridge
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
            w = p * (1 - p)
            h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
        self.slope, self.shift = max(a, 1e-3), b

    def score(self, words: list[bytes]) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability, and the segments of which clean texts as long hold less than one in a hundred."""
        found = self.found(words)
        x = math.log1p(self.evidence(found, len(words)))
        sure = [(a, b, s) for a, b, s in found if self.k * len(words) * math.exp(-self.rate * s) < 0.01]
        return 1 / (1 + math.exp(-(self.slope * x + self.shift))), sure


class _Graded:
    """Segments at all levels at once. A token counts at the levels that its significance reaches, so one look at it
    serves them all."""

    def __init__(self, odds: dict[bytes, tuple[float, float]]):
        self.odds, self.memo = odds, {}

    def grades(self, words: list[bytes]) -> list[tuple[float, float]]:
        out = []
        for w in words:
            x = self.memo.get(w)
            if x is None:
                if len(self.memo) > 100_000:
                    self.memo.clear()
                x = self.memo[w] = strongest(self.odds, w)
            out.append(x)
        return out

    @staticmethod
    def found(grades: list[tuple[float, float]]) -> list[list[tuple[int, int, float]]]:
        held = [(i, s, z) for i, (s, z) in enumerate(grades) if s != BACKGROUND]
        out = []
        for level in LEVELS:
            held = [x for x in held if x[2] >= level]
            out.append(segments([i for i, _, _ in held], [s for _, s, _ in held]))
        return out


def _calibrate(model: Model, folds: list[dict], both: DataFrame) -> None:
    """Chooses the model's level, and fits its law and curve, by texts, labels and folds; each text is measured by the
    log-odds that the other fold's texts have given. Texts are read where they are; what is gathered is a few numbers a
    text and level, and the tokens' different scores, which are no more than the models have tokens."""
    context = both.sparkSession.sparkContext
    odds = context.broadcast(folds)
    told_as = ["level", "score", "n", "top"]

    def measure(batches):
        graded = [_Graded(x) for x in odds.value]
        times: Counter = Counter()
        for batch in batches:
            n, tops = [], [[] for _ in LEVELS]
            for text, label, fold in zip(*batch.columns, strict=True):
                if label.as_py():
                    continue
                grades = graded[fold.as_py()].grades(tokens(text.as_py()))
                times.update(grades)
                n.append(len(grades))
                for k, found in enumerate(_Graded.found(grades)):
                    tops[k].append(max((s for *_, s in found), default=0.0))
            for k, top in enumerate(tops):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int32()), pa.nulls(len(n), pa.float32()), pa.array(n, pa.int64()), pa.array(top, pa.float64())], names=told_as)
        for k, level in enumerate(LEVELS):
            at: Counter = Counter()
            for (s, z), n in times.items():
                at[s if z >= level else BACKGROUND] += n
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(list(at), pa.float32()), pa.array(list(at.values()), pa.int64()), pa.nulls(len(at), pa.float64())], names=told_as)

    measured = checkpointed(both.mapInArrow(lean(measure), "level int, score float, n long, top double"))
    told = measured.where("score is not null").groupBy("level", "score").agg(F.sum("n").alias("n")).orderBy("level", "score").toArrow()
    tops = measured.where("score is null").select("level", "top", "n").orderBy("level", "top", "n").collect()
    laws = []
    for k in range(len(LEVELS)):
        mine = told.column("level").to_numpy() == k
        model.law(told.column("score").to_numpy()[mine].astype(np.float64), told.column("n").to_numpy()[mine], [(r.top, r.n) for r in tops if r.level == k])
        laws.append((model.rate, model.k))
    laws_told = context.broadcast(laws)

    def weigh(batches):
        graded, models = [_Graded(x) for x in odds.value], []
        for rate, k in laws_told.value:
            models.append(Model({}))
            models[-1].rate, models[-1].k = rate, k
        for batch in batches:
            each: list[list[float]] = [[] for _ in models]
            for text, fold in zip(batch.column(0), batch.column(2), strict=True):
                grades = graded[fold.as_py()].grades(tokens(text.as_py()))
                for x, own, found in zip(each, models, _Graded.found(grades), strict=True):
                    x.append(own.evidence(found, len(grades)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.float64()) for x in each), batch.column(1)], names=[*(f"x{k}" for k in range(len(models))), "y"])

    names = [f"x{k}" for k in range(len(LEVELS))]
    pairs = both.mapInArrow(lean(weigh), ", ".join(f"{x} double" for x in names) + ", y int").orderBy("y", *names).toArrow()
    y = pairs.column("y").to_numpy().astype(np.float64)
    fitted = []
    for k, name in enumerate(names):
        x = pairs.column(name).to_numpy()
        model.curve(x, y)
        p = np.clip(1 / (1 + np.exp(-(model.slope * np.log1p(x) + model.shift))), 1e-9, 1 - 1e-9)
        fitted.append((-float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), -k, model.slope, model.shift))
    _, k, model.slope, model.shift = min(fitted)
    model.rate, model.k = laws[-k]
    model.odds = {w: x for w, x in model.odds.items() if abs(x[1]) >= LEVELS[-k]}
    model.memo = {}


def _odds(counted: DataFrame, c: Column, t: Column) -> dict[bytes, tuple[float, float]]:
    """Log-odds and significance of the tokens that tell toxic from other texts; no more than a sample of bounded size
    has. c, t: in how many clean and toxic texts each token is."""
    nc, nt = (x or 0 for x in counted.agg(F.sum(c), F.sum(t)).first())
    if not nc or not nt:
        return {}
    prior = LEAST_PRIOR + F.lit(PRIOR) * (c + t) / (nc + nt)
    odds = F.log((t + prior) / (nt + PRIOR - t + prior)) - F.log((c + prior) / (nc + PRIOR - c + prior))
    z = odds / F.sqrt(1 / (t + prior) + 1 / (c + prior))
    rows = counted.where(c + t >= LEAST_DOCS).select("w", odds.alias("d"), z.alias("z")).where(F.abs("z") >= LEVELS[0]).orderBy("w").collect()
    return {bytes(w): (d, s) for w, d, s in rows}


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS) -> Model:
    """The model of labelled documents; of two labels for one id the larger counts, null ids, labels and texts take
    no part, and equal texts count once. Without documents of both labels, or tokens that tell them apart, nothing is
    known to be toxic, and all have the lowest score. The level of significance, the law and the curve are fitted out
    of sample: texts are dealt into two folds, and each is measured by what the other has taught."""
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    sample = drawn(clean, id_col, max_docs)  # about max_docs rows of two numbers
    both = docs.select(id_col, F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(sample), id_col)
    both = both.groupBy(F.sha2("_text", 256).alias("_key")).agg(F.first("_text").alias("_text"), F.max("_label").alias("_label"))
    fold = F.pmod(F.xxhash64("_key"), F.lit(2)).cast("int")
    both = checkpointed(both.select("_text", F.least("_label", F.lit(1)).alias("_label"), fold.alias("_fold")))

    def count(batches):
        def told(held):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), *(pa.array([n[k] for n in held.values()], pa.int64()) for k in range(4))], names=["w", "c0", "t0", "c1", "t1"])

        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, label, fold in zip(*batch.columns, strict=True):
                words = set(tokens(text.as_py()))
                at = 2 * fold.as_py() + label.as_py()
                for w in words | {w[:n] + b"*" for w in words for n in BEGINNINGS if n <= len(w)}:
                    held.setdefault(w, [0, 0, 0, 0])[at] += 1
                if len(held) > 100_000:  # handed on, so that a task holds no more
                    yield told(held)
                    held.clear()
        yield told(held)

    counts = ["c0", "t0", "c1", "t1"]
    counted = both.mapInArrow(lean(count), "w binary, c0 long, t0 long, c1 long, t1 long").groupBy("w").agg(*(F.sum(x).alias(x) for x in counts))
    counted = checkpointed(counted.where(f"{' + '.join(counts)} >= {LEAST_DOCS}"))
    c0, t0, c1, t1 = map(F.col, counts)
    model = Model(_odds(counted, c0 + c1, t0 + t1))
    if not model.odds:
        model.shift = UNKNOWN
        return model
    _calibrate(model, [_odds(counted, c1, t1), _odds(counted, c0, t0)], both)
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", passages_col: str = "passages") -> DataFrame:
    """df with each whole text's probability of being toxic, 0 to 1, and its significant passages: first and last
    token and score. Null and empty texts have no passage and the lowest score. Columns of these names give way."""
    # what is broadcast holds no class of this library, which executors may not have
    shared = df.sparkSession.sparkContext.broadcast((model.odds, model.rate, model.k, model.slope, model.shift))

    def make():
        own = Model(shared.value[0])
        own.rate, own.k, own.slope, own.shift = shared.value[1:]

        def run(texts):
            found = [own.score(tokens(t)) for t in texts]
            return [[p for p, _ in found], [[{"first": a, "last": b, "score": s} for a, b, s in x] for _, x in found]]

        return run

    return map_texts(df, text_col, [field(score_col, "double"), field(passages_col, "array<struct<first:int,last:int,score:double>>")], make)
