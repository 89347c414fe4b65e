"""Quality: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of 64 words. Each passage is encoded by shares of kinds of characters, lengths and
repetition, then by a learned layer. Gated attention, tanh(V h) times sigmoid(U h), weights the passages; the weighted
representation is scored by a logistic output. All weights are learned together from document labels alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.llm._grams import WordBuffer, byte_slices
from stratamill.llm._shared import checkpointed, drawn, field, lean, map_texts, slices

#: At most about this many labelled documents are learned from, drawn by a hash of their id.
TRAIN_DOCS = 6000
#: Their texts have no more than this many bytes in all; a text that no longer fits is passed over.
TRAIN_BYTES = 32_000_000
PASSAGE = 64
#: Passages whose gradient is taken at once; a longer text's passages stay together.
TOGETHER = 16_384
#: Classes of bytes that are counted apart.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!?", "*", "$", "%", "&", "#", "|", "\"'()-", "<>{}[]=/\\_@+~^`"]
FEATURES = len(CLASSES) + 1 + 7


def passages(texts: list[str | None]):
    """For slices of texts: the range, the first passage of each text and one more, and the passages' features.

    A text without words has one passage, all zeros.
    """
    classes = np.full(256, len(CLASSES), np.uint8)
    for i, c in enumerate(CLASSES):
        classes[[ord(x) for x in c]] = i
    for a, b in byte_slices(texts):
        w = WordBuffer(texts[a:b])
        many = np.maximum(1, -(-w.counts // PASSAGE))
        first = np.concatenate([[0], np.cumsum(many)])
        x = np.zeros((first[-1], FEATURES), np.float32)
        if len(w.start):
            of = first[w.text_of] + w.place // PASSAGE
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            rows, n = of[heads], np.diff(np.concatenate([heads, [len(of)]]))
            start, end = w.start[heads], w.end[heads + n - 1]
            size = (end - start).astype(np.float64)
            kind = classes[w.buffer]
            letters = size - (n - 1)
            for i in range(len(CLASSES) + 1):
                sums = np.concatenate([[0], np.cumsum(kind == i, dtype=np.int32)])
                # spaces between words are in the last class
                x[rows, i] = (sums[end] - sums[start] - (n - 1) * (i == len(CLASSES))) / letters
            length = (w.end - w.start).astype(np.float64)
            mean = np.add.reduceat(length, heads) / n
            keys = w.hashes()
            again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (of[1:] == of[:-1])])
            order = np.lexsort((keys, w.text_of))
            k, t, o = keys[order], w.text_of[order], of[order]
            new_text = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
            new_here = new_text | np.concatenate([[True], o[1:] != o[:-1]])
            base = len(CLASSES) + 1
            x[rows, base] = mean / 8
            x[rows, base + 1] = np.add.reduceat((length - mean[np.repeat(np.arange(len(n)), n)]) ** 2, heads) / n / 16
            x[rows, base + 2] = np.add.reduceat(again, heads) / n
            x[rows, base + 3] = np.bincount(o[new_here], minlength=first[-1])[rows] / n
            x[rows, base + 4] = np.bincount(o[new_text], minlength=first[-1])[rows] / n
            x[rows, base + 5] = np.log1p(n) / 4
            x[rows, base + 6] = np.log1p(w.counts[w.text_of[heads]]) / 8
        yield a, b, first, x


def fitting(sizes: list[tuple[str | None, int | None]], most: int) -> list[str | None]:
    """Of texts' keys and sizes the keys of those to pass over, so that the others have no more than so many bytes in
    all; texts are taken in the order of their keys, while they fit."""
    over = []
    for key, size in sorted(sizes, key=lambda x: x[0] or ""):
        if (size or 0) > most:
            over.append(key)
        else:
            most -= size or 0
    return over


class Attention:
    def __init__(self, features: int = FEATURES, hidden: int = 24, gate: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.w = {"E": draw(features, hidden), "e": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "g": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        w, heads = self.w, first[:-1]
        of = np.repeat(np.arange(len(heads)), np.diff(first))
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (v * u) @ w["g"]
        a = np.exp(a - np.maximum.reduceat(a, heads)[of])
        a /= np.add.reduceat(a, heads)[of]
        z = np.add.reduceat(a[:, None] * h, heads)
        return {"of": of, "h": h, "v": v, "u": u, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """The sum of the bags' gradients."""
        w, heads, f = self.w, first[:-1], self.forward(x, first)
        of, h, v, u, a = (f[k] for k in ("of", "h", "v", "u", "a"))
        d = f["p"] - y
        dz = d[:, None] * w["c"]
        dot = (h * dz[of]).sum(1)
        da = a * (dot - np.add.reduceat(a * dot, heads)[of])
        dgate = da[:, None] * w["g"]
        dv, du = dgate * u * (1 - v * v), dgate * v * u * (1 - u)
        dh = a[:, None] * dz[of] + dv @ w["V"].T + du @ w["U"].T
        dx = dh * (1 - h * h)
        return {"E": x.T @ dx, "e": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "g": (v * u).T @ da, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.01, decay: float = 1e-4, together: int = TOGETHER) -> None:
        """Adam over all bags in each step. A step's gradient is summed over parts of about so many passages, in
        single precision, so only the passages themselves are held whole."""
        self.mean, self.scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
        x, y = ((x - self.mean) / self.scale).astype(np.float32), y.astype(np.float32)
        w, own = self.w, Attention()
        one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
        parts = list(slices(np.diff(first), together))
        for step in range(1, steps + 1):
            g = {k: decay * v for k, v in w.items()}
            own.w = {k: v.astype(np.float32) for k, v in w.items()}
            for a, b in parts:
                for k, v in own.gradient(x[first[a] : first[b]], first[a : b + 1] - first[a], y[a:b]).items():
                    g[k] = g[k] + v.astype(np.float64) / len(y)
            for k in w:
                one[k] = 0.9 * one[k] + 0.1 * g[k]
                two[k] = 0.999 * two[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each bag the probability, and of each passage its attention."""
        f = self.forward((x - self.mean) / self.scale, first)
        return f["p"], f["a"]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Attention:
    """The model of labelled documents; of two labels for one id the larger counts, null ids and labels take no part,
    and equal texts count once. Without labelled documents the weights stay as drawn. It learns from all passages of about
    ``max_docs`` documents at most, whose texts have ``max_bytes`` bytes in all at most: they are taken in the order of a
    hash, and one that no longer fits is passed over. Scoring reads all passages."""
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    sample = drawn(clean, id_col, max_docs)  # about max_docs rows of two numbers
    both = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(sample), id_col)
    both = both.groupBy(F.sha2("_text", 256).alias("_key")).agg(F.first("_text").alias("_text"), F.least(F.max("_label"), F.lit(1)).alias("_label"))
    both = checkpointed(both)
    over = fitting([tuple(r) for r in both.select("_key", F.octet_length("_text")).collect()], max_bytes)  # of the sample, two values a text
    if over:
        both = both.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in over], "_key string")), "_key", "left_anti")

    def encode(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b, first, x in passages(texts):
                cuts = first * FEATURES
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), lists], names=["key", "label", "x"])

    found = both.select("_text", "_key", "_label").mapInArrow(lean(encode), "key string, label int, x array<float>").orderBy("key").toArrow().combine_chunks()
    model = Attention()
    if found.num_rows:
        bags = found.column("x").chunk(0)
        x = bags.flatten().to_numpy().reshape(-1, FEATURES)
        first = (bags.offsets.to_numpy() - bags.offsets[0].as_py()) // FEATURES
        model.fit(x, first, found.column("label").to_numpy().astype(np.float64))
    return model


def score(df: DataFrame, model: Attention, text_col: str = "text", score_col: str = "score", attention_col: str = "attention") -> DataFrame:
    """df with each whole text's probability of label 1, 0 to 1, and the attention on its passages of 64 words.
    Null and empty texts are scored as one empty passage. Columns of these names give way."""
    # what is broadcast holds no class of this library, which executors may not have
    shared = df.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.w))

    def make():
        own = Attention()
        own.mean, own.scale, own.w = shared.value

        def run(texts):
            scores, weights, cuts = [np.zeros(0)], [np.zeros(0)], [np.zeros(1, np.int64)]
            for _, _, first, x in passages(texts):
                p, a = own.score(x.astype(np.float64), first)
                scores.append(p)
                weights.append(a)
                cuts.append(first[1:] + cuts[-1][-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(cuts).astype(np.int32)), pa.array(np.concatenate(weights).astype(np.float32)))
            return [pa.array(np.concatenate(scores)), lists]

        return run

    return map_texts(df, text_col, [field(score_col, "double"), field(attention_col, "array<float>")], make)
