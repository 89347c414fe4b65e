"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over characters are trained from labelled samples: one on random strings, one on
ordinary identifiers. Each step's probability is a mixture of the step between characters and of that between their
classes, so that words of a language that was not learned from are not taken for random ones. A run of key characters,
or a part of it between its separators, is a secret when the log-likelihood ratio per character, and the whole ratio,
exceed their thresholds. Such runs add spans to those of the patterns.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.llm._shared import drawn, field, map_texts

KINDS = ("assign", "access", "hex", "markov")
#: The patterns, and how long their matches have to be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # shorter runs fail, and a run is one match
ASSIGN_CHARS, ACCESS_CHARS = 8, 16

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Shorter runs are not scored: too few steps tell too little.
CANDIDATE_CHARS = 16
CANDIDATE, PIECE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_CHARS},}}"), re.compile(rf"[A-Za-z0-9+]{{{CANDIDATE_CHARS},}}")
#: Classes of characters, and the weight of the step between characters against that between classes.
CLASSES = [range(0, 26), range(26, 52), range(52, 62), range(62, 67)]
WEIGHT = 0.7


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of what the patterns find, by start and then by kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


class MarkovPair:
    """Log-likelihood ratios of character steps between random strings and ordinary identifiers."""

    def __init__(self, counts: dict[int, np.ndarray], smoothing: float = 0.5):
        n = len(ALPHABET)
        logs = {}
        for label in (0, 1):
            c = counts[label] + smoothing
            by_class = np.zeros_like(c)
            for rows in [*CLASSES, range(n, n + 1)]:
                together = c[rows].sum(0)
                for columns in CLASSES:
                    by_class[np.ix_(rows, columns)] = together[columns].sum() / together.sum() / len(columns)
            logs[label] = np.log(WEIGHT * c / c.sum(axis=1, keepdims=True) + (1 - WEIGHT) * by_class)
        #: Row n stands for the start of the string.
        self.ratio = logs[1] - logs[0]
        self.code = np.full(128, -1, np.int16)
        self.code[[ord(c) for c in ALPHABET]] = np.arange(n)

    def score(self, s: str) -> tuple[float, float]:
        """The whole ratio and the ratio per character."""
        codes = self.code[np.frombuffer(s.encode(), np.uint8)]
        total = float(self.ratio[np.concatenate([[len(ALPHABET)], codes[:-1]]), codes].sum())
        return total, total / len(codes)


def train(samples: DataFrame, string_col: str = "sample", label_col: str = "label") -> MarkovPair:
    """The models from labelled strings (1: random, 0: ordinary). Characters outside the alphabet cut a string;
    null strings or labels take no part. Gathers two tables of steps, whose size is fixed."""
    n = len(ALPHABET)
    rows = samples.where(F.col(string_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(string_col).alias("s"), F.col(label_col).cast("int").alias("l"))
    runs = rows.select("l", F.explode(F.split("s", "[^A-Za-z0-9+/_=-]+")).alias("s")).where("length(s) > 0")
    letters = F.slice(F.split("s", ""), F.lit(1), F.length("s"))  # all at once; one by one would take the square of a run
    before = F.concat(F.array(F.lit("")), F.slice(letters, F.lit(1), F.length("s") - 1))
    steps = runs.select("l", F.explode(F.arrays_zip(before.alias("a"), letters.alias("b"))).alias("x"))
    counts = {0: np.zeros((n + 1, n)), 1: np.zeros((n + 1, n))}
    for label, a, b, c in steps.groupBy("l", "x.a", "x.b").count().collect():
        if label in counts:
            counts[label][ALPHABET.index(a) if a else n, ALPHABET.index(b)] = c
    return MarkovPair(counts)


def scan(df: DataFrame, model: MarkovPair, text_col: str = "text", spans_col: str = "spans", per_char: float = 0.35, whole: float = 12.0, runs_col: str | None = None) -> DataFrame:
    """df with an array of (kind, start, end) for each whole text, in code points and by start.

    Null or empty texts have an empty array. Spans of the patterns always stay; a run of CANDIDATE_CHARS characters or
    more that the models take for a secret, or else each piece of it without separators that they do, adds a ``markov``
    span unless a span covers it. With ``runs_col`` there is also an array of every such run, in order, those that the
    patterns have found among them: start, end, ratio and per_char are the run's or its most telling piece's, and likely
    says whether the models take that for a secret. Columns named as the new ones give way.
    """

    def make():
        def one(t):
            if not t:
                return [], []
            spans, added, runs = base_spans(t), [], []
            reach, k = -1, 0  # how far the spans go that begin before a place; places come in order
            for m in CANDIDATE.finditer(t):
                best = None
                for a, b in (m.span(), *(x.span() for x in PIECE.finditer(t, *m.span()))):
                    while k < len(spans) and spans[k][0] <= a:
                        reach, k = max(reach, spans[k][1]), k + 1
                    if b <= reach and not runs_col:
                        continue
                    total, mean = model.score(t[a:b])
                    likely = total >= whole and mean >= per_char
                    best = max(best or (), (likely, mean, total, -a, b))
                    if likely and b > reach:
                        added.append((a, b, "markov"))
                        reach = b
                if best:
                    runs.append({"start": -best[3], "end": best[4], "ratio": best[2], "per_char": best[1], "likely": best[0]})
            return [{"kind": x, "start": a, "end": b} for a, b, x in (ordered(spans + added) if added else spans)], runs

        def run(texts):
            told = [one(t) for t in texts]
            return [[x for x, _ in told], *([[y for _, y in told]] if runs_col else [])]

        return run

    more = [field(runs_col, "array<struct<start:bigint,end:bigint,ratio:double,per_char:double,likely:boolean>>")] if runs_col else []
    return map_texts(df, text_col, [field(spans_col, "array<struct<kind:string,start:bigint,end:bigint>>"), *more], make)


def samples(spark: SparkSession, docs: DataFrame, random_strings: int = 4000, ordinary_docs: int = 1000) -> DataFrame:
    """Labelled samples: that many strings of each random alphabet, and identifiers joined from the words of about
    that many documents, drawn by a hash of their id; words with digits are left out. Plain numbers, as cards and
    accounts have, are ordinary too."""
    ids = spark.range(random_strings)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    random = [digest.substr(1, 40), F.base64(F.unhex(digest)), F.upper(F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", ""), 1, 24))]
    words = drawn(docs.where(F.col("text").isNotNull()), "doc_id", ordinary_docs).select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("length(w) > 1").distinct()
    ordinary = [F.col("w"), F.lower("w"), F.initcap("w"), F.upper("w"), F.concat_ws("_", F.lower("w"), F.lower("w")), F.concat_ws("_", F.upper("w"), F.upper("w"), F.upper("w")), F.concat_ws("-", F.lower("w"), F.initcap("w")), F.concat_ws("/", F.col("w"), F.lower("w")), F.concat(F.lower("w"), F.initcap("w"), F.initcap("w")), F.concat(F.initcap("w"), F.initcap("w"), F.lit("2")), F.concat(F.crc32("w"), F.crc32(F.reverse("w")))]
    labelled = lambda df, forms, label: df.select(F.explode(F.array(*forms)).alias("sample"), F.lit(label).alias("label"))
    return labelled(ids, random, 1).unionByName(labelled(words, ordinary, 0))


def digests(found: DataFrame, spans_col: str = "spans", runs_col: str | None = None) -> DataFrame:
    """doc_id, counts by kind, the hash of the patterns' spans, and all spans as text; with ``runs_col`` also how many
    runs the models have scored, how many of these they take for secrets, and the largest ratio per character."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.col(spans_col)
    base = F.filter(spans, lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    runs = F.col(runs_col) if runs_col else None
    more = [F.size(runs).cast("long").alias("n_runs"), F.size(F.filter(runs, lambda r: r["likely"])).cast("long").alias("n_likely"), F.array_max(F.transform(runs, lambda r: r["per_char"])).alias("best_per_char")] if runs_col else []
    return found.select("doc_id", *map(count, KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(spans).alias("spans"), *more)
