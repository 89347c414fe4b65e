"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

The context trie is pretrained: counts of (context, next byte) for contexts of 0 to ``order`` bytes, over all training
texts. A byte that a context has seen has count / (total + kinds) there; otherwise the context's escape, kinds /
(total + kinds), leads to the context that is one byte shorter, where the symbols of the longer one are excluded.
Below the empty context all symbols not seen are alike. A text starts after boundary symbols and ends with one, so
the scores are log10 probabilities of whole texts. ``unigram`` with an ``order`` scores a corpus with all edges, which
stay a partitioned table: contexts are told apart by their last two bytes, the edges of one such end are valued in one
task, and chunks of texts get the values of their distinct keys. Only the edges of orders 0 and 1, which are no more
than pairs of symbols, are sent to all tasks. ``train`` and ``score`` are for models that one process can hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm._grams import CHUNK_BYTES, WordBuffer, answers, byte_slices, chunked, dealt, gathered, mixed
from stratamill.llm._shared import checkpointed, field, lean, map_texts

ORDER = 4
BITS = 9
#: About so many keys are valued in one task.
VALUED = 200_000
BOUNDARY = 256


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte and end of the texts the symbol with its context, packed into one number; and where texts begin."""
    each = [t.encode() if t else b"" for t in texts]
    gap = b"\0" * order
    symbols = np.frombuffer(gap + gap.join(each) + gap, np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    begin = order + np.concatenate([[0], np.cumsum(sizes + order)[:-1]])
    end = begin + sizes
    edge = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(edge, np.concatenate([[0], end]), 1)
    np.add.at(edge, np.concatenate([begin, [len(symbols)]]), -1)
    symbols[np.cumsum(edge[:-1]) > 0] = BOUNDARY
    packed = symbols[order:].copy()
    for j in range(1, order + 1):
        packed |= symbols[order - j : len(symbols) - j] << np.uint64(BITS * j)
    # of the boundary after a text only its first symbol counts
    counts = np.ones(len(packed), bool)
    for j in range(1, order):
        counts[end - order + j] = False
    return packed[counts], np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _counted(df: DataFrame, text_col: str, trains: Column, order: int) -> DataFrame:
    """All keys of the texts of df and how often those that train have them; 0 for keys of others only."""

    def count(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held = []
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for a, b in byte_slices(texts):
                found, begin = grams(texts[a:b], order)
                own = np.repeat(of[a:b], np.diff(np.concatenate([begin, [len(found)]])))
                held.append(np.unique(found[own], return_counts=True))
                if not own.all():
                    others = np.unique(found[~own])
                    held.append((others, np.zeros(len(others), np.int64)))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    keys, counts = _merged(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([counts, *(c for _, c in held)]))
                    held = []
        keys, counts = _merged(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([counts, *(c for _, c in held)]))
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].astype(np.int64)), pa.array(counts[i : i + 100_000])], names=["key", "n"])

    rows = df.select(F.col(f"`{text_col}`").cast("string"), trains)
    return checkpointed(rows.mapInArrow(lean(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))


def train(df: DataFrame, text_col: str = "text", order: int = ORDER, max_edges: int | None = None) -> dict:
    """The trie of all texts of df: for each context length the edges and their counts. Null texts count as empty.

    It is gathered: all of it, or of a larger one the edges of the highest counts, all of a count or none, up to
    ``max_edges`` where that is given. ``unigram`` scores without gathering it.
    """
    level = _counted(df, text_col, F.lit(True), order)
    levels = [level.withColumn("order", F.lit(order))]
    for k in range(order - 1, -1, -1):
        level = level.groupBy((F.col("key") % 2 ** (BITS * (k + 1))).alias("key")).agg(F.sum("n").alias("n"))
        levels.append(level.withColumn("order", F.lit(k)))
    edges = levels[0]
    for other in levels[1:]:
        edges = edges.unionByName(other)
    edges = checkpointed(edges)
    sizes = sorted(edges.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().collect(), reverse=True)
    least, kept = 1 << 20, 0
    for n, many in sizes:
        if max_edges is not None and kept + many > max_edges:
            break
        least, kept = n, kept + many
    found = edges.where(F.col("n") >= least).toArrow()
    k, key, n = (found.column(c).to_numpy() for c in ("order", "key", "n"))
    out = {"order": order, "edges": []}
    for i in range(order + 1):
        mine = k == i
        sort = np.argsort(key[mine])
        out["edges"].append((key[mine][sort].astype(np.uint64), n[mine][sort].astype(np.float64)))
    return out


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted are in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Lookup:
    """Values of keys, most of them found by their slot in one of two tables."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, kind: type = np.float64):
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.tables = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            slot, index = np.unique(self._slot(keys, salt), return_index=True)
            table, held = np.full(2**self.bits, 2**64 - 1, np.uint64), np.zeros(2**self.bits, kind)
            table[slot], held[slot] = keys[index], values[index]
            self.tables.append((salt, table, held))
            rest = np.ones(len(keys), bool)
            rest[index] = False
            keys, values = keys[rest], values[rest]

    def _slot(self, keys: np.ndarray, salt: int) -> np.ndarray:
        return (keys * np.uint64(salt | 1)) >> np.uint64(64 - self.bits)

    def values(self, keys: np.ndarray, others: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Values of the keys; those in neither table get theirs from ``others``, once for each key."""
        salt, table, held = self.tables[0]
        slot = self._slot(keys, salt)
        values = held[slot].astype(np.float64)
        left = np.flatnonzero(table[slot] != keys)
        if len(left):
            salt, table, held = self.tables[1]
            slot = self._slot(keys[left], salt)
            values[left] = held[slot]
            left = left[table[slot] != keys[left]]
            if len(left):
                rare, of = np.unique(keys[left], return_inverse=True)
                values[left] = others(rare)[of]
        return values


class Trie:
    """Log10 probabilities of symbols after contexts, from counts. Edges of contexts of two bytes and more may be those
    of some ends of contexts only; then it is right for these."""

    def __init__(self, counts: dict):
        self.order, self.edges = counts["order"], counts["edges"]
        self.nodes = []
        for k, (keys, n) in enumerate(self.edges):
            context = keys >> np.uint64(BITS)
            heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, heads) if len(heads) else np.zeros(0)
            kinds = np.diff(np.concatenate([heads, [len(keys)]])).astype(np.float64)
            # what remains of the next shorter context when the symbols of this one are excluded
            rest_total, rest_kinds = total, kinds
            if k and len(keys):
                short_keys, short_n = self.edges[k - 1]
                at, _ = _at(short_keys, keys & np.uint64(2 ** (BITS * k) - 1))
                parent, _ = _at(self.nodes[k - 1][0], context[heads] & np.uint64(2 ** (BITS * (k - 1)) - 1))
                rest_total = self.nodes[k - 1][1][parent] - np.add.reduceat(short_n[at], heads)
                rest_kinds = self.nodes[k - 1][2][parent] - kinds
            self.nodes.append((context[heads], total, kinds, rest_total, rest_kinds))
        self.lookup: Lookup | None = None

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        longer = np.zeros(len(keys), bool)  # whether the next longer context is in the trie
        rest_total, rest_kinds = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(self.order, -1, -1):
            contexts, total, kinds, next_total, next_kinds = self.nodes[k]
            node, there = _at(contexts, (keys >> np.uint64(BITS)) & np.uint64(2 ** (BITS * k) - 1))
            edge, seen = _at(self.edges[k][0], keys & np.uint64(2 ** (BITS * (k + 1)) - 1))
            if len(contexts):
                n = np.where(longer, rest_total, total[node])
                d = np.where(longer, rest_kinds, kinds[node])
                if k == 0 and kinds[0] == BOUNDARY + 1:
                    d = np.zeros(len(keys))
                hit = open_ & there & seen
                out[hit] += np.log10(self.edges[k][1][edge[hit]] / (n[hit] + d[hit]))
                miss = open_ & there & ~seen & (d > 0)
                out[miss] += np.log10(d[miss] / (n[miss] + d[miss]))
                open_ &= ~hit
                longer = there
                rest_total, rest_kinds = next_total[node], next_kinds[node]
        seen = len(self.edges[0][0])
        out[open_] -= np.log10(max(1, BOUNDARY + 1 - seen))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.lookup is None:
            keys = self.edges[self.order][0]
            self.lookup = Lookup(keys, self.log10(keys), np.float32)
        out = []
        for a, b in byte_slices(texts):
            keys, begin = grams(texts[a:b], self.order)
            out.append(np.add.reduceat(self.lookup.values(keys, self.log10), begin))
        return np.concatenate(out) if out else np.zeros(0)


def score(df: DataFrame, trie: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the log10 probability of each whole text; a null text counts as empty, for which only the end is
    scored. A column named as ``score_col`` gives way. Repeated rows score alike."""
    shared = df.sparkSession.sparkContext.broadcast(trie)

    def make():
        model = Trie(shared.value)
        return lambda texts: [pa.array(model.score(texts))]

    return map_texts(df, text_col, [field(score_col, "double")], make)


def _valued(level: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, key, scrambled, and log10 probability of each key of counted ones, from all edges that these have."""
    ends = min(order, 1)
    told = level.where("n > 0").groupBy((F.col("key") % 2 ** (BITS * (ends + 1))).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    short = [_merged(told.column("key").to_numpy().astype(np.uint64), told.column("n").to_numpy())]
    if ends:
        short.insert(0, _merged(short[0][0] & np.uint64(2**BITS - 1), short[0][1]))
    shared = level.sparkSession.sparkContext.broadcast(short)
    many = 1 + level.count() // VALUED

    def value(table):
        keys, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
        seen, times = keys[n > 0], n[n > 0]
        edges = [*shared.value, *(_merged(seen & np.uint64(2 ** (BITS * (k + 1)) - 1), times) for k in range(2, order + 1))]
        values = Trie({"order": order, "edges": [(k, c.astype(np.float64)) for k, c in edges]}).log10(keys)
        keys = mixed(keys)
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return pa.table([pa.array(bucket.astype(np.int64)), pa.array(keys.view(np.int64)), pa.array(values)], names=["bucket", "key", "value"])

    end = F.shiftright("key", BITS).bitwiseAND(F.lit(2 ** (2 * BITS) - 1))
    return level.withColumn("end", F.pmod(F.xxhash64(end), F.lit(many))).groupBy("end").applyInArrow(value, "bucket long, key long, value double")


def unigram(df: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES, order: int | None = None) -> DataFrame:
    """Per row of df id, ``more`` columns, n_tokens, n_known, train_tokens and base_score, the sum over a text's tokens
    of log10((c + 1) / (N + V + 1)) with counts of the rows where ``train_col`` is true.

    Tokens are words, A-Z lowered, and one end a text. Null texts are empty: their end is all they have. Words are
    told apart by 64-bit hashes, so two words of one hash, which a trillion different ones would hold, count as one.

    With an ``order`` there is a column score too, the log10 probability of the whole text under the trie of that order
    of all texts where ``train_col`` is true.
    """
    docs, n = chunked(df, id_col, text_col, chunk_bytes, (train_col, *more))

    def words_of(table):
        texts = table.column("text").to_pylist()
        for a, b in byte_slices(texts):
            w = WordBuffer(texts[a:b], lower=True)
            yield a, b, w, w.hashes(21)

    def send(table):
        trains = table.column(train_col).fill_null(False).to_numpy(zero_copy_only=False)
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for a, b, w, keys in words_of(table):
            held.append(_merged(keys, trains[a:b][w.text_of].astype(np.int64)))
        keys, counts = _merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        return pa.Table.from_batches([dealt(keys, n, table.column("chunk")[0].as_py(), counts.astype(np.uint32))])

    def total(table):
        chunk, keys, counts = gathered(table, {"keys": np.uint64, "more0": np.uint32})
        words, of = np.unique(keys, return_inverse=True)
        sums = np.bincount(of, counts, len(words)).astype(np.int64)
        known = sums[of] > 0
        told = answers(chunk[known], keys[known], sums[of][known], names=["keys", "counts"])
        zeros = pa.array(np.zeros(told.num_rows, np.int64))
        stats = pa.table([pa.array([-1]), pa.array([b""]), pa.array([b""]), pa.array([int((sums > 0).sum())]), pa.array([int(sums.sum())])], names=["chunk", "keys", "counts", "words", "sum"])
        return pa.concat_tables([told.append_column("words", zeros).append_column("sum", zeros), stats])

    def send_grams(table):
        texts, keys = table.column("text").to_pylist(), np.zeros(0, np.uint64)
        held = []
        for a, b in byte_slices(texts):
            held.append(np.unique(grams(texts[a:b], order)[0]))
            if sum(map(len, held)) > 2_000_000:
                keys, held = np.unique(np.concatenate([keys, *held])), []
        keys = np.sort(mixed(np.unique(np.concatenate([keys, *held]))))
        return pa.Table.from_batches([dealt(keys, n, table.column("chunk")[0].as_py())])

    def answer(sent, valued):
        chunk, keys = gathered(sent, {"keys": np.uint64})
        known, values = valued.column("key").to_numpy().view(np.uint64), valued.column("value").to_numpy()
        by = np.argsort(known)
        at, there = _at(known[by], keys)
        if not there.all():
            raise ValueError("a key of a text was not counted")
        return answers(chunk, keys, values[by][at] if len(keys) else np.zeros(0), names=["keys", "counts"])

    def base(table, told):
        if not table.num_rows:
            out = table.select(["id", *more]).append_column("n_tokens", pa.array([], pa.int64())).append_column("n_known", pa.array([], pa.int64())).append_column("logs", pa.array([], pa.float64()))
            return out if order is None else out.append_column("score", pa.array([], pa.float64()))
        if order is not None:
            mine = told.column("grams").to_numpy(zero_copy_only=False)
            answered, told = told.filter(pa.array(mine)), told.filter(pa.array(~mine))
        known = np.frombuffer(b"".join(told.column("keys").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(told.column("counts").to_pylist()), np.int64)
        by = np.argsort(known)
        known, counts = known[by], counts[by]
        tokens, hits, logs = [], [], []
        for a, b, w, keys in words_of(table):
            rare, of = np.unique(keys, return_inverse=True)
            at, there = _at(known, rare)
            c = np.where(there, counts[at], 0) if len(counts) else np.zeros(len(rare), np.int64)
            tokens.append(w.counts + 1)
            hits.append(np.bincount(w.text_of, there[of], b - a).astype(np.int64))
            logs.append(np.bincount(w.text_of, np.log10(c + 1.0)[of], b - a))
        out = table.select(["id", *more])
        for name, x in (("n_tokens", tokens), ("n_known", hits), ("logs", logs)):
            out = out.append_column(name, pa.array(np.concatenate(x).astype(np.float64 if name == "logs" else np.int64)))
        return out if order is None else out.append_column("score", pa.array(scores(table, answered)))

    def scores(table, answered):
        keys = np.frombuffer(b"".join(answered.column("keys").to_pylist()), np.uint64)
        values = np.frombuffer(b"".join(answered.column("counts").to_pylist()), np.float64)
        lookup, by = Lookup(keys, values), np.argsort(keys)
        texts, out = table.column("text").to_pylist(), []
        for a, b in byte_slices(texts):
            own, begin = grams(texts[a:b], order)
            out.append(np.add.reduceat(lookup.values(mixed(own), lambda rare: values[by[np.searchsorted(keys, rare, sorter=by)]]), begin))
        return np.concatenate(out)

    kinds = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in more)
    sent = docs.groupBy("chunk").applyInArrow(send, "chunk long, bucket long, keys binary, more0 binary")
    told = sent.groupBy("bucket").applyInArrow(total, "chunk long, keys binary, counts binary, words long, sum long")
    back, score = told.select("chunk", "keys", "counts"), ""
    if order is not None:
        valued = _valued(_counted(df, text_col, F.col(train_col), order), order, n)
        asked = docs.groupBy("chunk").applyInArrow(send_grams, "chunk long, bucket long, keys binary")
        of_grams = asked.groupBy("bucket").cogroup(valued.groupBy("bucket")).applyInArrow(answer, "chunk long, keys binary, counts binary")
        back, score = back.withColumn("grams", F.lit(False)).unionByName(of_grams.withColumn("grams", F.lit(True))), ", score double"
    sums = docs.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(base, f"id long{kinds}, n_tokens long, n_known long, logs double{score}")
    ends = df.where(F.col(train_col)).count()
    stats = told.where("chunk = -1").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("sum"), F.lit(0)).alias("tokens"))
    known_end = 1 if ends else 0
    # of each text the end is a token too
    whole = sums.withColumn("train_tokens", stats.select(F.col("tokens") + ends).scalar()).withColumn("kinds", stats.select(F.col("words") + known_end).scalar())
    each = F.log10(F.col("train_tokens") + F.col("kinds") + 1.0)
    return whole.select(F.col("id").alias(id_col), *more, "n_tokens", (F.col("n_known") + known_end).alias("n_known"), "train_tokens", (F.col("logs") + float(np.log10(ends + 1.0)) - F.col("n_tokens") * each).alias("base_score"), *(["score"] if order is not None else []))
