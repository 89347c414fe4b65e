"""Exact top-k search with a bit-sliced index.

A block of rows holds, for each attribute, one bitmap per bit of its quantised values. For a query, every slice is
weighted by the query's bits and all are added with bitmap arithmetic: full adders over whole bitmaps turn three of
one weight into a sum and a carry, so the score of every row of the block appears as slices. The best rows are then
taken from the most significant slice downward: a bitmap of rows that are surely in, and one of rows that are still
level with the boundary; rows that stay level to the last slice are settled by their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamill.llm._shared import checkpointed

BLOCK_ROWS = 8192
CHUNK_QUERIES = 1024
#: Queries that are added at once; their bitmaps stay in the processor's cache.
TOGETHER = 64
WORD = 64


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vector: Column) -> Column:
    """Not null, and without null, infinite or undefined components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


class BitSlices:
    """Slices of a block of vectors: values less the block's least value, bit by bit."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows, self.size = len(ids), values.shape[1]
        self.low = values.min(0)
        values = (values - self.low).astype(np.uint64)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        pad = -self.rows % WORD
        #: by attribute and bit, a bitmap over the rows
        self.slices = np.zeros((self.size, self.bits, (self.rows + pad) // WORD), np.uint64)
        for b in range(self.bits):
            plane = np.zeros((self.size, self.rows + pad), np.uint8)
            plane[:, : self.rows] = ((values >> np.uint64(b)) & np.uint64(1)).T
            self.slices[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)

    @property
    def live(self) -> np.ndarray:
        """The bitmap of rows that there are."""
        bits = np.zeros(self.rows + -self.rows % WORD, np.uint8)
        bits[: self.rows] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Ids, least values and slices, as ``unpacked`` takes them."""
        return self.ids.tobytes(), self.low.tobytes(), self.slices.tobytes()

    @classmethod
    def unpacked(cls, ids: bytes, low: bytes, slices: bytes) -> BitSlices:
        own = cls.__new__(cls)
        own.ids, own.low = np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64)
        own.rows, own.size = len(own.ids), len(own.low)
        words = (own.rows + -own.rows % WORD) // WORD
        own.bits = len(slices) // 8 // (own.size * words) if own.size else 1
        own.slices = np.frombuffer(slices, np.uint64).reshape(own.size, own.bits, words)
        return own

    def sums(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slices of the scores of each query, from the least significant, and what to add to them.

        A negative weight -w of a value v stands as w times the complement of v, less a constant.
        """
        sign = queries < 0
        size = np.abs(queries).astype(np.uint64)
        full = np.uint64(2**self.bits - 1)
        offset = queries @ self.low - (np.where(sign, size, 0) * full).sum(1).astype(np.int64)
        flip = np.where(sign, np.uint64(2**64 - 1), np.uint64(0))[:, :, None]
        columns: list[list[np.ndarray]] = [[] for _ in range(64 + self.bits)]
        for j in range(max(1, int(size.max(initial=0)).bit_length())):
            on = np.where((size >> np.uint64(j)) & np.uint64(1) == 1, np.uint64(2**64 - 1), np.uint64(0))[:, :, None]
            for d in range(self.size):
                if not on[:, d].any():
                    continue
                for b in range(self.bits):
                    new = (self.slices[d, b][None, :] ^ flip[:, d]) & on[:, d]
                    self._add(columns, b + j, new)
        out = []
        for w, column in enumerate(columns):
            while len(column) > 1:
                self._reduce(columns, w, 3 if len(column) > 2 else 2)
            out.append(column[0] if column else np.zeros((len(queries), self.slices.shape[2]), np.uint64))
        while len(out) > 1 and not out[-1].any():
            out.pop()
        return out, offset

    def _add(self, columns: list[list[np.ndarray]], w: int, new: np.ndarray) -> None:
        columns[w].append(new)
        while len(columns[w]) >= 3:
            self._reduce(columns, w, 3)
            w += 1

    @staticmethod
    def _reduce(columns: list[list[np.ndarray]], w: int, n: int) -> None:
        """A full or half adder: bitmaps of weight w become one, and a carry of weight w + 1."""
        x, y = columns[w].pop(), columns[w].pop()
        either = x ^ y
        carry = x & y
        if n == 3:
            z = columns[w].pop()
            carry |= either & z
            either ^= z
        columns[w].append(either)
        columns[w + 1].append(carry)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and scores of its k best rows other than those of id ``own``, not in order."""
        slices, offset = self.sums(queries)
        n = len(queries)
        level = np.repeat(self.live[None, :], n, 0)
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        for q in np.flatnonzero(last > first):
            for r in range(first[q], last[q]):
                level[q, r // WORD] &= ~np.uint64(1 << (r % WORD))
        sure, held = np.zeros_like(level), np.zeros(n, np.int64)
        for s in reversed(slices):
            high = level & s
            more = held + np.bitwise_count(high).sum(1).astype(np.int64)
            over = (more > k)[:, None]
            sure = np.where(over, sure, sure | high)
            level = np.where(over, high, level & ~s)
            held = np.where(over[:, 0], held, more)
        out = []
        for q in range(n):
            # rows are by id, so of those at the boundary the first are taken
            at = self._rows(sure[q])
            at = np.concatenate([at, self._rows(level[q])[: k - len(at)]])
            word, bit = at // WORD, (at % WORD).astype(np.uint64)
            score = np.zeros(len(at), np.int64)
            for w, s in enumerate(slices):
                score += ((s[q, word] >> bit) & np.uint64(1)).astype(np.int64) << w
            out.append((self.ids[at], score + offset[q]))
        return out

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, WORD)
        row, bit = np.nonzero(bits)
        return words[row] * WORD + bit


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank from 1, vec_id and score: each query's k rows of the highest integer inner product, ties to the
    smaller id; all rows, if there are fewer.

    Both sides are quantised alike. Unusable vectors and null ids take no part; rows of one id are rows like others, and
    queries of one id are ranked as one. A query meets rows of its own length other than those of its id; empty vectors
    have a score of 0. Rows and queries are dealt into blocks of bounded size. The slices of a block of rows are made once
    and written; they, a bit for each bit of a value, are what is sent to each block of queries. Scores must stay within
    63 bits. Other columns take no part.
    """
    own = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))
    rows, queries = own(rows), own(queries)
    n, m = rows.count(), queries.count()
    blocks, chunks = 1 + n // BLOCK_ROWS, 1 + m // CHUNK_QUERIES
    fields = ["block", "size", "ids", "low", "cells"]
    kind = "block int, size int, ids binary, low binary, cells binary"

    def vectors(table):
        ids, size = table.column("id").to_numpy(), table.column("size")[0].as_py()
        return ids, table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), size), [[table.column("block")[0].as_py()], [size]]

    def sliced(table):
        ids, values, at = vectors(table)
        return pa.table([*map(pa.array, at), *([x] for x in BitSlices(ids, values).packed())], schema=made)

    def plain(table):
        ids, values, at = vectors(table)
        return pa.table([*map(pa.array, at), [ids.tobytes()], [None], [values.tobytes()]], schema=made)

    made = pa.schema([*((k, pa.int32()) for k in fields[:2]), *((k, pa.binary()) for k in fields[2:])])
    deal = lambda df, many: df.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(many)).cast("int")).withColumn("size", F.size("v")).groupBy("block", "size")
    index = checkpointed(deal(rows, blocks).applyInArrow(sliced, kind))
    asked = checkpointed(deal(queries, chunks).applyInArrow(plain, kind).withColumnRenamed("block", "chunk"))
    each = lambda df, many, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    both = each(index, chunks, "chunk").unionByName(each(asked, blocks, "block"))

    def search(table):
        """One block of rows, which has least values, and one of queries."""
        out = [(np.zeros(0, np.int64),) * 3]
        is_query = table.column("low").is_null().to_pylist()
        if sorted(is_query) == [False, True]:
            r, q = is_query.index(False), is_query.index(True)
            index = BitSlices.unpacked(*(table.column(c)[r].as_py() for c in fields[2:]))
            wanted = np.frombuffer(table.column("ids")[q].as_py(), np.int64)
            weights = np.frombuffer(table.column("cells")[q].as_py(), np.int64).reshape(len(wanted), index.size)
            for i in range(0, len(wanted), TOGETHER):
                for w, (found, score) in zip(wanted[i : i + TOGETHER], index.top(weights[i : i + TOGETHER], wanted[i : i + TOGETHER], k), strict=True):
                    out.append((np.full(len(found), w), found, score))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = both.groupBy("block", "chunk", "size").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
