"""Substring deduplication: difference-cover anchors.

Runs of ``words - period + 1`` words are hashed only at places whose residue modulo ``period`` is in a difference
cover. For any two places there is a shift under the period that brings both onto the cover, so two equal windows
of ``words`` words share an anchor at the same offset. Anchors that occur once rule out all windows around them; the
others are extended to whole windows, and of equal windows the first, by document and place, stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.llm._grams import CHUNK_BYTES, WordBuffer, answers, byte_slices, chunked, dealt, gathered, run_hashes

#: Perfect difference sets, by modulus.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(words: int) -> int:
    """The largest period that leaves anchors of two fifths of a window at least."""
    return max(p for p in COVERS if words - p + 1 >= max(1, 2 * words // 5))


class _Anchors:
    def __init__(self, texts: list[str | None], words: int, period: int):
        self.words, self.period = words, period
        self.w = w = WordBuffer(texts)
        self.hashes = w.hashes(11)
        length = words - period + 1
        # texts that are too short for a window have no anchors
        at = w.windows(length)
        on = np.zeros(period, bool)
        on[list(COVERS[period])] = True
        self.at = at[on[w.place[at] % period] & (w.counts[w.text_of[at]] >= words)]
        self.keys = run_hashes(self.hashes, length)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Windows with an anchor that is marked as repeated."""
        marks = np.zeros(len(self.w.start) + self.period + 1, np.int32)
        marks[self.at[repeated] + 1] = 1
        sums = np.cumsum(marks)
        windows = self.w.windows(self.words)
        return windows[sums[windows + self.period] > sums[windows]]

    def window_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows a hash, and a check that is made from other hashes of their words."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return run_hashes(self.hashes, self.words)[at], (run_hashes(self.w.hashes(12), self.words)[at] >> np.uint64(32)).astype(np.uint32)


def _sliced(table: pa.Table, words: int, period: int):
    """Ids, and anchors by slice, of a chunk."""
    ids = table.column("id").fill_null(-(2**63)).to_numpy()
    texts = table.column("text").to_pylist()
    return ids, texts, (lambda: ((a, b, _Anchors(texts[a:b], words, period)) for a, b in byte_slices(texts)))


def _unique_all(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
    return keys, keys[counts > 1]


def _is_in(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    return sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == keys


_WINDOW = np.dtype([("h", np.uint64), ("c", np.uint32)])


def _windows(table: pa.Table, replies: np.ndarray, words: int, period: int):
    """For each slice its anchors; and of the chunk's candidate windows keys, checks, ids, places and slices."""
    ids, texts, cut = _sliced(table, words, period)
    kept = [(a, b, x.keys) for a, b, x in cut()]
    repeated = np.union1d(_unique_all([k for _, _, k in kept])[1], replies)
    out, at_all = [], []
    for n, (a, b, x) in enumerate(cut()):
        at = x.candidates(_is_in(x.keys, repeated))
        h, c = x.window_keys(at)
        out.append((h, c, ids[a:b][x.w.text_of[at]], x.w.place[at], np.full(len(at), n)))
        at_all.append(at)
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, d) for d in (np.uint64, np.uint32, np.int64, np.int64, np.int64)]
    return texts, cut, at_all, columns


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of df its id, n_words, n_removed and the kept words joined by one space (``kept``).

    A word goes if it lies in a window of ``words`` words whose sequence also starts earlier: in a document of
    smaller id, or earlier in the same. All windows of the input count. Null and empty texts have no words; rows of
    one id stand for one document, and the same place in them is no earlier one; null ids count as the smallest.
    Other columns of df take no part. Windows are told apart by 96 bits, of two hashes that are made apart.
    """
    period = cover_for(words)
    docs, n = chunked(df, id_col, text_col, chunk_bytes)

    def send_anchors(table):
        _, _, cut = _sliced(table, words, period)
        keys, _ = _unique_all([x.keys for _, _, x in cut()])
        return pa.Table.from_batches([dealt(keys, n, table.column("chunk")[0].as_py())])

    def shared_anchors(table):
        chunk, keys = gathered(table, {"keys": np.uint64})
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
        shared = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        return answers(chunk[shared], keys[shared], names=["keys"])

    def anchors_in(replies):
        return np.frombuffer(b"".join(replies.column("keys").to_pylist()), np.uint64)

    def send_windows(table, replies):
        if not table.num_rows:
            return empty_windows
        *_, (h, c, ids, place, _) = _windows(table, anchors_in(replies), words, period)
        order = np.lexsort((place, ids, c, h))
        h, c, ids, place = (x[order] for x in (h, c, ids, place))
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
        return pa.Table.from_batches([dealt(h[first], n, table.column("chunk")[0].as_py(), c[first], ids[first], place[first].astype(np.int32))])

    def later_windows(table):
        chunk, h, c, ids, place = gathered(table, {"keys": np.uint64, "more0": np.uint32, "more1": np.int64, "more2": np.int32})
        order = np.lexsort((place, ids, c, h))
        h, c, ids, place, chunk = (x[order] for x in (h, c, ids, place, chunk))
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
        head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.zeros(0, np.int64)
        later = np.flatnonzero((ids != ids[head]) | (place != place[head]))
        return answers(chunk[later], h[later], c[later], names=["keys", "checks"])

    def remove(table, replies):
        if not table.num_rows:
            return empty_result
        kind = replies.column("checks").is_null().to_numpy(zero_copy_only=False)
        anchors = anchors_in(replies.filter(pa.array(kind)))
        later = replies.filter(pa.array(~kind))
        texts, cut, at_all, (h, c, ids, place, piece) = _windows(table, anchors, words, period)
        gone = np.zeros(len(h), bool)
        if len(h):
            told = np.zeros(len(b"".join(later.column("keys").to_pylist())) // 8, _WINDOW)
            told["h"] = anchors_in(later)
            told["c"] = np.frombuffer(b"".join(later.column("checks").to_pylist()), np.uint32)
            # entries told by others come first of their key
            hh, cc = np.concatenate([told["h"], h]), np.concatenate([told["c"], c])
            flag = np.concatenate([np.zeros(len(told), np.int8), np.ones(len(h), np.int8)])
            ii = np.concatenate([np.zeros(len(told), np.int64), ids])
            pp = np.concatenate([np.full(len(told), -1, np.int64), place])
            order = np.lexsort((pp, ii, flag, cc, hh))
            hh, cc, ii, pp = (x[order] for x in (hh, cc, ii, pp))
            head = np.flatnonzero(np.concatenate([[True], (hh[1:] != hh[:-1]) | (cc[1:] != cc[:-1])]))
            of = np.repeat(head, np.diff(np.concatenate([head, [len(hh)]])))
            late = (ii != ii[of]) | (pp != pp[of])
            back = np.zeros(len(hh), bool)
            back[order] = late
            gone = back[len(told) :]
        n_words, n_removed, kept = [], [], []
        for i, (a, b, x) in enumerate(cut()):
            w = x.w
            cover = np.zeros(len(w.start) + 1, np.int32)
            at = at_all[i][gone[piece == i]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + words, -1)
            out = np.cumsum(cover[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(out)])
            removed = removed[w.first[1:]] - removed[w.first[:-1]]
            n_words.append(w.counts)
            n_removed.append(removed)
            for j in range(b - a):
                if removed[j]:
                    mine = slice(w.first[j], w.first[j + 1])
                    kept.append(b" ".join(y for y, z in zip(w.bytes_of(j).split(b" "), out[mine].tolist(), strict=True) if not z).decode())
                else:
                    kept.append(w.bytes_of(j).decode())
        return pa.table([table.column("id"), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed).astype(np.int64)), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    empty_windows = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), *(pa.array([], pa.binary()) for _ in range(4))], names=["chunk", "bucket", "keys", "more0", "more1", "more2"])
    empty_result = pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())], names=["id", "n_words", "n_removed", "kept"])

    anchors = docs.groupBy("chunk").applyInArrow(send_anchors, "chunk long, bucket long, keys binary")
    shared = anchors.groupBy("bucket").applyInArrow(shared_anchors, "chunk long, keys binary")
    windows = docs.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send_windows, "chunk long, bucket long, keys binary, more0 binary, more1 binary, more2 binary")
    later = windows.groupBy("bucket").applyInArrow(later_windows, "chunk long, keys binary, checks binary")
    both = shared.withColumn("checks", F.lit(None).cast("binary")).unionByName(later)
    out = docs.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(remove, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
