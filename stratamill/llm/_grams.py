"""Hashes of runs of words, for many texts at once, and their exchange between chunks of documents.

Texts are cut into words at ASCII white space and laid out in one byte buffer, a space between words and a line
feed after each text. Each word's bytes are hashed, eight at a time, and the hash of a run is made of the hashes of its
halves, as in a tree. Every step scrambles 64 bits in a way that is not linear, so runs of the same few words collide no
more often than any others do.

To compare what whole corpora hold, documents are dealt into chunks of about one size. Each chunk sends its distinct
hashes, sorted, as one binary per bucket of the hash range; a bucket compares the chunks and answers to each. A key
that is everywhere is sent once by a chunk, so no bucket gathers all rows of a hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4_000_000
SLICE_BYTES = 1_500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of runs from those of their two parts, in order."""
    return mixed(mixed(left + _MIX) * np.uint64(0xD6E8FEB86659FD93) + right)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """For each place the hash of the n words from there, from the hashes of single words."""
    out, at, power, size = None, 0, words, 1
    while True:
        if n & size:
            out = power if out is None else joined(out[: max(0, len(words) - at - size + 1)], power[at:])
            at += size
        if 2 * size > n:
            return out
        power, size = joined(power[:-size], power[size:]), 2 * size


#: Bytes of words that are hashed in arrays; longer ones are hashed one by one.
LONG_WORD = 64
_MASKS = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each word."""
    pad = np.zeros(len(buffer) + 16 + -len(buffer) % 8, np.uint8)
    pad[: len(buffer)] = buffer
    eights = pad.view("<u8")

    def bytes_at(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        by = ((at & 7) << 3).astype(np.uint64)
        i = at >> 3
        return ((eights[i] >> by) | ((eights[i + 1] << (np.uint64(63) - by)) << np.uint64(1))) & _MASKS[np.minimum(size, 8)]

    size = end - start
    h = mixed(bytes_at(start, size) + mixed(size.astype(np.uint64) * _MIX + np.uint64(seed)))
    for k in range(8, LONG_WORD, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        h[more] = joined(h[more], bytes_at(start[more] + k, size[more] - k))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buffer[start[i] : end[i]].tobytes(), digest_size=8, salt=b"%d" % seed).digest(), "little")
    return h


class WordBuffer:
    """Words of some texts. first: index of each text's first word, one more at the end; start, end: bytes of words."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        each = []
        for t in texts:
            b = t.encode() if t else b""
            each.append(b" ".join((b.lower() if lower else b).split()))
        self.buffer = np.frombuffer(b"\n".join(each) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        self.text_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        space = self.buffer == 0x20
        breaks = np.flatnonzero(space | (self.buffer == 0x0A))
        full = sizes > 0
        counts = np.zeros(len(each), np.int64)
        if full.any():
            inside = np.concatenate([[0], np.cumsum(space)])
            counts = np.where(full, inside[self.text_start[1:]] - inside[self.text_start[:-1]] + 1, 0)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.counts = counts
        # an empty text has a break but no word
        blank = self.text_start[:-1][~full]
        self.end = breaks[~np.isin(breaks, blank)] if len(blank) else breaks
        if len(self.end):
            text_of = np.repeat(np.arange(len(each)), counts)
            before = np.concatenate([[-1], self.end[:-1]]) + 1
            heads = self.first[:-1][full]
            before[heads] = self.text_start[:-1][full]
            self.start, self.text_of = before, text_of
        else:
            self.start = self.text_of = np.zeros(0, np.int64)
        self.place = np.arange(len(self.start)) - self.first[self.text_of]

    def windows(self, words: int) -> np.ndarray:
        """Indexes of words that begin a run of that many words inside their text."""
        return np.flatnonzero(self.place + words <= self.counts[self.text_of])

    def hashes(self, seed: int = 0) -> np.ndarray:
        return word_hashes(self.buffer, self.start, self.end, seed)

    def bytes_of(self, i: int) -> bytes:
        return self.buffer[self.text_start[i] : self.text_start[i + 1] - 1].tobytes()


def byte_slices(texts: list[str | None], most: int = SLICE_BYTES):
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def chunked(df: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """id, text, chunk and ``more`` columns; and the number of chunks, which grows with the bytes of text. Rows are dealt
    by id and text, so rows that share an id, null ones too, do not share a chunk."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    n = 1 + total // chunk_bytes
    key = F.col(f"`{id_col}`").cast("long")
    text = F.col(f"`{text_col}`").cast("string")
    return df.select(key.alias("id"), text.alias("text"), F.pmod(F.xxhash64(key, text), F.lit(n)).alias("chunk"), *more), n


def dealt(keys: np.ndarray, buckets: int, chunk: int, *more: np.ndarray) -> pa.RecordBatch:
    """One row per bucket that has any of the sorted keys: chunk, bucket, the keys and what belongs to them."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    n = len(edges) - 1
    columns = [pa.array(np.full(n, chunk, np.int64)), pa.array(bucket[edges[:-1]].astype(np.int64))]
    for x in (keys, *more):
        columns.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * x.dtype.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())]))
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "keys", *(f"more{i}" for i in range(len(more)))])


def gathered(table: pa.Table, dtypes: dict[str, type]) -> tuple[np.ndarray, ...]:
    """The chunk of each key, and the arrays of the binary columns, of one bucket."""
    sizes = np.array([len(b) // np.dtype(dtypes["keys"]).itemsize for b in table.column("keys").to_pylist()], np.int64)
    chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
    return chunk, *(np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in dtypes.items())


def answers(chunk: np.ndarray, *columns: np.ndarray, names: list[str]) -> pa.Table:
    """One row per chunk with the binaries of its entries, in the order given."""
    order = np.argsort(chunk, kind="stable")
    chunk, columns = chunk[order], [x[order] for x in columns]
    edges = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else np.zeros(1, np.int64)
    out = [pa.array(chunk[edges[:-1]])]
    for x in columns:
        out.append(pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))
    return pa.table(out, names=["chunk", *names])
