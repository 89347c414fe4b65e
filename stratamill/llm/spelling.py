"""Spelling variants: words of a corpus that differ by one code point, found in a forward and a reversed dictionary.

One edit leaves a half of a word intact. So each word stands in two sorted dictionaries: a forward one, where words that
share their first half lie together, and a reversed one, where words that share their last half do. Each is dealt
by ranges, and each range is scanned block by block; only words of a block are compared.

A block belongs to a length, that of the longer word of a pair, and to a region of places where the edit may be: it holds
the words of this length, and those of one less, that are equal before the region and after it. Blocks of more words than
can be compared at once are divided: an edit is in one half of the region or in the other, so their words go to two
blocks of half the region, which share more. A region of one place ends this, as its words differ in one code point only.
Each pair is told by the one block whose region has the first place where its words differ.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm._shared import checkpointed, lean, sliced_texts, small

#: Fixed value: runs of letters.
RUN = r"[A-Za-z\u00C0-\u00FF]+"
#: Words that are compared with each other, and code points of them at once.
BLOCK, BLOCK_POINTS = 256, 4_000_000
#: Different words that a task holds before it hands them on, and runs that it cuts from a text at once.
HELD, CUT = 300_000, 100_000


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: str = RUN, least_points: int = 5, least_n: int = 3, every: int | None = 97) -> DataFrame:
    """word and n: the words of at least so many code points that whole texts have at least so many times.

    Words are runs of letters with A-Z lowered. With ``every``, those of a document whose hash it divides lose a code
    point first, as if misspelt. Null and empty texts have no words. A null id counts as an empty one; rows
    that repeat count each. Tasks count the words of their batches before these are dealt.
    """

    def count(batches):
        find = re.compile(run).finditer
        held: Counter = Counter()

        def flush():
            words, n = list(held.keys()), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in sliced_texts(batch.column(1)):
                for doc_id, text in zip(ids.slice(a, b - a).to_pylist(), texts, strict=True):
                    runs = (m[0] for m in find(text.encode().lower().decode() if text else ""))
                    prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                    while part := Counter(islice(runs, CUT)):
                        for w, n in part.items():
                            if len(w) < least_points:
                                continue
                            if every and (h := zlib.crc32(w.encode(), prefix)) % every == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1 :]
                                if len(w) < least_points:
                                    continue
                            held[w] += n
                        if len(held) > HELD:
                            yield flush()
        yield flush()

    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _most(block: int) -> Column:
    """Words of a block that are compared at once: fewer, where they are long."""
    return F.greatest(F.lit(2), F.least(F.lit(block), F.floor(F.lit(BLOCK_POINTS) / F.col("size"))))


_BLOCK = ["size", "lo", "hi", "head", "tail"]


def _placed(rows: DataFrame) -> DataFrame:
    """word, n, and the block of its region: its length, and what a word has before the region, and after it, reversed."""
    head, tail = F.expr("substring(word, 1, lo)"), F.expr("reverse(right(word, size - hi))")
    return rows.select("word", "n", "size", "lo", "hi", head.alias("head"), tail.alias("tail"))


def dictionaries(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n and block of every entry of the two dictionaries, large blocks divided."""
    size = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    half = F.floor(F.col("size") / 2).cast("int")
    regions = F.array(F.struct(half.alias("lo"), F.col("size").alias("hi")), F.struct(F.lit(0).alias("lo"), half.alias("hi")))
    rows = words.where("word != ''").select("word", "n", size).select("word", "n", "size", F.explode(regions).alias("r"))
    rows = checkpointed(_placed(rows.select("word", "n", "size", "r.lo", "r.hi").where("lo < hi")))
    out = None
    while True:
        large = rows.where("hi - lo > 1").groupBy(*_BLOCK).count().where(F.col("count") > _most(block)).select(*_BLOCK)
        large = small(checkpointed(large), F.col("size"))
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        kept = rows.join(large, _BLOCK, "left_anti")
        out = kept if out is None else out.unionByName(kept)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))).alias("r")
        rows = rows.join(large, _BLOCK, "left_semi").select("word", "n", "size", halves)
        rows = checkpointed(_placed(rows.select("word", "n", "size", "r.lo", "r.hi")))


def _points(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1) if words and words[0] else np.zeros((len(words), 0), np.uint32)


def near(words: list[str], size: int, lo: int, hi: int) -> np.ndarray:
    """Which words of a block are near each other, as a matrix of booleans: pairs that differ by one code point in the
    region, and no earlier place tells them apart."""
    long = np.array([i for i, w in enumerate(words) if len(w) == size], np.int64)
    short = np.array([i for i, w in enumerate(words) if len(w) < size], np.int64)
    out = np.zeros((len(words), len(words)), bool)
    a, b = _points([words[i][lo:hi] for i in long]), _points([words[i][lo : hi - 1] for i in short])
    for k, i in enumerate(long):
        out[i, long] = (a != a[k]).sum(1) == 1
        if len(short):
            equal, shifted = b == a[k, :-1], b == a[k, 1:]
            # where they first differ; all after it has to be equal, one place on
            first = np.where(equal.all(1), hi - lo - 1, (~equal).argmax(1)) if hi - lo > 1 else np.zeros(len(short), np.int64)
            after = np.where(shifted.all(1), 0, hi - lo - 1 - (~shifted[:, ::-1]).argmax(1)) if hi - lo > 1 else first
            good = after <= first
            if hi < size and words[i][hi - 1] == words[i][hi]:
                good &= first < hi - lo - 1  # they first differ after the region
            out[i, short] = good
            out[short, i] = good
    return out


def variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, and form and form_n, the near word of largest n (the smallest of these), for every word that has a
    near one, from (word, n) of different words."""

    def told(words, n, key):
        """Words of a block that have near ones, with the best of these."""
        if len(words) < 2:
            return []
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        words, n = [words[i] for i in order], [n[i] for i in order]
        found = near(words, *key[:3])
        many, best = found.sum(1).tolist(), found.argmax(1).tolist()
        return [(w, m, words[i], n[i]) for w, m, i in zip(words, many, best, strict=True) if m]

    def scan(batches):
        """Blocks of a range, one after another; the last of a batch may go on in the next."""
        key, held, held_n = None, [], []
        for batch in batches:
            columns, rows = batch.select(_BLOCK).columns, batch.num_rows
            if not rows:
                continue
            new = np.zeros(rows, bool)
            for c in columns:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(new).tolist(), rows]
            words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            key_at = lambda i: tuple(c[i].as_py() for c in columns)  # noqa: B023, E731
            out = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x or key_at(0) != key:
                    out += told(held, held_n, key)
                    key, held, held_n = None, [], []
                    if y < rows:  # it begins and ends in the batch
                        if y - x > 1:
                            out += told(words[x:y], n[x:y], key_at(x))
                        continue
                    key = key_at(x)
                held += words[x:y]
                held_n += n[x:y]
            yield rows_of(out)
        yield rows_of(told(held, held_n, key))

    def rows_of(out):
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "form", "form_n"])

    # equal blocks are never cut by a range, and a range holds them in order
    dealt = dictionaries(words, block).select("word", "n", *_BLOCK).repartitionByRange(*_BLOCK).sortWithinPartitions(*_BLOCK)
    found = dealt.mapInArrow(lean(scan), "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("by"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.by")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word and root, the end of the links (word, form) from it; no word has two links, and none leads back. Each round
    halves the paths that are left, and what has come to its end is only looked up by the others."""
    ends = checkpointed(links.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not ends.where("open").isEmpty():
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = ends.where("open").join(on, "root", "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        ends = checkpointed(ends.where("not open").unionByName(moved))
    return ends.select("word", "root")


def spelling_forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = 5, least_n: int = 3, every: int | None = 97, times: int = 2, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``word_counts``.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n, the smallest in code-point order of several, if it has at least ``times`` the word's n, and null otherwise;
    root is where forms lead in the end, the word itself if it has none. n_near counts all near words. An empty table, and
    texts without words, give no rows. Other columns of df take no part.
    """
    words = checkpointed(word_counts(df, id_col, text_col, least_points=least_points, least_n=least_n, every=every))
    found = words.join(variants(words, block), "word", "left")
    good = F.col("form_n") >= times * F.col("n")
    told = checkpointed(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
