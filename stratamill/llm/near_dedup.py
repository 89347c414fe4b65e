"""Near-duplicate documents: MinHash with tensored banding.

Each different shingle set gets ``collections`` small hash collections of two minhashes. The table keys are all pairs
of collections: c collections make c(c-1)/2 tables, so hash work grows only with about the square root of the
tables. Two sets of similarity s meet in a table unless fewer than two of their collections agree; with 14
collections that leaves out 2 in 10,000 pairs at s = 0.75, and fewer above.

Candidates are verified on full sets. Members of a table's bucket are first compared with the bucket's smallest, which
joins groups of copies in linear work. Where that leaves a bucket's members in different components, all sets of
these components are joined exactly: sets of similarity s share one of their rarest ``(1 - s) n + 1`` shingles, so
sets of different components that share such a shingle are compared, without giving out the pairs. Shingles that most
sets of a group have are the last of their order, so what is sent for the comparison is little.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamill.llm._grams import WordBuffer, byte_slices, joined, mixed, run_hashes
from stratamill.llm._shared import checkpointed, heavy_join, lean, sliced_texts, small
from stratamill.llm.components import components

COLLECTIONS = 14
#: Sets that are verified against one in one task.
PART = 256
#: Bytes of the sets that one task compares with each other.
BLOCK_BYTES = 8_000_000


def shingle_sets(texts: list[str | None], words: int):
    """For slices of texts: the texts' range, the number of shingles of each, and all sets, sorted, one after another.

    A text of fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    for a, b in byte_slices(texts):
        w = WordBuffer(texts[a:b], lower=True)
        if not len(w.start):
            yield a, b, np.zeros(b - a, np.int64), np.zeros(0, np.uint64)
            continue
        h, at = w.hashes(31), w.windows(words)
        keys, of = [run_hashes(h, words)[at] if len(at) else np.zeros(0, np.uint64)], [w.text_of[at]]
        for n in range(1, words):  # texts of n words
            short = np.flatnonzero(w.counts == n)
            whole = h[w.first[short]]
            for j in range(1, n):
                whole = joined(whole, h[w.first[short] + j])
            keys.append(whole)
            of.append(short)
        keys, of = np.concatenate(keys), np.concatenate(of)
        order = np.lexsort((keys, of))
        keys, of = keys[order], of[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
        yield a, b, np.bincount(of[new], minlength=b - a), keys[new]


def set_hash(keys: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set."""
    one, two = mixed(keys + np.uint64(1)), mixed(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return mixed(np.add.reduceat(one, heads) ^ mixed(np.bitwise_xor.reduceat(two, heads) + sizes.astype(np.uint64)))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _signatures(words: int, collections: int, with_sets: bool):
    """A function from batches of (id, text) to id, class of the set, its size, and sketches or the set itself."""
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 2**62, (2 * collections, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            each = ((x + a, x + b, sizes, keys) for x, _, texts in sliced_texts(batch.column(1)) for a, b, sizes, keys in shingle_sets(texts, words))
            for a, b, sizes, keys in each:
                full = np.flatnonzero(sizes)
                heads = (np.cumsum(sizes) - sizes)[full]
                cls = np.zeros(b - a, np.int64)
                if len(full):
                    cls[full] = set_hash(keys, heads, sizes[full]).view(np.int64)
                if with_sets:
                    more = lists(keys, sizes)
                else:
                    sketch = np.zeros((b - a, collections), np.uint64)
                    spread = mixed(keys)
                    for c in range(collections if len(full) else 0):
                        x, y = (np.minimum.reduceat(mixed_by(spread, *odd[2 * c + i]), heads) for i in (0, 1))
                        sketch[full, c] = mixed(x ^ mixed(y + np.uint64(c)))
                    more = lists(sketch.ravel(), np.full(b - a, collections))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(cls), pa.array(sizes.astype(np.int64)), more], names=["id", "cls", "n", "set" if with_sets else "sketch"])

    return run


def mixed_by(h: np.ndarray, odd: np.uint64, add: np.uint64) -> np.ndarray:
    """A keyed order of values, by their high bits."""
    h = (h ^ add) * odd
    return (h ^ (h >> np.uint64(32))) * add


def candidates(classes: DataFrame, collections: int = COLLECTIONS) -> DataFrame:
    """a, b: links of the classes of each table bucket to its smallest class, from (cls, sketch)."""
    pairs = list(combinations(range(collections), 2))

    def send(batches):
        """Of each batch every key once, with its smallest class, and the links of the others to that one."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sketch = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, collections)
            keys = np.concatenate([mixed(mixed(sketch[:, i] + np.uint64(i)) ^ (sketch[:, j] + np.uint64(j))) for i, j in pairs])
            ids = np.tile(ids, len(pairs))
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            heads = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            first = ids[np.flatnonzero(heads)[np.cumsum(heads) - 1]] if len(keys) else ids
            other = ~heads & (ids != first)
            links = np.unique(np.stack([first[other], ids[other]], 1), axis=0)
            for cls, key, other_of in ((ids[heads], keys[heads], None), (links[:, 0], mixed(links[:, 1].view(np.uint64)), links[:, 1])):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls), pa.nulls(len(cls), pa.int64()) if other_of is None else pa.array(other_of)], names=["key", "cls", "linked"])

    sent = classes.select("cls", "sketch").mapInArrow(lean(send), "key long, cls long, linked long")
    # a row that is a link already needs no other, and lies wherever its key puts it
    least = F.min(F.when(F.col("linked").isNull(), F.col("cls"))).over(Window.partitionBy("key"))
    met = sent.select(F.when(F.col("linked").isNull(), least).otherwise(F.col("cls")).alias("a"), F.coalesce("linked", "cls").alias("b"))
    return met.where("a != b").distinct()


def sets_of(table: pa.Table, column: str = "set") -> tuple[np.ndarray, np.ndarray]:
    """All sets of a table, one after another, and where each begins, one more at the end."""
    lists = table.column(column).combine_chunks()
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), offsets - offsets[0]


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are as similar as asked for. The pairs of one a are verified together,
    in parts of about PART, each of which gets the set of a."""

    def verify(table):
        a = table.column("a")[0].as_py()
        cls = table.column("cls").to_numpy()
        flat, at = sets_of(table)
        n = np.diff(at)
        own = np.flatnonzero(cls == a)[0]
        both = np.add.reduceat(np.isin(flat, flat[at[own] : at[own + 1]]), at[:-1])
        good = cls[(100 * both >= percent * (n + n[own] - both)) & (cls != a)]
        return pa.table([pa.array(np.full(len(good), a)), pa.array(good)], names=["a", "b"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("cls"))
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("cls"))
    rows = members.unionByName(own).join(sets.select("cls", "set"), "cls")
    return rows.groupBy("a", "part").applyInArrow(verify, "a long, b long")


def _rest(sets: DataFrame, percent: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b: components that have sets as similar as asked for, from all (cls, n, set, comp) of components that may.

    A shingle's rank is its number of sets. Sets that have one of their rarest shingles in common are compared, those of
    many shingles together in blocks; the sets of a shingle that has more than a block are compared in pairs of blocks.
    """
    tokens = sets.select("cls", "comp", "n", F.explode("set").alias("token"))
    seen = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    place = F.row_number().over(Window.partitionBy("cls").orderBy("df", "token"))
    told = tokens.join(seen, "token").select("cls", "comp", "n", "token", "low", "high", place.alias("place"))
    told = checkpointed(told.where(F.expr(f"place <= n - ceil({percent} * n / 100) + 1 and low < high")).select("cls", "comp", "n", "token"))
    # of shingles that the same sets have, as those of a passage, one will do
    of = told.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("sets"), F.min("cls").alias("lead"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    of = checkpointed(of.groupBy("sets", "lead", "x", "y").agg(F.min("token").alias("token"), F.first("n").alias("n")).select("token", "lead", "n"))
    blocks = 1 + (of.agg(F.sum("n")).first()[0] or 0) * 8 // block_bytes
    # shingles with the same first set are together in a block, so that what they share is sent once
    large = F.col("size") * 8 > block_bytes
    of = of.select("token", "lead", F.col("n").alias("size")).select("token", F.when(large, F.ceil(F.col("size") * 8 / block_bytes)).otherwise(1).cast("int").alias("many"), F.when(large, F.col("token")).otherwise(F.pmod(F.xxhash64("lead"), F.lit(blocks))).alias("group"))
    dealt = told.join(of, "token").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("many")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "comp", "token")
    rows = dealt.groupBy("group", "i", "j", "cls", "comp").agg(F.collect_set("token").alias("tokens")).join(sets.select("cls", "set"), "cls")

    def compare(table):
        comp, found = table.column("comp").to_numpy(), set()
        flat, at = sets_of(table)
        token, cut = sets_of(table, "tokens")
        row = np.repeat(np.arange(len(comp)), np.diff(cut))
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            mine = row[x:y]
            of, first = np.unique(comp[mine], return_inverse=True)
            if len(of) < 2:
                continue
            n = at[mine + 1] - at[mine]
            _, code = np.unique(np.concatenate([flat[at[r] : at[r + 1]] for r in mine]), return_inverse=True)
            begin = np.cumsum(n) - n
            held = np.zeros(code.max() + 1, bool)
            largest = np.bincount(first).argmax()  # its sets need no comparison with each other
            for k in np.flatnonzero(first != largest):
                held[:] = False
                held[code[begin[k] : begin[k] + n[k]]] = True
                both = np.add.reduceat(held[code], begin)
                for m in np.flatnonzero((100 * both >= percent * (n + n[k] - both)) & (first != first[k])):
                    found.add((min(of[first[k]], of[first[m]]), max(of[first[k]], of[first[m]])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.groupBy("group", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, collections: int = COLLECTIONS) -> DataFrame:
    """Per row of df its id, n_shingles, component_id and kept.

    Texts are linked if their sets of ``words``-word shingles, A-Z lowered, have at least ``percent`` hundredths of
    their union in common; component_id is the smallest id of all that links reach, and kept says whether it is the
    row's own. Null and empty texts have no shingles and no links. Rows of equal id are rows like others: they are
    kept or not together. A null id is never a component's id unless all its ids are null, and is not kept with others.
    Shingles and sets are told apart by 64-bit hashes. Other columns of df take no part.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = checkpointed(docs.mapInArrow(lean(_signatures(words, collections, False)), "id long, cls long, n long, sketch array<long>"))
    classes = checkpointed(signed.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("sketch").alias("sketch")))
    pairs = checkpointed(candidates(classes, collections))
    family = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    reps = checkpointed(classes.join(family, "cls").select(F.col("rep").alias("id"), "cls"))
    # the texts are read again, and only those of candidates are encoded as sets
    texts = docs.join(small(reps.select(F.col("id").alias("rep")).distinct()), F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    sets = texts.mapInArrow(lean(_signatures(words, collections, True)), "id long, cls long, n long, set array<long>")
    sets = checkpointed(sets.join(small(reps.select("cls").distinct()), "cls", "left_semi").select("cls", "n", "set"))
    rows, different = sets.select("cls").agg(F.count("*"), F.countDistinct("cls")).first()
    if rows > different:  # rows of one id and text
        sets = checkpointed(sets.groupBy("cls").agg(F.first("n").alias("n"), F.first("set").alias("set")))
    comps = components(checkpointed(linked(pairs, sets, percent)))
    comp_of = sets.select("cls").join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("comp"))
    comp_of = checkpointed(comp_of)
    side = lambda name: comp_of.select(F.col("cls").alias(name), F.col("comp").alias(f"c{name}"))
    torn = pairs.join(side("a"), "a").join(side("b"), "b").where("ca != cb").select(F.explode(F.array("ca", "cb")).alias("comp")).distinct()
    torn = checkpointed(torn.join(comp_of, "comp"))
    merged = components(checkpointed(_rest(checkpointed(sets.join(small(torn), "cls")), percent)))
    final = comp_of.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("cls", F.coalesce("component", "comp").alias("comp"))
    final = checkpointed(final.join(reps, "cls"))
    least = checkpointed(final.groupBy("comp").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    named = heavy_join(final, least, "comp").select("cls", "least")
    answers = checkpointed(classes.select("cls", "rep", "rows").join(named, "cls", "left").select("cls", "rows", F.coalesce("least", "rep").alias("component_id")))
    out = heavy_join(signed.where("n > 0").select("id", "cls", "n"), answers, "cls").select("id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(signed.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
