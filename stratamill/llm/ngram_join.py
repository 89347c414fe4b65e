"""Jaccard join of documents on shingle sets, by trees over count vectors.

Shingles are hashed into groups, and a set is a point: how many shingles it has in each group. Two sets have no more
shingles in common than the sum, over groups, of the smaller of their counts; so boxes of points whose smaller upper
counts sum to less than a pair needs hold no pair, and neither do points. What is left is verified on full sets.

All points in one tree would not do for a cluster: its boxes overlap in most groups. The groups are therefore cut into
``2**k`` blocks, more than a pair may differ in. Sets that differ in at most d shingles have the same counts in all
blocks but d; of blocks in one order of all contents, those of most shingles first, they share one among the first d + 1
of each. A cell holds the points of one such content, and has a tree of its own. Sets of different sizes are cut alike, as
k follows from the larger set of a pair, and a set is cut for every k that a partner can ask for.

A cell's points are first held against its smallest, which joins groups of copies in linear work. Cells whose points
are then still in different components get their tree, which is joined with itself; nodes of one component are passed by.
Large cells are cut into parts, and their trees joined by pairs of parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamill.llm._grams import mixed
from stratamill.llm._shared import checkpointed, heavy_join, lean, sliced_texts, small
from stratamill.llm.components import components
from stratamill.llm.near_dedup import linked, lists, set_hash, sets_of, shingle_sets

#: Groups of the points that boxes are made of, and points of a leaf.
GROUPS, LEAF = 32, 24
#: Groups of a block.
FINE = 256
#: Bytes of the sets whose trees one task joins.
BLOCK_BYTES = 8_000_000


def most_apart(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles a set of n and any partner of it may differ in at most."""
    return n * (100 - percent) // percent


def cut_of(n: np.ndarray, percent: int) -> np.ndarray:
    """k of a pair whose larger set has n shingles: with a quarter of blocks, and two, to spare."""
    return np.ceil(np.log2(1.25 * (most_apart(n, percent) + 1) + 2)).astype(np.int64)


def cells_of(keys: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of sets that lie one after another, and how many each set has; none for sets too small for any partner
    but an equal one."""
    d = most_apart(sizes, percent)
    own, larger = cut_of(sizes, percent), cut_of(sizes * 100 // percent, percent)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    group = mixed(keys ^ np.uint64(0x5851F42D4C957F2D))
    told, of = [], []
    for more in range(int((larger - own).max(initial=0)) + 1):
        here = (d > 0) & (own + more <= larger)
        if not here.any():
            continue
        inside, at = here[owner], np.cumsum(here) - 1
        here, at = np.flatnonzero(here), at[owner]
        k, at = own[here] + more, at[inside]
        g = group[inside]
        block = (g >> (np.uint64(64) - k[at].astype(np.uint64))).astype(np.int64)
        begin = np.cumsum(1 << k) - (1 << k)
        place = begin[at] + block
        order = np.argsort(place, kind="stable")
        place, fine = place[order], mixed((g[order] & np.uint64(FINE - 1)) + np.uint64(FINE))
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        # a sum over shingles of a number for their group: the same for the same counts
        content, held = np.zeros((1 << k).sum(), np.uint64), np.zeros((1 << k).sum(), np.int64)
        content[place[heads]] = np.add.reduceat(fine, heads)
        held[place[heads]] = np.diff(np.concatenate([heads, [len(place)]]))
        row = np.repeat(np.arange(len(here)), 1 << k)
        number = np.arange(len(row)) - begin[row]
        cell = mixed(mixed(content + mixed(number.astype(np.uint64))) + k[row].astype(np.uint64))
        order = np.lexsort((cell, -held, row))
        first = number < d[here][row] + 1  # number counts from 0 in each row, in any order
        told.append(cell[order][first])
        of.append(here[row[first]])
    if not told:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    told, of = np.concatenate(told), np.concatenate(of)
    return told[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(sizes))


def counts_of(keys: np.ndarray, sizes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Points: of each set how many shingles it has in each group."""
    at = np.repeat(np.arange(len(sizes)), sizes) * groups + (mixed(keys + np.uint64(0x2545F491)) % np.uint64(groups)).astype(np.int64)
    return np.bincount(at, minlength=len(sizes) * groups).reshape(-1, groups)


def _points(words: int, percent: int):
    """From batches of (id, text) to id, class of the set, its size, point and cells."""

    def run(batches):
        for batch in batches:
            for x, _, texts in sliced_texts(batch.column(1)):
                for a, b, sizes, keys in shingle_sets(texts, words):
                    full = np.flatnonzero(sizes)
                    cls = np.zeros(b - a, np.int64)
                    if len(full):
                        cls[full] = set_hash(keys, (np.cumsum(sizes) - sizes)[full], sizes[full]).view(np.int64)
                    cells, many = cells_of(keys, sizes, percent)
                    point = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * GROUPS, GROUPS, dtype=np.int32)), pa.array(counts_of(keys, sizes).ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(x + a, b - a), pa.array(cls), pa.array(sizes.astype(np.int64)), point, lists(cells, many)], names=["id", "cls", "n", "point", "cells"])

    return run


def _sets(words: int):
    """From batches of texts to class and set."""

    def run(batches):
        for batch in batches:
            for _, _, texts in sliced_texts(batch.column(0)):
                for _, _, sizes, keys in shingle_sets(texts, words):
                    full = np.flatnonzero(sizes)
                    if len(full):
                        cls = set_hash(keys, (np.cumsum(sizes) - sizes)[full], sizes[full]).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(sizes[full].astype(np.int64)), lists(keys, sizes[full])], names=["cls", "n", "set"])

    return run


def stars(points: DataFrame) -> DataFrame:
    """a, b: links of the classes of each cell to its smallest class, from (cls, cells)."""

    def send(batches):
        """Of each batch every cell once, with its smallest class, and the links of the others to that one."""
        for batch in batches:
            column = batch.column(1)
            cell, many = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            cls = np.repeat(batch.column(0).to_numpy(), many)
            order = np.lexsort((cls, cell))
            cell, cls = cell[order], cls[order]
            heads = np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)]
            first = cls[np.flatnonzero(heads)[np.cumsum(heads) - 1]] if len(cell) else cls
            other = ~heads & (cls != first)
            links = np.unique(np.stack([first[other], cls[other]], 1), axis=0)
            for key, a, b in ((cell[heads], cls[heads], None), (mixed(links[:, 1].copy().view(np.uint64)).view(np.int64), links[:, 0], links[:, 1])):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["cell", "cls", "other"])

    sent = points.select("cls", "cells").mapInArrow(lean(send), "cell long, cls long, other long")
    alone = F.col("other").isNull()
    # a row that is a link already needs no other, and lies wherever its key puts it
    least = F.min(F.when(alone, F.col("cls"))).over(Window.partitionBy("cell"))
    met = sent.select(F.when(alone, least).otherwise(F.col("cls")).alias("a"), F.coalesce("other", "cls").alias("b"))
    return met.where("a != b").distinct()


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose smaller counts sum to what a link needs, from (cls, n, point)."""
    side = lambda c: points.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))
    n = F.col("n_a") + F.col("n_b")
    both = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(both * (100 + percent) >= n * percent).select("a", "b")


class Tree:
    """Points in boxes: each node has the largest counts, the least size and the components of its points, and two
    halves by the group where the points are widest, down to leaves."""

    def __init__(self, points: np.ndarray, n: np.ndarray, comp: np.ndarray, at: np.ndarray):
        self.at, self.most, self.least_n, self.most_n = at, points[at].max(0), n[at].min(), n[at].max()
        self.comps = set(comp[at].tolist())
        self.halves: list[Tree] = []
        if len(at) > LEAF:
            wide = np.concatenate([points[at], n[at, None]], 1)
            order = at[np.argsort(wide[:, np.ptp(wide, 0).argmax()], kind="stable")]
            self.halves = [Tree(points, n, comp, order[: len(at) // 2]), Tree(points, n, comp, order[len(at) // 2 :])]


def tree_join(points: np.ndarray, n: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, same, verify) -> None:
    """Calls verify(i, j) for pairs of a left and a right point that may be linked and are in different components, as
    ``same`` tells, of which some may have been joined meanwhile. Left and right are the same points or other ones."""
    a = Tree(points, n, comp, left)
    stack = [(a, a if left is right else Tree(points, n, comp, right))]
    while stack:
        x, y = stack.pop()
        # a pair needs percent hundredths of its union, and no more than the smaller set can be common
        need = -(-percent * (x.least_n + y.least_n) // (100 + percent))
        if np.minimum(x.most, y.most).sum() < need or 100 * x.most_n < percent * y.least_n or 100 * y.most_n < percent * x.least_n:
            continue
        if len(x.comps) == len(y.comps) == 1 and same(next(iter(x.comps)), next(iter(y.comps))):
            continue
        if x is y and x.halves:
            stack += [(x.halves[0], x.halves[0]), (x.halves[1], x.halves[1]), (x.halves[0], x.halves[1])]
        elif x.halves and (not y.halves or len(x.at) >= len(y.at)):
            stack += [(half, y) for half in x.halves]
        elif y.halves:
            stack += [(x, half) for half in y.halves]
        else:
            both = np.minimum(points[x.at][:, None], points[y.at][None]).sum(2)
            good = both * (100 + percent) >= percent * (n[x.at][:, None] + n[y.at][None])
            for i, j in zip(*np.nonzero(np.triu(good, 1) if x is y else good), strict=True):
                if not same(comp[x.at[i]], comp[y.at[j]]):
                    verify(x.at[i], y.at[j])


def _torn(rows: DataFrame, sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """a, b: components that cells have shown to be linked, from (cell, cls, n, comp) of cells with several components."""
    # of cells that the same sets have, one will do
    of = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("sets"), F.min("cls").alias("lead"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    of = checkpointed(of.groupBy("sets", "lead", "x", "y").agg(F.min("cell").alias("cell"), F.first("n").alias("n")).select("cell", "lead", "n"))
    blocks = 1 + (of.agg(F.sum("n")).first()[0] or 0) * 8 // block_bytes
    large = F.col("size") * 8 > block_bytes
    # cells with the same first set are together in a block, so that what they share is sent once
    of = of.select("cell", "lead", F.col("n").alias("size")).select("cell", F.when(large, F.ceil(F.col("size") * 8 / block_bytes)).otherwise(1).cast("int").alias("many"), F.when(large, F.col("cell")).otherwise(F.pmod(F.xxhash64("lead"), F.lit(blocks))).alias("group"))
    dealt = rows.join(of, "cell").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("many")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "comp", "cell")
    dealt = dealt.groupBy("group", "i", "j", "own", "cls", "comp").agg(F.collect_set("cell").alias("cells")).join(sets.select("cls", "set"), "cls")

    def compare(table):
        flat, at = sets_of(table)
        own, comp = table.column("own").to_numpy(), table.column("comp").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        of, comp = np.unique(comp, return_inverse=True)
        n = np.diff(at)
        points = counts_of(flat.view(np.uint64), n)
        cell, cut = sets_of(table, "cells")
        row = np.repeat(np.arange(len(comp)), np.diff(cut))
        order = np.argsort(cell, kind="stable")
        cell, row = cell[order], row[order]
        root, found = list(range(len(of))), []

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def same(x, y):
            return top(x) == top(y)

        def verify(x, y):
            both = len(np.intersect1d(flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]], assume_unique=True))
            if 100 * both >= percent * (n[x] + n[y] - both):
                found.append((of[comp[x]], of[comp[y]]))
                root[top(comp[x])] = top(comp[y])

        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            mine = row[x:y]
            if i == j:
                tree_join(points, n, comp, mine, mine, percent, same, verify)
            elif len(left := mine[own[mine] == i]) and len(right := mine[own[mine] == j]):
                tree_join(points, n, comp, left, right, percent, same, verify)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.groupBy("group", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of df its id, n_shingles and component_id.

    Texts are linked if their sets of ``words``-word shingles, A-Z lowered, have at least ``percent`` hundredths of their
    union in common; component_id is the smallest id of all that links reach, the row's own included. No link is left
    out, whatever the number of a cell's sets. Null and empty texts have no shingles and no links. Rows of equal id are
    rows like others; a null id is a component's id only if all its ids are null. Shingles, sets and cells are told
    apart by 64-bit hashes. Other columns of df take no part, and an empty table has no rows.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = checkpointed(docs.mapInArrow(lean(_points(words, percent)), "id long, cls long, n long, point array<int>, cells array<long>"))
    classes = made.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("cells").alias("cells"))
    classes = checkpointed(classes)
    pairs = checkpointed(stars(classes.where(F.size("cells") > 0)))
    near = checkpointed(bounded(pairs, classes, percent))
    met = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    family = checkpointed(classes.join(met, "cls").select("cls", "rep", "n", "cells"))
    # the texts are read again, and only those of sets that share a cell are encoded as sets
    texts = docs.join(small(family.select("rep").distinct()), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = texts.mapInArrow(lean(_sets(words)), "cls long, n long, set array<long>")
    sets = checkpointed(sets.join(small(family.select("cls")), "cls", "left_semi").select("cls", "n", "set"))
    rows, different = sets.select("cls").agg(F.count("*"), F.countDistinct("cls")).first()
    if rows > different:  # rows of one id and set
        sets = checkpointed(sets.groupBy("cls").agg(F.first("n").alias("n"), F.first("set").alias("set")))
    comps = components(checkpointed(linked(near, sets, percent)))
    comp_of = family.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", "n", "cells", F.coalesce("component", "cls").alias("comp"))
    comp_of = checkpointed(comp_of)
    side = lambda name: comp_of.select(F.col("cls").alias(name), F.col("comp").alias(f"c{name}"))
    apart = pairs.join(side("a"), "a").join(side("b"), "b").where("ca != cb").select(F.explode(F.array("ca", "cb")).alias("comp")).distinct()
    in_cells = comp_of.join(small(checkpointed(apart)), "comp", "left_semi").select("cls", "n", "comp", F.explode("cells").alias("cell")).distinct()
    in_cells = checkpointed(in_cells)
    # two sets of a cell were held against each other
    torn = in_cells.groupBy("cell").agg(F.count("*").alias("sets"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("sets > 2 and low < high").select("cell")
    rows = checkpointed(in_cells.join(small(checkpointed(torn)), "cell", "left_semi").select("cell", "cls", "n", "comp"))
    merged = components(checkpointed(_torn(rows, sets, percent, block_bytes)))
    final = comp_of.select("cls", "rep", "comp").join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("cls", "rep", F.coalesce("component", "comp").alias("comp"))
    final = checkpointed(final)
    least = checkpointed(final.groupBy("comp").agg(F.min("rep").alias("least"), F.count("*").alias("rows")))
    told = heavy_join(final, least, "comp").select("cls", "least")
    answers = checkpointed(classes.select("cls", "rep", "rows").join(told, "cls", "left").select("cls", "rows", F.coalesce("least", "rep").alias("least")))
    alone = made.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = heavy_join(made.where("n > 0").select("id", "cls", "n"), answers, "cls").select("id", "n", F.col("least").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
