"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

Words are runs of letters and digits, lowered; a window's or item's weighted shingles are its 5-word shingles with
their numbers of occurrences: the second, third and later occurrence of a shingle count as shingles of their own, so
weighted similarity is that of sets, and a similarity of 0.75 is a cosine of 0.857, about 11 of 64 bits. For each size that items have, every window of a text that holds a benchmark shingle
gets a SimHash; windows without any have similarity 0 to all items. Fingerprints are cut into 8 blocks of a byte. If two
differ in at most 23 bits, some block differs in at most 2, so looking the window's blocks up among all bytes within 2
of an item's finds every pair within the radius. Their weighted Jaccard similarity is then computed exactly.
All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.llm._shared import checkpointed, small

WORDS = 5
RADIUS, BLOCKS, BITS = 23, 8, 8


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(text: Column) -> Column:
    """64-bit hashes of all runs of five words in order; none of fewer words or null.

    The words are bound to a variable of a lambda, so that they are cut once and not for each run.
    """
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WORDS))))
    none = F.array().cast("array<bigint>")
    return F.coalesce(F.get(F.transform(F.array(_words(text)), lambda w: F.when(F.size(w) >= WORDS, runs(w)).otherwise(none)), F.lit(0)), none)


def _fingerprints(rows: DataFrame, keys: list[str], hashes: str, out: str) -> DataFrame:
    """keys and SimHash of rows with arrays of hashes: each bit as most shingles, by weight, have it.

    Four bits are counted in one number, 16 bits apart, so 16 sums count all 64.
    """
    h, lanes = F.col("_h"), range(0, 64, 4)
    spread = {k: sum((F.shiftleft(F.shiftright(h, k + i).bitwiseAND(F.lit(1)), 16 * i) for i in range(4)), F.lit(0).cast("bigint")) for k in lanes}
    sums = rows.select(*keys, F.explode(hashes).alias("_h")).groupBy(*keys).agg(F.count("*").alias("_n"), *(F.sum(spread[k]).alias(f"_{k}") for k in lanes))
    bit = lambda k, i: F.shiftleft((2 * F.shiftright(F.col(f"_{k}"), 16 * i).bitwiseAND(F.lit(0xFFFF)) > F.col("_n")).cast("bigint"), k + i)
    return sums.select(*keys, sum((bit(k, i) for k in lanes for i in range(4)), F.lit(0).cast("bigint")).alias(out))


def _occurrences(h: Column) -> Column:
    """Hashes, all different: of one that comes again, later occurrences get hashes of their own."""
    nth = lambda x, i: F.size(F.filter(F.slice(h, F.lit(1), i + 1), lambda y: y == x))
    again = F.transform(h, lambda x, i: F.when(nth(x, i) == 1, x).otherwise(F.xxhash64(x, nth(x, i))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(again)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.75) -> DataFrame:
    """doc id, item id, start_word, n_words and similarity of the best window, for each document and item that have
    a window of at least that similarity.

    Windows have the item's number of words, or the whole document's where it has fewer. Null and empty texts, and
    items of fewer than five words, match nothing. Rows of one id count together; ties go to the first window. Items
    up to 65,000 words are counted rightly.
    """
    items = checkpointed(benchmark.select(F.col(item_col).alias("item"), _shingles(F.col(item_text_col)).alias("ih")))
    items = items.where(F.size("ih") > 0).select("item", F.size("ih").alias("size"), _occurrences(F.col("ih")).alias("ih"), F.xxhash64("ih").alias("ikey"), F.col("ih").alias("plain"))
    shared = small(checkpointed(items.select("size", F.explode("plain").alias("h")).distinct()))
    items = items.drop("plain")

    texts = docs.select(F.col(id_col).alias("id"), _shingles(F.col(text_col)).alias("dh"))
    # only windows that hold a shingle of an item of their size can be similar to one
    hits = texts.select("id", F.posexplode("dh").alias("at", "h")).join(shared, "h").select("id", "size", "at")
    starts = hits.select("id", "size", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.col("at"))).alias("start")).distinct()
    starts = checkpointed(starts.groupBy("id", "size").agg(F.collect_list("start").alias("starts")).withColumnRenamed("id", "sid"))

    windows = texts.join(small(starts, F.size("starts")), F.col("id").eqNullSafe(F.col("sid"))).select("id", "size", "dh", F.explode("starts").alias("start"))
    inside = (F.col("start") + F.col("size") <= F.size("dh")) | ((F.col("start") == 0) & (F.col("size") > F.size("dh")))
    windows = windows.where(inside).select("id", "size", "start", F.expr("slice(dh, start + 1, size)").alias("wh"))
    windows = checkpointed(windows.select("id", "size", "start", F.xxhash64("wh").alias("key"), _occurrences(F.col("wh")).alias("wh")))
    blocks = lambda fp: F.array(*(F.struct(F.lit(b).alias("block"), F.shiftright(fp, BITS * b).bitwiseAND(F.lit(2**BITS - 1)).alias("value")) for b in range(BLOCKS)))
    around = [x for x in range(2**BITS) if x.bit_count() <= RADIUS // BLOCKS]
    marked = _fingerprints(items, ["item", "size", "ikey"], "ih", "ifp")
    known = marked.select("item", "size", "ifp", F.explode(blocks(F.col("ifp"))).alias("x"))
    known = known.select("item", "size", "ifp", "x.block", F.explode(F.array(*map(F.lit, around))).alias("flip"), F.col("x.value").alias("own"))
    known = small(checkpointed(known.select("item", "size", "ifp", "block", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))))
    probes = _fingerprints(windows.dropDuplicates(["id", "size", "start", "key"]), ["id", "size", "start", "key"], "wh", "fp")
    probes = probes.select("id", "size", "start", "fp", F.explode(blocks(F.col("fp"))).alias("x")).select("id", "size", "start", "fp", "x.block", "x.value")
    met = probes.join(known, ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    met = met.select(F.col("id").alias("mid"), F.col("size").alias("msize"), F.col("start").alias("mstart"), "item").distinct()

    same = F.col("id").eqNullSafe(F.col("mid")) & (F.col("size") == F.col("msize")) & (F.col("start") == F.col("mstart"))
    pairs = windows.select("id", "size", "start", "wh").join(met, same).join(small(items.select("item", "ih"), F.size("ih")), "item")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("wh", "ih")))
    pairs = pairs.withColumn("similarity", F.col("both") / (F.size("wh") + F.size("ih") - F.col("both"))).where(F.col("similarity") >= similarity)
    best = pairs.groupBy("id", "item").agg(F.min_by(F.struct("start", F.size("wh").alias("n"), "similarity"), F.struct(-F.col("similarity"), "start")).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("x.start").alias("start_word"), (F.col("x.n") + WORDS - 1).alias("n_words"), F.col("x.similarity").alias("similarity"))
