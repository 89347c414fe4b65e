"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, benchmark leaks go, personal
data gets pseudonyms, and what is left is encoded. Each stage works on all that the one before has kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.llm import bpe, decontaminate, near_dedup, pseudonyms, toxicity
from stratamill.llm._shared import checkpointed, crc_mod, shared_folder, small, table
from stratamill.llm.queries import KEY, vocabulary


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Names of columns that stages make and drop again.
WITHIN = ("_key", "_toxic", "_passages", "_found")


def _apart(stage: Stage) -> Stage:
    """The stage, with a caller's columns of names that it uses itself put aside while it runs, in any case of letters."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        taken, aside = {c.lower() for c in docs.columns}, {}
        for c in docs.columns:
            if c.lower() in WITHIN:
                aside[c] = next(n for n in (f"{c}_{i}" for i in range(len(taken) + 1)) if n.lower() not in taken)
                taken.add(aside[c].lower())
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.withColumnsRenamed({new: c for c, new in aside.items()})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of 64 bits for doc_id and text, as ids can be null or repeat; nulls count like values."""
    return docs.withColumn("_key", F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among those."""
    return keyed.join(small(checkpointed(keys.select("_key").distinct())), "_key", "left_anti")


@_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op8_segments does not predict to be toxic; null and empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    scored = toxicity.score(docs, model, score_col="_toxic", passages_col="_passages")
    return scored.where((F.col("_toxic") < toxicity.TOXIC) | (F.coalesce("text", F.lit("")) == "")).select(docs.columns)


@_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates, that of the smallest id, null last; of rows of one id and text
    one stays."""
    keyed = _keyed(docs)
    found = near_dedup.near_duplicates(keyed.select("_key", "text"), id_col="_key").where("n_shingles > 0")
    found = checkpointed(found.select("_key", "component_id").distinct())
    shared = found.where("_key != component_id").select("component_id").distinct()
    members = small(checkpointed(found.join(shared, "component_id", "left_semi")))
    named = checkpointed(keyed.select("_key", "doc_id").join(members, "_key").distinct())
    first = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "_key")).alias("x"))
    out = _without(keyed, named.join(first, "component_id").where(F.col("_key") != F.col("x._key")))
    twice = checkpointed(keyed.groupBy("_key").count().where("count > 1").select("_key"))
    if not twice.isEmpty():
        equal = out.join(small(twice), "_key", "left_semi").dropDuplicates(["_key"])
        out = out.join(small(twice), "_key", "left_anti").unionByName(equal)
    return out.select(docs.columns)


@_apart
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item."""
    keyed = _keyed(docs)
    leaks = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_key")
    return _without(keyed, leaks).select(docs.columns)


@_apart
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; these keep their length."""
    return pseudonyms.pseudonymised(docs, KEY, found_col="_found").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their tokens (``ids``), their number (``n_tokens``), and the text that these decode
    to (``decoded``). These are the stage's results, and columns of a caller's that have their names give way."""
    encoded = bpe.encode(docs, vocabulary(), decoded_col="decoded")
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pseudonyms", hide_personal_data),
    ("bpe", encode),
]

#: SQL can't express the models, pseudonyms and token ids; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``. Stages are written in the shared folder of spark.checkpoint.dir; each
    goes when the next one is written, and only the last stays, as the result is read from it."""
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path.toString())
        docs = spark.read.parquet(path.toString())
        if before:
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
        before = path
    return docs
