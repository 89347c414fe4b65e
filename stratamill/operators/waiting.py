"""Waits for machines: observations folded, in the order of time, to the outcome of each wait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamill.functions.decisions import evaluate, exit_code
from stratamill.functions.scalars import poll_cap, seconds

#: Seconds that a wait may take at most, and polls of such a wait.
MOST_SECONDS, MOST_POLLS = 600, 301
#: Errors of a poll that end a wait; others count as one more observation without a result.
ABORTS = ("Auth", "ProviderRejected")
#: Tasks that the observations of one machine are dealt over.
SALTS = 16


def state_of(kind: Column, target: Column, action_state: Column, status: Column, missing: Column, error: Column) -> Column:
    """How a poll stands to what is waited for: settled, failed, aborted or pending. NotFound tells that the machine is
    missing."""
    gone = F.coalesce(missing, F.lit(False)) | F.coalesce(error == "NotFound", F.lit(False))
    return F.when(error.isin(*ABORTS), "aborted").when(error.isNotNull() & (error != "NotFound"), "pending").otherwise(evaluate(kind, target, action_state, status, gone))


def error_of(outcome: Column, error: Column) -> Column:
    return F.when(outcome == "failed", "ProviderRejected").when(outcome == "aborted", error).when(outcome == "timeout", "WaitTimeout").when(outcome == "usage", "Usage")


def waited(requests: DataFrame, observations: DataFrame, salts: int = SALTS) -> DataFrame:
    """wait_id, outcome, error, exit_code, polls, elapsed_s and status of every request.

    ``requests`` has wait_id, kind (status, absent or created), target, timeout (as 30s or 2m, null for the default) and
    started (seconds); ``observations`` has wait_id, at (seconds), action_state, status, missing and error. Observations
    of one wait and time count once. The first decisive one, in the order of time, is the outcome: settled, failed, or
    aborted by an error that no further poll would mend. Transport errors count as pending. Without one until
    the deadline, or within the number of polls that fit it, the outcome is timeout, and elapsed_s the whole deadline; a
    timeout that is malformed or too long is a usage error, and nothing is polled. status is the last one seen, null for
    a machine that is gone. Observations from before the start, after the end, or of no request take no part.

    A wait's observations are dealt over ``salts`` tasks, of which each hands on the first polls only, so a wait with many
    of them is in no task as a whole.
    """
    asked = requests.select("wait_id", "kind", "target", F.col("started").cast("double").alias("started"), seconds(F.col("timeout")).cast("double").alias("deadline"))
    dealt = asked.where("deadline is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    seen = observations.select("wait_id", F.col("at").cast("double").alias("at"), F.struct("error", "action_state", "status", "missing").alias("seen"))
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int"))
    polls = seen.join(dealt, ["wait_id", "salt"]).where("at >= started and at <= started + deadline")
    polls = polls.groupBy("wait_id", "salt", "at").agg(F.min("seen").alias("seen"), F.first("kind").alias("kind"), F.first("target").alias("target"), F.first("started").alias("started"), F.first("deadline").alias("deadline"))
    # the salt in the partitioning keeps the first polls of a task apart from the rest before they are dealt by wait
    n = F.row_number().over(Window.partitionBy("wait_id").orderBy("at"))
    polls = polls.withColumn("n", n).where(F.col("n") <= MOST_POLLS).where(F.col("n") <= poll_cap(F.col("deadline")))
    state = state_of(F.col("kind"), F.col("target"), F.col("seen.action_state"), F.col("seen.status"), F.col("seen.missing"), F.col("seen.error"))
    decisive = F.struct("n", state.alias("outcome"), "seen.error", F.col("seen.status").alias("status"), (F.col("at") - F.col("started")).alias("elapsed_s"))
    last = F.struct("n", F.when(F.col("seen.error").isNull(), F.col("seen.status")).alias("status"))
    found = polls.groupBy("wait_id").agg(F.min(F.when(state != "pending", decisive)).alias("first"), F.count("*").alias("polls"), F.max(F.when(F.col("seen.error").isNull(), last)).alias("last"))
    out = asked.join(found, "wait_id", "left")
    outcome = F.when(F.col("deadline").isNull(), "usage").otherwise(F.coalesce("first.outcome", F.lit("timeout")))
    status = F.when(F.col("first").isNotNull(), F.when(F.col("first.error").isNull(), F.col("first.status"))).otherwise(F.col("last.status"))
    out = out.select("wait_id", outcome.alias("outcome"), error_of(outcome, F.col("first.error")).alias("error"), F.coalesce("first.n", "polls", F.lit(0)).cast("long").alias("polls"), F.coalesce("first.elapsed_s", "deadline").alias("elapsed_s"), status.alias("status"))
    return out.withColumn("exit_code", exit_code(F.col("error")).cast("int"))
