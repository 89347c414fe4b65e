"""Checkpoints, and bounded walks over pages that are stored in a table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of one walk at most, and seconds.
MAX_PAGES, MAX_SECONDS = 100, 180


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage, in the folder that spark.checkpoint.dir names. Where it is unset, a local session gets one of its
    own; on a cluster it has to be set, as executors share no other folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratamill-"))
    return df.checkpoint()


#: Pages and starts of an account that one row may hold; the walks of accounts of more go on in the recursive plan.
AT_ONCE = 10_000

_WALK = """
WITH RECURSIVE walk(account, cursor, next, page, seen, elapsed, reason) MAX RECURSION LEVEL {levels} AS (
  SELECT account, CAST(NULL AS STRING), cursor, 0, CAST(array() AS ARRAY<STRING>), CAST(0 AS DOUBLE), CAST(NULL AS STRING) FROM {{starts}}
  UNION ALL
  SELECT w.account, w.next, p.next, CASE WHEN {reason} IS NULL THEN w.page + 1 ELSE w.page END, array_append(w.seen, w.next), w.elapsed + coalesce(p.seconds, 0), {reason}
  FROM walk w LEFT JOIN {{pages}} p ON p.account = w.account AND p.cursor = w.next
  WHERE w.next IS NOT NULL AND w.reason IS NULL
)
SELECT account, page, cursor, reason FROM walk WHERE page > 0 OR reason IS NOT NULL
"""

#: The same step over an account's pages in one map; a walk has read all of them, or ended, after as many steps.
_FOLD = """
aggregate(sequence(1, least(cardinality(pages), {most}) + 1),
  named_struct('next', start.cursor, 'page', 0, 'seen', CAST(array() AS ARRAY<STRING>), 'elapsed', CAST(0 AS DOUBLE), 'reason', CAST(NULL AS STRING)),
  (w, i) -> CASE WHEN w.next IS NULL OR w.reason IS NOT NULL THEN w ELSE transform(array(element_at(pages, w.next)), p -> named_struct(
    'next', p.next, 'page', CASE WHEN {reason} IS NULL THEN w.page + 1 ELSE w.page END, 'seen', array_append(w.seen, w.next), 'elapsed', w.elapsed + coalesce(p.seconds, 0), 'reason', {reason}))[0] END)
"""

_REASON = """CASE WHEN array_contains(w.seen, w.next) THEN 'cursor' WHEN w.page >= {most} THEN 'pages'
    WHEN w.elapsed > {seconds} THEN 'time' WHEN {missing} IS NULL THEN 'page' END"""


def _folded(pages: DataFrame, starts: DataFrame, most: int, seconds: float) -> DataFrame:
    """The walks of accounts whose pages and starts fit in one row: one shuffle, however long the walks are."""
    page = F.struct("cursor", F.struct("next", "seconds").alias("page"))
    both = pages.where("account is not null").select("account", page.alias("page"), F.lit(None).alias("start")).unionAll(starts.select("account", F.lit(None).alias("page"), F.struct("account", "cursor").alias("start")))
    grouped = both.groupBy("account").agg(F.map_from_entries(F.collect_list("page")).alias("pages"), F.collect_list("start").alias("starts"))
    fold = F.expr(_FOLD.format(most=most, reason=_REASON.format(most=most, seconds=seconds, missing="p")))
    walks = grouped.select("pages", F.explode("starts").alias("start")).select("start.account", fold.alias("w"))
    visits = F.transform("w.seen", lambda cursor, i: F.struct(F.least(i + 1, F.col("w.page")).alias("page"), cursor.alias("cursor"), F.when(i >= F.col("w.page"), F.col("w.reason")).alias("reason")))
    return walks.select("account", F.inline(visits))


def walked(pages: DataFrame, starts: DataFrame, max_pages: int = MAX_PAGES, max_seconds: float = MAX_SECONDS, at_once: int = AT_ONCE) -> DataFrame:
    """account, page, cursor and reason: every page that a walk from an account's first cursor visits, numbered from 1,
    with no reason; and where a walk ends early, one more row with the number of pages read, the cursor that was not
    followed, and the reason: cursor (met before), pages or time (no more of these left), or page (there is none).

    ``pages`` has account, cursor, next (null at the end) and, if told, the seconds that a page took; ``starts`` has
    account and cursor, null for nothing to read. Accounts of up to ``at_once`` pages and starts, whose product is no more
    than 100 times that, are each gathered in a row, and walked there. The walks of the others go on together in one
    recursive plan, a level for a page, and each level joins the walks that are left, one row each, with these accounts'
    pages. Of several pages of one cursor the one with the least next counts. Rows of a recursion are limited by
    ``spark.sql.cteRecursionRowLimit``, which is lifted in the session: walks end by themselves, after ``max_pages``.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    most, budget = int(max_pages), float(max_seconds)
    seconds = F.col("seconds").cast("double") if "seconds" in pages.columns else F.lit(0.0)
    one = pages.where("cursor is not null").groupBy("account", F.col("cursor").cast("string").alias("cursor")).agg(F.min(F.struct(F.col("next").isNull().alias("last"), F.col("next").cast("string").alias("next"), seconds.alias("seconds"))).alias("x"))
    stored = checkpointed(one.select("account", "cursor", "x.next", "x.seconds"))
    first = checkpointed(starts.select("account", F.col("cursor").cast("string").alias("cursor")).distinct())
    both = stored.select("account", F.lit(1).alias("pages"), F.lit(0).alias("starts")).unionAll(first.select("account", F.lit(0), F.lit(1)))
    held = both.groupBy(F.col("account").alias("large")).agg(F.sum("pages").alias("pages"), F.sum("starts").alias("starts"))
    # a step looks through the whole map, so many walks over many pages are cheaper as joins
    large = F.broadcast(checkpointed(held.where((F.col("pages") + F.col("starts") > at_once) | (F.col("pages") * F.col("starts") > 100 * at_once)).select("large")))
    is_large = F.col("account").eqNullSafe(F.col("large"))
    folded = _folded(stored.join(large, is_large, "left_anti"), first.join(large, is_large, "left_anti"), most, budget)
    rest = [checkpointed(df.join(large, is_large, "left_semi")) for df in (stored, first)]
    recursion = _WALK.format(levels=most + 2, reason=_REASON.format(most=most, seconds=budget, missing="p.account"))
    return folded.unionAll(spark.sql(recursion, pages=rest[0], starts=rest[1]))


def ends(walk: DataFrame) -> DataFrame:
    """account, pages_read, reason and error of each walk: what ended early is an incomplete inventory, or a failure of
    its own where not one page was read."""
    of = walk.groupBy("account").agg(F.coalesce(F.max(F.when(F.col("reason").isNull(), F.col("page"))), F.lit(0)).alias("pages_read"), F.max("reason").alias("reason"))
    return of.withColumn("error", F.when(F.col("reason").isNotNull(), F.when(F.col("pages_read") == 0, "Transport").otherwise("IncompleteInventory")))
