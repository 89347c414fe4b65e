"""Filters, choices and unions over inventories and catalogs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from stratamill.functions.decisions import ERROR_CODES, exit_code, mapped
from stratamill.sources.stored import checkpointed


def in_region(rows: DataFrame, region: str | None, column: str = "region") -> DataFrame:
    return rows if region is None else rows.where(F.col(column) == region)


def offered(rows: DataFrame, region: str | None = None, arch: str | None = None) -> DataFrame:
    """Types or images of an architecture that a region offers; without a list of regions, all do."""
    if region is not None:
        rows = rows.where(F.col("available_regions").isNull() | F.array_contains("available_regions", region))
    return rows if arch is None else rows.where(F.col("arch") == arch)


def compatible_types(types: DataFrame, image: DataFrame, region: str) -> DataFrame:
    """Types that the region offers with the architecture of the image, a table of one row."""
    return types.where(F.array_contains("available_regions", region)).join(image.select("arch").distinct(), "arch", "left_semi")


def fitting(types: DataFrame, vcpu: float, memory_gb: float, disk_gb: float | None = None) -> DataFrame:
    rows = types.where((F.col("vcpu") >= vcpu) & (F.col("memory_gb") >= memory_gb))
    return rows if disk_gb is None else rows.where(F.col("disk_gb") >= disk_gb)


def within(types: DataFrame, limits: tuple[float, float, float]) -> DataFrame:
    return types.where((F.col("vcpu") <= limits[0]) & (F.col("memory_gb") <= limits[1]) & (F.col("disk_gb") <= limits[2]))


def first_violated(wanted: dict[str, float | None], limits: tuple[float, float, float]) -> str | None:
    """The first of vcpu, memory and disk whose wanted least is over its limit, before anything is read."""
    return next((k for k, most in zip(("vcpu", "memory_gb", "disk_gb"), limits, strict=True) if (wanted.get(k) or 0) > most), None)


def smallest_fit(types: DataFrame) -> DataFrame:
    """The least by memory, vcpu, disk and id, whatever the order of the input."""
    return types.orderBy("memory_gb", "vcpu", "disk_gb", "id").limit(1)


def resolve_type(types: DataFrame, image: DataFrame, region: str, vcpu: float, memory_gb: float, disk_gb: float | None, limits: tuple[float, float, float]) -> DataFrame:
    """The smallest fit, if it is within the limits: they are checked after the choice, and none takes its place."""
    return within(smallest_fit(fitting(compatible_types(types, image, region), vcpu, memory_gb, disk_gb)), limits)


def named_or_known(types: DataFrame, wanted: str) -> DataFrame:
    """found, and up to five ids to name in a message."""
    return types.agg(F.coalesce(F.bool_or(F.col("id") == wanted), F.lit(False)).alias("found")).join(types.orderBy("id").limit(5).agg(F.array_sort(F.collect_list("id")).alias("known")), F.lit(True))


def inventory_order(vms: DataFrame) -> DataFrame:
    return vms.orderBy("provider", "name", "id")


def lookup(vms: DataFrame, provider: str, vm_id: str) -> DataFrame:
    return vms.where((F.col("provider") == provider) & (F.col("id") == vm_id))


def read_all(sources: dict[str, Callable[[], DataFrame]], materialize: Callable[[str, DataFrame], DataFrame] | None = None, seconds: float = 180) -> tuple[DataFrame | None, list[dict]]:
    """The rows of all sources that could be read, and an outcome for each, by name: provider, ok, and error and message
    of one that failed.

    Sources are read at once, each in a thread of its own whose jobs have a tag; what is not done after ``seconds`` is
    cancelled by its tag and fails as Transport, and none of this touches the others. ``materialize`` runs a source's
    read, by a checkpoint unless it is given: Spark is lazy, and a failure must show while it can still be told apart.
    An exception's attribute ``kind`` names its kind of error; without one it is Transport.
    """
    run = materialize or (lambda _, df: checkpointed(df))
    found, failed = {}, {}

    def read(name: str, tag: str) -> None:
        try:
            df = sources[name]()
            sc = df.sparkSession.sparkContext
            sc.addJobTag(tag)
            try:
                found[name] = run(name, df)
            finally:
                sc.removeJobTag(tag)
        except Exception as error:  # noqa: BLE001  each source's failure is a result
            failed.setdefault(name, (getattr(error, "kind", "Transport"), f"{type(error).__name__}: {error}"[:500]))

    tags = {name: f"read-{uuid.uuid4().hex}" for name in sorted(sources)}
    threads = {name: InheritableThread(target=read, args=(name, tag), daemon=True) for name, tag in tags.items()}
    for thread in threads.values():
        thread.start()
    until = time.monotonic() + seconds
    for name, thread in threads.items():
        thread.join(max(0, until - time.monotonic()))
        if thread.is_alive():
            failed[name] = ("Transport", f"not read in {seconds} s")
            SparkSession.active().sparkContext.cancelJobsWithTag(tags[name])
    rows, outcomes = None, []
    for name in tags:
        error, message = failed.get(name, (None, None))
        outcomes.append({"provider": name, "ok": error is None, "error": error, "message": message})
        if error is None:
            rows = found[name] if rows is None else rows.unionByName(found[name])
    return rows, outcomes


def first_ids(rows: DataFrame, group: str, id_col: str, most: int = 5) -> DataFrame:
    """For each group up to so many of its ids, least first, without gathering the others."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(id_col))
    kept = rows.select(group, id_col, first.alias("n")).where(F.col("n") <= most)
    return kept.groupBy(group).agg(F.array_sort(F.collect_list(id_col)).alias("known"))


def found_or_error(vms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted provider and id with its machine, or with the error NotFound."""
    there = vms.select("provider", "id", F.struct(*vms.columns).alias("vm"))
    return wanted.select("provider", "id").join(there, ["provider", "id"], "left").withColumn("error", F.when(F.col("vm").isNull(), "NotFound"))


ERROR = "array<struct<code:string,message:string,provider:string,vmId:string,actionId:string,requestId:string>>"


def error_object(code: Column, message: Column, **more: Column) -> Column:
    """An error of an envelope: a stable code, a message, and the ids that are known."""
    null = F.lit(None).cast("string")
    return F.struct(code.alias("code"), message.alias("message"), *(more.get(k, null).alias(k) for k in ("provider", "vmId", "actionId", "requestId")))


def list_outcome(outcomes: DataFrame) -> DataFrame:
    """ok, errors and exit_code of a listing, from each provider's (provider, error, reason), and message if there is
    one: it is ok where all were read and complete, and otherwise has an error for each that was not, by provider.

    A listing of which some rows could be read, of another provider or of an incomplete one, is a partial inventory and
    exits as such; where there is none, the first error tells how.
    """
    message = F.col("message") if "message" in outcomes.columns else F.lit(None).cast("string")
    kind = F.coalesce("error", F.when(F.col("reason").isNotNull(), "IncompleteInventory"))
    said = F.coalesce(message, F.when(F.col("error").isNull(), F.concat(F.lit("stopped by "), "reason")), "error")
    rows = outcomes.select("provider", kind.alias("kind"), said.alias("message"), F.col("error").isNull().alias("read"))
    told = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("provider", mapped(F.col("kind"), ERROR_CODES, "internal").alias("code"), "kind", "message"))))
    out = rows.agg(told.alias("errors"), F.coalesce(F.bool_or("read"), F.lit(False)).alias("read"))
    first = F.when((F.size("errors") > 0) & F.col("read"), "IncompleteInventory").otherwise(F.get("errors", F.lit(0))["kind"])
    return out.select((F.size("errors") == 0).alias("ok"), F.transform("errors", lambda e: error_object(e["code"], e["message"], provider=e["provider"])).alias("errors"), exit_code(first).alias("exit_code"))


def listing(sources: dict[str, Callable[[], DataFrame]], spark: SparkSession, seconds: float = 180) -> tuple[DataFrame | None, DataFrame]:
    """The rows of all providers in the order of an inventory, with their position, and the outcome of the whole. A source
    may give a column ``reason``, of rows that say how its read ended early; these are no machines."""
    rows, outcomes = read_all(sources, seconds=seconds)
    told = spark.createDataFrame([(o["provider"], o["error"], o["message"]) for o in outcomes], "provider string, error string, message string")
    ends = None if rows is None or "reason" not in rows.columns else rows.where("reason is not null").groupBy("provider").agg(F.min("reason").alias("reason"))
    told = told.withColumn("reason", F.lit(None).cast("string")) if ends is None else told.join(ends, "provider", "left")
    if rows is not None:
        rows = numbered(rows.where("reason is null").drop("reason") if ends is not None else rows, ["provider", "name", "id"], "position")
    return rows, list_outcome(told)


def usage_errors(requests: DataFrame) -> DataFrame:
    """requests, with what is wrong with each (``usage``): rules for command, provider, type, vcpu, memory, disk,
    timeout, wait, yes and dry_run, of which absent ones are null or false. timeout is in seconds."""
    has = lambda c: F.col(c).isNotNull()
    positive = lambda c: F.col(c).isNull() | ((F.col(c) > 0) & ~F.col(c).isin(float("inf"), float("nan")))
    sized = has("vcpu") | has("memory")
    wrong = {
        "timeout requires wait": has("timeout") & ~F.coalesce("wait", F.lit(False)),
        "timeout is over 10 minutes": F.col("timeout") > 600,
        "type excludes vcpu and memory": has("type") & sized,
        "create takes a type, or vcpu and memory": (F.col("command") == "create") & ~has("type") & ~(has("vcpu") & has("memory")),
        "disk goes with vcpu and memory only": has("disk") & ~(has("vcpu") & has("memory")),
        "all providers are for list only": (F.col("provider") == "all") & (F.col("command") != "list"),
        "yes is for stop and delete only": F.col("yes") & ~F.col("command").isin("stop", "delete"),
        "dry-run is for changes only": F.col("dry_run") & ~F.col("command").isin("create", "start", "stop", "delete"),
        "vcpu is no positive whole number": ~(positive("vcpu") & (F.col("vcpu").isNull() | (F.col("vcpu") % 1 == 0))),
        "memory is not positive": ~positive("memory"),
        "disk is not positive": ~positive("disk"),
    }
    return requests.withColumn("usage", F.filter(F.array(*(F.when(c, k) for k, c in wrong.items())), lambda x: x.isNotNull()))


def _errors(errors: list[dict] | Column | None) -> Column:
    if isinstance(errors, Column):
        return errors
    text = lambda v: F.lit(v).cast("string")
    made = [error_object(text(e["code"]), text(e.get("message")), **{k: text(v) for k, v in e.items() if k not in ("code", "message")}) for e in errors or []]
    return F.array(*made).cast(ERROR)


def envelope(data: DataFrame | None, errors: list[dict] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """One JSON object with schemaVersion, ok, data and errors, each an object with a code, a message and the ids that
    are known. Rows of a page-sized report are gathered; ``envelope_lines`` writes one of any size. Without data, as
    where nothing could be read, data is null."""
    told = _errors(errors)
    if data is None:
        data_col, rows = F.lit(None).cast("string").alias("data"), (spark or SparkSession.active()).range(1)
    else:
        data_col, rows = F.col("data"), data.agg(F.collect_list(F.struct(*data.columns)).alias("data"))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.lit(not errors).alias("ok"), data_col, told.alias("errors"))
    return rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def failed_envelope(outcome: DataFrame) -> DataFrame:
    """The JSON object of an outcome of which nothing could be read, with its exit code."""
    body = F.struct(F.lit(1).alias("schemaVersion"), "ok", F.lit(None).cast("string").alias("data"), "errors")
    return outcome.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"), "exit_code")


def envelope_lines(data: DataFrame, order: list[str], outcome: DataFrame) -> DataFrame:
    """line, from 0, and text: the lines of one JSON object as ``envelope`` has it, an item of data in a line, so that no
    task holds them all. ``outcome`` has one row with ok and errors."""
    items = numbered(data, order, "line")
    texts = items.select("line", F.concat(F.when(F.col("line") > 1, ",").otherwise(""), F.to_json(F.struct(*data.columns), {"ignoreNullFields": "false"})).alias("text"))
    said = outcome.select("ok", F.to_json("errors", {"ignoreNullFields": "false"}).alias("errors"))
    head = said.select(F.lit(0).cast("long").alias("line"), F.concat(F.lit('{"schemaVersion":1,"ok":'), F.col("ok").cast("string"), F.lit(',"data":[')).alias("text"))
    last = data.agg((F.count("*") + 1).alias("line"))
    tail = last.crossJoin(said).select("line", F.concat(F.lit('],"errors":'), "errors", F.lit("}")).alias("text"))
    return head.unionByName(texts).unionByName(tail)


def numbered(rows: DataFrame, order: list[str], column: str = "row") -> DataFrame:
    """rows with their number in that order, from 1, without a task that has them all: ranges of the order are dealt to
    tasks and sorted there, and each task's first number follows from how many rows the ranges before it have. Rows that
    the order does not tell apart are told apart by their other columns, so many of them make no large range; nulls
    come first. Only the numbers of rows of the tasks come to the driver."""
    keys = [*order, *(f.name for f in rows.schema if f.name not in order and isinstance(f.dataType, AtomicType))]
    dealt = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftright("_id", 33).cast("int")
    counts = sorted(dealt.groupBy(task.alias("task")).count().collect())
    before = list(accumulate((r["count"] for r in counts), initial=0))
    first = F.element_at(F.map_from_arrays(F.array(*(F.lit(r["task"]) for r in counts)), F.array(*map(F.lit, before[:-1]))), task) if counts else F.lit(0)
    return dealt.withColumn(column, (F.col("_id").bitwiseAND(2**33 - 1) + first + 1).cast("long")).drop("_id")


def text_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """row and line of a report: row 0 has the names of the columns, the others follow in order; cells are padded to
    their column's widest, a dash for what is missing."""
    shown = numbered(rows.select(*columns, *(c for c in order if c not in columns)), order, "row").select("row", *(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns))
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("row"), *(F.lit(c.upper()).alias(c) for c in columns))
    widths = shown.agg(*(F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(c))).alias(f"_{c}") for c in columns))
    cells = [F.expr(f"rpad(`{c}`, `_{c}`, ' ')") for c in columns]
    return head.unionByName(shown).join(F.broadcast(widths), F.lit(True)).select("row", F.rtrim(F.concat_ws("  ", *cells)).alias("line"))
