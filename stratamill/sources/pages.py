"""Paged JSON records: strict reads, and a bounded walk over pages as a data source."""

from __future__ import annotations

import json
import os
import re
import time
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from stratamill.sources.stored import MAX_PAGES, MAX_SECONDS


def strict_json(spark: SparkSession, path: str, items: str, schema: str) -> DataFrame:
    """The items of JSON pages by a fixed schema; what doesn't decode fails the read, unknown fields are dropped."""
    pages = spark.read.schema(f"{items} array<struct<{_ddl(schema)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return pages.select(F.explode(items).alias("x")).select("x.*")


def _ddl(schema: str) -> str:
    from pyspark.sql import types as T

    return T._parse_datatype_string(schema).simpleString().removeprefix("struct<").removesuffix(">")


def _faults(typed: Column, item: Column, kind: T.StructType, required: tuple[str, ...], path: str = "$"):
    """For each field, in order, its path where the item has a value that the type can't take, or needs one and has none."""
    for f in kind:
        at = f"{path}.{f.name}"
        there, value = F.get_json_object(item, at).isNotNull(), typed.getField(f.name)
        yield F.when(there & value.isNull(), at)
        if at.removeprefix("$.") in required:
            yield F.when(~there, at)
        if isinstance(f.dataType, T.StructType):
            yield from _faults(value, item, f.dataType, required, at)


def decoded(items: DataFrame, schema: str, item_col: str = "item", required: tuple[str, ...] = ("id",)) -> DataFrame:
    """items with ``record``, the item by a fixed schema, or else ``error`` ProviderRejected and ``path``, where the item
    first departs from it: the field, ``$`` for what is no JSON object. Unknown fields are dropped, and absent or null
    ones are null, but for those required. No other item is touched by one that does not decode; null items stay, without
    any of the three. Columns of these names give way."""
    items = items.drop(*(c for c in ("record", "error", "path") if c != item_col))
    kind, item = T._parse_datatype_string(schema), F.col(item_col)
    typed = F.from_json(item, T.StructType([*kind, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = items.withColumn("_typed", typed)
    found = F.coalesce(*_faults(F.col("_typed"), item, kind, required), F.lit("$"))
    missing = [F.when(F.col(f"_typed.{name}").isNull(), f"$.{name}") for name in required]
    whole = F.get_json_object(item, "$").startswith("{")
    at = F.when(item.isNotNull(), F.when(~F.coalesce(whole, F.lit(False)), "$").otherwise(F.when(F.col("_typed._corrupt").isNotNull(), found).otherwise(F.coalesce(*missing, F.lit(None).cast("string")))))
    record = F.when(item.isNotNull() & F.col("path").isNull(), F.struct(*(F.col(f"_typed.{f.name}").alias(f.name) for f in kind)))
    return rows.withColumn("path", at).withColumn("error", F.when(F.col("path").isNotNull(), "ProviderRejected")).withColumn("record", record).drop("_typed")


def machines(items: DataFrame, schema: str, normalize) -> tuple[DataFrame, DataFrame]:
    """The machines of a walk's items, by ``normalize`` from records of that schema; and what the read is short of:
    provider, error, path and reason of each item that does not decode, and of a walk that ended early."""
    told = decoded(items, schema)
    return normalize(told.where("record is not null").select("record.*")), told.where("error is not null or reason is not null").select("provider", "error", "path", "reason")


class PagedSource(DataSource):
    """Options: path (a folder of pages), first (a page's file name), items and next (keys of the list and the cursor,
    with dots where they are nested), provider. A cursor is opaque text, as a number or an address; cursor is a pattern
    whose first group is what names a page, and file the name of a page's file with {} for that. Each row is one item as JSON, or, with a reason, how the walk ended early: pages, time, cursor or page.

    region is the path of an item's region; ``FilteredPagedSource`` takes a filter on it in the reader, which keeps other
    items back, and of one on another provider reads no page. With total, the path of the number of all items, and per_page, the first page
    tells all pages there are; these are read side by side, ``pages_per_task`` in a task, and none waits for the one
    before it."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "provider string, item string, reason string, pages_read int, region string"

    def reader(self, schema) -> DataSourceReader:
        return _Walk(dict(self.options))


class _Pages(InputPartition):
    """Pages of a folder: all that the first leads to, or those of a range of numbers."""

    def __init__(self, folder: str, numbers: range | None = None, reason: str | None = None):
        super().__init__(folder)
        self.folder, self.numbers, self.reason = folder, numbers, reason


class _Walk(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.only: dict[str, object] = {}

    def file_of(self, cursor) -> str | None:
        if cursor is None or cursor == "":
            return None
        named = re.search(self.options.get("cursor", "(.*)"), str(cursor))
        return self.options.get("file", "{}").replace("{}", named[1]) if named else None

    def page(self, folder: str, name: str) -> dict:
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            return json.load(f)

    def partitions(self):
        o, out = self.options, []
        if self.only.get("provider", o.get("provider")) != o.get("provider"):
            return [_Pages("", range(0))]
        most, each = int(o.get("max_pages", MAX_PAGES)), int(o.get("pages_per_task", 4))
        for folder in o["path"].split(","):
            if "total" not in o:
                out.append(_Pages(folder))
                continue
            pages = -(-int(_at(self.page(folder, o["first"]), o["total"]) or 0) // int(o["per_page"]))
            last = min(max(1, pages), most)
            for a in range(1, last + 1, each):
                b = min(a + each, last + 1)
                out.append(_Pages(folder, range(a, b), "pages" if b > last and pages > most else None))
        return out

    def rows(self, body: dict):
        o = self.options
        for item in _at(body, o["items"]) or []:
            region = _at(item, o["region"]) if "region" in o else None
            if "region" not in self.only or region == self.only["region"]:
                yield o.get("provider"), json.dumps(item), None, None, region

    def read(self, partition):
        o, reason, read = self.options, None, 0
        if partition.numbers is None:
            page, seen, began = o["first"], set(), time.monotonic()
            while page and reason is None:
                if page in seen:
                    reason = "cursor"
                elif read >= int(o.get("max_pages", MAX_PAGES)):
                    reason = "pages"
                elif time.monotonic() - began > float(o.get("max_seconds", MAX_SECONDS)):
                    reason = "time"
                else:
                    seen.add(page)
                    try:
                        body = self.page(partition.folder, page)
                    except (OSError, ValueError):
                        if not read:
                            raise
                        reason = "page"
                        break
                    read += 1
                    yield from self.rows(body)
                    page = self.file_of(_at(body, o["next"]))
        else:
            began = time.monotonic()
            for number in partition.numbers:
                if time.monotonic() - began > float(o.get("max_seconds", MAX_SECONDS)):
                    reason = "time"
                    break
                try:
                    body = self.page(partition.folder, o["file"].replace("{}", str(number)))
                except (OSError, ValueError):
                    if number == 1:
                        raise
                    reason = "page"
                    break
                read += 1
                yield from self.rows(body)
            reason = reason or partition.reason
        if reason and "region" not in self.only:
            yield o.get("provider"), None, reason, read, None


class _FilteredWalk(_Walk):
    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo) and len(f.attribute) == 1 else None
            if column == "provider" or column == "region" and "region" in self.options:
                if self.only.setdefault(column, f.value) == f.value:
                    continue
            yield f


class FilteredPagedSource(PagedSource):
    """A ``PagedSource`` whose reader takes filters on region and provider; the session has to set
    ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "filtered_paged_json"

    def reader(self, schema) -> DataSourceReader:
        return _FilteredWalk(dict(self.options))


def _at(body: dict, path: str):
    """What a path of keys leads to, or None."""
    for key in path.split("."):
        body = body.get(key) if isinstance(body, dict) else None
    return body


def prefix(rows: DataFrame, order: list[str], page_size: int, max_pages: int = MAX_PAGES) -> DataFrame:
    """The rows that a bounded walk over pages of an ordered table sees."""
    return rows.orderBy(*order).limit(page_size * max_pages)


def settings(candidates: list[str], known: dict, explicit: str | None = None) -> dict:
    """Each known setting's value and source, from the first file there is; unknown keys fail, and so does an explicit
    file that is missing."""
    path = explicit or next((p for p in candidates if os.path.exists(p)), None)
    given = {}
    if path:
        with open(path, "rb") as f:
            given = tomllib.load(f)
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {k: {"value": given.get(k, v), "source": "file" if k in given else "default"} for k, v in known.items()}


def merged(flags: dict, effective: dict) -> dict:
    """Flags win over settings; each value keeps where it came from."""
    return {k: {"value": flags[k], "source": "flag"} if flags.get(k) is not None else v for k, v in effective.items()}


def settings_rows(spark: SparkSession, effective: dict) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v["value"]), v["source"]) for k, v in sorted(effective.items())], "name string, value string, source string")


def user_data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))
