"""Inventories that are seeded by hand: transitions of machines, and reads with faults, for trying out what reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.functions.decisions import settled
from stratamill.operators.choose import in_region


def _moved(vms: DataFrame, vm_id: str, raw: str) -> DataFrame:
    mine = F.col("id") == vm_id
    return vms.withColumns({"status": F.when(mine, "transitioning").otherwise(F.col("status")), "raw_status": F.when(mine, raw).otherwise(F.col("raw_status"))})


def shut_down(vms: DataFrame, vm_id: str) -> DataFrame:
    return _moved(vms, vm_id, "stopping")


def powered_on(vms: DataFrame, vm_id: str) -> DataFrame:
    return _moved(vms, vm_id, "starting")


def deleted(vms: DataFrame, vm_id: str) -> DataFrame:
    """Without that machine; once more changes nothing."""
    return vms.where(F.col("id") != vm_id)


def created(vms: DataFrame, new: DataFrame) -> DataFrame:
    """With new machines, which are in transition."""
    return vms.unionByName(new.withColumns({"status": F.lit("transitioning"), "raw_status": F.lit("initializing")}))


def settle(vms: DataFrame) -> DataFrame:
    """Every machine in the stable state that it is on the way to; once more changes nothing."""
    return vms.withColumn("status", settled(F.col("status"), F.col("raw_status")))


def listed(vms: DataFrame, faults: DataFrame, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a region, and provider, error and reason for each provider of the seed or the faults. ``faults`` has
    (provider, error, reason): an error keeps all rows of its provider back, a reason marks them as incomplete."""
    failed = faults.where("error is not null").select("provider").distinct()
    read = in_region(vms.join(F.broadcast(failed), "provider", "left_anti"), region)
    outcomes = vms.select("provider").union(faults.select("provider")).distinct().join(faults, "provider", "left")
    return read, outcomes.select("provider", "error", "reason")
