"""Raw provider records to the fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamill.functions.decisions import mapped, power_status
from stratamill.functions.scalars import gb_from_mib, number_text


def _refs(ids: Column) -> Column:
    return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda v: F.struct(F.lit("volume").alias("kind"), v.cast("string").alias("id"), F.lit(None).cast("string").alias("name")))


def hetzner_vms(raw: DataFrame) -> DataFrame:
    p = F.lit("hetzner")
    return raw.select(
        p.alias("provider"), F.col("id").cast("string").alias("id"), "name", F.col("server_type.name").alias("type_id"), F.col("datacenter.location.name").alias("region"),
        power_status(F.col("status"), p).alias("status"), F.col("status").alias("raw_status"), F.col("server_type.memory").alias("memory_gb"), F.col("server_type.disk").alias("disk_gb"),
        F.col("public_net.ipv4.ip").alias("ipv4"), F.col("public_net.ipv6.ip").alias("ipv6"), F.col("image.name").alias("image"), F.col("created").alias("created_at"),
        "labels", F.lit(None).cast("array<string>").alias("tags"), _refs(F.col("volumes")).alias("attached"),
    )


def digitalocean_vms(raw: DataFrame) -> DataFrame:
    p = F.lit("digitalocean")
    public = F.get(F.filter("networks.v4", lambda n: n["type"] == "public"), F.lit(0))["ip_address"]
    return raw.select(
        p.alias("provider"), F.col("id").cast("string").alias("id"), "name", F.col("size_slug").alias("type_id"), F.col("region.slug").alias("region"),
        power_status(F.col("status"), p).alias("status"), F.col("status").alias("raw_status"), gb_from_mib(F.col("memory")).alias("memory_gb"), F.col("disk").alias("disk_gb"),
        public.alias("ipv4"), F.get("networks.v6", F.lit(0))["ip_address"].alias("ipv6"), F.coalesce("image.slug", F.col("image.id").cast("string")).alias("image"), "created_at",
        F.lit(None).cast("map<string,string>").alias("labels"), "tags", _refs(F.col("volume_ids")).alias("attached"),
    )


def hetzner_types(raw: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    gone = F.col("deprecation.unavailable_after")
    return raw.where(gone.isNull() | (gone > now)).select(
        F.col("name").alias("id"), "name", F.col("cores").alias("vcpu"), F.col("memory").alias("memory_gb"), F.col("disk").alias("disk_gb"), F.col("architecture").alias("arch"), F.transform("prices", lambda x: x["location"]).alias("available_regions")
    )


def digitalocean_types(raw: DataFrame) -> DataFrame:
    return raw.where("available").select(F.col("slug").alias("id"), F.col("slug").alias("name"), F.col("vcpus").alias("vcpu"), gb_from_mib(F.col("memory")).alias("memory_gb"), F.col("disk").alias("disk_gb"), F.lit("x86").alias("arch"), F.col("regions").alias("available_regions"))


def hetzner_regions(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("name").alias("id"), F.col("description").alias("name"))


def digitalocean_regions(raw: DataFrame) -> DataFrame:
    return raw.where("available").select(F.col("slug").alias("id"), "name")


def hetzner_images(raw: DataFrame) -> DataFrame:
    return raw.where("type = 'system' and status = 'available'").select(F.col("name").alias("id"), "name", F.col("architecture").alias("arch"), F.lit(None).cast("array<string>").alias("available_regions"))


def digitalocean_images(raw: DataFrame) -> DataFrame:
    return raw.select(F.coalesce("slug", F.col("id").cast("string")).alias("id"), F.concat_ws(" ", "distribution", "name").alias("name"), F.lit("x86").alias("arch"), F.col("regions").alias("available_regions"))


def action_status(raw: DataFrame, provider: str) -> DataFrame:
    states = {"running": "running", "success": "success", "error": "error"} if provider == "hetzner" else {"in-progress": "running", "completed": "success", "errored": "error"}
    message = F.col("error.message") if provider == "hetzner" else F.lit(None).cast("string")
    return raw.select(F.col("id").cast("string").alias("id"), mapped(F.col("status"), states, "unknown").alias("state"), message.alias("message"))


def droplet_action(c: Column) -> Column:
    """The two ids in ``<droplet>:<action>``."""
    return F.struct(F.get(F.split(c, ":"), F.lit(0)).alias("vm_id"), F.get(F.split(c, ":"), F.lit(1)).alias("action_id"))


def receipts(raw: DataFrame, provider: str) -> DataFrame:
    """What a change was answered with, from (vm_id, action_id, raw status); a provider may tell no action, and then
    the change is taken to be accepted."""
    states = {"running": "accepted", "success": "completed", "in-progress": "accepted", "completed": "completed"}
    return raw.select(F.lit(provider).alias("provider"), F.col("vm_id").cast("string").alias("vm_id"), F.col("action_id").cast("string").alias("action_id"), mapped(F.col("status"), states, "accepted").alias("status"))


def details(vms: DataFrame) -> DataFrame:
    """The detail view: a machine's columns as text, with a dash for what is missing, labels or tags as one line, and
    the provider's own status."""
    labels = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", ")
    shown = {
        **{c: F.col(c) for c in ("provider", "id", "name", "type_id", "region", "status", "raw_status", "ipv4", "ipv6", "image")},
        "ram_gb": number_text(F.col("memory_gb")), "disk_gb": number_text(F.col("disk_gb")), "created": F.col("created_at").cast("string"),
        "labels": F.coalesce(labels, F.array_join("tags", ", ")), "attached": F.array_join(F.transform("attached", lambda a: F.concat_ws(":", a["kind"], a["id"])), ", "),
    }
    return vms.select(*(F.when(F.coalesce(c.cast("string"), F.lit("")) != "", c.cast("string")).otherwise("-").alias(k) for k, c in shown.items()))
