"""Layered settings as rows: each layer's leaves by dotted path, merged so that the first layer that has one wins."""

from __future__ import annotations

import json
import math
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every setting and its default; None for unset.
DEFAULTS = {
    "defaultProvider": None,
    "limits.maxVcpu": 8, "limits.maxMemoryGb": 8, "limits.maxDiskGb": 128,
    "providers.hetzner.tokenEnv": "HCLOUD_TOKEN", "providers.hetzner.region": None, "providers.hetzner.image": None, "providers.hetzner.sshKeys": None,
    "providers.digitalocean.tokenEnv": "DIGITALOCEAN_TOKEN", "providers.digitalocean.region": None, "providers.digitalocean.image": None, "providers.digitalocean.sshKeys": None,
}
#: Settings that there were once.
EXPIRED = ("ttl", "expiry", "reaper")


class ConfigInvalid(ValueError):
    kind = "ConfigInvalid"


def flattened(values: dict, path: str = "") -> dict:
    """Leaves by dotted path; lists are leaves, and an empty table has none."""
    out = {}
    for k, v in values.items():
        out |= flattened(v, f"{path}{k}.") if isinstance(v, dict) else {f"{path}{k}": v}
    return out


def checked(values: dict, known: dict, source: str) -> dict:
    """The leaves, if they are known settings of the right kind; the message names the path of one that is not."""
    leaves = flattened(values)
    for path, value in leaves.items():
        if path not in known:
            hint = "; there is no expiry" if path.split(".")[0] in EXPIRED or path.split(".")[-1] in EXPIRED else ""
            raise ConfigInvalid(f"{source}: unknown setting {path}{hint}")
        if path.startswith("limits.") and (isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value < math.inf):
            raise ConfigInvalid(f"{source}: {path} is no positive number")
        if path.startswith("providers.") and not (isinstance(value, list) and all(isinstance(x, str) for x in value) if path.endswith(".sshKeys") else isinstance(value, str)):
            raise ConfigInvalid(f"{source}: {path} is of the wrong kind")
    return leaves


def file_layer(candidates: list[str], explicit: str | None = None, known: dict = DEFAULTS) -> tuple[str, dict] | None:
    """The first file there is, with its leaves, or none; an explicit one that is missing fails, and so does what can't
    be read."""
    path = explicit or next((p for p in candidates if os.path.exists(p)), None)
    if path is None:
        return None
    try:
        with open(path, "rb") as f:
            values = tomllib.load(f)
    except FileNotFoundError:
        raise ConfigInvalid(f"there is no file {path}") from None
    except tomllib.TOMLDecodeError as error:
        raise ConfigInvalid(f"{path}: {error}") from None
    return path, checked(values, known, path)


def first_wins(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Of the rows of each key the one of least rank whose value is not null; if all are null, that of greatest rank.
    Partial results are merged before rows are dealt, so a key may have any number."""
    others = [c for c in rows.columns if c not in (key, rank, "value")]
    order = F.struct(F.col("value").isNull().alias("unset"), F.when(F.col("value").isNull(), -F.col(rank)).otherwise(F.col(rank)).alias("rank"), "value", *others)
    return rows.groupBy(key).agg(F.min(order).alias("x")).select(key, "x.value", *(f"x.{c}" for c in others))


def effective(spark: SparkSession, layers: list[tuple[str, dict]], known: dict = DEFAULTS) -> DataFrame:
    """setting, value (as JSON, null for unset) and source of every known setting, from any number of layers, of which
    earlier ones win; defaults come last. A layer is a source's name and leaves by path."""
    rows = [(path, n, None if v is None else json.dumps(v), source) for n, (source, leaves) in enumerate([*layers, ("default", known)]) for path, v in leaves.items()]
    return first_wins(spark.createDataFrame(rows, "setting string, rank int, value string, source string"), "setting", "rank")


def shown(settings: DataFrame) -> DataFrame:
    """The settings that a view shows, as text, with a dash for what is unset. tokenEnv names a variable; a token's value
    is no setting, and would not be shown."""
    secret = F.lower(F.element_at(F.split("setting", r"\."), -1)).isin("token", "authorization", "userdata")
    plain = F.when(F.col("value").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")).otherwise(F.col("value"))
    return settings.where(~secret).select("setting", F.coalesce(plain, F.lit("-")).alias("value"), "source")


def warnings(settings: DataFrame) -> DataFrame:
    """provider and warning, where a provider has no region or no image, so that a request has to tell them."""
    part = F.split("setting", r"\.")
    unset = settings.where(F.col("setting").startswith("providers.") & part[2].isin("region", "image") & F.col("value").isNull())
    return unset.select(part[1].alias("provider"), F.concat(F.lit("no "), part[2], F.lit(" is set")).alias("warning"))
