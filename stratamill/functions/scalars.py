"""Scalar functions over columns: names, numbers, durations, redaction."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME_CHARS = 64


def trimmed(c: Column) -> Column:
    """Without white space at its ends; Spark's own trim takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def valid_name(c: Column) -> Column:
    """The trimmed name, or null if it is empty or too long."""
    t = trimmed(c)
    return F.when(F.length(t).between(1, NAME_CHARS), t)


def name_error(c: Column) -> Column:
    t = trimmed(c)
    return F.when(c.isNull() | (F.length(t) == 0), "empty").when(F.length(t) > NAME_CHARS, "too long")


def greeting(c: Column) -> Column:
    return F.concat(F.lit("Hello, "), valid_name(F.coalesce(c, F.lit("world"))), F.lit("!"))


def in_range(c: Column, low: int = 20, high: int = 300) -> Column:
    """A comma-separated list as integers, or null if one is no integer of the range."""
    parts = F.transform(F.split(c, ","), lambda x: trimmed(x).try_cast("int"))
    return F.when(F.forall(parts, lambda x: F.coalesce(x.between(low, high), F.lit(False))), parts)


#: Fixed value: the line of options.
_OPTION_LINE = r"^\s*(?:%%|')\s*draw-visual:\s*(.*)$"
_SHELL_WORD = r"""(?:"(?:[^"\\]|\\.)*"|'[^']*'|\\.|[^\s"'\\])++"""


def options(text: Column) -> Column:
    """The words of the option line that a diagram's source may begin with, cut and unquoted as a shell would; none
    without such a line, null where a quote is left open."""
    line = F.regexp_extract(F.get(F.split(text, "\n"), F.lit(0)), _OPTION_LINE, 1)
    words = F.regexp_extract_all(line, F.lit(_SHELL_WORD), F.lit(0))
    unquoted = F.transform(words, lambda w: F.regexp_replace(w, r"""\"((?:[^"\\]|\\.)*)\"|'([^']*)'|\\(.)""", "$1$2$3"))
    return F.when(line.rlike(rf"""^\s*(?:{_SHELL_WORD}\s*+)*+$"""), unquoted)


def json_path(c: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(c, path), F.lit(""))


def or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def short_count(c: Column) -> Column:
    """Thousands as a rounded ``k``, ties to even."""
    return F.when(c >= 1000, F.concat(F.bround(c.cast("double") / 1000).cast("bigint").cast("string"), F.lit("k"))).otherwise(c.cast("bigint").cast("string"))


def percent(given: Column, used: Column, most: Column) -> Column:
    """A whole percentage: the one given or that of what is used, ties to even."""
    return F.bround(F.coalesce(given.cast("double"), F.when(most > 0, used / most * 100)))


def alarm(pct: Column) -> Column:
    return F.when(pct > 90, "red").when(pct > 70, "yellow").otherwise("green")


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).when(s.isNotNull(), F.format_string("%ds", s))


def cost_text(cost: Column) -> Column:
    return F.when(cost.isNotNull(), F.format_string("$%.4f", cost.cast("double")))


def joined(*parts: Column) -> Column:
    """Non-empty parts, joined by a bar."""
    return F.concat_ws(" | ", *(F.when(p != "", p) for p in parts))


def number_text(c: Column) -> Column:
    """Without trailing zeros."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def gb_from_mib(c: Column) -> Column:
    return c.cast("double") / 1024


def preview(data: Column) -> Column:
    """Length and hash in place of the bytes."""
    return F.struct(F.octet_length(data).alias("byteLength"), F.sha2(data.cast("binary"), 256).alias("sha256"))


def user_data_ok(data: Column, provider: Column) -> Column:
    most = F.when(provider == "hetzner", 32 * 1024).when(provider == "digitalocean", 64 * 1024)
    return F.is_valid_utf8(data.cast("binary").cast("string")) & (F.octet_length(data) <= most)


def redacted(c: Column) -> Column:
    """Token shapes masked; masking again changes nothing."""
    for shape, mask in _SHAPES:
        c = F.regexp_replace(c, shape, mask)
    return c


#: Names of what a record never shows, however they are written.
SECRET_KEYS = ("token", "authorization", "userdata")


def _is_secret(name: str) -> bool:
    return name.lower().replace("_", "") in SECRET_KEYS


def redacted_record(c: Column, kind: T.DataType) -> Column:
    """A value of that type without the fields and keys of secrets at any depth, and with token shapes masked in all
    its strings, in arrays, structs and maps; doing so again changes nothing. The plan is as deep as the type, and all of
    it are built-in functions. A struct of nothing but secrets becomes null."""
    if isinstance(kind, T.StringType):
        return redacted(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redacted_record(x, kind.elementType)) if _has_text(kind.elementType) else c
    if isinstance(kind, T.MapType):
        shown = c if not isinstance(kind.keyType, T.StringType) else F.map_filter(c, lambda k, _: ~F.replace(F.lower(k), F.lit("_"), F.lit("")).isin(*SECRET_KEYS))
        return F.transform_values(shown, lambda _, v: redacted_record(v, kind.valueType)) if _has_text(kind.valueType) else shown
    if isinstance(kind, T.StructType):
        kept = [redacted_record(c.getField(f.name), f.dataType).alias(f.name) for f in kind if not _is_secret(f.name)]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    return redacted_variant(c) if isinstance(kind, T.VariantType) else c


def _has_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.ArrayType, T.MapType, T.StructType, T.VariantType))


#: The shapes that ``redacted`` masks, in the order in which it does.
_SHAPES = ((r"(?i)\bAuthorization\s*:\s*[^\r\n]+", "[redacted]"), (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]"), (r"\b(?:dop_v1_[A-Za-z0-9]+|[A-Za-z0-9]{64})\b", "[redacted]"))


def redacted_variant(c: Column) -> Column:
    """The same for a VARIANT, whose shape each row has for itself."""

    @F.pandas_udf(T.StringType())
    def shown(texts: pd.Series) -> pd.Series:
        import re

        shapes = [(re.compile(shape, re.ASCII), mask) for shape, mask in _SHAPES]

        def masked(x) -> str:
            if isinstance(x, dict):
                return "{" + ",".join(f"{json.dumps(k)}:{masked(v)}" for k, v in x.items() if not _is_secret(k)) + "}"
            if isinstance(x, list):
                return "[" + ",".join(map(masked, x)) + "]"
            if isinstance(x, str):
                for shape, mask in shapes:
                    x = shape.sub(mask, x)
            return x.text if isinstance(x, _Number) else json.dumps(x)

        return texts.map(lambda t: masked(json.loads(t, parse_float=_Number)), na_action="ignore")

    return F.parse_json(shown(F.to_json(c)))


class _Number:
    """A number that stays as it was written."""

    def __init__(self, text: str):
        self.text = text


def without_keys(record: Column, names: tuple[str, ...] = ("token", "authorization", "password", "userdata", "user_data")) -> Column:
    return F.map_filter(record, lambda k, _: ~F.lower(k).isin(*names))


def seconds(text: Column, default: int = 180, most: int = 600) -> Column:
    """30s, 2m or 1h as seconds; null text is the default, what is malformed or too long is null."""
    n = F.regexp_extract(text, r"^(\d+)[smh]$", 1).try_cast("int")
    unit = F.when(text.endswith("h"), 3600).when(text.endswith("m"), 60).otherwise(1)
    return F.when(text.isNull(), default).otherwise(F.when((n > 0) & (n * unit <= most), n * unit))


def poll_cap(deadline_s: Column) -> Column:
    return F.ceil(deadline_s / 2) + 1
