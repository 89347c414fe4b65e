"""Fenced text blocks of documents: extraction, tab expansion, wrapping by display width, and measures."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control sequences of terminals, which texts are rid of, and the markers before diagrams.
_ANSI, _FENCE = re.compile(r"\x1b\[[0-?]*[ -/]*[@-~]"), re.compile(r"(`{3,}|~{3,})(.*)")
_MARKER, _EMBED = re.compile(r"<!-- draw-visual:(.*?)(?:-->)?$"), re.compile(r"<!-- draw-visual: (\S+) -->\s*$")
BLOCK = T.ArrayType(T.StructType().add("label", T.StringType()).add("line", T.IntegerType()).add("lines", T.ArrayType(T.StringType())))
FOUND = T.StructType().add("blocks", BLOCK).add("error", T.StringType())


def _clean(text: str) -> list[str]:
    return _ANSI.sub("", text.replace("\r\n", "\n")).removesuffix("\n").split("\n")


def _found(text: str | None, language: str, raw: bool) -> tuple[list | None, str | None]:
    rows = _clean(text or "")
    odd = next((c for row in rows for c in row if unicodedata.category(c) == "Cc" and c != "\t"), None)
    if odd is not None:
        return None, f"control character U+{ord(odd):04X}"
    if raw:
        return ([("text", 1, rows)], None) if any(map(str.strip, rows)) else (None, "empty input")
    blocks, names, numbered = [], {}, iter(enumerate(map(str.strip, rows), 1))
    for at, row in numbered:
        if row.startswith("#"):
            names["heading"] = row.lstrip("#").strip()
        elif m := _MARKER.match(row):
            names["marker"] = m[1].strip()
        elif m := _FENCE.match(row):
            end = next((n for n, x in numbered if len(x) >= len(m[1]) and set(x) == {m[1][0]}), None)
            if end is None:
                return None, "unclosed fence"
            if m[2].strip() == language and end > at + 1:
                blocks.append((names.get("marker") or names.get("heading") or "text", at + 1, rows[at : end - 1]))
            names.pop("marker", None)
    return (blocks, None) if blocks else (None, "no block")


def _embeds(text: str | None) -> tuple[list | None, str | None]:
    rows, out = (text or "").split("\n"), []
    numbered = iter(enumerate(rows, 1))
    for at, row in numbered:
        if m := _EMBED.match(row):
            if not next(numbered, (0, ""))[1].startswith("```"):
                return None, f"line {at}: a marker without a fenced block"
            end = next((n for n, x in numbered if x.startswith("```")), None)
            if end is None:
                return None, f"line {at + 1}: unclosed fence"
            out.append((m[1], at, rows[at + 1 : end - 1]))
    return out, None


def _scan(docs: DataFrame, id_col: str, text_col: str, scan) -> DataFrame:
    """id, error, and of each block its number, label, line and lines; one row with an error for a text that has one."""

    @F.pandas_udf(FOUND)
    def found(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(t) for t in s], columns=["blocks", "error"], dtype=object)

    rows = docs.select(id_col, found(text_col).alias("x"))
    rows = rows.select(id_col, "x.error", F.posexplode_outer("x.blocks").alias("n", "b"))
    return rows.select(id_col, (F.col("n") + 1).alias("block"), "b.label", "b.line", "b.lines", "error")


def fenced(docs: DataFrame, language: str = "text", id_col: str = "id", text_col: str = "text", raw: bool = False) -> DataFrame:
    """id, block from 1, label, line of its first text line, and lines of every fenced block of that language that has
    lines, in order; and error for texts with an unclosed fence, control characters, or no such block.

    Fences are of three or more backquotes or tildes, and end with as many at least. A block's label is that of the
    marker before it, or else the last heading. ANSI sequences are left out. ``raw`` takes the whole text as a block.
    """
    return _scan(docs, id_col, text_col, lambda t: _found(t, language, raw))


def embeds(docs: DataFrame, rendered: DataFrame, most: int = 110, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, path, line and problem of every embedded diagram: ``rendered`` has each path's lines as they are now. A
    problem is an embed that is stale, too wide, of an unknown path, or a marker that no closed fence follows."""
    rows = _scan(docs, id_col, text_col, _embeds).where("block is not null or error is not null").withColumnRenamed("label", "path")
    rows = rows.join(rendered.select("path", F.col("lines").alias("now")), "path", "left")
    width = F.array_max(F.transform("now", F.length))
    told = F.concat_ws("; ", F.when(F.col("path").isNotNull() & F.col("now").isNull(), "not rendered"), F.when(width > most, F.format_string("%d columns wide", width)), F.when(F.col("lines") != F.col("now"), "stale"), "error")
    return rows.select(id_col, "path", "line", F.when(told != "", told).alias("problem"))


def display_width(c: str) -> int:
    if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf"):
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def _expanded(text: str, stop: int = 8) -> str:
    out, at = [], 0
    for c in text:
        add = " " * (stop - at % stop) if c == "\t" else c
        at += len(add) if c == "\t" else display_width(c)
        out.append(add)
    return "".join(out)


def _wrapped(text: str, width: int) -> list[str]:
    out, line, at = [], [], 0
    for c in text:
        w = display_width(c)
        if line and at + w > width:
            out.append("".join(line))
            line, at = [], 0
        line.append(c)
        at += w
    return [*out, "".join(line)]


@F.pandas_udf(T.StringType())
def expand_tabs(s: pd.Series) -> pd.Series:
    return s.map(_expanded, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap(s: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _wrapped(t, int(w)) for t, w in zip(s, width, strict=True)])


@F.pandas_udf(T.IntegerType())
def width_of(s: pd.Series) -> pd.Series:
    return s.map(lambda t: sum(map(display_width, t)), na_action="ignore").astype("Int32")


def measured(blocks: DataFrame, widths: list[int], id_col: str = "id") -> DataFrame:
    """For each block and each of a few widths: its widest line, the lines that are over the width, whether any is,
    and a hash of the block."""
    rows = blocks.where("error is null").select(id_col, "block", "label", "line", "lines", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    rows = rows.select("*", F.posexplode("lines").alias("i", "t")).withColumn("w", width_of(expand_tabs("t")))
    over = F.col("w") > F.col("width")
    found = rows.groupBy(id_col, "block", "width").agg(F.max("w").alias("columns"), F.array_sort(F.collect_list(F.when(over, F.col("line") + F.col("i")))).alias("wrapped_lines"), F.bool_or(over).alias("overflow"), F.first("label").alias("label"), F.first("line").alias("line"), F.first("lines").alias("x"))
    return found.withColumn("sha256", F.sha2(F.concat_ws("\n", "x"), 256)).drop("x")


def manifest(blocks: DataFrame, widths: list[int], id_col: str = "id") -> DataFrame:
    """id, one JSON list of what ``measured`` tells of each block and width, and failed, if any block is too wide."""
    rows = measured(blocks, widths, id_col)
    each = F.struct("block", "label", "line", "columns", F.col("width").alias("content_width"), "wrapped_lines", "sha256")
    return rows.groupBy(id_col).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("block", "width", each.alias("x")))), lambda y: y["x"])).alias("manifest"), F.bool_or("overflow").alias("failed"))
