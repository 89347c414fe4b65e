"""Fill-in-middle: texts cut into prefix, middle and suffix, with the middle moved to the end.

Each task runs an engine of its own inside ``mapInArrow``: slices of a batch are registered as tables, one SELECT
cuts, orders and restores all their texts, and the result goes back as Arrow. Where a text is cut, and how its parts are
ordered, comes from the SHA-256 of ``seed:id``, so a row gets the same form wherever and however often it is run.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamill.llm._shared import field, lean, slices

#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Code points, line feeds too.
UNIT = "(?s)."

_SQL = """
WITH told AS (
  SELECT row, coalesce(text, '') AS t, sha256($seed || ':' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM texts
), cut AS (
  SELECT row, t, regexp_extract_all(t, $unit) AS units,
    list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS x
  FROM told
), placed AS (
  SELECT row, t, units, x, len(units) AS n,
    CASE WHEN t = '' OR contains(t, $p) OR contains(t, $s) OR contains(t, $m) OR x[3] % 100 >= $moved THEN 'plain'
      WHEN x[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form,
    least(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS a, greatest(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS b
  FROM cut
), parts AS (
  SELECT row, t, n, form, a, b - a AS c,
    CASE form WHEN 'plain' THEN '' ELSE array_to_string(list_slice(units, 1, a), '') END AS prefix,
    CASE form WHEN 'plain' THEN '' ELSE array_to_string(list_slice(units, a + 1, b), '') END AS middle,
    CASE form WHEN 'plain' THEN '' ELSE array_to_string(list_slice(units, b + 1, n), '') END AS suffix
  FROM placed
), made AS (
  SELECT row, n, form, a, c, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle
    ELSE $s || suffix || $p || prefix || $m || middle END AS output
  FROM parts
)
SELECT row, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN c END AS middle_chars, output
FROM made ORDER BY row
"""

#: Markers can't overlap each other or a text's end, so each is where it was put.
_RESTORE = """
WITH cut AS (
  SELECT row, coalesce(text, '') AS t, coalesce(form, 'plain') AS form, string_split(coalesce(text, ''), $m) AS whole FROM texts
), two AS (
  SELECT row, t, form, whole[2] AS middle, string_split(whole[1], CASE form WHEN 'psm' THEN $s ELSE $p END) AS parts FROM cut
)
SELECT row, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN substr(parts[1], length($p) + 1) || middle || parts[2]
  ELSE parts[2] || middle || substr(parts[1], length($s) + 1) END AS restored
FROM two ORDER BY row
"""


def _apart(markers: tuple[str, ...]) -> None:
    """Markers have to be told apart in any text that holds none of them: no end of one may be the beginning of one."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            if not a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j))) or i != j and a in b:
                raise ValueError(f"markers overlap: {a!r} and {b!r}")


def _mapped(df: DataFrame, given: list[str], names: list[str], fields: list[T.StructField], sql: str, values: dict, slice_bytes: int) -> DataFrame:
    """df with the columns of ``fields``, which one SELECT makes of the columns ``given``, as ``names``, of each slice of
    a batch. The SELECT returns row and the fields, by row."""
    from pyspark.sql.pandas.types import to_arrow_type

    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    read = df.select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"`{c}`").alias(f"_given{i}") for i, c in enumerate(given)))
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        import duckdb

        # one thread for one task; nothing is spilled, as every row is made on its own
        engine = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        try:
            for batch in batches:
                texts = batch.column(len(keep))
                for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), slice_bytes):
                    part = batch.slice(a, b - a)
                    engine.register("texts", pa.table([pa.array(range(b - a), pa.int64()), *(part.column(len(keep) + i) for i in range(len(given)))], names=["row", *names]))
                    made = engine.sql(sql, params=values).to_arrow_table().combine_chunks()
                    engine.unregister("texts")
                    columns = [made.column(f.name).cast(k).combine_chunks() for f, k in zip(fields, kinds, strict=True)]
                    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], names=[*keep, *(f.name for f in fields)])
        finally:
            engine.close()

    return read.mapInArrow(lean(run), T.StructType([*(df.schema[c] for c in keep), *fields]))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: str = "1", moved: int = 90, spm: int = 20, markers: tuple[str, str, str] = MARKERS, slice_bytes: int = 1_000_000) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars and output.

    A text is matched left to right into n units, which have to cover it (code points, unless ``unit`` says otherwise).
    With h1 to h4 the first four groups of eight hex digits of sha256(``seed:id``), the prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units and the middle after the larger; ``moved`` hundredths of texts (by h3) are moved,
    ``spm`` hundredths of these (by h4) with the suffix first. Other texts are plain: output is the text, and the counts
    of units are null. So are empty texts, null ones, which count as empty, and those that hold a marker.

    A null id counts as an empty one; rows of one id are cut alike, if their texts are as long. Other columns of df stay,
    but for those named as the new ones, which give way. ``slice_bytes`` of texts are cut at once, or one longer text.
    """
    _apart(markers)
    values = dict(zip("psm", markers, strict=True)) | {"seed": seed, "unit": unit, "moved": moved, "spm": spm}
    fields = [field("n", "long"), field("form", "string"), field("prefix_chars", "long"), field("middle_chars", "long"), field("output", "string")]
    return _mapped(df, [text_col, id_col], ["text", "id"], fields, _SQL, values, slice_bytes)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored", markers: tuple[str, str, str] = MARKERS, slice_bytes: int = 1_000_000) -> DataFrame:
    """df with the texts that outputs were made of, from output and form alone. A null output is an empty text, and what
    has no form is plain. A column named as the new one gives way."""
    _apart(markers)
    return _mapped(df, [output_col, form_col], ["text", "form"], [field(restored_col, "string")], _RESTORE, dict(zip("psm", markers, strict=True)), slice_bytes)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, the cut, and hashes of output and restored text."""
    hashed: Callable = lambda c: F.sha2(F.col(c), 256)
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed("output").alias("output_sha256"), hashed("restored").alias("restored_sha256"))
