"""Arrow plumbing shared by the operators of this subpackage.

Every operator takes a DataFrame plus the names of its id and text columns and
selects only those, so extra columns, whatever their names, never reach it.
Batches are cut again by bytes before user code sees them, so that a run of
very long texts doesn't pile up in one Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handed to user code at once (one longer text goes alone).
SLICE_BYTES = 2 << 20


def col(name: str) -> Column:
    """Column by exact name, also when the name has dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; nothing is turned into Python strings before."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (int(ends[start - 1]) if start else 0) + limit, "right")))
        yield start, end
        start = end


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    make: Callable[[], Callable[[list, list[str | None]], Iterable[dict[str, list]]]],
    limit: int = SLICE_BYTES,
    extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Run ``make()(ids, texts, *extra)`` over slices of the two columns.

    ``make`` runs once in each task; the function it returns gives columns (as
    a dict of lists or Arrow arrays) for each slice.
    """
    cols = [col(id_col).alias("i"), col(text_col).cast("string").alias("t")]
    cols += [c.alias(f"x{k}") for k, c in zip(count(), extra)]
    return map_columns(df.select(*cols), schema, make, limit)


def map_columns(df: DataFrame, schema: str, make: Callable, limit: int = SLICE_BYTES) -> DataFrame:
    """As map_texts, for a frame of an id, a text and further columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for a, b in slices(batch.column(1), limit):
                for out in fn(*(c.slice(a, b - a).to_pylist() for c in batch.columns)):
                    yield pa.RecordBatch.from_arrays(
                        [v if isinstance(v := out[f.name], pa.Array) and v.type == f.type else pa.array(v, f.type, from_pandas=False) for f in arrow], schema=arrow
                    )
        pa.default_memory_pool().release_unused()  # a worker outlives the task

    return df.mapInArrow(run, spark_schema)


def keep_rows(df: DataFrame, id_col: str, text_col: str, make: Callable) -> DataFrame:
    """Rows of df, all columns, for which ``make()(texts)`` gives true."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(fn(part.column(at).to_pylist()), pa.bool_()))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)


ASCII_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)
