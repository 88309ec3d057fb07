"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.operators.graphs import written
from parley.operators.numbering import numbered

__all__ = ["numbered", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, mod: int) -> Column:
    """crc32 of an id written as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def per_batch(df: DataFrame, schema: str | StructType, rows: Callable[..., dict], *columns: str) -> DataFrame:
    """Run ``rows`` over Arrow batches of the named columns, given as Python lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(*(batch.column(i).to_pylist() for i in range(len(columns))))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def slices(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Cut a list of texts or bytes into runs of at most ``most`` characters (one item at least)."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


_LETTER = None


def letter_table() -> np.ndarray:
    """For every code point, whether it is a letter; made once in each Python worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
