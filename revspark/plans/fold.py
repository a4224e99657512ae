"""Ordered folds over keyed rows, for operators whose state depends on the rows before."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..shipping import ship

BATCH = 10_000


def fold(rows: DataFrame, key: list[str], order: list[str], fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """fn applied to the ordered rows of every key; it gets an iterator and yields rows of `schema`.

    One shuffle by key, then a sorted stream: many small keys cost no call into Spark each, and a key's rows are
    never gathered unless fn does so.
    """
    ship(rows.sparkSession)
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    at = [rows.columns.index(k) for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for _, group in groupby(stream, key=lambda r: tuple(r[k] for k in at)):
            for row in fn(group):
                out.append(row)
                if len(out) >= BATCH:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
