"""Filters that look at one text column and pass all other columns through, whatever their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sabermill.llm.kernels import release, utf8


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` for which ``keep`` (bytes, offsets of a batch's texts) is true, without a shuffle or a join."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield part.filter(pa.array(keep(*utf8(part.column(at))), pa.bool_()))
        release()

    return plain.mapInArrow(run, schema).toDF(*names)
