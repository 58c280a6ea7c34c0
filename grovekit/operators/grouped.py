"""The one way order-dependent operators run: a group's rows as an ordered array, functions over Arrow batches of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], fn: Callable[[list], Iterable[tuple]], out: str) -> DataFrame:
    """(keys, out…): ``fn`` maps a group's rows (dict-like, sorted by ``order`` ascending) to tuples of the columns ``out``.

    A group is an image or a tree: bounded by what a camera sees, not by the size of the table.  Rows with null keys form a
    group of their own; groups without rows don't exist.
    """
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("_rows"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name in keys)
    names = [c.split()[0] for c in _split(out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                key = tuple(r[:-1])
                rows += [(*key, *x) for x in fn(list(r[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return packed.mapInPandas(run, f"{kinds}, {out}")


def per_batch(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], fn: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]], out: str) -> DataFrame:
    """(keys, out…): like :func:`per_group`, for functions that treat many groups at once.

    ``fn`` gets the batch's rows as columns (numbers; missing ones are NaN), and where each group starts and how many rows it
    has; it gives the number of the group of each row that it makes, and the columns ``out``.
    """
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("_rows"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name in keys)
    names = [c.split()[0] for c in _split(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("_rows"))
            n = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = rows.flatten()
            columns = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            group, made = fn(columns, np.cumsum(n) - n, n)
            picked = [batch.column(batch.schema.get_field_index(k)).take(pa.array(group)) for k in keys]
            yield pa.RecordBatch.from_arrays([*picked, *[pa.array(x) for x in made]], names=[*keys, *names])

    return packed.mapInArrow(run, f"{kinds}, {out}")


def _split(ddl: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*parts, cur.strip()]
