"""A symbol's bars, in time order, as one Arrow group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
_SPARK = {"double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def per_symbol(df: DataFrame, made: dict[str, str], fold: Callable[[pd.DataFrame], dict[str, np.ndarray]], needs: list[str]) -> DataFrame:
    """Adds the columns ``made`` (name -> SQL type) that ``fold`` computes from the columns ``needs``.

    A symbol's bars are one Arrow table. Only ``needs`` become a pandas frame; all other columns pass through as they
    are, so a chain of folds stays a chain and no fold is computed twice for a join. NaN comes out as NULL.
    """
    df = df.drop(*made)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, _SPARK[t]) for c, t in made.items()]])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("ts", "ascending")]))
        found = fold(table.select(list(dict.fromkeys(["ts", *needs]))).to_pandas())
        for name, kind in made.items():
            table = table.append_column(name, pa.array(found[name], _ARROW[kind], from_pandas=True))
        return table

    return df.groupBy("symbol").applyInArrow(run, schema)


def doubles(df: DataFrame, names: list[str], fold: Callable[[pd.DataFrame], dict[str, np.ndarray]], needs: list[str]) -> DataFrame:
    """``per_symbol`` for columns of doubles."""
    return per_symbol(df, dict.fromkeys(names, "double"), fold, needs)


#: Bars of short symbols that one call of a fold takes together.
TOGETHER_ROWS = 1 << 16


def _starts(table: pa.Table) -> np.ndarray:
    """The first row of each symbol; equal symbols stand together."""
    code = table.column("symbol").combine_chunks().dictionary_encode("encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])


def doubles_together(df: DataFrame, names: list[str], fold: Callable[[list[np.ndarray]], dict[str, np.ndarray]], need: str, timeless_first: bool = False) -> DataFrame:
    """``doubles`` from one column, with many symbols a call: ``fold`` takes their arrays and gives columns of all bars.

    A task's bars come sorted by symbol and time and are handed on in stretches of whole symbols, so that it holds
    some ``TOGETHER_ROWS`` of them, or one symbol's bars if those are more. Bars without a time stand last; with
    ``timeless_first`` they stand first, as in a window's frame, whose exchange and sort then serve here too.
    """
    df = df.drop(*names)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])

    def folded(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x = table.column(need).to_numpy().astype(float)
        found = fold(np.split(x, _starts(table)[1:]))
        for name in names:
            table = table.append_column(name, pa.array(found[name], pa.float64(), from_pandas=True))
        yield from table.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit = [], 0, TOGETHER_ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= limit:
                table = pa.Table.from_batches(held).combine_chunks()
                last = int(_starts(table)[-1])  # this symbol may go on
                if last:
                    yield from folded(table.slice(0, last))
                rest = table.slice(last)
                held, n = rest.to_batches(), rest.num_rows
                limit = max(TOGETHER_ROWS, 2 * n)
        if n:
            yield from folded(pa.Table.from_batches(held).combine_chunks())

    return df.repartition("symbol").sortWithinPartitions("symbol", F.col("ts").asc() if timeless_first else F.col("ts").asc_nulls_last()).mapInArrow(run, schema)
