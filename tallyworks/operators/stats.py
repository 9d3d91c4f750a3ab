"""Putting statistics of a group next to its rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Add aggregate columns of each group to its rows.

    An aggregation with map-side combine and a join, not a window: a hot group is never
    sorted in one task, and AQE broadcasts the statistics or splits the hot partition.
    Without keys the statistics are one scalar row.
    """
    named = [c.alias(n) for n, c in stats.items()]
    if keys:
        return df.join(df.groupBy(*keys).agg(*named), list(keys), "left")
    return with_scalars(df, df.agg(F.struct(*named).alias("s")), list(stats))


def with_scalars(df: DataFrame, one_row: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the fields of a one-row, one-struct frame as columns."""
    return df.withColumn("_s", one_row.scalar()).select(*df.columns, *[F.col("_s")[n].alias(n) for n in names])


def long_form(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric: ids, ``metric``, ``value``."""
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(*ids, F.inline(F.array(*values)))


CO_MOMENTS = "i int, j int, n double, mean_i double, mean_j double, square_i double, square_j double, product double"


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, square_i, square_j, product) for i <= j: rows with both columns, and centred sums over them.

    A task keeps one matrix of each sum for all pairs, whatever its rows, and hands on a row per pair; these merge by their
    means. Null and NaN are absent values. Columns are numbered from 0.
    """
    k = len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = None
        n, total, squares, products = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            if not len(x):
                continue
            there = ~np.isnan(x)
            if shift is None or np.isnan(shift).any():
                # Sums run over the distance to a value of the column, so that large means do not cost digits.
                first = np.array([c[t][0] if t.any() else np.nan for c, t in zip(x.T, there.T)])
                shift = first if shift is None else np.where(np.isnan(shift), first, shift)
            x = np.where(there, x - shift, 0.0)
            mask = there.astype(np.float64)
            n += mask.T @ mask
            total += x.T @ mask
            squares += (x * x).T @ mask
            products += x.T @ x
        if shift is None:
            return
        i, j = np.triu_indices(k)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean_i, mean_j = total[i, j] / n[i, j], total[j, i] / n[i, j]
        some = n[i, j] > 0
        made = [
            i.astype(np.int32), j.astype(np.int32), n[i, j], mean_i + shift[i], mean_j + shift[j],
            squares[i, j] - mean_i * total[i, j], squares[j, i] - mean_j * total[j, i], products[i, j] - mean_i * total[j, i],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(m[some]) for m in made], names=[f.split()[0] for f in CO_MOMENTS.split(", ")])

    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = values.mapInArrow(partial, CO_MOMENTS)
    # As many rows a pair as there are tasks.
    pair = Window.partitionBy("i", "j")
    apart = {x: F.col(f"mean_{x}") - F.sum(F.col("n") * F.col(f"mean_{x}")).over(pair) / F.sum("n").over(pair) for x in "ij"}
    parts = parts.select("*", apart["i"].alias("_di"), apart["j"].alias("_dj"))
    between = {"square_i": "_di * _di", "square_j": "_dj * _dj", "product": "_di * _dj"}
    return parts.groupBy("i", "j").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) + F.expr(f"n * {d}")).alias(c) for c, d in between.items()])
