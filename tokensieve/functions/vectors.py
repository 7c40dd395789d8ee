"""Vector arithmetic on array columns; all but the means of groups runs in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Norms count as this at least, so a zero vector stays zero.
LEAST_NORM = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(LEAST_NORM))
    return F.transform(v, lambda x: x / norm)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def group_means(rows: DataFrame, keys: dict[str, str], vec: str = "vec", count: str = "members") -> DataFrame:
    """(keys, vec, count): the element-wise mean of vec and the number of rows for each combination of keys (name: type).

    Each Arrow batch is summed up by key before the shuffle, so a group that holds a large share of all rows costs a row
    for each batch. The keys are integers; vectors of one group have one length.
    """
    names = list(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            by = np.stack([batch.column(i).to_numpy() for i in range(len(names))])
            order = np.lexsort(by[::-1])
            first = np.flatnonzero(np.concatenate(([True], (by[:, order][:, 1:] != by[:, order][:, :-1]).any(0))))
            lists = batch.column(len(names))
            width = lists.value_lengths().to_numpy()
            if (width == width[0]).all():
                sums = list(np.add.reduceat(lists.flatten().to_numpy().reshape(-1, width[0])[order], first, axis=0))
            else:
                every = lists.to_pylist()
                sums = [np.sum([every[i] for i in part], axis=0) for part in np.split(order, first[1:])]
            n = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(order[first])) for i in range(len(names))), pa.array(sums, pa.list_(pa.float64())), pa.array(n, pa.int64())], [*names, "total", "n"])

    chosen = rows.select(*(F.col(k).cast(t).alias(k) for k, t in keys.items()), F.col(vec).cast("array<double>").alias("vec"))
    sums = chosen.mapInArrow(partial, ", ".join(f"{k} {t}" for k, t in keys.items()) + ", total array<double>, n long")
    whole = sums.groupBy(*names).agg(F.collect_list("total").alias("totals"), F.sum("n").alias(count))
    zero = F.transform(F.col("totals")[0], lambda x: F.lit(0.0))
    added = F.aggregate("totals", zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return whole.select(*names, added.alias("_total"), count).select(*names, F.transform("_total", lambda x: x / F.col(count)).alias("vec"), count)


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))
