"""Folds over groups of rows, many groups to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that goes back.
BATCH = 10_000


def sweep_groups(rows: DataFrame, keys: list[str], order: list, columns: list[str], sweep: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str, dealt: bool = False) -> DataFrame:
    """What `sweep` makes of each group: it gets the values of `keys` and the group's `columns` as tuples, sorted by `order` and one after the other, and gives rows of `schema`.

    Spark deals and sorts the rows; a task then reads its groups one after the other
    from Arrow batches. No group is held, and a small one costs no frame of its own,
    which takes some 15 ms with applyInPandas. dealt: each group's rows are together already.
    """
    shape, n = to_arrow_schema(StructType.fromDDL(schema)), len(keys)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        read = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for key, group in groupby(read, key=itemgetter(slice(n))):
            for made in sweep(key, (row[n:] for row in group)):
                out.append(made)
                if len(out) >= BATCH:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    rows = rows if dealt else rows.repartition(*keys)
    return rows.sortWithinPartitions(*keys, *order).select(*keys, *columns).mapInArrow(run, schema)


def fold_groups(rows: DataFrame, keys: list[str], order: list, columns: list[str], fold: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What `fold` makes of each group, as `sweep_groups`, but with all rows of the group at once."""
    return sweep_groups(rows, keys, order, columns, lambda key, group: fold(key, list(group)), schema)
