"""Sequential rules over many groups: Spark deals and sorts the rows, a worker passes through them group by group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import ship

#: Rows of an Arrow batch that a worker gives out.
BATCH = 5000


def in_groups(df: DataFrame, by: list[str], order: list, fn: Callable[[list[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """Rows (ddl) that ``fn`` gives for each group: the tuples of df's columns with equal ``by``, in the order of ``order``.

    A task holds one group and a batch; a group costs what ``fn`` costs, with no frame or Arrow stream of its own, so
    tables that fall apart into groups of a row or two are as cheap as others. Nulls of ``by`` are equal and come as None.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(ddl))
    at = [df.columns.index(c) for c in by]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, found = None, [], []
        for part in batches:
            columns = [c.to_pylist() for c in part.columns]
            for row, key in zip(zip(*columns), zip(*[columns[i] for i in at]) if at else repeat(())):
                if key != held:
                    if rows:
                        found.extend(fn(rows))
                        while len(found) >= BATCH:
                            yield batch(found[:BATCH])
                            found = found[BATCH:]
                    held, rows = key, []
                rows.append(row)
        if rows:
            found.extend(fn(rows))
        for i in range(0, len(found), BATCH):
            yield batch(found[i : i + BATCH])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, ddl)


def in_tables(df: DataFrame, by: list[str], order: list, fn: Callable[[pa.Table], pa.Table | None], ddl: str) -> DataFrame:
    """Like ``in_groups``, but ``fn`` takes a group as an Arrow table and gives one of the columns of ddl, or None.

    For rules over columns of numbers: rows never become Python objects. A task holds one group and a batch; rows with a null in ``by`` take no part.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(ddl))
    at = [df.columns.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            made = fn(pa.Table.from_batches(held)) if held else None
            held.clear()
            if made is not None and made.num_rows:
                found.append(made.select(arrow.names).cast(arrow))
            if sum(t.num_rows for t in found) >= BATCH:
                yield from given()

        def given() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(found) if found else None
            found.clear()
            if whole is not None:
                yield from whole.combine_chunks().to_batches(max_chunksize=4 * BATCH)

        for part in batches:
            n = part.num_rows
            if not n:
                continue
            new = np.zeros(max(n - 1, 0), bool)
            for i in at:
                c = part.column(i)
                new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            if held and any(held[-1].column(i)[-1] != part.column(i)[0] for i in at):
                yield from done()
            begin = 0
            for end in (np.flatnonzero(new) + 1).tolist():
                held.append(part.slice(begin, end - begin))
                yield from done()
                begin = end
            held.append(part.slice(begin))
        yield from done()
        yield from given()

    return df.dropna(subset=by).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, ddl)
