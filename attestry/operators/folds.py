"""Folds over the rows of a key in their order, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: object, step: Callable, out: str) -> DataFrame:
    """``df`` with what ``step(state, *columns)`` gives for each row, carried on in the order of each key's rows.

    ``step`` gives the new state and the tuple of the columns ``out``. A task
    reads its sorted rows batch by batch and holds one state, so a key may have
    any number of rows; its fold is one after the other by nature. ``order``
    should tell all rows of a key apart.
    """
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType([*df.schema.fields, *StructType.fromDDL(out).fields])
    arrow = to_arrow_schema(schema)
    added = [f.name for f in StructType.fromDDL(out).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            given: list[tuple] = []
            values = [batch.column(c).to_pylist() for c in (*keys, *columns)]
            for row in zip(*values, strict=True):
                if row[: len(keys)] != key:
                    key, state = row[: len(keys)], start
                state, new = step(state, *row[len(keys) :])
                given.append(new)
            more = [pa.array([g[i] for g in given], arrow.field(name).type) for i, name in enumerate(added)]
            yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, *added])

    return rows.mapInArrow(run, schema)


def admitted(df: DataFrame, keys: list[str], order: list[str], amount: str, limit) -> DataFrame:
    """``df`` with ``admitted``: whether a reservation fits under the limit beside those admitted before it.

    A rejected one leaves its room to later ones. A reservation without an
    amount is not admitted.
    """
    from decimal import Decimal

    most = Decimal(limit)

    def step(used: Decimal, value):
        fits = value is not None and used + Decimal(value) <= most
        return (used + Decimal(value) if fits else used), (fits,)

    return ordered_fold(df, keys, order, [amount], Decimal(0), step, "admitted boolean")
