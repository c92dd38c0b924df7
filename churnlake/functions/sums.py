"""Sums of arrays that tasks hand out as bytes, added up in a tree of tasks instead of on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions that one task adds up, and that the driver adds up at the end.
FAN = 32


def summed(rows: DataFrame, parts: int, keys: Sequence[str], dtype) -> dict[tuple, np.ndarray]:
    """Sum of ``sums`` (an array as bytes) for every value of the int columns ``keys``.

    ``rows`` also has an int column ``part``, the partition that made a row; there are about ``parts`` of them.
    Results are small: the driver gets at most about FAN rows per key.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype) for b in table["sums"].to_pylist())
        return pa.table({**{c: table[c].slice(0, 1) for c in ("part", *keys)}, "sums": pa.array([total.tobytes()], pa.binary())})

    schema = ", ".join([*(f"{c} int" for c in ("part", *keys)), "sums binary"])
    rows = rows.select("part", *keys, "sums")
    while parts > FAN:
        rows = rows.withColumn("part", F.expr(f"int(part div {FAN})")).groupBy("part", *keys).applyInArrow(add, schema)
        parts = -(-parts // FAN)
    found: dict[tuple, np.ndarray] = {}
    for r in rows.orderBy("part").collect():
        key, value = tuple(r[c] for c in keys), np.frombuffer(r["sums"], dtype)
        found[key] = found[key] + value if key in found else value
    return found
