"""A stream in random order through a buffer of bounded size, as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def _draw(seed: int, lane: int, i: int) -> int:
    """64 bits for the i-th draw of a lane, whatever micro-batch it falls in."""
    x = (seed * 0x9E3779B97F4A7C15 + lane * 0xC2B2AE3D27D4EB4F + i * 0xD6E8FEB86659FD93 + 1) & (1 << 64) - 1
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ x >> 30) * m & (1 << 64) - 1
    return x ^ x >> 31


def shuffled(rows: DataFrame, buffer: int, seed: int = 42, lane: str = "lane", order: str = "row_number") -> DataFrame:
    """rows with `place`: each lane's rows in the order in which they leave its buffer, from 0.

    A lane is a key, so lanes are many tasks' work; its state is the buffer, of `buffer` rows. A row that comes to a full
    buffer takes the place of a drawn one, which leaves; so none leaves over `buffer` places early. A row whose `order` is
    null only empties its lane's buffer, in a drawn order. Rows of a lane come in order over micro-batches (RowStream's
    do, and it marks its end). The same seed gives the same order, whatever the micro-batches.
    """
    if buffer < 1:
        raise ValueError("buffer must be 1 or more")
    names, at = rows.columns, rows.columns.index(order)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, came, left = (pickle.loads(state.get[0]), *state.get[1:]) if state.exists else ([], 0, 0)
        table = pd.concat(list(frames)).sort_values(order, na_position="last", kind="stable")
        out, n = [], int(key[0])
        for row in table.astype(object).where(table.notna(), None).itertuples(index=False, name=None):
            if row[at] is None:
                for k in range(len(held), 0, -1):
                    j = _draw(seed, n, came + k) % k
                    held[j], held[k - 1] = held[k - 1], held[j]
                    out.append(held.pop())
            elif len(held) < buffer:
                held.append(row)
            else:
                j = _draw(seed, n, came) % buffer
                out.append(held[j])
                held[j] = row
            came += row[at] is not None
        state.update((pickle.dumps(held), came, left + len(out)))
        found = pd.DataFrame(out, columns=names)
        found["place"] = np.arange(left, left + len(out), dtype=np.int64)
        yield found

    schema = StructType([*rows.schema.fields]).add("place", "long")
    return rows.groupBy(lane).applyInPandasWithState(step, schema, "held binary, came long, gone long", "append", GroupStateTimeout.NoTimeout)
