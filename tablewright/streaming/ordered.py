"""Ordered steps on streams that never end: state per key, kept only as long as it is needed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def carry_forward_stream(rows: DataFrame, stream: Sequence[str], pos: str, headers: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """``ordering.carry_forward`` on an unbounded stream, whatever way it is cut into micro-batches.

    The state of a stream key is the last position and, for each header, value and position in
    force. Rows of a key come in rising positions from batch to batch and in any order inside one. A row
    at or before the last position of an earlier batch is late: it comes out with ``late`` true and without
    headers, and changes nothing. Header values are texts; ``pos`` is a whole number. A micro-batch's rows of
    one key are sorted in one task, so the size of a batch bounds them.
    """
    names = [name for name, _, _ in headers]
    marked = rows.withColumn(pos, F.col(pos).cast("long"))
    for n, (_, test, value) in enumerate(headers):
        marked = marked.withColumns({f"_is{n}": F.coalesce(test, F.lit(False)), f"_to{n}": value.cast("string")})
    kept = [T.StructField(f.name, f.dataType) for f in marked.schema if not f.name.startswith(("_is", "_to"))]
    found = [field for name in names for field in (T.StructField(name, T.StringType()), T.StructField(f"{name}_pos", T.LongType()))]
    out = T.StructType([*kept, *found, T.StructField("late", T.BooleanType())])
    state = T.StructType([T.StructField("last", T.LongType())] + [T.StructField(f"s{n}", T.StringType() if n % 2 == 0 else T.LongType()) for n in range(2 * len(names))])
    shown = [f.name for f in kept]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, *flat = held.get if held.exists else (None, *[None] * (2 * len(names)))
        now = pd.concat(list(batches)).sort_values(pos, kind="stable")
        late = (now[pos] <= last) if last is not None else pd.Series(False, index=now.index)
        force = [(flat[2 * n], flat[2 * n + 1]) for n in range(len(names))]
        values: list[list] = [[] for _ in range(2 * len(names))]
        tests = [now[f"_is{n}"].tolist() for n in range(len(names))]
        texts = [now[f"_to{n}"].tolist() for n in range(len(names))]
        for row, (at, is_late) in enumerate(zip(now[pos].tolist(), late.tolist())):
            if not is_late:
                last = at
                # An inner header ends where a new outer one starts, so the outermost one of a row counts.
                first = next((n for n in range(len(names)) if tests[n][row]), None)
                if first is not None:
                    force[first:] = [(texts[first][row], at), *[(None, None)] * (len(names) - first - 1)]
            for n in range(len(names)):
                text, where = (None, None) if is_late else force[n]
                values[2 * n].append(text)
                values[2 * n + 1].append(where)
        held.update((last, *[part for pair in force for part in pair]))
        made = now[shown].copy()
        for field, column in zip(found, values):
            made[field.name] = pd.Series(column, index=made.index, dtype="object" if isinstance(field.dataType, T.StringType) else "Int64")
        made["late"] = late
        yield made

    return marked.groupBy(*stream).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


# --- dedup in snapshots ---------------------------------------------------------------------


def first_seen_stream(rows: DataFrame, keys: Sequence[str], order: str, snapshot: str = "snapshot_ts", delay: str = "1 hour") -> DataFrame:
    """``ordering.dedup_first_seen`` in each snapshot of a stream.

    A snapshot is complete once rows more than ``delay`` younger have come; then its keys come out (append mode)
    and its state goes. Rows of a snapshot that is complete are dropped.
    """
    timed = rows.withWatermark(snapshot, delay)
    return timed.groupBy(*keys, snapshot).agg(F.min(order).alias(order))


def first_wins_stream(
    rows: DataFrame, keys: Sequence[str], order: Column, payload: Sequence[str], snapshot: str = "snapshot_ts", delay: str = "1 hour"
) -> DataFrame:
    """``ordering.first_wins`` in each snapshot of a stream; see ``first_seen_stream``."""
    timed = rows.withWatermark(snapshot, delay)
    picked = timed.groupBy(*keys, snapshot).agg(F.min_by(F.struct(*payload), order).alias("_p"))
    return picked.select(*keys, snapshot, "_p.*")
