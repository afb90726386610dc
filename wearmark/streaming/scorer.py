"""Stateful scoring of unit streams: the last rows of each unit are kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.features import EXTRA, GROUPS, RECENT
from ..operators.models import predict
from ..operators.segments import UNIT


def tail_features(rows: np.ndarray) -> np.ndarray:
    """Feature vector of one tail, ordered group by group over the sensors."""
    n = len(rows)
    last = rows[-1]
    t = np.arange(n) - (n - 1) / 2.0
    slope = t @ (rows - rows.mean(axis=0)) / (t @ t) if n > 1 else np.zeros(rows.shape[1])
    recent = [rows[-k:].mean(axis=0) if n >= k else last for k in RECENT]
    return np.concatenate(
        [last, rows.mean(axis=0), rows.std(axis=0), rows.min(axis=0), rows.max(axis=0), slope, last - rows[0], *recent]
    )


def latest_features(
    stream: DataFrame,
    cols: Sequence[str],
    w: int,
    u: str = UNIT,
    order: str = "cycle",
    idle_minutes: int | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Per micro-batch, the windowed features of every unit that got new rows.

    State per unit: the newest ``w`` rows by ``order`` (rows of one order value
    by ``tie``) and the number of rows seen. Every row counts, in whatever order
    and chunks it arrives; a row older than the kept ones counts without
    entering the window. The source is taken to deliver each row once. With
    ``idle_minutes`` the state of silent units is removed; that needs a
    processing-time trigger, since such a timeout asks for further batches for
    ever and an availableNow run would not end.
    """
    cols = list(cols)
    names = [f"{c}_{g}" for g in GROUPS for c in cols]
    id_type = stream.schema[u].dataType.simpleString()
    out_schema = ", ".join(
        [f"{u} {id_type}", f"{order} long", *[f"{n} double" for n in [*names, *EXTRA]]]
    )
    state_schema = "orders array<long>, ties array<long>, tail array<double>, seen long"
    width = len(cols)

    def update(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            orders, ties, tail, seen = state.get
            orders, ties = np.asarray(orders, np.int64), np.asarray(ties, np.int64)
            tail = np.asarray(tail, dtype=float).reshape(-1, width)
        else:
            orders, ties, tail, seen = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width)), 0
        before = seen
        # the newest w rows of all chunks are the newest of the newest of each
        for batch in batches:
            seen += len(batch)
            orders = np.concatenate([orders, batch[order].to_numpy(np.int64)])
            ties = np.concatenate([ties, batch["_tie"].to_numpy(np.int64)])
            tail = np.concatenate([tail, batch[cols].to_numpy(float)])
            place = np.lexsort((ties, orders))[-w:]
            orders, ties, tail = orders[place], ties[place], tail[place]
        state.update((orders.tolist(), ties.tolist(), tail.reshape(-1).tolist(), int(seen)))
        if idle_minutes is not None:
            state.setTimeoutDuration(idle_minutes * 60_000)
        if seen > before:
            values = [*tail_features(tail), float(seen), float(len(tail))]
            line = {u: [key[0]], order: [int(orders[-1])]}
            line.update({n: [v] for n, v in zip([*names, *EXTRA], values)})
            yield pd.DataFrame(line)

    timeout = (
        GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    )
    second = F.lit(0).cast("long") if tie is None else F.col(tie).cast("long")
    return stream.select(u, order, second.alias("_tie"), *cols).groupBy(u).applyInPandasWithState(
        update, out_schema, state_schema, "append", timeout
    )


def stream_scorer(
    stream: DataFrame,
    model,
    cols: Sequence[str],
    w: int,
    u: str = UNIT,
    order: str = "cycle",
    idle_minutes: int | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Streaming predictions: stateful features, then the model as JVM-side columns."""
    return predict(latest_features(stream, cols, w, u, order, idle_minutes, tie), model)


def run_available(
    scored: DataFrame, path: str, checkpoint: str, on_start: Callable | None = None
) -> None:
    """Score everything available now and append it to a Parquet table."""
    query = (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    if on_start is not None:
        on_start(query)
    query.awaitTermination()
