"""Session dedup: a text is a hit if its hash is among the last distinct ones of its session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 20


def batch_dedup(turns: DataFrame, session: str, order: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(session, order, is_hit): the recent hashes fold over a session's turns in order, a hit moves to the front."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.xxhash64(text).alias("h"))))
    start = F.struct(F.array().cast("array<bigint>").alias("recent"), F.lit("").alias("flags"))

    def step(a: Column, x: Column) -> Column:
        recent = F.slice(F.concat(F.array(x["h"]), F.array_remove(a["recent"], x["h"])), 1, capacity)
        return F.struct(recent.alias("recent"), F.concat(a["flags"], F.array_contains(a["recent"], x["h"]).cast("int").cast("string")).alias("flags"))

    docs = turns.groupBy(session).agg(rows.alias("rows")).withColumn("flags", F.split(F.aggregate("rows", start, step, lambda a: a["flags"]), ""))
    return docs.select(session, F.inline(F.transform("rows", lambda x, i: F.struct(x["o"].alias(order), (F.get("flags", i) == "1").alias("is_hit")))))


def stream_dedup(turns: DataFrame, session: str, order: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The same over a stream: recent hashes of each session are its state."""

    def update(key, frames, state):
        recent = list(state.get[0]) if state.exists else []
        for pdf in frames:
            out = []
            for row in pdf.sort_values(order).itertuples(index=False):
                h = int(row.h)
                out.append((key[0], getattr(row, order), h in recent))
                if h in recent:
                    recent.remove(h)
                recent = [*recent, h][-capacity:]
            yield pd.DataFrame(out, columns=[session, order, "is_hit"])
        state.update((recent,))

    kinds = dict(turns.dtypes)
    rows = turns.select(session, order, F.xxhash64(text).alias("h"))
    return rows.groupBy(session).applyInPandasWithState(update, f"{session} {kinds[session]}, {order} {kinds[order]}, is_hit boolean", "recent array<bigint>", "append", "NoTimeout")
