"""A shuffle buffer of bounded size, over partitions and over streams.

A buffer of ``n`` rows fills first; from then on each row that comes takes the place of a drawn one, which leaves. So a row
comes at most ``n`` places sooner than it would have, and no more than ``n`` rows a partition are ever held. Draws are a keyed
hash of the seed, the partition and the number of rows seen: a task that runs again, or a stream that begins again from its
checkpoint, draws the same.

At the end of a partition what is left leaves in drawn order. A stream has no end: ``buffered`` rows stay in the state
until others come, and ``left_over`` reads them from a checkpoint, so that every row is there once.

Defined results: rows that repeat are rows of their own; a null key is a key; ``n`` of 0 changes nothing; an empty table or stream
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def draw(seed: int, part: int, seen: int, size: int) -> int:
    h = hashlib.blake2b(f"{seed}|{part}|{seen}".encode(), digest_size=8).digest()
    return int.from_bytes(h, "little") % size


def passed(buffer: list, rows: Iterable, n: int, seed: int, part: int, seen: int) -> Iterator:
    """The rows that leave a buffer as ``rows`` come; the buffer is changed in place."""
    for row in rows:
        if n <= 0:
            yield row
        elif len(buffer) < n:
            buffer.append(row)
        else:
            at = draw(seed, part, seen, n)
            yield buffer[at]
            buffer[at] = row
        seen += 1


def drained(buffer: list, seed: int, part: int, seen: int) -> Iterator:
    """What is left, in drawn order."""
    while buffer:
        at = draw(seed, part, seen, len(buffer))
        buffer[at], buffer[-1] = buffer[-1], buffer[at]
        yield buffer.pop()
        seen += 1


def shuffle_buffer(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The rows of each partition in the order of a shuffle buffer of ``n`` rows; nothing moves between partitions."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, buffer, seen, columns = TaskContext.get().partitionId(), [], 0, None
        for b in batches:
            columns = b.columns
            out = list(passed(buffer, b.itertuples(index=False, name=None), n, seed, part, seen))
            seen += len(b)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if buffer:
            yield pd.DataFrame(list(drained(buffer, seed, part, seen)), columns=columns)

    # rows pass as texts, so that no type is changed on the way
    text = rows.select(F.to_json(F.struct("*"), JSON).alias("row")).mapInPandas(run, "row string")
    return text.select(F.from_json("row", rows.schema, JSON).alias("row")).select("row.*")


def buffered(stream: DataFrame, n: int, key: Column, *, parts: int = 16, seed: int = 42) -> DataFrame:
    """A stream's rows as they leave buffers of ``n`` rows, one for each of ``parts`` shares of the keys."""
    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (part,) = name
        seen, held = state.get if state.exists else (0, "")
        buffer = held.split("\n") if held else []
        for b in batches:
            out = list(passed(buffer, b["row"], n, seed, part, seen))
            seen += len(b)
            if out:
                yield pd.DataFrame({"row": out})
        state.update((seen, "\n".join(buffer)))

    text = stream.select(F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int").alias("part"), F.to_json(F.struct(*[F.col(c) for c in stream.columns]), JSON).alias("row"))
    out = text.groupBy("part").applyInPandasWithState(step, "row string", "seen long, held string", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.from_json("row", stream.schema, JSON).alias("row")).select("row.*")


def left_over(spark: SparkSession, checkpoint: str, schema) -> DataFrame:
    """The rows that are still in the buffers of a stream that has stopped, from its checkpoint."""
    held = spark.read.format("statestore").load(checkpoint).select(F.explode(F.split("value.groupState.held", "\n")).alias("row")).where("row <> ''")
    return held.select(F.from_json("row", schema, JSON).alias("row")).select("row.*")
