"""Uploads as a stream: attempts that withdraw earlier ones, and a barrier that opens when all batches of a run are in."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import windows

CHANGES = "run_id string, batch long, attempt long, item string, change long"
#: Batches of a run whose attempts are one state.
TOGETHER = 64
#: Logarithm of the batches of a block that a barrier keeps as bits.
BLOCK_BITS = 15
READY = "run_id string, total_batches long"


class Attempts(StatefulProcessor):
    """Of some batches of a run: the latest attempt of each and the items it has brought so far.

    Items are kept in chunks as they came, so that a micro-batch adds to what is there; chunks are read again only when
    an attempt is withdrawn.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getValueState("attempts", "batches array<long>, attempts array<long>")
        self.items = handle.getListState("items", "batches array<long>, items array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = dict(zip(*(self.attempts.get() or ((), ())), strict=True))
        changed = False
        for frame in rows:
            came = list(zip(*(frame[c].tolist() for c in ("batch", "attempt", "item")), strict=True))
            newest = dict(held)
            for batch, attempt, _ in came:
                if attempt > newest.get(batch, attempt - 1):
                    newest[batch] = attempt
            risen = {batch for batch, attempt in held.items() if newest[batch] > attempt}
            if risen:
                yield from self._withdrawn(key, held, risen)
            changed, held = changed or newest != held, newest
            mine = [(batch, item) for batch, attempt, item in came if attempt == held[batch]]
            if mine:
                self.items.appendValue(tuple(map(list, zip(*mine, strict=True))))
                yield self._told(key, held, mine, 1)
        if changed:
            self.attempts.update((list(held), list(held.values())))

    def _withdrawn(self, key: tuple, held: dict[int, int], risen: set[int]) -> Iterator[pd.DataFrame]:
        left = []
        for chunk in self.items.get():
            pairs = list(zip(*chunk, strict=True))
            if gone := [p for p in pairs if p[0] in risen]:
                yield self._told(key, held, gone, -1)
            if stays := [p for p in pairs if p[0] not in risen]:
                left.append(tuple(map(list, zip(*stays, strict=True))))
        self.items.clear()
        for chunk in left:
            self.items.appendValue(chunk)

    def _told(self, key: tuple, held: dict[int, int], pairs: list[tuple[int, str]], change: int) -> pd.DataFrame:
        # Strings as plain objects: frames of them can be put together into one array.
        n = len(pairs)
        columns = {"run_id": [key[0]] * n, "batch": [b for b, _ in pairs], "attempt": [held[b] for b, _ in pairs], "item": [i for _, i in pairs], "change": [change] * n}
        return pd.DataFrame({c: pd.Series(v, dtype=object if c in ("run_id", "item") else "int64") for c, v in columns.items()})

    def close(self) -> None:
        pass


class Barrier(StatefulProcessor):
    """Of one run: which batches have come, and whether it was told that all have.

    Batches are bits of blocks, so a micro-batch reads and writes a state a block that it touches, not one a batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("blocks", "block long", "bits binary")
        self.count = handle.getValueState("count", "n long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, told = self.count.get() or (0, False)
        total, blocks = 0, {}
        for frame in rows:
            announced = frame["total_batches"].dropna()
            total = max(total, int(announced.max())) if len(announced) else total
            batches = np.unique(frame["batch"].to_numpy())
            numbers, starts = np.unique(batches >> BLOCK_BITS, return_index=True)
            for number, part in zip(numbers.tolist(), np.split(batches, starts[1:]), strict=True):
                if number not in blocks:
                    blocks[number] = self._bits(number)
                blocks[number][0][part & ((1 << BLOCK_BITS) - 1)] = True
        for number, (bits, before) in blocks.items():
            if (now := int(bits.sum())) > before:
                self.seen.updateValue((number,), (np.packbits(bits).tobytes(),))
                n += now - before
        if not told and total and n >= total:
            told = True
            yield pd.DataFrame({"run_id": [key[0]], "total_batches": [total]})
        self.count.update((n, told))

    def _bits(self, number: int) -> tuple[np.ndarray, int]:
        held = self.seen.getValue((number,)) if self.seen.containsKey((number,)) else None
        bits = np.unpackbits(np.frombuffer(held[0], np.uint8)).astype(bool) if held else np.zeros(1 << BLOCK_BITS, bool)
        return bits, int(bits.sum())

    def close(self) -> None:
        pass


def with_store(spark: SparkSession) -> None:
    """State of several kinds needs the store on disk, which is also the one for states beyond memory."""
    # The process that asks a processor for its states is started without the session's files: it is given the classes whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    windows.disk_store(spark)


def changes(rows: DataFrame, together: int = TOGETHER) -> DataFrame:
    """run_id, batch, attempt, item, change (1: brought, -1: withdrawn) from a stream of run_id, batch, attempt, item.

    An attempt above the held one withdraws all that was brought and takes its place; rows of lower ones are passed over,
    however late. So many batches of a run that follow one another are one state, so that a state is worth its call to
    Python, and a run with a third of all rows is still many tasks; set together to 1 where a batch alone is large. It is
    fixed once a checkpoint exists. Null runs and batches are no uploads.
    """
    with_store(rows.sparkSession)
    typed = rows.select(F.col("run_id").cast("string").alias("run_id"), F.col("batch").cast("long").alias("batch"), F.col("attempt").cast("long").alias("attempt"), F.col("item").cast("string").alias("item"))
    blocks = typed.where("run_id IS NOT NULL AND batch IS NOT NULL AND attempt IS NOT NULL").withColumn("block", F.expr(f"batch div {together}"))
    return blocks.groupBy("run_id", "block").transformWithStateInPandas(Attempts(), CHANGES, "Append", "None")


def ready(rows: DataFrame) -> DataFrame:
    """run_id, total_batches, once a run, when as many different batches have come as were announced, from a stream of run_id, batch, total_batches.

    Only batches' headers go to a run's task, frame by frame; what it holds is a bit a batch.
    """
    with_store(rows.sparkSession)
    typed = rows.select(F.col("run_id").cast("string").alias("run_id"), F.col("batch").cast("long").alias("batch"), F.col("total_batches").cast("long").alias("total_batches"))
    return typed.where("run_id IS NOT NULL AND batch IS NOT NULL").groupBy("run_id").transformWithStateInPandas(Barrier(), READY, "Append", "None")


def finished(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream to its end into a table; from the same checkpoint it goes on where it stopped."""
    return windows.run_to_table(rows, path, checkpoint)


def standing(changed: DataFrame) -> DataFrame:
    """run_id, batch, attempt, item of what was brought and not withdrawn, from a table of changes."""
    keys = ["run_id", "batch", "attempt", "item"]
    left = changed.groupBy(*keys).agg(F.sum("change").alias("n")).where("n > 0")
    return left.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).drop("copy")


def drained(changed: DataFrame, complete: DataFrame) -> DataFrame:
    """What stands of complete runs only: cleaning starts from these."""
    return standing(changed).join(complete.select(F.col("run_id").alias("of")).distinct(), F.col("run_id") == F.col("of"), "left_semi")
