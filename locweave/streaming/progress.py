"""Progress of runs as a fold over frames: weighted percent, rate and time left, and gates of what to log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

# The steps of a run with their share of the whole, and the smoothing of the rate.
STEPS = (("upload", 35), ("classify", 25), ("clean", 30), ("package", 10))
SMOOTHING = 0.3
# The step that each stage of a run's log belongs to.
STAGE_STEP = {
    "upload": "upload", "unzip": "upload", "start": "classify", "parse": "classify", "select": "classify", "dedup": "clean",
    "output": "clean", "index": "package", "report": "package", "cleanup": "package", "zip": "package",
}
LEAST_SECONDS, LEAST_ITEMS, NO_ETA_FROM = 5.0, 10, 97.0
LOG_STEP, LOG_SECONDS = 5.0, 2.0


def percent(stage: Column, current: Column, total: Column) -> Column:
    """The percent of the whole that a frame stands for."""
    out, before = F.lit(0.0), 0
    for name, share in STEPS:
        part = F.when(total > 0, F.least(current, total) / total).otherwise(0.0)
        out = F.when(stage == name, before + share * part).otherwise(out)
        before += share
    return out


def step_of(stage: Column) -> Column:
    """The step of a logged stage, null for one that is not known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_STEP.items() for x in kv]), stage)


def with_steps(frames: DataFrame) -> DataFrame:
    """The frames (run, seq, stage ...) with step; under a stage that is not known a run stays at the step it was at, upload at first."""
    so_far = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("step", F.coalesce(F.last(step_of(F.col("stage")), ignorenulls=True).over(so_far), F.lit("upload")))


def _in_order(rows: DataFrame, names: list[str], work: Callable[[dict, dict | None, dict | None], Iterator[dict]], out: str) -> DataFrame:
    """Frames go to a task by run and pass through it in the order of seq; work sees a run's state, a frame, and the next one if there is any.

    A run's frames are streamed, never gathered: what is held is one state and one frame.
    """
    columns = [c.split()[0] for c in out.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        held: dict | None = None
        for batch in frames:
            made: list[dict] = []
            for row in batch.to_dict("records"):
                if held is not None:
                    same = held["run"] == row["run"]
                    made += [{"run": held["run"], **x} for x in work(state, held, row if same else None)]
                    state = state if same else {}
                held = row
            yield pd.DataFrame(made, columns=columns)
        if held is not None:
            yield pd.DataFrame([{"run": held["run"], **x} for x in work(state, held, None)], columns=columns)

    return rows.select(*names).repartition("run").sortWithinPartitions("run", "seq").mapInPandas(run, out)


def _timed(frames: DataFrame) -> DataFrame:
    return frames.select("run", "seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "stage", F.col("current").cast("double").alias("current"), F.col("total").cast("double").alias("total"), percent(F.col("stage"), F.col("current"), F.col("total")).alias("pct"))


def fold(frames: DataFrame) -> DataFrame:
    """run, seq, percent (never falling), rate (items a second, smoothed) and eta_seconds for each frame in the order of seq.

    The batch form: one pass over the ordered frames of a run. frames has run, seq, ts, stage, current
    and total. A time left is given once five seconds and ten items have passed and below 97 percent.
    """
    ship(frames.sparkSession)
    names = ["run", "seq", "ms", "stage", "current", "total", "pct"]
    return _in_order(_timed(frames), names, lambda state, frame, _: iter([step(state, frame)]), "run string, seq long, percent double, rate double, eta_seconds double")


def step(state: dict, frame: dict) -> dict:
    """One frame on top of a state, which is changed in place."""
    if state.get("stage") != frame["stage"]:
        state.update(stage=frame["stage"], began=frame["ms"], first=frame["current"], ms=frame["ms"], current=frame["current"], rate=None)
    gone = (frame["ms"] - state["ms"]) / 1000
    if gone > 0:
        rate = max(0.0, frame["current"] - state["current"]) / gone
        state["rate"] = rate if state["rate"] is None else SMOOTHING * rate + (1 - SMOOTHING) * state["rate"]
        state.update(ms=frame["ms"], current=frame["current"])
    state["percent"] = max(state.get("percent", 0.0), frame["pct"])
    known = (frame["ms"] - state["began"]) / 1000 >= LEAST_SECONDS and frame["current"] - state["first"] >= LEAST_ITEMS and state["percent"] < NO_ETA_FROM
    eta = (frame["total"] - frame["current"]) / state["rate"] if known and state["rate"] else None
    return {"seq": int(frame["seq"]), "percent": state["percent"], "rate": state["rate"], "eta_seconds": eta}


def live_progress(frames: DataFrame) -> DataFrame:
    """The same fold on a stream: run, seq, percent, rate, eta_seconds, with the state of each run kept until it is complete."""
    ship(frames.sparkSession)
    state = "stage string, began long, first double, ms long, current double, rate double, percent double"
    names = [c.split()[0] for c in state.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, held.get, strict=True)) if held.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [{"run": key[0], **step(now, r)} for r in rows.to_dict("records")]
        if now["percent"] < 100:
            held.update(tuple(now.get(n) for n in names))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=["run", "seq", "percent", "rate", "eta_seconds"])

    return _timed(frames).groupBy("run").applyInPandasWithState(update, "run string, seq long, percent double, rate double, eta_seconds double", state, "append", GroupStateTimeout.NoTimeout)


def log_gate(frames: DataFrame) -> DataFrame:
    """The frames (run, seq, ms, pct) to log: the first and last, and those 5 percent and 2 seconds past the last one logged."""
    ship(frames.sparkSession)

    def gate(state: dict, frame: dict, after: dict | None) -> Iterator[dict]:
        due = not state or after is None or (frame["pct"] - state["pct"] >= LOG_STEP and frame["ms"] - state["ms"] >= LOG_SECONDS * 1000)
        if due:
            state.update(ms=frame["ms"], pct=frame["pct"])
            yield {"seq": frame["seq"]}

    return _in_order(frames, ["run", "seq", "ms", "pct"], gate, "run string, seq long")


def liveness(runs: DataFrame, now: Column, grace: str = "5 minutes", pending: str = "120 seconds") -> DataFrame:
    """The runs with state: cleaning ones live, uploads expire after their time, others are abandoned without a heartbeat.

    runs has phase, subscribers and last_seen.
    """
    silent = lambda wait: F.col("last_seen") < now - F.expr(f"INTERVAL {wait}")
    state = (
        F.when(F.col("phase") == "finished", "finished")
        .when(F.col("phase") == "cleaning", "live")
        .when((F.col("phase") == "pending") & silent(pending), "expired")
        .when((F.col("subscribers") == 0) & silent(grace), "abandoned")
        .otherwise("live")
    )
    return runs.withColumn("state", state)
