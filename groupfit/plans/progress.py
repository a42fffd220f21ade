"""What a long job has done so far, on the standard error: nothing in the first minute, then a line a minute."""

from __future__ import annotations

import sys
import threading
import time

from pyspark.sql import SparkSession

#: Seconds before the first line, and between lines.
AFTER, EVERY = 60, 60


def due(elapsed: float, since_last: float) -> bool:
    return elapsed >= AFTER and since_last >= EVERY


def duration(seconds: float) -> str:
    """'1h 4m 12s', without leading parts that are zero."""
    h, rest = divmod(int(seconds), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h {m}m {s}s" if h else f"{m}m {s}s" if m else f"{s}s"


class Progress:
    """`with Progress(spark, "fitting"):` around whatever runs jobs. Tasks are what the scheduler counts as the work goes on."""

    def __init__(self, spark: SparkSession, what: str, out=None, tick: float = 1.0):
        self.tracker, self.what, self.out, self.tick = spark.sparkContext.statusTracker(), what, out or sys.stderr, tick
        self.seen: dict[int, tuple[int, int]] = {}
        self.stop = threading.Event()

    def look(self) -> tuple[int, int]:
        """(tasks done, tasks known) of the stages seen running so far."""
        for stage in self.tracker.getActiveStageIds():
            info = self.tracker.getStageInfo(stage)
            if info:
                self.seen[stage] = info.numCompletedTasks, info.numTasks
        return sum(a for a, _ in self.seen.values()), sum(b for _, b in self.seen.values())

    def line(self, elapsed: float) -> str:
        done, known = self.look()
        return f"{self.what}: {done} of {known} tasks in {duration(elapsed)}, {done / max(elapsed, 1):.2f} tasks/s"

    def _run(self) -> None:
        began = last = time.monotonic()
        while not self.stop.wait(self.tick):
            now = time.monotonic()
            self.look()
            if due(now - began, now - last):
                last = now
                print(self.line(now - began), file=self.out, flush=True)

    def __enter__(self) -> Progress:
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop.set()
        self.thread.join()
