"""Named timers, estimated work, and statements run side by side."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait


class Timer:
    """with Timer('name'): adds up seconds and calls by name."""

    totals: dict[str, tuple[float, int]] = {}

    def __init__(self, name: str):
        self.name = name

    def __enter__(self) -> Timer:
        self.began = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        seconds, calls = Timer.totals.get(self.name, (0.0, 0))
        Timer.totals[self.name] = (seconds + time.perf_counter() - self.began, calls + 1)


class TimerEpoch(Timer):
    """Timers that start within are counted from zero; what was there before is put back at the end."""

    def __enter__(self) -> TimerEpoch:
        self.before, Timer.totals = Timer.totals, {}
        super().__enter__()
        return self

    def __exit__(self, *_) -> None:
        super().__exit__()
        self.seen, Timer.totals = Timer.totals, self.before


class Profile:
    """Per-tensor profiling: while it is on, materialised tensors are timed under their names."""

    on = False

    @classmethod
    def switch(cls, on: bool) -> None:
        cls.on = on

    @staticmethod
    def run(t):
        """The tensor's rows computed once, in the shared folder; timed under the tensor's name, which Spark's job descriptions show too."""
        from ..sources.checkpoint import checkpointed

        context = t.spark.sparkContext
        context.setJobDescription(t.name or None)
        try:
            if not Profile.on:
                return t._with(checkpointed(t.df))
            with Timer(t.name or "tensor"):
                return t._with(checkpointed(t.df))
        finally:
            context.setJobDescription(None)


class FlopCounter:
    """Estimated multiply-adds of the terms that are evaluated while it counts: two for each row that the planner expects to join."""

    def __init__(self):
        self.flops = 0.0

    def add(self, term) -> None:
        self.flops += 2 * term.estimate()

    def reset(self) -> None:
        self.flops = 0.0


class World:
    """The session that tensors live in: how many tasks run at once, and its end."""

    def __init__(self, spark):
        self.spark = spark

    @property
    def size(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def stop(self) -> None:
        self.spark.stop()


class Schedule:
    """Recorded statements with the names they read and write; independent ones run at the same time as Spark jobs of their own."""

    def __init__(self, at_once: int = 4):
        self.at_once, self.statements = at_once, []

    def set_max_partitions(self, n: int) -> None:
        """At most so many statements run at the same time."""
        if n < 1:
            raise ValueError("at least one statement has to run")
        self.at_once = n

    def record(self, run: Callable[[], object], reads: tuple[str, ...] = (), writes: tuple[str, ...] = ()) -> None:
        self.statements.append((run, set(reads), set(writes)))

    def execute(self) -> list:
        before = [{j for j in range(i) if w & self.statements[j][2] or w & self.statements[j][1] or r & self.statements[j][2]} for i, (_, r, w) in enumerate(self.statements)]
        results: dict[int, object] = {}
        with ThreadPoolExecutor(self.at_once) as pool:
            running: dict = {}
            while len(results) < len(self.statements):
                for i, (run, _, _) in enumerate(self.statements):
                    if i not in results and i not in running.values() and before[i] <= results.keys():
                        running[pool.submit(run)] = i
                done, _ = wait(running, return_when="FIRST_COMPLETED")
                for f in done:
                    results[running.pop(f)] = f.result()
        self.statements = []
        return [results[i] for i in range(len(results))]
