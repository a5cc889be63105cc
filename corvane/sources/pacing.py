"""Pacing of requests by service, not by task: every call has a slot of its own on one common clock (STM-8)."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession

#: Tasks that share a service at most; they only wait for each other, so more wouldn't be faster.
LANES = 4


@dataclass(frozen=True)
class Plan:
    """Slots of `pace` seconds from `start` on; of n lanes, lane k may call in slots k, k + n, k + 2n...

    No two lanes share a slot, so the service sees at most one call a slot however many tasks there are; a task that is
    late, or runs again, takes the next slot of its lane.  Executors' clocks have to agree within a small part of the pace.
    """

    pace: float
    start: float

    @classmethod
    def now(cls, pace: float) -> Plan:
        return cls(pace, time.time())

    def lanes(self, spark: SparkSession) -> int:
        return LANES if self.pace else spark.sparkContext.defaultParallelism

    def turns(self, lane: int | None = None, lanes: int = LANES) -> Iterator[int]:
        """Waits for the lane's next slot at each step, and gives its number; without a pace nothing waits."""
        if lane is None:
            context = TaskContext.get()
            lane = context.partitionId() % lanes if context is not None else 0
        last = -1
        while True:
            if not self.pace:
                yield (last := last + 1)
                continue
            passed = (time.time() - self.start) / self.pace
            slot = max(last + 1, int(passed) + (passed > int(passed)))
            slot += (lane - slot) % lanes
            while (wait := self.start + slot * self.pace - time.time()) > 0:
                time.sleep(wait)
            last = slot
            yield slot
