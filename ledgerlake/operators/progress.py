"""What the steps of a plan have passed on, as metrics of the run itself.

A step is observed where it stands in the plan, so nothing runs twice; its rows are known once an action has run.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Progress:
    """Named steps in the order of their making; `notify`, if given, is called with each event of `run`."""

    def __init__(self, notify: Callable[[dict], None] | None = None) -> None:
        self.steps: dict[str, Observation] = {}
        self.events: list[dict] = []
        self.notify = notify

    def step(self, df: DataFrame, name: str) -> DataFrame:
        """`df`, its rows counted as they pass."""
        self.steps[name] = Observation(name)
        return df.observe(self.steps[name], F.count(F.lit(1)).alias("rows"))

    def run(self, name: str, action: Callable[[], object]) -> object:
        """The action's result; its event has `step` and `elapsed_ms`."""
        began = time.monotonic()
        result = action()
        self.events.append({"step": name, "elapsed_ms": round(1000 * (time.monotonic() - began))})
        if self.notify:
            self.notify(self.events[-1])
        return result

    def rows(self) -> dict[str, int]:
        """Rows of each step, after an action over all of them."""
        return {name: seen.get["rows"] for name, seen in self.steps.items()}

    def total_ms(self) -> int:
        return sum(e.get("elapsed_ms") or 0 for e in self.events)
