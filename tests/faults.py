"""A plan of delays and failures at the steps of a dump: before and after each of nine steps, eighteen places."""

import time
from dataclasses import dataclass, field

from tidemark.operators.live import STEPS

PLACES = [f"{when}-{step}" for step in STEPS for when in ("before", "after")]


class PlannedFault(Exception):
    pass


@dataclass
class FaultPlan:
    """fail: place -> how often it fails from now on; delay: place -> seconds."""

    fail: dict[str, int] = field(default_factory=dict)
    delay: dict[str, float] = field(default_factory=dict)
    seen: list[str] = field(default_factory=list)

    def __post_init__(self):
        if unknown := [p for p in [*self.fail, *self.delay] if p not in PLACES]:
            raise ValueError(f"no such place: {unknown}")

    def __call__(self, place: str) -> None:
        self.seen.append(place)
        time.sleep(self.delay.get(place, 0))
        if self.fail.get(place, 0) > 0:
            self.fail[place] -= 1
            raise PlannedFault(place)
