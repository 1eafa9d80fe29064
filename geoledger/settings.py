"""Checked settings. True and False are no numbers, and numbers must be finite."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Collection

MODES = ("borehole", "row")
POLICIES = ("error", "archive", "resume")


def finite(name: str, value: object, least: float | None = 0.0, optional: bool = False) -> float | None:
    """value as a float; raises if it is no finite number or lies under the least."""
    if value is None and optional:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or (least is not None and value < least):
        raise ValueError(f"{name} must be a finite number{'' if least is None else f' of at least {least:g}'}{' or missing' if optional else ''}")
    return float(value)


def one_of(name: str, value: object, allowed: Collection[str]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return str(value)


@dataclasses.dataclass(frozen=True)
class Training:
    """Depths that may teach (inclusive, open where missing), and whether capped blow counts do."""

    least_depth: float | None = None
    most_depth: float | None = None
    include_capped: bool = True

    def __post_init__(self) -> None:
        low, high = finite("least_depth", self.least_depth, optional=True), finite("most_depth", self.most_depth, optional=True)
        if low is not None and high is not None and low > high:
            raise ValueError("least_depth must not exceed most_depth")
        if not isinstance(self.include_capped, bool):
            raise ValueError("include_capped must be true or false")


@dataclasses.dataclass(frozen=True)
class Validation:
    """How rows are held out: whole boreholes or single rows, and the shares."""

    mode: str = "borehole"
    test_size: float = 0.2
    validation_size: float = 0.2
    seed: int = 42

    def __post_init__(self) -> None:
        one_of("mode", self.mode, MODES)
        for name in ("test_size", "validation_size"):
            if not 0 < finite(name, getattr(self, name)) < 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if isinstance(self.seed, bool) or not isinstance(self.seed, int):
            raise ValueError("seed must be a whole number")


@dataclasses.dataclass(frozen=True)
class Scoring:
    """The depth that a grid is predicted at, how far observations may be from it, limits of what is predicted, and what to do with old chunks."""

    depth: float
    tolerance: float
    least: float | None = None
    most: float | None = None
    existing: str = "resume"

    def __post_init__(self) -> None:
        finite("depth", self.depth), finite("tolerance", self.tolerance)
        low, high = finite("least", self.least, None, True), finite("most", self.most, None, True)
        if low is not None and high is not None and low > high:
            raise ValueError("least must not exceed most")
        one_of("existing", self.existing, POLICIES)
