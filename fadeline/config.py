"""Scoring configuration: modes, half-life, mixing weight and the graph's per-level stiffness."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum


class Mode(Enum):
    MULTIPLICATIVE = "multiplicative"  # dot * decay
    ADDITIVE = "additive"  # alpha * dot + (1 - alpha) * decay
    SEMANTIC = "semantic"  # dot alone (control)


class PairMode(Enum):
    TIMELIFT = "timelift"
    SEMANTIC = "semantic"


class Schedule(Enum):
    FIXED = "fixed"
    TWO_TIER = "two-tier"
    PER_LEVEL = "per-level"


def decay_rate(half_life: float) -> float:
    """Per-day rate at which freshness halves every ``half_life`` days."""
    if not math.isfinite(half_life) or half_life <= 0:
        raise ValueError("the half-life must be finite and positive")
    return math.log(2.0) / half_life


@dataclass(frozen=True)
class Decay:
    """What a score and a graph edge depend on; invalid combinations raise ``ValueError``."""

    dim: int
    half_life: float
    mode: Mode = Mode.MULTIPLICATIVE
    alpha: float = 1.0
    pair_mode: PairMode = PairMode.TIMELIFT
    schedule: Schedule = Schedule.FIXED
    kappa_base: float = 0.0
    kappa_nav: float = 0.0
    kappa_levels: tuple[float, ...] = field(default=())
    rate: float | None = None
    future_slack: float = 1e-9

    def __post_init__(self) -> None:
        expected = decay_rate(self.half_life)
        if self.rate is None:
            object.__setattr__(self, "rate", expected)
        levels, finite = self.kappa_levels, math.isfinite
        checks = [
            (self.dim > 0, "dim must be positive"),
            (abs(self.rate - expected) <= 1e-10 * max(1.0, expected), "rate must be ln(2) / half_life"),
            (finite(self.alpha) and 0 <= self.alpha <= 1, "alpha must lie in [0, 1]"),
            (self.mode is not Mode.MULTIPLICATIVE or abs(self.alpha - 1) <= 1e-12, "multiplicative scores need alpha = 1"),
            (finite(self.kappa_base) and finite(self.kappa_nav) and 0 <= self.kappa_base <= self.kappa_nav, "0 <= kappa_base <= kappa_nav is required"),
            (self.schedule is not Schedule.FIXED or abs(self.kappa_base - self.kappa_nav) <= 1e-12, "a fixed schedule has equal kappas"),
            (finite(self.future_slack) and self.future_slack >= 0, "the slack for future times must be finite and not negative"),
        ]
        if self.schedule is Schedule.PER_LEVEL:
            near = 1e-12 * max(1.0, abs(self.kappa_base), abs(self.kappa_nav))
            checks += [
                (bool(levels), "a per-level schedule needs kappas"),
                (all(finite(k) and k >= 0 for k in levels), "kappas must be finite and not negative"),
                (all(a <= b for a, b in zip(levels, levels[1:], strict=False)), "kappas must not fall with the level"),
                (bool(levels) and abs(levels[0] - self.kappa_base) <= near and abs(levels[-1] - self.kappa_nav) <= near, "the kappas' ends must be kappa_base and kappa_nav"),
            ]
        else:
            checks.append((not levels, "only a per-level schedule lists kappas"))
        for ok, what in checks:
            if not ok:
                raise ValueError(what)

    def kappa(self, level: int) -> float:
        """Stiffness of edges at ``level``; levels beyond the list take its last entry."""
        if level < 0:
            raise ValueError("levels start at 0")
        if self.schedule is Schedule.PER_LEVEL:
            return self.kappa_levels[min(level, len(self.kappa_levels) - 1)]
        return self.kappa_nav if self.schedule is Schedule.TWO_TIER and level > 0 else self.kappa_base


def kappa_for_spread(c: int) -> float:
    """The documented rule 1 / (2^C - 1)."""
    if c < 1:
        raise ValueError("C starts at 1")
    return 1.0 / (2**c - 1)


def file_tag(value: float) -> str:
    """A number as it stands in file names: no sign of its own, no trailing zeros, ``p`` for the point."""
    return format(value, ".12g").replace("-", "m").replace(".", "p").replace("+", "")
