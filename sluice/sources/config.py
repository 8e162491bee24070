"""Study parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from sluice.operators.bands import Window


@dataclass(frozen=True)
class Config:
    """Windows by purpose, thresholds, and the addresses of sources."""

    phases: list[Window] = field(default_factory=list)
    event_windows: list[Window] = field(default_factory=list)
    visibility_announced_min: float = 0.5
    probing_dark_ratio: float = 0.2
    probing_nonzero_min: float = 0.5
    probing_median_min: float = 5.0
    full_feed: dict[int, int] = field(default_factory=lambda: {4: 400_000, 6: 50_000})
    peers_total_min: int = 15
    sources: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> Config:
        """From parsed YAML or JSON; windows are {name: [start, end]}. Unknown keys are an error."""
        windows = {k: [Window(n, int(a), int(b)) for n, (a, b) in d[k].items()] for k in ("phases", "event_windows") if k in d}
        return cls(**{**d, **windows})

    def window(self, name: str) -> Window:
        for w in (*self.event_windows, *self.phases):
            if w.name == name:
                return w
        raise KeyError(f"unknown window {name!r}; known: {[w.name for w in (*self.event_windows, *self.phases)]}")
