"""Settings of a run, with their ranges; an unknown or impossible setting is an error."""

from __future__ import annotations

from dataclasses import dataclass, fields

RANGES = {"temperature": (1e-9, None), "stride": (1, None), "components": (1, None), "smooth_sigma": (0.0, None), "min_state_population": (0.0, 1.0), "max_states": (1, None), "bootstrap": (0, None), "lag": (1, None), "msm_lag": (1, None), "clusters": (2, None), "contact_cutoff": (1e-9, None)}
CHOICES = {"method": ("pca", "tica", "columns"), "weighting": ("equal-replicate", "frame"), "equilibration": ("off", "report", "auto")}


@dataclass
class Analysis:
    """Defaults are those of the analyses this engine reproduces."""

    vector: str = "coords"
    system: str = "system"
    replicate: str = "replicate"
    order: tuple[str, ...] = ("frame",)
    time: str = "time_ps"
    x: str = "PC1"
    y: str = "PC2"
    weight: str | None = None
    method: str = "pca"
    weighting: str = "equal-replicate"
    components: int = 10
    lag: int = 10
    temperature: float = 300.0
    bins: int | None = None
    smooth_sigma: float = 0.0
    min_state_population: float = 0.05
    max_states: int = 10
    min_barrier: float | None = None
    stride: int = 1
    begin: float | None = None
    end: float | None = None
    equilibration: str = "report"
    bootstrap: int = 200
    seed: int = 0
    msm_lag: int = 10
    clusters: int = 100
    metastable: int = 3
    msm_lags: tuple[int, ...] = (1, 2, 5, 10, 20)
    contact_cutoff: float = 4.5

    def __post_init__(self) -> None:
        for name, (low, high) in RANGES.items():
            value = getattr(self, name)
            if value is not None and (value < low or high is not None and value > high):
                raise ValueError(f"{name} = {value} is outside {low} to {high if high is not None else 'any'}")
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        self.order, self.msm_lags = tuple(self.order), tuple(self.msm_lags)


def merged(*sources: dict | None) -> Analysis:
    """Settings from several sources; earlier ones win, so give command line, file and stored settings in this order."""
    out: dict = {}
    known = {f.name for f in fields(Analysis)}
    for s in sources:
        for k, v in (s or {}).items():
            if k not in known:
                raise ValueError(f"unknown setting {k!r}")
            if v is not None:
                out.setdefault(k, v)
    return Analysis(**out)


def from_file(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}
