"""Thresholds of the flags: defaults and a checked TOML file."""

from __future__ import annotations

import tomllib
from pathlib import Path

#: Fixed values that flags must agree with.
DEFAULTS = {"frac_bad_dt": 0.05, "stuck_state_frac": 0.20, "identity_frac": 0.50, "lag_large": 3, "dup_episode_frac": 0.0, "min_lag_correlation": 0.5}
NON_NEGATIVE = ("lag_large",)


def load(path: str | Path | None = None) -> dict[str, float]:
    """All keys must be there; all but lag_large are shares between 0 and 1."""
    if path is None:
        return dict(DEFAULTS)
    found = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("thresholds", {})
    missing = sorted(set(DEFAULTS) - set(found))
    if missing:
        raise ValueError(f"thresholds without {', '.join(missing)}")
    for k in DEFAULTS:
        v = found[k]
        if not isinstance(v, (int, float)) or isinstance(v, bool) or v < 0 or (k not in NON_NEGATIVE and v > 1):
            raise ValueError(f"{k} = {v!r} is out of range")
    return {k: found[k] for k in DEFAULTS}
