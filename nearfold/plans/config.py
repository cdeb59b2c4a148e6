"""Scan configurations and presets."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class ScanConfig:
    """Which tiers run and how. The threshold is inclusive, in bits of 64; the window inclusive, in seconds."""

    exact_hash: bool = True
    visual_similar: bool = True
    burst_detection: bool = True
    filename_ranking: bool = True
    phash_threshold: int = 6
    burst_window_secs: int = 2
    include_raw: bool = False

    def to_json(self) -> str:
        return json.dumps({_camel(k): v for k, v in asdict(self).items()})

    @classmethod
    def from_json(cls, text: str | None) -> ScanConfig:
        """Camel-case keys; missing keys, null and malformed text take the defaults."""
        try:
            given = json.loads(text or "{}")
        except ValueError:
            given = {}
        known = {_camel(f.name): f.name for f in fields(cls)}
        return cls(**{known[k]: v for k, v in given.items() if k in known and v is not None})


def _camel(name: str) -> str:
    return re.sub("_(.)", lambda m: m[1].upper(), name)


PRESETS = {
    "visual_similar": ScanConfig(),
    "exact_only": ScanConfig(visual_similar=False, burst_detection=False, filename_ranking=False),
    "burst_time_window": ScanConfig(burst_window_secs=3),
}


def resolve_config(preset: str | None = None, override: ScanConfig | None = None) -> ScanConfig:
    """The configuration of a preset, of which an override changes include_raw only; for "custom" the override itself."""
    if preset == "custom":
        return override or ScanConfig()
    base = PRESETS[preset or "visual_similar"]
    return replace(base, include_raw=override.include_raw) if override else base
