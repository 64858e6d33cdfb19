"""Tuning parameters of the repair chain, their two profiles, and the settings file."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Defaults are the fixed values of the standard profile; pairs are (low, high) of a ramp or band."""

    severe: float = 8.0
    severe_pad: float = 0.2
    severe_merge: float = 0.2
    ramp: float = 0.3
    light_cutoff: float = 25.0
    strong_cutoff: float = 2.5
    noise_low: float = 1.5
    noise_high: float = 5.0
    noise_band: tuple[float, float] = (30.0, 180.0)
    noise_window_ms: float = 100.0
    hampel_window: int = 7
    hampel_sigma: float = 6.0
    optical_cutoff: float = 8.0
    handback_cutoff: float | None = None
    fast_handback: tuple[float, float] = (100.0, 250.0)
    gyro_trust_noise: tuple[float, float] = (200.0, 300.0)
    patch_pad: float = 0.5
    patch_merge: float = 1.0
    optical_noise: tuple[float, float] | None = None
    fast_wide_cutoff: float = 0.0
    fast_wide_ramp: tuple[float, float] = (150.0, 300.0)
    fast_wide_accel: float = 1500.0
    anchor_mode: bool = False
    anchor_cutoff: float = 1.5

    def m4(self) -> Config:
        """The profile of the wider hand-back branch."""
        return replace(self, fast_wide_cutoff=16.0)

    def problems(self) -> list[str]:
        """What makes the parameters unusable, if anything."""
        out = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, tuple) and (len(v) != 2 or not v[0] < v[1]):
                out.append(f"{f.name}: needs low < high")
            if f.name.endswith("cutoff") and v is not None and v < 0:
                out.append(f"{f.name}: negative")
        if self.hampel_window < 1:
            out.append("hampel_window: needs at least 1")
        return out


@dataclass(frozen=True)
class Settings:
    """What a user keeps between runs."""

    profile: str = "m2"
    config: Config = field(default_factory=Config)
    output_dir: str | None = None
    concurrent_files: int = 1

    def workers(self) -> int:
        return min(3, max(1, self.concurrent_files))


def _config_of(raw: object) -> Config:
    known = {f.name: f for f in fields(Config)}
    out = {}
    for k, v in (raw if isinstance(raw, dict) else {}).items():
        if k in known:
            out[k] = tuple(v) if isinstance(v, list) else v
    return Config(**out)


def load_settings(path: str | Path) -> Settings:
    """Missing or unreadable files give the defaults, missing keys their own default."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(raw, dict):
            return Settings()
        plain = {k: raw[k] for k in ("profile", "output_dir", "concurrent_files") if k in raw}
        return Settings(config=_config_of(raw.get("config")), **plain)
    except (OSError, ValueError, TypeError):
        return Settings()


def save_settings(settings: Settings, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(asdict(settings), indent=2), encoding="utf-8")


def output_path(source: str, folder: str | None = None) -> str:
    """Name of the repaired file: the stem with ``_fixed``, the extension as it was."""
    head, name = os.path.split(source)
    stem, dot, ext = name.rpartition(".")
    fixed = f"{stem}_fixed.{ext}" if dot and stem else f"{name}_fixed"
    return os.path.join(folder if folder else head, fixed)
