"""Read and validate the configuration file that may override the built-in assumptions."""

from __future__ import annotations

import json
from pathlib import Path

CONFIG_PATH = Path(__file__).resolve().parents[1] / "config" / "assumptions.json"


class ConfigError(ValueError):
    """The configuration breaks a rule."""


def validate(cfg: dict) -> dict:
    policy, psi, binning = cfg["policy"], cfg["monitoring"], cfg["binning"]
    if not 0 < policy["approve_below"] <= policy["decline_above"] < 1:
        raise ConfigError("the lines must satisfy 0 < approve_below <= decline_above < 1")
    if policy["min_words"] >= policy["max_words"]:
        raise ConfigError("min_words must be below max_words")
    if not 0 < psi["psi_warn"] <= psi["psi_alert"]:
        raise ConfigError("psi_warn must not exceed psi_alert")
    if cfg["money"]["margin"] <= 0 or cfg["money"]["loss"] <= 0:
        raise ConfigError("margin and loss must be positive")
    if binning["max_bins_per_numeric"] < 2 or not 0 < binning["min_bin_share"] < 1:
        raise ConfigError("binning needs at least two bands and a share between 0 and 1")
    return cfg


def load_config(path: Path | str = CONFIG_PATH) -> dict:
    return validate(json.loads(Path(path).read_text(encoding="utf-8")))
