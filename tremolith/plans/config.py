"""Configuration: defaults, then environment, file and call, later ones winning."""

from __future__ import annotations

import copy
import os

from ..errors import InvalidConfig
from ..functions.metrics import HIGHER
from ..functions.scoring import METHODS, NORMALISERS

DEFAULTS = {
    "input": {"path": None, "sample_rate": None, "channel": None},
    "simulation": {"sample_rate": 12000.0, "duration": 1.0, "fault_freq": 78.5, "noise_level": 0.3, "seed": 42},
    "preprocess": {"remove_dc": True, "target_rate": None, "segment_seconds": None, "overlap": 0.0, "normalise": False},
    "operators": {"mode": "all", "ids": [], "categories": [], "params": {}},
    "envelope": {"band": None, "n_fft": None, "shaft_rpm": None, "bearing": None, "manual": {}, "tolerance": 0.02},
    "metrics": {"enabled": sorted(HIGHER), "flattened": False},
    "scoring": {"method": "weighted_sum", "normaliser": "minmax", "weights": {}},
    "output": {"top_n": 3, "folder": None},
}
PREFIX = "TREMOLITH_"


def merge(base: dict, more: dict) -> dict:
    """Recursive; values of ``more`` win."""
    out = copy.deepcopy(base)
    for k, v in more.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) and k not in ("params", "manual", "weights") else copy.deepcopy(v)
    return out


def from_environment(environ=None) -> dict:
    """TREMOLITH_SCORING__METHOD=topsis sets scoring.method."""
    import json

    out: dict = {}
    for k, v in (environ if environ is not None else os.environ).items():
        if k.startswith(PREFIX) and "__" in k:
            section, name = k[len(PREFIX) :].lower().split("__", 1)
            try:
                v = json.loads(v)
            except ValueError:
                pass
            out.setdefault(section, {})[name] = v
    return out


def load(path: str | None = None, overrides: dict | None = None, environ=None) -> dict:
    config = merge(DEFAULTS, from_environment(environ))
    if path:
        import yaml

        with open(path) as f:
            config = merge(config, yaml.safe_load(f) or {})
    return validate(merge(config, overrides or {}))


def validate(config: dict) -> dict:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise InvalidConfig(what)

    need(config["scoring"]["method"] in METHODS, f"scoring.method is one of {METHODS}")
    need(config["scoring"]["normaliser"] in NORMALISERS, f"scoring.normaliser is one of {NORMALISERS}")
    need(config["operators"]["mode"] in ("all", "selected", "category"), "operators.mode is all, selected or category")
    need(config["operators"]["mode"] != "selected" or bool(config["operators"]["ids"]), "operators.ids is empty")
    need(config["operators"]["mode"] != "category" or bool(config["operators"]["categories"]), "operators.categories is empty")
    need(0 <= config["preprocess"]["overlap"] < 1, "preprocess.overlap lies in [0, 1)")
    need(all(w >= 0 for w in config["scoring"]["weights"].values()), "weights are not negative")
    need(set(config["metrics"]["enabled"]) <= set(HIGHER), "metrics.enabled has an unknown metric")
    need(config["output"]["top_n"] >= 1, "output.top_n is at least 1")
    return config
