"""Settings: defaults, then a YAML file, then overrides, then the environment. Maps merge, lists are replaced."""

from __future__ import annotations

import copy
import os
from collections.abc import Mapping
from typing import Any

#: The defaults that results depend on.
DEFAULTS: dict[str, Any] = {
    "geometry": {"depth_scale": 1000.0, "depth_min": 0.10, "depth_max": 8.00, "voxel_size": 0.05, "ghost_percentile": 99.0},
    "mapping": {"fusion": "mean", "min_observations": 1, "conf_threshold": 0.0, "assoc_radius": 0.60, "assoc_iou": 0.10, "one_to_one": True, "eps": 0.08, "min_samples": 3, "min_voxels": 5, "bbox_percentile": 2.0},
    "query": {"top_k": 5, "lexical": 0.5, "embedding": None, "weights": {"lexical": 0.4, "embedding": 0.6}},
}
PREFIX = "LATTICA_"


def parse_scalar(text: str) -> Any:
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


class Config:
    def __init__(self, values: Mapping[str, Any] | None = None):
        self.values = merged(DEFAULTS, values or {})

    @classmethod
    def load(cls, path: str | None = None, overrides: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> Config:
        values: dict[str, Any] = {}
        if path:
            import yaml

            with open(path) as f:
                values = yaml.safe_load(f) or {}
        values = merged(values, overrides or {})
        for name, text in (os.environ if env is None else env).items():
            if name.startswith(PREFIX):
                node: dict[str, Any] = {}
                at = node
                *parts, last = name[len(PREFIX) :].lower().split("__")
                for part in parts:
                    at = at.setdefault(part, {})
                at[last] = parse_scalar(text)
                values = merged(values, node)
        return cls(values)

    def get(self, dotted: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in dotted.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, dotted: str, value: Any) -> None:
        at = self.values
        *parts, last = dotted.split(".")
        for part in parts:
            at = at.setdefault(part, {})
        at[last] = value
