"""Settings as one declared table: each has a default and, where it is bounded, a range; relations between settings are declared beside
it. A configuration is any assignment of the table that meets both, and its hash depends on the values alone."""

from __future__ import annotations

import hashlib
import json
import operator
import platform
from collections.abc import Iterator, Mapping
from types import SimpleNamespace
from typing import Any

# The settings by group, each with its default, or with its default and its least and greatest value
DECLARED: dict[str, dict[str, Any]] = {
    "run": {"seed": (0, 0, 2**31 - 1)},
    "paths": {"ground_truth": "data/ground_truth.json", "clips": "data/clips.json", "outputs": "outputs", "responses": "data/vlm_cache"},
    "tracker": {"det_floor": (0.10, 0.0, 1.0), "gmc": "orb"},
    "vlm": {"model_id": "", "revision": "", "max_new_tokens": (512, 1, 1 << 16), "max_pixels_per_frame": (401_408, 1, 1 << 30), "temperature": (0.0, 0.0, 0.0), "batch_size": (1, 1, 1)},
    "openvocab": {"model_id": "", "revision": "", "box_threshold": (0.27, 0.0, 1.0), "text_threshold": (0.25, 0.0, 1.0)},
    "tunable": {
        "det_conf": (0.65, 0.15, 0.80), "tau_near": (0.10, 0.05, 0.40), "tau_far": (0.25, 0.10, 0.80), "min_dwell_s": (0.5, 0.3, 0.7), "smooth_window_s": (0.4, 0.0, 0.8),
        "door_conf_thresh": (0.30, 0.20, 0.70), "context_pad_s": (1.0, 0.0, 3.0), "n_vlm_frames": (12, 4, 24), "crop_margin": (0.25, 0.0, 0.6), "vlm_conf_thresh": (0.5, 0.0, 0.9),
    },
}
# What has to be below what; the last is the shortest labelled interaction in seconds
BELOW = [("tunable.tau_near", "tunable.tau_far"), ("tracker.det_floor", "tunable.det_conf"), ("tunable.min_dwell_s", 0.75)]

DEFAULTS = {f"{g}.{k}": v[0] if isinstance(v, tuple) else v for g, names in DECLARED.items() for k, v in names.items()}
RANGES = {f"{g}.{k}": v[1:] for g, names in DECLARED.items() for k, v in names.items() if isinstance(v, tuple)}


class ConfigError(ValueError):
    """Settings that can't go together, or that nobody has declared."""


def flat(tree: Mapping[str, Any], above: str = "") -> Iterator[tuple[str, Any]]:
    """group.name and value of each leaf of nested mappings."""
    for k, v in tree.items():
        if isinstance(v, Mapping):
            yield from flat(v, f"{above}{k}.")
        else:
            yield f"{above}{k}", v


def objections(values: Mapping[str, Any]) -> Iterator[str]:
    """What speaks against an assignment, in the table's order."""
    for name in sorted(set(values) - set(DEFAULTS)):
        yield f"{name} isn't a setting"
    for name, default in DEFAULTS.items():
        value = values[name]
        number = isinstance(default, (int, float))
        if number != (isinstance(value, (int, float)) and not isinstance(value, bool)):
            yield f"{name} = {value!r} isn't {'a number' if number else 'a text'}"
        elif number and not RANGES[name][0] <= value <= RANGES[name][1]:
            yield f"{name} = {value} isn't within {RANGES[name][0]} and {RANGES[name][1]}"
    for low, high in BELOW:
        pair = values[low], values[high] if isinstance(high, str) else high
        if all(isinstance(x, (int, float)) for x in pair) and not operator.lt(*pair):
            yield f"{low} = {pair[0]} has to be below {high}" + (f" = {pair[1]}" if isinstance(high, str) else "")


class Config:
    """An assignment of the declared settings: config.tunable.tau_near. It never changes; with_tunables gives another."""

    def __init__(self, values: Mapping[str, Any] | None = None):
        found = DEFAULTS | dict(values or {})
        against = list(objections(found))
        if against:
            raise ConfigError("; ".join(against))
        # an int given for a float is that float, so that equal settings have equal hashes
        self._values = {k: float(v) if isinstance(DEFAULTS[k], float) else v for k, v in found.items()}

    def __getattr__(self, group: str) -> SimpleNamespace:
        if group not in DECLARED:
            raise AttributeError(group)
        return SimpleNamespace(**{k: self._values[f"{group}.{k}"] for k in DECLARED[group]})

    def __reduce__(self):
        return Config, (self._values,)

    def with_tunables(self, **values: float) -> "Config":
        return Config(self._values | {f"tunable.{k}": v for k, v in values.items()})

    def tree(self) -> dict[str, dict[str, Any]]:
        """All settings, the defaults among them, by group."""
        return {g: {k: self._values[f"{g}.{k}"] for k in names} for g, names in DECLARED.items()}

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self._values, sort_keys=True).encode()).hexdigest()[:16]


def load(values: Mapping[str, Any], overrides: Mapping[str, Any] | None = None) -> Config:
    """A Config of nested mappings; overrides go before values."""
    return Config(dict(flat(values)) | dict(flat(overrides or {})))


def parse(text: str, overrides: Mapping[str, Any] | None = None) -> Config:
    """A Config of a YAML text, of which JSON is a part; without a YAML library only JSON can be read."""
    try:
        from yaml import safe_load
    except ImportError:
        safe_load = json.loads
    tree = safe_load(text) or {}
    if not isinstance(tree, Mapping):
        raise ConfigError("a configuration is a mapping of groups")
    return load(tree, overrides)


def dumped(config: Config) -> str:
    """All settings as JSON text, which parse() reads back."""
    return json.dumps(config.tree(), indent=2) + "\n"


def environment(spark=None) -> dict[str, str]:
    return {"python": platform.python_version()} | ({"spark": spark.version} if spark else {})
