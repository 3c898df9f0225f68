"""Profiles of parameters in layers, with where each value came from."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from tidemark.operators.detectors import REGISTRY
from tidemark.schema import TIMEFRAMES, InputError

# Frames that differ by timeframe.
BY_TIMEFRAME: dict[str, dict[str, dict[str, Any]]] = {
    "atr_volatility": {"M1": {"n_atr": 20, "fenetre": 30000}, "M5": {"n_atr": 20, "fenetre": 6000}, "M15": {"fenetre": 2000}, "M30": {"fenetre": 1000}, "H4": {"fenetre": 125}, "D1": {"fenetre": 21}, "W1": {"fenetre": 12}},
    "er_kaufman": {"M1": {"fenetre": 8000}, "M5": {"fenetre": 3000}, "M15": {"fenetre": 2000}, "M30": {"fenetre": 1500}, "H4": {"fenetre": 200}, "D1": {"fenetre": 40}, "W1": {"fenetre": 20}},
    "shannon": {"M1": {"fenetre": 200}, "M5": {"fenetre": 200}, "M15": {"fenetre": 150}, "H4": {"fenetre": 50}, "D1": {"fenetre": 30}},
    "pca_axis": {"M1": {"fenetre": 200}, "M5": {"fenetre": 200}, "M15": {"fenetre": 150}, "H4": {"fenetre": 50}, "D1": {"fenetre": 30}},
    "ofi": {"D1": {"fenetre": 10}},
    "quote_size_imbalance": {"D1": {"fenetre": 10}},
    "divergence_pv": {"D1": {"fenetre_median_vol": 30}},
}


@dataclass(frozen=True)
class Profile:
    """Values by method, and by method and timeframe, that replace the defaults."""

    name: str = "default"
    methods: dict[str, dict[str, Any]] = field(default_factory=dict)
    by_timeframe: dict[str, dict[str, dict[str, Any]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for method in {*self.methods, *self.by_timeframe}:
            if method not in REGISTRY:
                raise InputError(f"profile {self.name}: unknown method {method!r}")
            for timeframe in (None, *TIMEFRAMES):
                resolve(method, timeframe, self)

    @property
    def digest(self) -> str:
        return _digest({"name": self.name, "methods": self.methods, "by_timeframe": self.by_timeframe})


def _digest(x: object) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()[:16]


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in pairs:
        if k in out:
            raise InputError(f"{k!r} stands twice")
        out[k] = v
    return out


def _yaml(text: str) -> dict[str, Any]:
    """A YAML mapping, where PyYAML is installed; keys must be distinct strings, and merges are errors."""
    try:
        import yaml
    except ModuleNotFoundError as error:
        raise InputError("profiles in YAML need PyYAML; JSON needs nothing") from error

    def plain(node: Any) -> Any:
        if isinstance(node, yaml.MappingNode):
            for k, _ in node.value:
                if k.tag != "tag:yaml.org,2002:str":
                    raise InputError(f"key {k.value!r} is no string")
            return _unique([(k.value, plain(v)) for k, v in node.value])
        if isinstance(node, yaml.SequenceNode):
            return [plain(v) for v in node.value]
        return yaml.safe_load(yaml.serialize(node))

    root = yaml.compose(text, yaml.SafeLoader)
    return plain(root) if root is not None else {}


def load(text: str, name: str = "profile") -> Profile:
    """A profile from JSON or YAML of {"methods": ..., "by_timeframe": ...}; a key that stands twice is an error."""
    got = json.loads(text, object_pairs_hook=_unique) if text.lstrip().startswith("{") else _yaml(text)
    if odd := sorted(set(got) - {"methods", "by_timeframe"}):
        raise InputError(f"unknown keys: {', '.join(odd)}")
    return Profile(name, got.get("methods", {}), got.get("by_timeframe", {}))


def resolve(method: str, timeframe: str | None = None, profile: Profile | None = None, **explicit: Any) -> tuple[dict[str, Any], dict[str, str]]:
    """Values and their origins: defaults, then the timeframe's, the profile's, the profile's for the timeframe, the caller's."""
    layers = [("default", REGISTRY[method].defaults), (f"default.{timeframe}", BY_TIMEFRAME.get(method, {}).get(timeframe or "", {}))]
    if profile:
        layers += [(profile.name, profile.methods.get(method, {})), (f"{profile.name}.{timeframe}", profile.by_timeframe.get(method, {}).get(timeframe or "", {}))]
    layers.append(("explicit", explicit))
    values: dict[str, Any] = {}
    origin: dict[str, str] = {}
    for name, layer in layers:
        for k, v in layer.items():
            values[k], origin[k] = v, name
    return REGISTRY[method].parameters(values), origin


def params_hash(method: str, values: dict[str, Any]) -> str:
    return _digest([method, values])
