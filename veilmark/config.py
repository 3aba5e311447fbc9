"""Configuration of a study: defaults, files, dotted overrides, checks, and a hash of what affects results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from veilmark.errors import ConfigError

Check = Callable[[Any], bool]


def _at_least(least: float) -> tuple[Check, str]:
    return lambda v: isinstance(v, int | float) and v >= least, f"must be at least {least}"


def _between(low: float, high: float, closed: bool = False) -> tuple[Check, str]:
    return lambda v: isinstance(v, int | float) and low < v and (v <= high if closed else v < high), f"must be over {low} and {'at most' if closed else 'under'} {high}"


# Sections, their keys and defaults; a check where there is one. A default that is a tuple makes a list of the value.
SECTIONS: dict[str, dict[str, tuple]] = {
    "sampling": {"k": (16, _at_least(1)), "temperature": (0.7, _between(0, 4, True)), "top_p": (0.95, _between(0, 1, True)), "top_k": (50,), "max_new_tokens": (128, _at_least(1)), "base_seed": (20260101,), "topm_logprobs": (5,)},
    "corpus": {
        "quarters": (("2019Q1",),), "form_types": (("8-K",),), "target_restricted": (60, _at_least(1)), "control_ratio": (1.0, _between(0, 1e9)), "size_metric": ("Revenues",), "sic_match_digits": (2,),
        "user_agent": ("",), "synthetic": (False,), "synthetic_seed": (7,), "max_fetch_failure_rate": (0.25, _between(0, 1, True)),
    },
    "split": {"split_seed": (991,), "dev_fraction": (0.5, _between(0, 1))},
    "stats": {
        "bootstrap_resamples": (10_000, _at_least(100)), "cv_folds": (5, _at_least(2)), "cv_repeats": (10,), "permutation_draws": (2_000,), "fdr_q": (0.10, _between(0, 1)), "ci_level": (0.95, _between(0, 1)),
        "undetectable_threshold": (0.60,), "leak_curve_k": ((1, 2, 4, 8, 16),),
    },
    "": {
        "profile": ("smoke",), "tier": ("stub", (lambda v: v in ("stub", "tiny", "small", "large"), "must be stub, tiny, small or large")), "methods": (("none",), (lambda v: len(v) > 0, "must not be empty")), "method_params": ({},),
        "cache_layers": (("cache",), (lambda v: len(v) > 0, "must not be empty")), "artifacts_dir": ("artifacts",), "data_dir": ("data",), "logs_dir": ("logs",), "max_generations": (5_000, _at_least(1)),
        "behavioural_templates": (8,), "content_probes_per_family": (3,), "version": ("0.1.0",), "template_pack_version": ("tp1",),
    },
}
#: Folders: they do not change what a result means.
PLACES = ("cache_layers", "artifacts_dir", "data_dir", "logs_dir")


class Config(Mapping):
    """Values by dotted name, all of them checked; it cannot be changed."""

    def __init__(self, given: Mapping[str, Any] | None = None):
        values = {self._name(s, k): spec[0] for s, keys in SECTIONS.items() for k, spec in keys.items()}
        for top, value in (given or {}).items():
            if top in SECTIONS and top:
                if not isinstance(value, Mapping):
                    raise ConfigError(f"section {top} must be a mapping")
                parts = {f"{top}.{k}": v for k, v in value.items()}
            else:
                parts = {top: value}
            for name, v in parts.items():
                if name not in values:
                    raise ConfigError(f"unknown key {name}")
                values[name] = self._listed(name, v) if isinstance(values[name], tuple) else v
        self._values = values
        for s, keys in SECTIONS.items():
            for k, spec in keys.items():
                if len(spec) > 1 and not spec[1][0](values[self._name(s, k)]):
                    raise ConfigError(f"{self._name(s, k)} {spec[1][1]}")
        if not values["corpus.synthetic"] and not str(values["corpus.user_agent"]).strip():
            raise ConfigError("corpus.user_agent is needed for live access; set corpus.synthetic for an offline corpus")

    @staticmethod
    def _name(section: str, key: str) -> str:
        return f"{section}.{key}" if section else key

    @staticmethod
    def _listed(name: str, value: Any) -> tuple:
        """A list, or a text with commas, as a tuple."""
        if isinstance(value, str):
            value = [p.strip() for p in value.split(",") if p.strip()]
            if not value:
                raise ConfigError(f"{name} is empty")
        if not isinstance(value, list | tuple):
            raise ConfigError(f"{name} must be a list or a text with commas")
        return tuple(value)

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def hash(self) -> str:
        """Of all that affects results: no folders, methods in any order."""
        return digest({k: sorted(v) if k == "methods" else v for k, v in self._values.items() if k not in PLACES})


def literal(value: Any) -> Any:
    """A text from a command line as the value it shows: JSON, true, false, none, else itself."""
    if not isinstance(value, str):
        return value
    words = {"true": True, "false": False, "none": None, "null": None}
    if value.strip().lower() in words:
        return words[value.strip().lower()]
    try:
        return json.loads(value)
    except ValueError:
        return value


def load(path: str | Path, overrides: Mapping[str, Any] | None = None) -> Config:
    """A YAML or JSON file (JSON is YAML), then dotted overrides such as {"sampling.k": "4"}."""
    import yaml

    path = Path(path)
    if not path.exists():
        raise ConfigError(f"no file {path}")
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} cannot be read: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} must hold a mapping")
    for name, value in (overrides or {}).items():
        *above, last = name.split(".")
        node = raw
        for part in above:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ConfigError(f"{name}: {part} holds no keys")
        node[last] = literal(value)
    return Config(raw)


def canonical(value: Any) -> str:
    """JSON with sorted keys; sets sorted; floats as Python shows them; bytes by digest; dates as ISO texts."""

    def plain(v: Any) -> Any:
        if isinstance(v, float):
            return repr(v)
        if isinstance(v, bytes):
            return hashlib.sha256(v).hexdigest()
        if isinstance(v, Mapping):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, set | frozenset):
            return sorted((plain(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True))
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if hasattr(v, "value") and type(v).__module__ != "builtins":
            return plain(v.value)
        if v is None or isinstance(v, bool | int | str):
            return v
        raise TypeError(f"{type(v).__name__} has no canonical form")

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()
