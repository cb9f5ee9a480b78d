"""Evaluation settings: defaults, a YAML or JSON file over them, environment variables over that, and all errors at once."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from copy import deepcopy
from pathlib import Path

try:
    import yaml
except ImportError:  # JSON files only
    yaml = None

FORMS = ("NFC", "NFD", "NFKC", "NFKD", "")
# Settings that a file may leave out.
DEFAULTS = {
    "benchmark": {"runs": 1, "warmup_runs": 0, "timeout_seconds": 3600},
    "normalisation": {
        "unicode_form": "NFKC", "lowercase": False, "strip_whitespace": True, "collapse_whitespace": True, "remove_punctuation": False,
        "fullwidth_to_halfwidth": False, "traditional_to_simplified": False, "custom_replacements": {},
    },
    "metrics": ["cer", "wer", "char_f1"],
    "degradation": {"enabled": False, "pipelines": []},
    "data": {"input_dir": "data/inputs", "groundtruth_dir": "data/groundtruths", "processed_dir": "data/processed", "results_dir": "results", "pdf_dpi": 200},
    "models": {},
}
#: Sections whose keys are fixed; others in them are left out.
CLOSED = ("benchmark", "normalisation", "degradation", "data")


class SettingsError(ValueError):
    """All that is wrong with the settings, a line each."""


def merged(base: Mapping, over: Mapping) -> dict:
    """`over` laid on `base`: mappings key by key, anything else replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def dotenv(text: str) -> dict[str, str]:
    """Variables of a .env file: NAME=value lines, maybe after `export`, maybe quoted; # begins a comment."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        name, equals, value = line.removeprefix("export ").partition("=")
        if line.startswith("#") or not equals or not name.strip():
            continue
        value = value.strip()
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].strip()
    return out


def overlay(variables: Mapping[str, str], places: Mapping[str, str], env_file: str | None = None, kinds: Mapping[str, type] | None = None) -> dict:
    """Nested settings from variables: `places` says where each goes (a.b.c). Real ones win over those of the .env file.
    `kinds` turns some places' text into int, float or bool; true, 1 and yes are true."""
    if env_file is not None and not Path(env_file).is_file():
        raise FileNotFoundError(env_file)
    known = (dotenv(Path(env_file).read_text(encoding="utf-8")) if env_file else {}) | dict(variables)
    out: dict = {}
    for name, place in places.items():
        if name in known:
            kind = (kinds or {}).get(place, str)
            value = known[name].strip().lower() in ("true", "1", "yes") if kind is bool else kind(known[name])
            for key in reversed(place.split(".")):
                value = {key: value}
            out = merged(out, value)
    return out


def errors(settings: Mapping) -> list[str]:
    """What is wrong, in order of sections."""
    run, data, form = settings["benchmark"], settings["data"], settings["normalisation"]["unicode_form"]
    steps, names = settings["degradation"], [m["name"] for m in settings["metrics"]]
    found = [
        (run["runs"] < 1, "benchmark.runs must be 1 at least"),
        (run["warmup_runs"] < 0, "benchmark.warmup_runs must be 0 at least"),
        (run["timeout_seconds"] < 60, "benchmark.timeout_seconds must be 60 at least"),
        (not names, "metrics must not be empty"),
        (not all(names), "a metric has no name"),
        (steps["enabled"] and not steps["pipelines"], "degradation is enabled without steps"),
        (not data["input_dir"], "data.input_dir must not be empty"),
        (not data["groundtruth_dir"], "data.groundtruth_dir must not be empty"),
        (data["pdf_dpi"] < 72, "data.pdf_dpi must be 72 at least"),
        (form not in FORMS, f"normalisation.unicode_form {form!r} is none of {FORMS}"),
    ]
    for name, model in settings["models"].items():
        found += [(not model.get(k), f"models.{name}.{k} must not be empty") for k in ("project_dir", "module")]
    return [text for wrong, text in found if wrong]


def load(path: str | None = None, over: Mapping | None = None) -> dict:
    """Settings of a file over the defaults, `over` over both; metrics become {name, params, apply_to}. SettingsError if
    they can't be used."""
    given: Mapping = {}
    if path is not None:
        text = Path(path).read_text(encoding="utf-8")
        if not path.endswith(".json") and yaml is None:
            raise SettingsError("no YAML reader is installed; use a .json file")
        given = (json.loads(text) if path.endswith(".json") else yaml.safe_load(text)) or {}
    out = merged(merged(deepcopy(DEFAULTS), given), over or {})
    for section in CLOSED:
        out[section] = {k: v for k, v in out[section].items() if k in DEFAULTS[section]}
    out["metrics"] = [{"name": m, "params": {}, "apply_to": []} if isinstance(m, str) else {"name": m.get("name", ""), "params": m.get("params", {}), "apply_to": m.get("apply_to", [])} for m in out["metrics"]]
    if wrong := errors(out):
        raise SettingsError("\n".join(f"- {w}" for w in wrong))
    return out


def from_environment(places: Mapping[str, str], env_file: str | None = None, kinds: Mapping[str, type] | None = None) -> dict:
    """overlay() of this process's variables."""
    return overlay(os.environ, places, env_file, kinds)
