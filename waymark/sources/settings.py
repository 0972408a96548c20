"""Settings of a run: nested YAML or JSON whose leaf names are options with types and ranges."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from typing import Any


class SettingsError(ValueError):
    pass


def scalar(text: str) -> Any:
    """A YAML 1.2 scalar: only true and false are booleans; `off`, `yes` and the like are texts."""
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    if re.fullmatch(r"(?i)true|false", t):
        return t.lower() == "true"
    if t in ("", "~", "null"):
        return None
    if re.fullmatch(r"[-+]?\d+", t):
        return int(t)
    if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", t):
        return float(t)
    if t.startswith("[") and t.endswith("]"):
        return [scalar(x) for x in t[1:-1].split(",") if x.strip()]
    return t


def parse(text: str) -> dict:
    """Nested mappings by indentation with scalar leaves; JSON is taken as it is."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for number, line in enumerate(text.lstrip("﻿").split("\n"), 1):
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip():
            continue
        depth = len(body) - len(body.lstrip())
        key, colon, rest = body.strip().partition(":")
        if not colon:
            raise SettingsError(f"line {number} is no mapping: {line!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        if rest.strip():
            stack[-1][1][key.strip()] = scalar(rest)
        else:
            stack[-1][1][key.strip()] = child = {}
            stack.append((depth, child))
    return root


def flatten(tree: Mapping, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Any]]:
    return [leaf for k, v in tree.items() for leaf in (flatten(v, (*path, str(k))) if isinstance(v, Mapping) and v else [((*path, str(k)), None if isinstance(v, Mapping) else v)])]


def load(text: str, options: Mapping[str, Any], ranges: Mapping[str, tuple[float, float]] | None = None) -> dict[str, Any]:
    """options: name and default, whose type a value must have. Sections only order things;
    unknown names, a name given twice, wrong types and values out of range are errors."""
    found: dict[str, Any] = {}
    where: dict[str, str] = {}
    for path, value in flatten(parse(text)):
        name, dotted = path[-1], ".".join(path)
        if name == "config_version":
            if value != 1:
                raise SettingsError(f"version {value!r} isn't supported")
            continue
        if name not in options:
            raise SettingsError(f"unknown option {dotted}")
        if name in found:
            raise SettingsError(f"{name} is given twice: {where[name]} and {dotted}")
        default = options[name]
        if value is not None and default is not None:
            kind = type(default)
            if kind is bool and not isinstance(value, bool) or kind is not bool and isinstance(value, bool):
                raise SettingsError(f"{dotted} has to be {kind.__name__}")
            try:
                value = kind(value) if kind in (int, float, str) else value
            except (TypeError, ValueError):
                raise SettingsError(f"{dotted} has to be {kind.__name__}") from None
        low, high = (ranges or {}).get(name, (float("-inf"), float("inf")))
        if isinstance(value, (int, float)) and not low <= value <= high:
            raise SettingsError(f"{dotted} has to be between {low} and {high}")
        found[name], where[name] = value, dotted
    return {**options, **found}


def overlay(base: Mapping[str, Any], profiles: Mapping[str, Mapping[str, Any]], model: str, given: Mapping[str, Any]) -> dict[str, Any]:
    """Options of one model: the base, then its profile (by file name, else by stem), then what
    was given explicitly."""
    name = model.rsplit("/", 1)[-1]
    low = {k.lower(): v for k, v in profiles.items()}
    return {**base, **(low.get(name.lower()) or low.get(name.rpartition(".")[0].lower()) or {}), **given}


def select_models(found: list[str], wanted: list[str]) -> list[str]:
    """Models in the order found; names compare without case; unknown or repeated ones are errors."""
    low = [w.lower() for w in wanted]
    if len(set(low)) != len(low):
        raise SettingsError("a model is named twice")
    if missing := set(low) - {f.lower() for f in found}:
        raise SettingsError(f"unknown models: {', '.join(sorted(missing))}")
    return [f for f in found if not wanted or f.lower() in low]


def fingerprint(values: Mapping[str, Any], leave_out: tuple[str, ...] = ()) -> str:
    """SHA-256 of the canonical JSON of the settings that matter."""
    kept = {k: v for k, v in values.items() if k not in leave_out}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
