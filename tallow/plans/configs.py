"""Configurations: YAML or JSON files with defaults, environment values, dotted overrides."""

from __future__ import annotations

import json
import os
from pathlib import Path

OPEN, CLOSE = "${oc.env:", "}"


class ConfigError(ValueError):
    pass


def merge(base: dict, over: dict) -> dict:
    """Deep merge; the later wins."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def expand(text: str) -> str:
    """Every ${oc.env:NAME,default} in a string by the environment's value, else the default; neither is an error."""
    before, found, rest = text.partition(OPEN)
    if not found:
        return text
    inside, closed, after = rest.partition(CLOSE)
    if not closed:
        raise ConfigError(f"unclosed: {text}")
    name, has_default, default = (x.strip() for x in inside.partition(","))
    if name not in os.environ and not has_default:
        raise ConfigError(f"{name} is not set and has no default")
    return before + os.environ.get(name, default) + expand(after)


def resolve_env(tree):
    """``expand`` on the strings of a tree."""
    match tree:
        case dict():
            return dict(zip(tree, map(resolve_env, tree.values())))
        case list():
            return list(map(resolve_env, tree))
        case str():
            return expand(tree)
    return tree


def parsed(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def load(path: str, roots: tuple[str, ...] = (".",), within: tuple[str, ...] = ()) -> dict:
    """A configuration over the ones that ``defaults`` names (one or a list; the later wins).

    A relative path is looked for beside the file that names it, then below ``roots``.
    """
    tried = [Path(root, path) for root in roots]
    found = next((p for p in tried if p.is_file()), None)
    if found is None:
        raise FileNotFoundError(f"{path}; tried {', '.join(map(str, tried))}")
    name = str(found.resolve())
    if name in within:
        raise ConfigError(f"{path} is its own default")
    own = dict(parsed(found))
    parents = own.pop("defaults", None) or []
    if isinstance(parents, str):
        parents = [parents]
    if not isinstance(parents, list):
        raise ConfigError("defaults must be a path or a list of paths")
    out: dict = {}
    for parent in parents:
        out = merge(out, load(parent, (str(found.parent), *roots), (*within, name)))
    return resolve_env(merge(out, own))


def scalar(text: str):
    """A JSON scalar, in any case; else the text."""
    try:
        value = json.loads(text.lower())
    except ValueError:
        return text
    return text if isinstance(value, (dict, list)) else value


def override(config: dict, *settings: str) -> dict:
    """a.b.c=value settings; what is no mapping cannot be reached into."""
    for setting in settings:
        path, given, text = setting.partition("=")
        if not given:
            raise ConfigError(f"no value: {setting}")
        *parents, last = path.split(".")
        node = config
        for key in parents:
            node = node.get(key, {})
            if not isinstance(node, dict):
                raise ConfigError(f"{key} in {path} is a value")
        leaf: dict = {last: scalar(text)}
        for key in reversed(parents):
            leaf = {key: leaf}
        config = merge(config, leaf)
    return config


def require_known(config: dict, known: set[str]) -> dict:
    """The mapping, unless it has a key that nothing reads."""
    if unknown := sorted(set(config) - known):
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    return config


def flatten(config: dict, prefix: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in config.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": str(v)}
    return out
