"""Settings from a JSON file over built-in ones."""

from __future__ import annotations

import json
import os

DEFAULTS = {"store": {"kind": "local", "root": "."}, "pack": {"index": True, "dedup": True, "most_bytes": None}, "logs": {"savings": None, "actions": None}, "project": None}


class ConfigError(ValueError):
    """Settings that can't be read."""


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; objects that both have are merged in turn, anything else is replaced."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(path: str | None) -> dict:
    """The settings of a file over DEFAULTS; a file that isn't there gives DEFAULTS alone."""
    if path is None or not os.path.exists(path):
        return merged(DEFAULTS, {})
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError) as error:
        raise ConfigError(f"{path}: {error}") from error
    if not isinstance(found, dict):
        raise ConfigError(f"{path} holds no object")
    return merged(DEFAULTS, found)


def setting(config: dict, path: str, given=None):
    """What was given on the command line, else the value at a dotted path, else None."""
    if given is not None:
        return given
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return None
        config = config[part]
    return config
