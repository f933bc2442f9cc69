"""Run configuration: the first of an explicit file, the environment, the working folder, defaults."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from gaugeworks.errors import ConfigError

ENV, LOCAL, LEAST_TOKENS = "GAUGEWORKS_CONFIG", "gaugeworks.json", 600


@dataclass(frozen=True)
class RunConfig:
    roster: tuple[str, ...] = ()
    local_base_url: str = "http://localhost:8080/v1"
    local_max_tokens: int = 2000
    local_timeout_s: float = 120.0
    cli_pool: int = 2
    samples_per_cell: int = 1
    judges: tuple[str, ...] = ()
    max_calls: int = 500
    config_source: str = field(default="defaults")


def load_config(explicit: str | None = None) -> RunConfig:
    if explicit is not None:
        return _read(explicit, "explicit")
    if ENV in os.environ:
        if not os.environ[ENV]:
            raise ConfigError(f"{ENV} is set but empty")
        return _read(os.environ[ENV], "environment")
    return _read(LOCAL, "folder") if Path(LOCAL).exists() else RunConfig()


def _read(path: str, origin: str) -> RunConfig:
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError, RecursionError) as e:
        raise ConfigError(f"{path} cannot be read: {e}") from e
    if not isinstance(value, dict):
        raise ConfigError(f"{path} is not an object")
    known = set(RunConfig.__dataclass_fields__) - {"config_source"}
    if set(value) - known:
        raise ConfigError(f"{path} has unknown keys {sorted(set(value) - known)}")
    for k, least in (("local_max_tokens", LEAST_TOKENS), ("cli_pool", 1), ("samples_per_cell", 1), ("max_calls", 1)):
        if k in value and (type(value[k]) is not int or value[k] < least):
            raise ConfigError(f"{k} must be a whole number of at least {least}")
    if "local_timeout_s" in value and (type(value["local_timeout_s"]) not in (int, float) or not value["local_timeout_s"] > 0):
        raise ConfigError("local_timeout_s must be a positive number")
    url = value.get("local_base_url", "http://x")
    if not isinstance(url, str) or not url.startswith(("http://", "https://")) or ".." in url:
        raise ConfigError("local_base_url must be an http address without ..")
    for k in ("roster", "judges"):
        if k in value:
            if not isinstance(value[k], list) or not all(isinstance(x, str) and x.strip() for x in value[k]):
                raise ConfigError(f"{k} must be a list of names")
            value[k] = tuple(dict.fromkeys(value[k]))
    return RunConfig(**value, config_source=f"{origin}:{path}")
