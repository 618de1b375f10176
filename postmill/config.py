"""Configuration: a YAML mapping read by dotted paths."""

from __future__ import annotations

from pathlib import Path
from typing import Any

DEFAULT_PATH = "config/postmill.yaml"


class ConfigError(Exception):
    pass


def dotted(config: dict, path: str, default: Any = None) -> Any:
    """Value at ``a.b.c``; the default when a step is missing or is no mapping."""
    value: Any = config
    for key in path.split("."):
        if not isinstance(value, dict) or key not in value:
            return default
        value = value[key]
    return value


def load_config(path: str | None = None) -> dict:
    import yaml

    file = Path(path or DEFAULT_PATH)
    if not file.is_file():
        raise ConfigError(f"no configuration at {file}")
    loaded = yaml.safe_load(file.read_text(encoding="utf-8"))
    if loaded is None:
        return {}
    if not isinstance(loaded, dict):
        raise ConfigError("the configuration must be a mapping")
    return loaded


def state_path(config: dict, override: str | None = None) -> str:
    """Folder of the state tables: override, then paths.database, project.default_database, var/postmill."""
    return override or dotted(config, "paths.database") or dotted(config, "project.default_database") or "var/postmill"


def model_for(config: dict, role: str, override: str | None = None) -> str:
    """Model name by precedence: override, the role's own, the default."""
    chosen = override or dotted(config, f"classification.ollama.models.{role}") or dotted(config, "classification.ollama.default_model")
    if not chosen:
        raise ConfigError(f"no model is configured for {role}")
    return chosen
