"""Settings files."""

from __future__ import annotations

import json


def settings(text: str) -> dict:
    """The mapping that a YAML text holds; without a YAML library, a JSON one. An empty text holds none; ValueError for
    anything that is no mapping or can't be read. Only plain values are made, never objects of other kinds."""
    try:
        import yaml
    except ImportError:
        found = json.loads(text) if text.strip() else {}
    else:
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"not YAML: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError("settings are a mapping of names to values")
    return found
