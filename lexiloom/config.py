"""Settings of a job, on the driver: layers, inheritance between files, overrides by path."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

INHERITS = "_inherits"


def layered(below: Mapping, above: Mapping) -> dict:
    """Two layers as one; maps on both sides merge, anything else above wins."""
    both = lambda k: isinstance(below.get(k), Mapping) and isinstance(above.get(k), Mapping)
    return {k: layered(below[k], above[k]) if both(k) else above.get(k, below.get(k)) for k in {**below, **above}}


def parser(path: Path) -> Callable[[str], dict]:
    if path.suffix == ".json":
        return json.loads
    try:
        import yaml
    except ImportError as e:
        raise ImportError(f"{path.name} needs a YAML parser; JSON files need none") from e
    return yaml.safe_load


def load(path: str | Path) -> dict:
    """A settings file over the one it inherits from, if any."""
    path = Path(path).resolve()
    own = parser(path)(path.read_text(encoding="utf-8")) or {}
    base = own.pop(INHERITS, None)
    return layered(load(path.parent / base), own) if base else own


def value_of(text: str) -> int | float | bool | str:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def overridden(settings: Mapping, items: Iterable[str]) -> dict:
    """With each a.b.c=value laid over the settings; items without = are ignored."""
    for path, found, text in (item.partition("=") for item in items):
        if found:
            layer: object = value_of(text)
            for key in reversed(path.split(".")):
                layer = {key: layer}
            settings = layered(settings, layer)
    return dict(settings)
