"""Settings of a deployment: sections of a TOML, JSON or YAML file, which the environment overrides."""

from __future__ import annotations

import json
import os
import re
import tomllib
from pathlib import Path
from typing import Any


_PLAIN = {"": None, "~": None, "null": None, "true": True, "false": False, "yes": True, "no": False}


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in ("'", '"'):
        if len(text) < 2 or text[-1] != text[0]:
            raise ValueError(f"a quote is not closed: {text}")
        return text[1:-1].replace("''", "'") if text[0] == "'" else json.loads(text)
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)\s*(?:,|$)""", text[1:-1])]
    if text.lower() in _PLAIN:
        return _PLAIN[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_yaml(text: str) -> dict[str, Any]:
    """Nested mappings, lists of plain values, quoted and plain values, and comments; anything else is an error that names its line."""
    root: dict[str, Any] = {}
    levels: list[tuple[int, Any, str | None]] = [(-1, root, None)]  # indent, mapping, the key that awaits a value
    for number, line in enumerate(text.splitlines(), 1):
        bare = re.sub(r"""^((?:[^'"#]|"(?:[^"\\]|\\.)*"|'(?:[^']|'')*')*?)(?:(?:^|\s)#.*)?$""", r"\1", line).rstrip()
        if not bare.strip() or bare.strip() == "---":
            continue
        indent = len(bare) - len(bare.lstrip(" "))
        item, pair = re.match(r"\s*-\s+(.*)$", bare), re.match(r"""\s*("[^"]*"|'[^']*'|[^\s:#&*!|>{\[][^:]*?)\s*:(?:\s+(.*))?$""", bare)
        while len(levels) > 1 and indent < levels[-1][0]:
            levels.pop()
        _, held, waiting = levels[-1]
        if item and waiting is not None and indent >= levels[-1][0]:
            held[waiting] = [*(held[waiting] or []), _scalar(item[1])]
            continue
        if not pair or pair[2] and re.match(r"[&*!|>{]", pair[2]):
            raise ValueError(f"line {number} is not known: {line.strip()}")
        if indent > levels[-1][0] and levels[-1][0] >= 0:
            if waiting is None or held[waiting] is not None:
                raise ValueError(f"line {number} is too far to the right")
            held[waiting] = {}
            held = held[waiting]
            levels.append((indent, held, None))
        elif levels[-1][0] < 0:
            levels.append((indent, held, None))
        key = str(_scalar(pair[1]))
        held[key] = _scalar(pair[2] or "")
        levels[-1] = (indent, held, None if pair[2] else key)
    return root


class Settings:
    """Values by section and key. A variable FLOORLENS_<SECTION>_<KEY> that is not empty comes first.

    A missing file raises FileNotFoundError; what is no section counts as an empty one. Relative paths
    are taken from the file's folder.
    """

    PREFIX = "FLOORLENS"

    def __init__(self, file: str | Path) -> None:
        self.file = Path(file).resolve()
        text = self.file.read_text(encoding="utf-8")
        kinds = {".json": lambda t: json.loads(t or "{}"), ".yaml": parse_yaml, ".yml": parse_yaml}
        found = kinds.get(self.file.suffix, tomllib.loads)(text)
        self.values: dict[str, Any] = found if isinstance(found, dict) else {}

    def get(self, section: str, key: str, default: Any = None) -> Any:
        own = os.environ.get(f"{self.PREFIX}_{section}_{key}".upper())
        held = self.values.get(section)
        return own or (held.get(key, default) if isinstance(held, dict) else default)

    def path(self, section: str, key: str, default: str | None = None) -> Path | None:
        value = self.get(section, key, default)
        return None if value is None else (self.file.parent / str(value)).resolve()
