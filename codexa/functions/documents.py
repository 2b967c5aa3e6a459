"""Functions on single documents, on the driver."""

from __future__ import annotations

import json
from typing import Any


def collapse_nullable(node: Any) -> Any:
    """A schema document in which each member whose `anyOf` names one type and null has that type instead.

    Alternatives of one type count once; what is no object among them has no type. Only members of objects are collapsed,
    not the root and not members of lists, and a collapsed one is not looked into any further; its other keys stay.
    """
    if isinstance(node, list):
        return [collapse_nullable(x) for x in node]
    if isinstance(node, dict):
        return {k: _member(v) for k, v in node.items()}
    return node


def _member(value: Any) -> Any:
    options = value.get("anyOf") if isinstance(value, dict) else None
    if isinstance(options, list):
        types = list(dict.fromkeys(x.get("type") for x in options if isinstance(x, dict)))
        if len(types) == 2 and "null" in types:
            types.remove("null")
            return {k: v for k, v in value.items() if k != "anyOf"} | {"type": types[0]}
    return collapse_nullable(value)


def dump(document: Any, path: str) -> None:
    """As JSON where the name ends so, else as YAML in block style; keys keep their order."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(document, indent=2, ensure_ascii=False) if path.endswith(".json") else _yaml(document, 0))


def _yaml(node: Any, depth: int) -> str:
    pad = "  " * depth
    if isinstance(node, dict) and node:
        return "".join(f"{pad}{json.dumps(k) if not str(k).isidentifier() else k}:{_nested(v, depth)}" for k, v in node.items())
    if isinstance(node, list) and node:
        return "".join(f"{pad}-{_nested(v, depth)}" for v in node)
    return f"{pad}{json.dumps(node, ensure_ascii=False)}\n"


def _nested(node: Any, depth: int) -> str:
    if isinstance(node, (dict, list)) and node:
        return "\n" + _yaml(node, depth + 1)
    return f" {json.dumps(node, ensure_ascii=False)}\n"
