"""A query's tree as indented lines."""

from __future__ import annotations

from . import ast
from .format import path as path_text


def _short(v: object) -> str:
    return repr(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) or v is None else str(v)


def outline(node: object, label: str = "", depth: int = 0) -> list[str]:
    """One line for each node: where it stands, its kind, and what it says itself; its parts below it."""
    lead = "  " * depth + (f"{label}: " if label else "")
    if isinstance(node, ast.Path):
        return [f"{lead}path {path_text(node)}"]
    if isinstance(node, ast.Literal):
        return [f"{lead}literal {_short(node.value)}"]
    if isinstance(node, ast.Node):
        parts = {k: v for k, v in vars(node).items() if k not in ("position", "positions") and v is not None and v is not False and v != ()}
        plain = {k: v for k, v in parts.items() if not isinstance(v, ast.Node | tuple)}
        out = [lead + " ".join([type(node).__name__.lower(), *(str(v) if k in ("op", "name", "alias", "kind") else f"{k} {_short(v)}" for k, v in plain.items())])]
        for k, v in parts.items():
            if k not in plain:
                out += outline(v, k, depth + 1)
        return out
    if isinstance(node, tuple):
        if all(not isinstance(x, ast.Node | tuple) for x in node):
            return [lead + " ".join(map(_short, node))]
        if len(node) == 2 and isinstance(node[0], str):
            return outline(node[1], f"{label} {node[0]}".strip(), depth)
        return [line for x in node for line in outline(x, label, depth)]
    return [lead + _short(node)]
