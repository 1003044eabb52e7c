"""Navigation of data and model trees: codes, paths, search, replacement, printing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import fields, is_dataclass, replace
from typing import Any

#: The 64 digits of traversal codes, in ASCII order.
DIGITS = "+/" + "0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz"


def children(node: Any) -> dict[str, Any]:
    """Child nodes by field name, for data and model trees alike."""
    if hasattr(node, "children"):
        return node.children()
    if hasattr(node, "parts"):
        return dict(node.parts)
    return {f: getattr(node, f) for f in ("inner", "model") if hasattr(node, f)}


def _encode(bits: str) -> str:
    bits += "0" * (-len(bits) % 6)
    return "".join(DIGITS[int(bits[i : i + 6], 2)] for i in range(0, len(bits), 6))


def walk(node: Any, path: tuple[str, ...] = (), bits: str = "") -> Iterator[tuple[tuple[str, ...], str, Any]]:
    """(path, bits, node) in pre-order; child i of n appends i in as many bits as n has."""
    yield path, bits, node
    own = children(node)
    for i, (name, child) in enumerate(own.items(), 1):
        yield from walk(child, (*path, name), bits + format(i, f"0{len(own).bit_length()}b"))


def codes(node: Any) -> list[tuple[str, Any]]:
    return [(_encode(bits), n) for _, bits, n in walk(node)]


def by_code(node: Any, code: str) -> Any:
    for c, n in codes(node):
        if c == code:
            return n
    raise KeyError(code)


def code_to_path(node: Any, code: str) -> list[tuple[str, ...]]:
    return [p for p, bits, _ in walk(node) if _encode(bits) == code]


def path_to_code(node: Any, path: tuple[str, ...]) -> str:
    return next(_encode(bits) for p, bits, _ in walk(node) if p == tuple(path))


def paths(node: Any, where: Callable[[Any], bool] = lambda n: True) -> list[tuple[str, ...]]:
    return [p for p, _, n in walk(node) if where(n)]


def find(node: Any, target: Any) -> list[tuple[str, ...]]:
    return paths(node, lambda n: n is target)


def at(node: Any, path: tuple[str, ...]) -> Any:
    for name in path:
        node = children(node)[name]
    return node


def model_path(data: Any, model: Any, path: tuple[str, ...]) -> tuple[str, ...]:
    """The model's path to what stands for the data at path: child is inner in models of bags."""
    out: tuple[str, ...] = ()
    for name in path:
        own = children(at(model, out))
        out = (*out, name if name in own else next(iter(own)))
    return out


def data_path(data: Any, model: Any, path: tuple[str, ...]) -> tuple[str, ...]:
    out: tuple[str, ...] = ()
    for name in path:
        own = children(at(data, out))
        out = (*out, name if name in own else next(iter(own)))
    return out


def replace_in(node: Any, old: Any, new: Any) -> Any:
    """The tree with every node that is `old` replaced; others are shared or copied, never changed."""
    if node is old:
        return new
    own = {k: replace_in(c, old, new) for k, c in children(node).items()}
    if hasattr(node, "with_children"):
        return node.with_children(own) if own else node
    if is_dataclass(node):
        names = {f.name for f in fields(node)}
        return replace(node, **({"parts": own} if "parts" in names else {k: v for k, v in own.items() if k in names}))
    return node


def nnodes(node: Any) -> int:
    return sum(1 for _ in walk(node))


def nleafs(node: Any) -> int:
    return sum(not children(n) for _, _, n in walk(node))


def print_tree(node: Any, trav: bool = False) -> str:
    """The tree as text, one line a node; no counts, as those would run jobs."""
    lines = []
    for path, bits, n in walk(node):
        name = f"{path[-1]}: " if path else ""
        cols = f"({', '.join(n.cols)})" if hasattr(n, "cols") else ""
        lines.append("  " * len(path) + name + type(n).__name__ + cols + (f' ["{_encode(bits)}"]' if trav else ""))
    return "\n".join(lines)


def data_summary(node: Any) -> list[tuple[str, str, int]]:
    """(path, kind, observations) of every level; one count a level."""
    return [("/".join(p), type(n).__name__, n.numobs().first()["n"]) for p, _, n in walk(node)]


def model_summary(model: Any) -> dict[str, int]:
    """Number of models, and of parameters in their layers."""
    count = 0
    for _, _, m in walk(model):
        d = getattr(m, "layer", None) or getattr(m, "outer", None)
        if d is not None:
            count += sum(map(len, d.w)) + (len(d.b) if d.b else 0)
    return {"models": nnodes(model), "parameters": count}
