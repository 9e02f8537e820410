"""The query's syntax tree, its canonical text, and its normal form."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Term:
    text: str
    fields: tuple[str, ...] = ()
    weight: float | None = None
    function: str = ""  # soundex, typo, range, ...; empty for a plain word or wildcard pattern
    required: bool = False


@dataclass(frozen=True)
class Cluster:
    """An n-ary operator, folded from the left. sign and distance belong to NEAR and ADJ."""

    op: str
    items: tuple[Node, ...]
    distance: int | None = None
    sign: str = ""
    required: bool = False


Node = Term | Cluster


@dataclass(frozen=True)
class Query:
    root: Node | None
    modifiers: dict = field(default_factory=dict)
    text: str = ""
    messages: tuple[str, ...] = ()


class QueryError(ValueError):
    pass


def show(node: Node | None) -> str:
    """Canonical text: fully parenthesised, so that parsing it gives the same tree."""
    if node is None:
        return ""
    if isinstance(node, Term):
        out = f"{node.function}[{node.text}]" if node.function else node.text
        if node.weight is not None:
            out += f"[{node.weight:g}]" if not node.function else ""
        if node.fields:
            out = f"{','.join(node.fields)}={out}"
        return ("+" if node.required else "") + out
    op = node.op + (f"[{node.sign}{node.distance}]" if node.distance is not None else "")
    return ("+" if node.required else "") + "( " + f" {op} ".join(map(show, node.items)) + " )"


def pruned(node: Node) -> Node:
    """Repeated operands of AND and OR clusters are dropped; clusters of one are unwrapped."""
    if isinstance(node, Term):
        return node
    items = tuple(pruned(x) for x in node.items)
    if node.op in ("and", "or"):
        items = tuple(dict.fromkeys(items))
    if len(items) == 1:
        return items[0]
    return Cluster(node.op, items, node.distance, node.sign, node.required)


def leaves(node: Node | None) -> list[Term]:
    if node is None:
        return []
    return [node] if isinstance(node, Term) else [t for x in node.items for t in leaves(x)]


def combines(node: Node | None) -> bool:
    """Whether an OR or AND stands in the tree, where neighbouring words count more."""
    return isinstance(node, Cluster) and (node.op in ("or", "and") or any(map(combines, node.items)))


def positional(node: Node | None) -> bool:
    return isinstance(node, Cluster) and (node.op in ("adj", "near") or any(map(positional, node.items)))
