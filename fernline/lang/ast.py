"""Syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    pass


# --- path segments


@dataclass(frozen=True)
class Field(Node):
    name: str


@dataclass(frozen=True)
class Index(Node):
    at: int


@dataclass(frozen=True)
class Iterate(Node):
    pass


@dataclass(frozen=True)
class Descend(Node):
    pass


@dataclass(frozen=True)
class FieldSet(Node):
    #: (name, override or None); a spread has been expanded already
    items: tuple


# --- expressions


@dataclass(frozen=True)
class Path(Node):
    root: str | None  # alias, or None for the row or document
    segments: tuple = ()
    position: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Param(Node):
    name: str
    position: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Binary(Node):
    op: str  # + - * / and or == != < <= > >= contains starts_with ends_with matches ??
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str  # - not
    item: Node


@dataclass(frozen=True)
class Exists(Node):
    item: Node


@dataclass(frozen=True)
class TypeTest(Node):
    item: Node
    kind: str
    negated: bool = False


@dataclass(frozen=True)
class In(Node):
    item: Node
    among: Node  # ArrayLit or Subquery
    negated: bool = False


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple
    position: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Reducer(Node):
    op: str
    arg: Node | None
    position: int = field(default=0, compare=False)


@dataclass(frozen=True)
class ArrayLit(Node):
    items: tuple


@dataclass(frozen=True)
class ObjectLit(Node):
    items: tuple  # of (name, Node)


@dataclass(frozen=True)
class Subquery(Node):
    query: Query


# --- clauses


@dataclass(frozen=True)
class Join(Node):
    kind: str  # inner, left
    path: Path
    alias: str
    on: Node
    position: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Unnest(Node):
    item: Node
    alias: str


@dataclass(frozen=True)
class AggItem(Node):
    name: str
    value: Node
    where: Node | None = None
    default: Node | None = None


@dataclass(frozen=True)
class Aggregate(Node):
    items: tuple  # of AggItem
    keys: tuple = ()
    rollup: bool = False


@dataclass(frozen=True)
class Query(Node):
    path: Path
    alias: str
    macros: tuple = ()  # of (name, names)
    joins: tuple = ()
    unnests: tuple = ()
    where: Node | None = None
    lets: tuple = ()  # of (name, Node)
    distinct: tuple | None = None  # () whole row, keys, or None
    aggregate: Aggregate | None = None
    collect: Node | None = None
    having: Node | None = None
    select: tuple | None = None  # of (name, Node)
    order: tuple = ()  # of (Node, descending)
    limit: int | None = None
    positions: dict = field(default_factory=dict, compare=False, hash=False)
