"""Lowering: a syntax tree and a catalog to a DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import scalar
from ..lang import ast, grammar
from ..operators import relational
from ..sources.catalog import Catalog, status
from . import kinds as K
from .kinds import Ex


@dataclass
class Lowered:
    """A compiled query: the result, and how its rows are to be shown."""

    df: DataFrame
    #: rows: objects of the columns; value: the single column is the row; items: each column is a row of its own
    shape: str = "rows"
    steps: list[str] = field(default_factory=list)
    sources: list[DataFrame] = field(default_factory=list)
    group_keys: list[str] = field(default_factory=list)
    observations: list[Observation] = field(default_factory=list)

    def scanned(self) -> int | None:
        """Rows read from the sources by a run that was compiled to observe them; None if Spark reports none (a source that was never run)."""
        until = time.time() + 5
        while not all(o._jo.future().isCompleted() for o in self.observations):  # reports follow the run
            if time.time() > until:
                return None
            time.sleep(0.01)
        return sum(o.get["rows"] for o in self.observations)

    def bytes(self) -> int:
        """Size of the files that the sources are read from, each file once."""
        spark = self.df.sparkSession
        return sum(status(spark, f).getLen() for f in {f for s in self.sources for f in s.inputFiles()})


@dataclass
class Scope:
    """Names that an expression may use. ``row``: what a leading dot means; ``aliases``: None after an aggregate."""

    aliases: dict[str, Ex]
    row: Ex | None
    closed: bool = False
    reducers: dict | None = None
    outer: Scope | None = None


def _refers(node: object, alias: str) -> bool:
    if isinstance(node, ast.Path) and node.root == alias:
        return True
    if isinstance(node, ast.Node):
        return any(_refers(v, alias) for v in vars(node).values())
    return isinstance(node, tuple) and any(_refers(v, alias) for v in node)


def _grouped(q: ast.Query) -> bool:
    return q.aggregate is not None and bool(q.aggregate.keys)


def _has_scalar_subquery(node: object, bare: bool = True) -> bool:
    """Whether a subquery stands where one value is wanted (not under exists or in), or groups by key."""
    if isinstance(node, ast.Subquery):
        return bare or _grouped(node.query)
    if isinstance(node, ast.Exists | ast.In):
        return any(_has_scalar_subquery(v, False) for v in vars(node).values())
    if isinstance(node, ast.Node):
        return any(_has_scalar_subquery(v) for v in vars(node).values())
    return isinstance(node, tuple) and any(_has_scalar_subquery(v, bare) for v in node)


def _has(node: object, kind: type) -> bool:
    if isinstance(node, kind):
        return True
    return any(_has(v, kind) for v in (vars(node).values() if isinstance(node, ast.Node) else node if isinstance(node, tuple) else ()))


def _aliases(node: object, known: set[str]) -> set[str]:
    return {a for a in known if _refers(node, a)}


def _label(e: ast.Node, default: str) -> str:
    if isinstance(e, ast.Path):
        names = [s.name for s in e.segments if isinstance(s, ast.Field)]
        return names[-1] if names else e.root or default
    return default


class Lowerer:
    def __init__(self, catalog: Catalog, params: dict[str, object] | None = None, ordered: bool = False, observe: bool = False):
        self.catalog, self.params, self.ordered, self.observe = catalog, params or {}, ordered, observe
        self.observations: list[Observation] = []
        self.counter = 0
        self.declared = False  # whether the last source has a column for its order
        self.sources: list[DataFrame] = []
        self.steps: list[str] = []

    def fresh(self, text: str) -> str:
        self.counter += 1
        return f"__{self.counter}_{text}"

    # --- sources

    def source(self, path: ast.Path, alias: str, need_order: bool, scope: Scope | None = None) -> tuple[DataFrame, Ex, list[str]]:
        """Rows of a path: the DataFrame, the alias's value and the columns that give their order."""
        if path.root is not None:
            raise QueryError(f"a source starts at the document, with a dot; {path.root!r} is no path (unnest goes through an alias)", path.position)
        if any(isinstance(s, ast.FieldSet) for s in path.segments):
            raise QueryError("a field set is allowed only on the left of a comparison", path.position)
        segments, orders = list(path.segments), []
        names = []
        for s in segments:
            if not isinstance(s, ast.Field):
                break
            names.append(s.name)
        after = segments[len(names)] if len(segments) > len(names) else None
        table = self.catalog.table(names) if isinstance(after, ast.Iterate | ast.Index) else None
        if table is not None and (isinstance(after, ast.Iterate) or table.order == "__pos"):
            df, rest = table.frame, segments[len(names) + 1 :]
            if isinstance(after, ast.Index):
                at = after.at
                df = df.where(F.col("__pos") == at) if at >= 0 else df.orderBy(F.desc("__pos")).limit(-at).orderBy("__pos").limit(1).where(F.col("__pos") >= 0)
            self.declared = table.order not in (None, "__pos")
            if table.order is not None:
                orders = [table.order]
            elif need_order:
                df = df.withColumn("__ord", F.monotonically_increasing_id())
                orders = ["__ord"]
            rename = {c: self.fresh(f"{alias}_{c}") for c in df.columns}
            types = {f.name: f.dataType for f in df.schema.fields}
            df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in rename.items()])
            orders = [rename[o] for o in orders]
            if table.element is not None:
                row = K.typed(F.col(rename[table.element]), types[table.element])
            else:
                hidden = {"__ord", "__pos"}
                row = Ex("obj", None, None, members={c: replace(K.typed(F.col(n), types[c]), sure=c in table.required) for c, n in rename.items() if c not in hidden})
        elif (document := self.catalog.document_for(names[0] if names else None)) is not None:
            name = self.fresh(alias)
            df, rest = document.select(F.col("doc").alias(name)), segments
            row = Ex("any", F.col(name), T.VariantType(), name=name)
        else:
            known = ", ".join(f".{n}[]" for n in sorted(self.catalog.tables)) or "none"
            raise QueryError(f"no such table in the document (it has {known})", path.position)
        # Iterations are exploded step by step, so that each level of rows is spread over the cluster.
        plain: list = []
        for s in rest:
            if isinstance(s, ast.Iterate | ast.Descend):
                row = self.walk(row, plain)
                row = K.iterate(row) if isinstance(s, ast.Iterate) else K.descend(row)
                plain = []
                df, row, orders = self.explode(df, row, alias, orders)
            else:
                plain.append(s)
        row = self.walk(row, plain)
        if row.many:
            df, row, orders = self.explode(df, row, alias, orders)
        elif plain:
            there = K.is_there(row)
            df = df.where(there) if there is not None else df
        if self.observe:
            seen = Observation()
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            self.observations.append(seen)
        self.sources.append(df)
        return df, row, orders

    def explode(self, df: DataFrame, row: Ex, alias: str, orders: list[str]) -> tuple[DataFrame, Ex, list[str]]:
        pos, name = self.fresh("pos"), self.fresh(alias)
        df = df.select("*", F.posexplode(row.col).alias(pos, name))
        return df, K.typed(F.col(name), row.dtype) if row.kind != "any" else Ex("any", F.col(name), T.VariantType(), name=name), [*orders, pos]

    def walk(self, e: Ex, segments: list) -> Ex:
        for s in segments:
            match s:
                case ast.Field(name):
                    e = K.get_field(e, name)
                case ast.Index(at):
                    e = K.get_index(e, at)
                case ast.Iterate():
                    e = K.iterate(e)
                case ast.Descend():
                    e = K.descend(e)
        return e

    # --- expressions

    def path(self, p: ast.Path, scope: Scope) -> Ex:
        if p.root is None:
            if scope.row is None:
                raise QueryError("there is no row here for a path that starts with a dot", p.position)
            return self.walk(scope.row, list(p.segments))
        if p.root in scope.aliases:
            if scope.closed:
                raise QueryError(f"{p.root!r} can't be used after aggregate or collect; name an output field such as .{p.root}", p.position)
            return self.walk(scope.aliases[p.root], list(p.segments))
        raise QueryError(f"unknown alias {p.root!r}", p.position)

    def ex(self, e: ast.Node, scope: Scope) -> Ex:
        match e:
            case ast.Path():
                if scope.reducers is not None:
                    raise QueryError("inside an aggregate item a path must stand in a reducer", e.position)
                return self.path(e, scope)
            case ast.Literal(value):
                return K.literal(value)
            case ast.Param(name):
                if name not in self.params:
                    raise QueryError(f"parameter ${name} isn't bound", e.position)
                return K.literal(self.params[name])
            case ast.Binary("and" | "or", a, b):
                x, y = K.truthy(self.ex(a, scope)), K.truthy(self.ex(b, scope))
                return K.boolean(x & y if e.op == "and" else x | y)
            case ast.Binary("+" | "-" | "*" | "/", a, b):
                return scalar.arithmetic(e.op, self.ex(a, scope), self.ex(b, scope))
            case ast.Binary("??", a, b):
                x, y = self.ex(a, scope), self.ex(b, scope)
                return K.merge(x, y, lambda p, q: F.coalesce(p, q)) if x.kind != "null" else y
            case ast.Binary(op, a, b):
                return self.comparison(op, a, b, scope)
            case ast.Unary("not", item):
                return K.negate(self.ex(item, scope))
            case ast.Unary("-", item):
                return scalar.minus(self.ex(item, scope))
            case ast.Exists(ast.Subquery(q)):
                return K.boolean(self.subquery(q, scope, as_json=_grouped(q))[0].exists(), unsure=False)
            case ast.Exists(item):
                there = K.is_there(self.ex(item, scope))
                return K.boolean(F.lit(True) if there is None else there, unsure=False)
            case ast.TypeTest(item, kind, negated):
                return K.type_test(self.ex(item, scope), kind, negated)
            case ast.In():
                return self.membership(e, scope)
            case ast.Call("if", (c, a, b)):
                cond = K.holds(self.ex(c, scope))
                return K.merge(self.ex(a, scope), self.ex(b, scope), lambda p, q: F.when(cond, p).otherwise(q))
            case ast.Call(name, args):
                return scalar.call(name, [self.ex(a, scope) for a in args])
            case ast.Reducer():
                if scope.reducers is None:
                    raise QueryError(f"{e.op}(...) is a reducer: it is allowed only inside aggregate {{ ... }}", e.position)
                return self.reduce(e, scope)
            case ast.ArrayLit(items):
                parts = [self.ex(i, scope) for i in items]
                if len({p.kind for p in parts}) == 1 and parts[0].kind in K.SCALARS:
                    whole = {p.dtype for p in parts}
                    t = parts[0].dtype if len(whole) == 1 else T.DoubleType() if parts[0].kind == "num" else T.StringType()
                    return Ex("arr", F.array(*[p.output().cast(t) for p in parts]), T.ArrayType(t))
                return Ex("arr", F.array(*[F.coalesce(K.variant(K.first(p)), K.VARIANT_NULL()) for p in parts]).cast("array<variant>"), T.ArrayType(T.VariantType()))
            case ast.ObjectLit(items):
                return Ex("obj", None, None, members={n: self.single(self.ex(v, scope)) for n, v in items})
            case ast.Subquery(q):
                return self.scalar_subquery(q, scope)
        raise QueryError(f"unsupported expression {type(e).__name__}")

    def single(self, e: Ex) -> Ex:
        """A value in a place that holds exactly one: missing becomes null."""
        if e.members is not None and e.present is None:
            return e
        e = K.first(e)
        out = e.output()
        if e.kind == "any":
            return Ex("any", out, e.dtype)
        return Ex(e.kind, out, e.dtype)

    def comparison(self, op: str, a: ast.Node, b: ast.Node, scope: Scope) -> Ex:
        if isinstance(a, ast.Path) and a.segments and isinstance(a.segments[-1], ast.FieldSet):
            base = self.path(ast.Path(a.root, a.segments[:-1], a.position), scope)
            right, out = self.ex(b, scope), None
            for name, override in a.segments[-1].items:
                one = K.truthy(K.compare(op, K.get_field(base, name), right if override is None else self.ex(override, scope)))
                out = one if out is None else out & one
            return K.boolean(out)
        for x, y, flip in ((a, b, False), (b, a, True)):
            if isinstance(y, ast.Subquery) and not self.is_scalar(y.query):
                return self.any_of(x, y.query, op, scope, flip)
        return K.compare(op, self.ex(a, scope), self.ex(b, scope))

    @staticmethod
    def is_scalar(q: ast.Query) -> bool:
        return q.aggregate is not None and not q.aggregate.keys or q.limit == 1

    def membership(self, e: ast.In, scope: Scope) -> Ex:
        if isinstance(e.among, ast.Subquery):
            found = self.any_of(e.item, e.among.query, "==", scope, False)
            return K.boolean(~F.coalesce(found.col, F.lit(False)), unsure=False) if e.negated else found
        items = [self.ex(i, scope) for i in e.among.items]
        item = self.ex(e.item, scope)
        if not items:
            return K.boolean(F.lit(e.negated), unsure=False)
        if len(items) == 1:
            return K.compare("!=" if e.negated else "==", item, items[0])
        if not item.many and item.kind in K.SCALARS and all(i.is_literal and i.kind == item.kind for i in items):
            own = item.value().isin([i.literal for i in items])
            if e.negated:
                own = ~F.coalesce(own, F.lit(False))
            return K.boolean(own if item.present is None else item.present & own)
        out = None
        for i in items:
            one = K.truthy(K.compare("!=" if e.negated else "==", item, i))
            out = one if out is None else out & one if e.negated else out | one
        return K.boolean(out)

    # --- subqueries

    def outer_scope(self, scope: Scope, as_json: bool = False) -> Scope:
        """The aliases of a query as its subqueries see them."""

        def outer(e: Ex) -> Ex:
            if as_json and e.name is not None:
                return Ex("any", F.parse_json(F.col(f"{e.name}_json").outer()), e.dtype)
            if e.members is not None:
                return replace(e, members={n: outer(m) for n, m in e.members.items()}, present=None if e.present is None else _outer_col(e.present), held=None if e.held is None else _outer_col(e.held))
            return replace(e, col=None if e.col is None else _outer_col(e.col), present=None if e.present is None else _outer_col(e.present))

        return Scope({n: outer(e) for n, e in scope.aliases.items()}, None if scope.row is None else outer(scope.row), scope.closed)

    def subquery(self, q: ast.Query, scope: Scope, as_json: bool = False) -> tuple[DataFrame, Ex]:
        outer = self.outer_scope(scope, as_json)
        clash = {q.alias, *(j.alias for j in q.joins), *(u.alias for u in q.unnests)} & set(scope.aliases)
        if clash:
            raise QueryError(f"alias {sorted(clash)[0]!r} of a subquery is already in use outside", q.path.position)
        inner = Lowerer(self.catalog, self.params, False)
        inner.counter = self.counter = self.counter + 1000
        lowered, value = inner.query(q, outer.aliases)
        self.sources += inner.sources
        return lowered.df, value

    def any_of(self, item: ast.Node, q: ast.Query, op: str, scope: Scope, flip: bool) -> Ex:
        """Whether a comparison with any value that a subquery emits is true."""
        df, value = self.subquery(q, scope, as_json=_grouped(q))
        own = self.ex(item, self.outer_scope(scope, as_json=_grouped(q)))
        test = K.compare(op, value, own) if flip else K.compare(op, own, value)
        return K.boolean(df.where(K.truthy(test)).exists(), unsure=False)

    def scalar_subquery(self, q: ast.Query, scope: Scope) -> Ex:
        if not self.is_scalar(q):
            q = replace(q, limit=1)
        df, value = self.subquery(q, scope, as_json=True)
        name = self.fresh("value")
        out = K.first(value)
        col = df.select(out.output().alias(name)).scalar()
        if q.aggregate is not None and not q.aggregate.keys and isinstance(q.aggregate.items[0].value, ast.Reducer) and q.aggregate.items[0].value.op == "count":
            col = F.coalesce(col, F.lit(0))
        return Ex("any" if out.kind == "any" else out.kind, F.coalesce(col, K.VARIANT_NULL()) if out.kind == "any" else col, out.dtype)

    # --- aggregation

    def reduce(self, r: ast.Reducer, scope: Scope) -> Ex:
        where: Column | None = scope.reducers["where"]
        rows = Scope(scope.aliases, scope.reducers["row"])
        over: WindowSpec | None = scope.reducers.get("over")

        def agg(c: Column) -> Column:
            return c if over is None else c.over(over)

        def kept(c: Column) -> Column:
            return c if where is None else F.when(where, c)

        if r.arg is None:
            return Ex("num", agg(F.count(F.lit(1)) if where is None else F.count_if(where)), T.LongType())
        e = self.ex(r.arg, rows)
        if r.op == "count":
            if e.many:
                return Ex("num", F.coalesce(agg(F.sum(kept(F.size(F.filter(e.col, lambda x: ~K.is_null(K.element(e, x))))))), F.lit(0)), T.LongType())
            there = ~K.is_null(e) if K.is_there(e) is None else K.is_there(e) & ~K.is_null(e)
            return Ex("num", agg(F.count(kept(F.when(there, 1)))), T.LongType())

        def number(x: Ex) -> Column:
            flag = K.of_kind(x, "bool").cast("int")
            if x.kind == "bool":
                return flag
            own = K.of_kind(x, "num")
            return F.coalesce(own, flag.cast("double")) if x.kind == "any" else own

        if e.many:
            values = F.filter(F.transform(e.col, lambda x: number(K.element(e, x)).cast("double")), lambda x: x.isNotNull())
            some = kept(F.when(F.size(values) > 0, values))
            total = agg(F.sum(F.aggregate(some, F.lit(0.0), lambda acc, x: acc + x)))
            out = {"sum": lambda: total, "avg": lambda: total / F.nullif(agg(F.sum(F.size(some))), F.lit(0)), "min": lambda: agg(F.min(F.array_min(some))), "max": lambda: agg(F.max(F.array_max(some)))}[r.op]()
            return Ex("num", out, T.DoubleType())
        c = kept(number(e))
        kind = e.dtype if e.kind == "num" and r.op in ("min", "max") else T.DoubleType()
        return Ex("num", agg({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[r.op](c)), kind)

    def item(self, i: ast.AggItem, scope: Scope, over: WindowSpec | None = None) -> Ex:
        where = None if i.where is None else K.truthy(self.ex(i.where, scope))
        inside = Scope(scope.aliases, None, reducers={"where": where, "row": scope.row, "over": over})
        value = self.ex(i.value, inside)
        if i.default is not None and value.members is None:
            value = self.default(value, i.default, inside)
        return self.single(value) if value.members is None else value

    def default(self, value: Ex, default: ast.Node, scope: Scope) -> Ex:
        d = self.ex(default, scope)
        if value.kind == "num" and d.kind == "num":
            return Ex("num", F.coalesce(value.output(), d.output()), T.DoubleType())
        return K.merge(value, d, lambda p, q: F.coalesce(p, q))

    def substitute(self, e: object, lets: dict[str, ast.Node]) -> object:
        """Names bound by let, put into an aggregate item."""
        if isinstance(e, ast.Path) and e.root in lets and not e.segments:
            return lets[e.root]
        if isinstance(e, ast.Subquery):
            return e
        if isinstance(e, ast.Node):
            return replace(e, **{k: self.substitute(v, lets) for k, v in vars(e).items() if isinstance(v, ast.Node | tuple)})
        return tuple(self.substitute(x, lets) for x in e) if isinstance(e, tuple) else e

    def hoist(self, e: object, df: DataFrame, aliases: dict[str, Ex]) -> tuple[object, DataFrame]:
        """Reducers over subqueries: each subquery is reduced for every row first, as a column, and the rows' results are then reduced."""
        if isinstance(e, ast.Reducer) and isinstance(e.arg, ast.Subquery):
            scope = Scope(aliases, None)

            def column(op: str) -> ast.Path:
                nonlocal df
                inner, value = self.subquery(e.arg.query, scope, as_json=True)
                one = Lowerer(self.catalog, self.params).reduce(ast.Reducer(op, ast.Path(None)), Scope({}, None, reducers={"where": None, "row": value}))
                name = self.fresh("sub")
                df = df.withColumn(name, inner.select(one.col.alias("v")).scalar())
                aliases[name] = K.typed(F.col(name), one.dtype)
                return ast.Path(name)

            if e.op == "avg":
                return ast.Binary("/", ast.Reducer("sum", column("sum")), ast.Reducer("sum", column("count"))), df
            if e.op == "count":
                return ast.Reducer("sum", column("count")), df
            return ast.Reducer(e.op, column(e.op)), df
        if isinstance(e, ast.Node) and not isinstance(e, ast.Subquery):
            changed = {}
            for k, v in vars(e).items():
                if isinstance(v, ast.Node | tuple):
                    changed[k], df = self.hoist(v, df, aliases)
            return replace(e, **changed), df
        if isinstance(e, tuple):
            out = []
            for x in e:
                x, df = self.hoist(x, df, aliases)
                out.append(x)
            return tuple(out), df
        return e, df

    # --- the query

    def query(self, q: ast.Query, outer: dict[str, Ex] | None = None) -> tuple[Lowered, Ex]:
        """The DataFrame of a query and the value of a row of it."""
        correlated = bool(outer) and any(_refers(q, name) for name in outer)
        stateful = q.distinct is not None and (q.distinct or q.joins or q.unnests) or q.collect is not None or q.limit is not None and not q.order and q.aggregate is None
        # Rows of one source come in its order by themselves, as long as nothing moves them and no column is declared to give the order.
        moved = bool(q.joins or q.order or q.limit is not None or q.distinct is not None) or _has(q, ast.Subquery)
        need_order = bool(stateful) or self.ordered and moved
        df, row, orders = self.source(q.path, q.alias, need_order)
        in_order = not moved and not self.declared
        from_columns = list(df.columns)
        aliases: dict[str, Ex] = {**(outer or {})}
        self.bind(aliases, q.alias, row, q.path.position)
        self.steps.append(f"source {q.alias}")
        for j in q.joins:
            df, orders = self.join(df, j, aliases, orders, need_order, set(outer or {}))
        for u in q.unnests:
            scope = Scope(aliases, row)
            e = self.ex(u.item, scope)
            e = K.iterate(K.first(e) if e.many else e) if e.kind in ("arr", "any") else Ex("any", F.expr("cast(array() as array<variant>)"), T.VariantType(), many=True)
            if e.kind == "any" and not e.many:
                e = K.iterate(e)
            source = self.ex(u.item, scope)
            if source.kind == "any":  # objects are no arrays
                one = K.first(source)
                e = Ex("any", F.try_variant_get(one.col, "$", "array<variant>"), T.VariantType(), many=True)
            name, pos = self.fresh(u.alias), self.fresh("pos") if need_order else None
            df = relational.unnest(df, e.col, name, pos)
            orders = [*orders, pos] if pos else orders
            self.bind(aliases, u.alias, K.typed(F.col(name), e.dtype) if e.kind != "any" else Ex("any", F.col(name), T.VariantType(), name=name), 0)
            self.steps.append(f"unnest {u.alias}")
        if outer is None and _has_scalar_subquery(q):
            # Spark correlates scalar subqueries by columns that can be grouped, which a VARIANT can't: its JSON text stands for it.
            for e in aliases.values():
                if e.name is not None:
                    df = df.withColumn(f"{e.name}_json", F.to_json(e.col))
        scope = Scope(aliases, row)
        if q.where is not None:
            df = df.where(K.truthy(self.ex(q.where, scope)))
            self.steps.append("filter")
        lets: dict[str, ast.Node] = {}
        if q.lets:
            if q.aggregate is None:
                raise QueryError("let needs an aggregate clause after it", q.positions.get("let", 0))
            for name, e in q.lets:
                if name in aliases:
                    raise QueryError(f"let {name!r} has the name of an alias")
                lets[name] = self.substitute(e, lets)
        if q.distinct is not None:
            df = self.distinct(df, q, row, scope, from_columns, orders)
            self.steps.append("distinct")
        shape, keys = "rows", []
        if q.aggregate is not None:
            block = q.aggregate
            if _has_scalar_subquery(block.items):
                items, df = self.hoist(block.items, df, aliases)
                block = replace(block, items=items)
            df, row, keys = self.aggregate(df, block, scope, lets, correlated)
            shape = "rows" if q.aggregate.keys else "items"
            scope = Scope(aliases, row if q.aggregate.keys else K.absent(), closed=True)
            self.steps.append("aggregate")
        elif q.collect is not None:
            df, row, scope, keys = self.collect(df, q.collect, row, scope, orders)
            shape = "value"
            self.steps.append("collect")
        if q.having is not None:
            df = df.where(K.truthy(self.ex(q.having, scope)))
            self.steps.append("having")
        out = row
        if q.select is not None:
            out = Ex("obj", None, None, members={n: self.single(self.ex(v, scope)) for n, v in q.select})
            shape = "rows"
            if _has_scalar_subquery(q.select):
                # they become joins, which keep no order: they are computed before the rows are sorted
                held = {n: self.fresh("out") for n in out.members}
                df = df.select("*", *[m.output().alias(held[n]) for n, m in out.members.items()])
                out = replace(out, members={n: Ex(m.kind, F.col(held[n]), m.dtype) for n, m in out.members.items()})
        if q.order:
            after = Scope(scope.aliases, out, scope.closed)
            columns = [c for e, down in q.order for c in K.sort_columns(self.ex(e, after), down)]
            if q.aggregate is None and q.collect is None:
                columns += [F.col(o).asc() for o in orders]
            df = df.orderBy(*columns)
            self.steps.append("sort")
        elif keys and (self.ordered and not outer or outer and q.limit is not None):
            if not (q.aggregate is not None and q.aggregate.rollup):
                df = df.orderBy(*[c for k in keys for c in K.canonical_sort(row.members[k] if row.members else Ex("any", F.col(k)))]) if q.collect is None else df.orderBy(*keys)
        elif orders and q.aggregate is None and q.collect is None and (self.ordered and not in_order and not outer or q.limit is not None):
            df = df.orderBy(*orders)
        if q.limit is not None:
            df = df.limit(q.limit)
            self.steps.append(f"limit {q.limit}")
        if outer is not None:
            if q.aggregate is not None and not q.aggregate.keys:
                out = next(iter(row.members.values()))
            return Lowered(df), out
        if out.members is not None:
            df = df.select(*[m.output().alias(n) for n, m in out.members.items()])
        else:
            df = df.select(out.output().alias("value"))
            shape = "value"
        return Lowered(df, shape, self.steps, self.sources, keys, self.observations), out

    def bind(self, aliases: dict[str, Ex], name: str, e: Ex, position: int) -> None:
        if name in aliases:
            raise QueryError(f"alias {name!r} is used twice", position)
        aliases[name] = e

    def join(self, df: DataFrame, j: ast.Join, aliases: dict[str, Ex], orders: list[str], need_order: bool, outer: set[str]) -> tuple[DataFrame, list[str]]:
        right, row, right_orders = self.source(j.path, j.alias, need_order)
        inner = Scope({j.alias: row}, None)
        left = Scope(dict(aliases), None)
        if j.alias in aliases:
            raise QueryError(f"alias {j.alias!r} is used twice", j.position)
        pairs, left_there, right_there, stack = [], [], [], [j.on]
        while stack:
            on = stack.pop(0)
            if isinstance(on, ast.Binary) and on.op == "and":
                stack = [on.left, on.right, *stack]
                continue
            if not (isinstance(on, ast.Binary) and on.op == "=="):
                raise QueryError("a join's condition is an equality, or several joined by and", j.position)
            sides = [on.left, on.right]
            if _refers(on.right, j.alias) == _refers(on.left, j.alias):
                raise QueryError(f"exactly one side of a join's equality must refer to {j.alias!r}", j.position)
            if _refers(on.left, j.alias):
                sides.reverse()
            if _aliases(sides[1], set(aliases)):
                raise QueryError(f"the side with {j.alias!r} can't refer to other aliases", j.position)
            a, b = K.first(self.ex(sides[0], left)), K.first(self.ex(sides[1], inner))
            for e, there in ((a, left_there), (b, right_there)):
                if (t := K.is_there(e)) is not None:
                    there.append(t)
            if a.kind == b.kind and a.kind in K.SCALARS:
                pairs.append((a.value(), b.value(), a.sure or b.sure))
            elif "any" in (a.kind, b.kind):
                x, y = K.canonical(a), K.canonical(b)
                pairs.append((x, y, False))
                right_there.append(y["t"] != 5)
            elif "null" in (a.kind, b.kind) or a.kind in K.SCALARS and b.kind in K.SCALARS:
                pairs.append((F.when(K.is_null(a), F.lit("null")).otherwise(F.lit("left")), F.when(K.is_null(b), F.lit("null")).otherwise(F.lit("right")), True))
            else:
                pairs.append((F.lit(1), F.lit(0), True))
        flag = None
        if j.kind == "left":
            flag = self.fresh("met")
            right = right.withColumn(flag, F.lit(True))
        # a missing key of the joined side matches nothing: such rows go before the join
        for t in right_there:
            right = right.where(t)
        df = relational.key_join(df, right, pairs, left_there, j.kind)
        if flag is not None:
            met = F.col(flag).isNotNull()
            row = replace(row, held=met) if row.members is not None else Ex("any", F.when(met, row.col).otherwise(K.VARIANT_NULL()), row.dtype) if row.kind == "any" else replace(row, present=None)
            if row.members is not None:
                # the alias itself is null then, and its fields are missing
                row = replace(row, members={n: replace(m, present=met) if m.kind != "any" else m for n, m in row.members.items()})
        aliases[j.alias] = row
        self.steps.append(f"{j.kind} join {j.alias}")
        return df, [*orders, *right_orders]

    def distinct(self, df: DataFrame, q: ast.Query, row: Ex, scope: Scope, from_columns: list[str], orders: list[str]) -> DataFrame:
        if q.distinct:
            keys = []
            for e in q.distinct:
                x = K.first(self.ex(e, scope))
                there = K.is_there(x)
                if x.kind in K.SCALARS:
                    own = x.value()
                elif x.kind == "any":
                    own = F.coalesce(F.to_json(x.col), F.lit(""))  # text of the value; no JSON text is empty
                else:
                    own = F.to_json(x.output()) if x.kind in ("arr", "obj") else F.lit(None).cast("string")
                keys.append(F.struct((F.lit(True) if there is None else there).alias("there"), own.alias("own")))
        elif row.members is not None:
            if not q.joins and not q.unnests:
                names = [c for c in from_columns if c not in orders or any(str(m.col) == str(F.col(c)) for m in row.members.values())]
                return df.dropDuplicates(names)  # the rows of a group are equal in every column
            keys = [m.col for m in row.members.values()]
        else:
            keys = [F.to_json(row.col)] if row.kind in ("any", "arr", "obj") else [row.col]
        return relational.first_by(df, keys, [F.col(o) for o in orders] or [F.lit(0)])

    def keys(self, exprs: tuple, scope: Scope) -> tuple[list[Column], list[str], list[Ex], list[Column]]:
        columns, names, exes, conditions = [], [], [], []
        for i, e in enumerate(exprs):
            name = _label(e, f"key{i + 1}" if len(exprs) > 1 else "key")
            if name in names:
                name = f"key{i + 1}"
            x = K.first(self.ex(e, scope))
            if (there := K.is_there(x)) is not None:
                conditions.append(there)
            if x.kind == "any":
                columns.append(K.canonical(x))
                if len(exprs) == 1:
                    conditions.append(columns[-1]["t"] != 5)
            elif x.kind in K.SCALARS or x.kind == "null":
                columns.append(x.value() if x.kind != "null" else F.lit(None).cast("string"))
            else:
                if len(exprs) == 1:
                    conditions.append(F.lit(False))
                columns.append(F.lit("(container)"))
            names.append(name)
            exes.append(x)
        return columns, names, exes, conditions

    def aggregate(self, df: DataFrame, a: ast.Aggregate, scope: Scope, lets: dict[str, ast.Node], correlated: bool = False) -> tuple[DataFrame, Ex, list[str]]:
        columns, names, exes, conditions = self.keys(a.keys, scope)
        if correlated and a.rollup:
            raise QueryError("a subquery that refers to the query around it can't roll up")
        # Spark analyses a grouping at once, before it is known what the outer columns are: a window with one row of each group stands for it.
        over = Window.partitionBy(*columns) if correlated and a.keys else None
        items = {i.name: self.item(self.substitute(i, lets) if lets else i, scope, over) for i in a.items}
        if clash := set(names) & set(items):
            raise QueryError(f"a key and an item are both named {sorted(clash)[0]!r}")
        for c in conditions:
            df = df.where(c)
        flat: list[Column] = []

        def lay(e: Ex, name: str) -> Ex:
            """Aggregates as columns, and how they are read back."""
            if e.members is not None:
                return replace(e, members={n: lay(m, f"{name}.{n}") for n, m in e.members.items()})
            column = self.fresh(name.replace(".", "_"))
            flat.append(e.value().alias(column))
            return Ex(e.kind, F.col(column), e.dtype)

        laid = {n: lay(e, n) for n, e in items.items()}
        if not a.keys:
            # a select of aggregates, unlike agg, isn't analysed before a subquery finds its outer columns
            return df.select(*flat), Ex("obj", None, None, members=laid), []
        held = [self.fresh(n) for n in names]
        named = [c.alias(h) for c, h in zip(columns, held, strict=True)]
        if over is not None:
            one = self.fresh("one")
            df = df.select(*named, *flat, F.row_number().over(over.orderBy(F.lit(0))).alias(one)).where(F.col(one) == 1)
        elif a.rollup:
            level = self.fresh("level")
            # keys become columns first: rollup nulls are then told from nulls of the data by the level
            df = df.select("*", *named).rollup(*held).agg(F.grouping_id().alias(level), *flat)
            if self.ordered:
                df = df.orderBy(level, *held)
        else:
            df = df.groupBy(*named).agg(*flat)
        members = {}
        for n, h, x in zip(names, held, exes, strict=True):
            if x.kind == "any":
                back = K.from_canonical(F.col(h))
                members[n] = Ex("any", F.when(F.col(h).isNull(), K.VARIANT_NULL()).otherwise(F.when(F.col(h)["t"] == 5, F.lit("(container)").cast("variant")).otherwise(back)), T.VariantType())
            else:
                members[n] = Ex(x.kind if x.kind in K.SCALARS or x.kind == "null" else "str", F.col(h), x.dtype if x.kind in K.SCALARS else T.StringType())
        return df, Ex("obj", None, None, members=members | laid), names

    def collect(self, df: DataFrame, key: ast.Node, row: Ex, scope: Scope, orders: list[str]) -> tuple[DataFrame, Ex, Scope, list[str]]:
        columns, names, exes, conditions = self.keys((key,), scope)
        for c in conditions:
            df = df.where(c)
        member = row.output()
        kind = df.select(member.alias("m")).schema["m"].dataType
        held, items = self.fresh(names[0]), self.fresh("items")
        df = relational.collect(df, columns[0], member, [F.col(o) for o in orders], held, items)
        array = Ex("arr", F.col(items), T.ArrayType(kind))
        return df, array, Scope(scope.aliases, array, closed=True), [held]


def _outer_col(c: Column) -> Column:
    """A column of an outer query as its subqueries write it."""
    return c.outer()


def lower(query: ast.Query, catalog: Catalog, params: dict[str, object] | None = None, ordered: bool = False) -> Lowered:
    """Compile a query. ``ordered``: rows come in document order and groups in order of their keys, as the command line shows them."""
    return Lowerer(catalog, params, ordered).query(query)[0]


__all__ = ["Lowered", "Lowerer", "lower", "grammar"]
