"""Facts of Python sources: routes, functions, models, imports and URL tables, one row each.

A file is read twice. First its statements are listed once, each with the classes around it, and each function's body becomes
a list of steps: bindings, branches, tries and calls, in the order of the text. Then rules, one for each kind of fact, go
over these lists; none depends on another's results but for the router and alias tables.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from meshlens.functions.columns import AUTH_HINTS, HTTP_VERBS

#: Names of calls that do I/O, bases of mapped classes, and parameter types that are no request body.
IO_NAMES = {"execute", "commit", "query", "get", "post", "put", "delete", "request", "fetch", "read", "write", "send"}
MAPPED = {"Base", "Model", "DeclarativeBase"}
PLAIN = {"int", "str", "float", "bool", "bytes", "dict", "list", "tuple", "set", "UUID", "date", "datetime", "Decimal", "Request", "BackgroundTasks", "Response"}
METHOD_MARKS = {"require_GET": ["GET"], "require_POST": ["POST"], "require_safe": ["GET"]}
Fact = tuple[str, dict]
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


# ---------------------------------------------------------------- reading names and literals


def chain(node: ast.AST) -> list[str] | None:
    """The names of a.b.c, or None if it doesn't begin with a name."""
    match node:
        case ast.Name(id=name):
            return [name]
        case ast.Attribute(value=inner, attr=name) if (before := chain(inner)) is not None:
            return [*before, name]
    return None


def dotted(node: ast.AST) -> str | None:
    names = chain(node)
    return ".".join(names) if names else None


def last_name(node: ast.AST) -> str:
    match node:
        case ast.Call(func=inner):
            return last_name(inner)
        case ast.Attribute(attr=name) | ast.Name(id=name):
            return name
    return ""


def bare(node: ast.AST | None) -> str | None:
    return node.id if isinstance(node, ast.Name) else None


def constant(node: ast.AST | None) -> str | None:
    return str(node.value) if isinstance(node, ast.Constant) else None


def items(node: ast.AST | None) -> list[ast.expr]:
    return node.elts if isinstance(node, (ast.List, ast.Tuple)) else []


def call_of(node: ast.AST | None, *names: str) -> bool:
    return isinstance(node, ast.Call) and last_name(node) in names


def keywords(call: ast.Call) -> dict[str | None, ast.expr]:
    return {k.arg: k.value for k in call.keywords}


def sounds_like_auth(*nodes: ast.AST | str) -> bool:
    text = " ".join(x if isinstance(x, str) else ast.unparse(x) for x in nodes).lower()
    return any(hint in text for hint in AUTH_HINTS)


def auth_dependency(node: ast.AST | None) -> bool:
    return call_of(node, "Depends") and bool(node.args) and sounds_like_auth(node.args[0])


def auth_annotation(node: ast.AST | None) -> bool:
    return isinstance(node, ast.Subscript) and "depends(" in ast.unparse(node).lower() and sounds_like_auth(node)


# ---------------------------------------------------------------- the lists


class Placed(NamedTuple):
    node: ast.AST
    classes: tuple[ast.ClassDef, ...]


class Step(NamedTuple):
    kind: str
    node: ast.AST
    guarded: bool


KINDS = {ast.Assign: "bind", ast.AnnAssign: "bind", ast.If: "branch", ast.For: "branch", ast.While: "branch", ast.ExceptHandler: "branch", ast.BoolOp: "branch", ast.Try: "try", ast.Call: "call"}


def placed(tree: ast.Module) -> list[Placed]:
    """Every node, in the order of the text, with the classes around it."""
    out: list[Placed] = []
    todo: list[Placed] = [Placed(tree, ())]
    while todo:
        at = todo.pop()
        out.append(at)
        around = (*at.classes, at.node) if isinstance(at.node, ast.ClassDef) else at.classes
        todo += [Placed(child, around) for child in reversed(list(ast.iter_child_nodes(at.node)))]
    return out


def steps(body: list[ast.stmt]) -> list[Step]:
    out: list[Step] = []
    todo = [(node, False) for node in reversed(body)]
    while todo:
        node, guarded = todo.pop()
        if type(node) in KINDS:
            out.append(Step(KINDS[type(node)], node, guarded))
        inside = guarded or isinstance(node, ast.Try)
        todo += [(child, inside) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


class Source(NamedTuple):
    file: str
    module: str
    nodes: list[Placed]

    def of(self, *kinds: type) -> Iterator[Placed]:
        return (p for p in self.nodes if isinstance(p.node, kinds))

    def calls_bound(self, *names: str) -> Iterator[tuple[list[str], ast.Call]]:
        """(variables, call) of assignments from a call of one of the names."""
        for p in self.of(ast.Assign):
            if call_of(p.node.value, *names):
                yield [t.id for t in p.node.targets if isinstance(t, ast.Name)], p.node.value


def parameters(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> list[ast.arg]:
    every = [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]
    return [p for p in every if p.arg not in ("self", "cls")]


# ---------------------------------------------------------------- rules on a body's steps


def callee(call: ast.Call) -> str:
    """name, object.name, or of deeper chains the last name."""
    names = chain(call.func)
    return ".".join(names) if names and len(names) <= 2 else last_name(call.func) if isinstance(call.func, ast.Attribute) else ""


def named_calls(found: list[Step]) -> list[Step]:
    return [s for s in found if s.kind == "call" and callee(s.node)]


def complexity(found: list[Step]) -> int:
    return 1 + sum(len(s.node.values) - 1 if isinstance(s.node, ast.BoolOp) else 1 for s in found if s.kind == "branch")


def unguarded_io(found: list[Step]) -> list[dict]:
    return [{"line": s.node.lineno, "name": last_name(s.node.func)} for s in named_calls(found) if not s.guarded and last_name(s.node.func) in IO_NAMES]


def queried(found: list[Step]) -> list[str]:
    asked = [s.node for s in named_calls(found) if isinstance(s.node.func, ast.Attribute) and s.node.func.attr == "query" and s.node.args]
    return [name for name in (bare(call.args[0]) for call in asked) if name]


def put_together(call: ast.Call) -> ast.expr | None:
    """The SQL text of an execute call, if it is made from values."""
    text = call.args[0] if last_name(call.func) in ("execute", "executemany") and call.args else None
    return text if isinstance(text, (ast.JoinedStr, ast.BinOp)) else None


def raw_sql(found: list[Step]) -> list[dict]:
    texts = [(s.node, put_together(s.node)) for s in named_calls(found)]
    return [{"line": call.lineno, "snippet": ast.unparse(text)[:80]} for call, text in texts if text is not None]


def flow(found: list[Step], params: list[str]) -> tuple[list[str], list[dict]]:
    """Parameters that reach SQL made from values, and calls that are handed parameters.

    held says which parameter a name's value comes from; a name bound to anything else is forgotten.
    """
    held = {p: p for p in params}

    def comes_from(node: ast.AST | None) -> str | None:
        match node:
            case ast.Name(id=name):
                return held.get(name)
            case ast.Subscript(value=inner) | ast.Attribute(value=inner):
                return comes_from(inner)
        return None

    sinks, handed = set(), []
    for s in found:
        if s.kind == "bind" and s.node.value is not None:
            came = comes_from(s.node.value)
            targets = s.node.targets if isinstance(s.node, ast.Assign) else [s.node.target]
            held |= {t.id: came for t in targets if isinstance(t, ast.Name)}
        elif s.kind == "call" and callee(s.node):
            text = put_together(s.node)
            sinks |= {held[x.id] for x in ast.walk(text) if isinstance(x, ast.Name) and held.get(x.id)} if text is not None else set()
            fed = [comes_from(a) for a in s.node.args]
            if any(fed):
                handed.append({"callee": callee(s.node), "arg_params": fed})
    return sorted(sinks), handed


# ---------------------------------------------------------------- rules on a file


def imports(src: Source) -> Iterator[Fact]:
    here = src.module.split(".") if src.module else []
    package = here if src.file.endswith("__init__.py") else here[:-1]
    for p in src.of(ast.Import, ast.ImportFrom):
        if isinstance(p.node, ast.Import):
            for a in p.node.names:
                bound, root = a.asname, a.name.partition(".")[0]
                yield "import", {"local": bound or root, "fqn": a.name if bound else root}
            continue
        up = max(p.node.level - 1, 0)
        if p.node.level > len(here) + src.file.endswith("__init__.py"):
            continue  # climbs out of the tree
        from_ = [*(package[: len(package) - up] if p.node.level else []), *([p.node.module] if p.node.module else [])]
        for a in p.node.names:
            if from_ and a.name != "*":
                yield "import", {"local": a.asname or a.name, "fqn": ".".join([*from_, a.name])}


def aliases(src: Source) -> Iterator[Fact]:
    for p in src.of(ast.Assign):
        if auth_annotation(p.node.value) and ast.unparse(p.node.value).lower().startswith("annotated["):
            yield from (("auth_alias", {"name": t.id}) for t in p.node.targets if isinstance(t, ast.Name))


def url_tables(src: Source) -> Iterator[Fact]:
    def entries(value: ast.AST) -> Iterator[ast.Call]:
        if isinstance(value, ast.BinOp):
            yield from entries(value.left)
            yield from entries(value.right)
        yield from (c for c in items(value) if call_of(c, "path", "re_path", "url") and len(c.args) > 1 and constant(c.args[0]) is not None)

    for p in src.of(ast.Assign, ast.AugAssign):
        targets = p.node.targets if isinstance(p.node, ast.Assign) else [p.node.target]
        for c in entries(p.node.value) if "urlpatterns" in map(bare, targets) else ():
            given, view = constant(c.args[0]), c.args[1]
            fact = {"pattern": given, "regex": last_name(c) != "path", "include": None, "view": None, "by_class": call_of(view, "as_view"), "line": c.lineno}
            if call_of(view, "include"):
                fact["include"] = constant(view.args[0]) if view.args else None
            elif fact["by_class"]:
                fact["view"] = dotted(view.func.value) if isinstance(view.func, ast.Attribute) else None
            else:
                fact["view"] = dotted(view)
            if fact["include"] or fact["view"]:
                yield "url", fact


def viewsets(src: Source) -> Iterator[Fact]:
    for p in src.of(ast.Expr):
        match p.node.value:
            case ast.Call(func=ast.Attribute(attr="register"), args=[ast.Constant(value=prefix), view, *_]) if dotted(view):
                yield "viewset", {"prefix": str(prefix).strip("/"), "view": dotted(view), "line": p.node.lineno}


def may_be_missing(field: ast.AnnAssign) -> bool:
    kind = ast.unparse(field.annotation)
    return field.value is not None or kind.startswith("Optional[") or "None" in kind.split("|")


def classes(src: Source) -> Iterator[Fact]:
    models = {"BaseModel"}
    for p in src.of(ast.ClassDef):
        bases = list(map(last_name, p.node.bases))
        if not MAPPED.isdisjoint(bases):
            yield "orm_model", {"name": p.node.name, "line": p.node.lineno}
        if not models.isdisjoint(bases):
            models.add(p.node.name)
            fields = {f.target.id: f for f in p.node.body if isinstance(f, ast.AnnAssign) and isinstance(f.target, ast.Name)}
            yield "contract", {"name": p.node.name, "bases": bases, "fields": list(fields), "required": [n for n, f in fields.items() if not may_be_missing(f)]}


def qualified(p: Placed) -> str:
    return ".".join([*(c.name for c in p.classes), p.node.name])


def functions(src: Source) -> Iterator[Fact]:
    for p in src.of(*FUNCTIONS):
        fn, found, names = p.node, steps(p.node.body), [x.arg for x in parameters(p.node)]
        methods = [m for d in fn.decorator_list for m in METHOD_MARKS.get(last_name(d), [])]
        for d in fn.decorator_list:
            if call_of(d, "require_http_methods", "api_view") and d.args:
                methods += [m.upper() for m in map(constant, items(d.args[0])) if m]
        sinks, handed = flow(found, names)
        around = any(sounds_like_auth(*map(last_name, c.bases), *c.decorator_list) for c in p.classes)
        yield "function", {
            "fqn": ".".join(filter(None, [src.module, qualified(p)])), "qname": qualified(p), "module": src.module, "line": fn.lineno, "end_line": fn.end_lineno or fn.lineno, "params": names,
            "calls": [callee(s.node) for s in named_calls(found)], "has_try": any(s.kind == "try" for s in found), "loose_io": unguarded_io(found), "raw_sql": raw_sql(found), "complexity": complexity(found), "orm_models": queried(found),
            "sql_sink_params": sinks, "forwards": handed, "methods": methods, "auth_hint": around or sounds_like_auth(*fn.decorator_list),
        }


def resolvers(src: Source) -> Iterator[Fact]:
    for p in src.of(*FUNCTIONS):
        owner = p.classes[-1] if p.classes else None
        if owner is None or owner.name not in ("Query", "Mutation"):
            continue
        marked = lambda decorators, mark: any(mark in ast.unparse(d).lower() for d in decorators)
        if "ObjectType" not in map(last_name, owner.bases) and not marked(owner.decorator_list, "strawberry.type"):
            continue
        name = p.node.name.removeprefix("resolve_")
        if name != p.node.name or marked(p.node.decorator_list, "strawberry.field"):
            head, *rest = name.split("_")
            yield "resolver", {"kind": owner.name.upper(), "field": head + "".join(map(str.title, rest)), "handler": ".".join(filter(None, [src.module, qualified(p)])), "line": p.node.lineno}


def routes(src: Source) -> Iterator[Fact]:
    prefixes, authed = {}, set()
    for names, call in src.calls_bound("APIRouter", "Blueprint"):
        given = keywords(call)
        prefixes |= dict.fromkeys(names, constant(given.get("prefix")) or constant(given.get("url_prefix")) or "")
        if any(map(auth_dependency, items(given.get("dependencies")))):
            authed |= set(names)
    own_aliases = {fact["name"] for _, fact in aliases(src)}
    for p in src.of(*FUNCTIONS):
        fn = p.node
        kinds = [x.annotation for x in parameters(fn)]
        types = [k for k in map(bare, kinds) if k and k not in PLAIN]
        defaults = [*fn.args.defaults, *fn.args.kw_defaults]
        guarded = any(map(auth_dependency, defaults)) or any(map(auth_annotation, kinds)) or not own_aliases.isdisjoint(types) or sounds_like_auth(*fn.decorator_list)
        for d in fn.decorator_list:
            match d:
                case ast.Call(func=ast.Attribute(attr=verb, value=owner), args=[ast.Constant(value=path), *_]) if verb == "route" or verb in HTTP_VERBS:
                    pass
                case _:
                    continue
            given = keywords(d)
            fact = {"path": str(path), "prefix": prefixes.get(bare(owner), ""), "handler": ".".join(filter(None, [src.module, qualified(p)])), "line": fn.lineno, "end_line": fn.end_lineno}
            if verb == "route":
                listed = given.get("methods")
                for method in filter(None, map(constant, items(listed))) if isinstance(listed, (ast.List, ast.Tuple)) else ["GET"]:
                    yield "route", fact | {"method": method.upper(), "framework": "flask", "has_auth": guarded, "response_model": None, "request_model": None, "annotations": []}
            else:
                behind = guarded or bare(owner) in authed or any(map(auth_dependency, items(given.get("dependencies"))))
                yield "route", fact | {"method": verb.upper(), "framework": "fastapi", "has_auth": behind, "response_model": bare(given.get("response_model")) or bare(fn.returns), "request_model": next(iter(types), None), "annotations": types}


#: A further kind of fact is one more rule here, and its shape in sources.tree.
RULES: list[Callable[[Source], Iterator[Fact]]] = [imports, aliases, url_tables, viewsets, classes, functions, resolvers, routes]


def parse(file: str, source: str) -> Iterator[Fact]:
    """Facts of one file; a file that isn't Python has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    module = re.sub(r"(^|\.)__init__$", "", file.removesuffix(".py").replace("/", "."))
    src = Source(file, module, placed(tree))
    for rule in RULES:
        yield from rule(src)
