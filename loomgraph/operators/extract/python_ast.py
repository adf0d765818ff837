"""Python files, by the standard syntax tree."""

from __future__ import annotations

import ast
import builtins
import re
import typing
import warnings
from collections import deque

from loomgraph.operators.extract.common import definition, reference, unique

_FACTORY = re.compile(r"^(?:get|create|build|make|load|init|setup)_([a-z0-9_]+)$")
_MAX_ARGS = 6
_UPPER = re.compile(r"\b[A-Z]\w*")
# Names of the standard library and of common frameworks that are no classes of a project.
_KNOWN = (
    "cast dataclass dataclasses abstractmethod auto field "
    "Path PurePath PosixPath WindowsPath datetime date time timedelta timezone deque defaultdict OrderedDict Counter ChainMap "
    "Thread Lock RLock Event Condition Semaphore Queue PriorityQueue LifoQueue Enum IntEnum StrEnum Flag IntFlag ABC ABCMeta StringIO BytesIO TextIOWrapper Pattern Match UUID Decimal Fraction "
    "BaseModel BaseSettings Field validator root_validator model_validator field_validator ConfigDict "
    "FastAPI APIRouter Request Response JSONResponse HTMLResponse StreamingResponse FileResponse RedirectResponse HTTPException WebSocket BackgroundTasks Depends Body Query Header Cookie Form File UploadFile status "
    "asyncio Task Future gather sleep create_task get_event_loop run wait wait_for shield timeout "
    "Logger LogRecord Formatter Handler StreamHandler NullHandler FileHandler json os sys re math random copy functools"
).split()
# what Python itself defines needs no list
IGNORED = frozenset(n for n in dir(builtins) if not n.startswith("_")) | frozenset(typing.__all__) | frozenset(_KNOWN)


def _annotations(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    """Capitalised words of a function's annotations, quoted ones too."""
    a = node.args
    found = [x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x is not None] + [node.returns]
    return [w for x in found if x is not None for w in _UPPER.findall(x.id if isinstance(x, ast.Name) else ast.unparse(x))]


def _kept(found: list[tuple[str, str, str]], own: str = "") -> list[tuple[str, str, str]]:
    """Calls of what a project may define, but for the class itself."""
    return [(k, t, v) for k, t, v in found if t != own and t.partition("::")[0] not in IGNORED]


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    if isinstance(node, ast.Subscript):
        return _dotted(node.value)
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    return ""


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = node.args
    names = [x.arg for x in [*a.posonlyargs, *a.args]]
    names += [f"*{a.vararg.arg}"] if a.vararg else []
    names += [x.arg for x in a.kwonlyargs]
    names += [f"**{a.kwarg.arg}"] if a.kwarg else []
    shown = ", ".join(names[:_MAX_ARGS]) + (", ..." if len(names) > _MAX_ARGS else "")
    return f"{node.name}({shown})"


def _pascal(snake: str) -> str:
    return "".join(p.capitalize() for p in snake.split("_"))


_LEAVES = frozenset({ast.Constant, ast.Load, ast.Store, ast.Del})


class _Calls:
    """What a body calls: (kind, target, via), from the top down."""

    def __init__(self, via: str, attributes: dict[str, str]) -> None:
        self.via, self.attributes, self.found = via, attributes, []

    def visit(self, node: ast.AST) -> None:
        kind = type(node)
        if kind is ast.Name:
            if node.id[:1].isupper() and not node.id.isupper() and isinstance(node.ctx, ast.Load):
                self.found.append(("call", node.id, self.via))
            return
        if kind is ast.Call:
            self._call(node)
        for field in kind._fields:
            value = getattr(node, field, None)
            if type(value) is list:
                for x in value:
                    if isinstance(x, ast.AST) and type(x) not in _LEAVES:
                        self.visit(x)
            elif isinstance(value, ast.AST) and type(value) not in _LEAVES:
                self.visit(value)

    def _call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            made = _FACTORY.match(f.id)
            if made:
                self.found.append(("call", _pascal(made.group(1)), self.via))
            self.found.append(("call", f.id, self.via))
        elif isinstance(f, ast.Attribute):
            owner = f.value
            if isinstance(owner, ast.Name) and owner.id[:1].isupper():
                self.found += [("call", owner.id, self.via), ("method_call", f"{owner.id}::{f.attr}", self.via)]
            elif isinstance(owner, ast.Attribute) and isinstance(owner.value, ast.Name) and owner.value.id == "self":
                made = self.attributes.get(owner.attr, "")
                if made:
                    self.found.append(("call", made, self.via))
                self.found.append(("method_call", f"{made}::{f.attr}", self.via))
            elif isinstance(owner, ast.Call) and _dotted(owner.func)[:1].isupper():
                self.found.append(("method_call", f"{_dotted(owner.func)}::{f.attr}", self.via))


# in the order of their fields
_BLOCKS = ("body", "handlers", "cases", "orelse", "finalbody")
_PLAIN = frozenset({ast.Expr, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Return, ast.Raise, ast.Assert, ast.Pass, ast.Break, ast.Continue, ast.Delete, ast.Global, ast.Nonlocal})


def _assignments(top: ast.AST) -> list[ast.Assign]:
    """All assignments below a function, outer ones first."""
    out, rest = [], deque([top])
    while rest:
        node = rest.popleft()
        kind = type(node)
        if kind is ast.Assign:
            out.append(node)
        elif kind not in _PLAIN:
            for block in _BLOCKS:
                rest.extend(getattr(node, block, ()))
    return out


def extract(path: str, text: str) -> tuple[list[dict], list[dict]]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    defs, refs = [], []

    def imports(node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            refs.extend(reference(path, "", "import", a.name, a.asname or "") for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            module = node.module or ""
            refs.append(reference(path, "", "import", module, ",".join(a.name for a in node.names), node.level, node.level > 0))

    def function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        defs.append(definition(path, "function", node.name, node.lineno, node.end_lineno or node.lineno, signature=_signature(node), is_async=isinstance(node, ast.AsyncFunctionDef), decorators=[_dotted(d) for d in node.decorator_list], docstring=(ast.get_docstring(node) or "")[:200]))
        calls = _Calls("", {})
        for child in node.body:
            calls.visit(child)
        calls.found += [("call", w, "") for w in _annotations(node)]
        refs.extend(reference(path, node.name, k, t, v) for k, t, v in _kept(calls.found))

    def klass(node: ast.ClassDef) -> None:
        methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        attributes = {}
        for m in methods:
            for x in _assignments(m):
                if isinstance(x.value, ast.Call) and _dotted(x.value.func).rpartition(".")[2][:1].isupper():
                    for t in x.targets:
                        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                            attributes[t.attr] = _dotted(x.value.func).rpartition(".")[2]
        bases = [b for b in map(_dotted, node.bases) if b]
        defs.append(definition(path, "class", node.name, node.lineno, node.end_lineno or node.lineno, bases=bases, decorators=[_dotted(d) for d in node.decorator_list], docstring=(ast.get_docstring(node) or "")[:300], methods=[{"name": m.name, "signature": _signature(m), "line_start": m.lineno, "line_end": m.end_lineno or m.lineno} for m in methods]))
        refs.extend(reference(path, node.name, "extends", b) for b in bases)
        for m in methods:
            calls = _Calls(m.name, attributes)
            for child in m.body:
                calls.visit(child)
            calls.found += [("call", w, m.name) for w in _annotations(m)]
            refs.extend(reference(path, node.name, k, t, v) for k, t, v in _kept(calls.found, node.name))

    def walk(nodes: list[ast.stmt], top: bool) -> None:
        for node in nodes:
            if type(node) in _PLAIN:
                continue
            imports(node)
            if isinstance(node, ast.ClassDef):
                if top:
                    klass(node)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                function(node)
                walk(node.body, False)
            else:
                for field in ("body", "orelse", "finalbody"):
                    walk(getattr(node, field, []), top)
                for handler in getattr(node, "handlers", []):
                    walk(handler.body, top)

    walk(tree.body, True)
    calls = _Calls("", {})
    for node in tree.body:
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Import, ast.ImportFrom)):
            calls.visit(node)
    refs.extend(reference(path, "", k, t, v) for k, t, v in _kept(calls.found))
    doc = (ast.get_docstring(tree) or "")[:500]
    defs.insert(0, definition(path, "module", path, 1, text.count("\n") + 1, docstring=doc))
    return defs, unique(refs)
