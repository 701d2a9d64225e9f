"""Symbols, references, imports and routes from source text.

Python is parsed with ``ast``. The other languages are read by declaration patterns and brace matching: names, kinds,
extents and calls, no types (declared reduced fidelity).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .changes import template_path

#: Verbs of route decorators and client calls, and names whose arguments are called back. Fixed values.
VERBS = frozenset("get post put patch delete head options".split())
CLIENTS = frozenset("requests httpx session client aiohttp".split())
CALLBACKS = frozenset("target key default_factory callback handler func function fn hook".split())
REGISTRARS = frozenset("register subscribe connect add_handler add_listener submit apply_async map filter partial signal atexit".split())

SCHEMA = """path string, parse_error boolean,
symbols array<struct<name:string,qualified_name:string,kind:string,signature:string,docstring:string,decorators:array<string>,start_line:int,end_line:int,param_names:array<string>,body:string,seed:string,visibility:string>>,
refs array<struct<scope:string,target_name:string,ref_type:string,scope_module:string,line:int>>,
routes array<struct<scope:string,role:string,method:string,path:string,line:int,framework:string,handler_name:string,handler_module:string>>"""


def module_name(path: str) -> str:
    stem = re.sub(r"\.[^./]+$", "", path).replace("/", ".")
    return stem


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        return dotted(node.func)
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def signature(node) -> str:
    if isinstance(node, ast.ClassDef):
        bases = [ast.unparse(b) for b in node.bases] + [f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords if k.arg]
        return f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}"
    a, out = node.args, []
    show = lambda x: x.arg + (f": {ast.unparse(x.annotation)}" if x.annotation else "")
    plain = [*a.posonlyargs, *a.args]
    optional = len(plain) - len(a.defaults)
    for i, x in enumerate(plain):
        out.append(show(x) + ("=..." if i >= optional else ""))
        if a.posonlyargs and i == len(a.posonlyargs) - 1:
            out.append("/")
    if a.vararg:
        out.append("*" + show(a.vararg))
    elif a.kwonlyargs:
        out.append("*")
    out += [show(x) + ("=..." if d is not None else "") for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        out.append("**" + show(a.kwarg))
    return f"{node.name}({', '.join(out)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


class _Python(ast.NodeVisitor):
    def __init__(self, source: str, module: str):
        self.lines, self.module = source.split("\n"), module
        self.scope, self.kinds, self.imports = [module], ["module"], {}
        self.symbols, self.refs, self.routes = [], [], []

    def define(self, node, kind: str) -> None:
        names = [dotted(d) for d in node.decorator_list]
        q = f"{self.scope[-1]}.{node.name}"
        args = [] if kind == "class" else [x.arg for x in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]
        self.symbols.append({"name": node.name, "qualified_name": q, "kind": kind, "signature": signature(node), "docstring": ast.get_docstring(node), "decorators": names, "start_line": node.lineno, "end_line": node.end_lineno, "param_names": args, "body": "\n".join(self.lines[node.lineno - 1 : node.end_lineno]), "seed": f"{signature(node)}|{ast.dump(node, annotate_fields=False)}"})
        for d in node.decorator_list:
            self.route(d, q)
            self.visit(d)
        self.scope.append(q)
        self.kinds.append("class" if kind == "class" else "function")
        if kind != "class":
            for x in [*node.args.defaults, *[k for k in node.args.kw_defaults if k]]:
                self.visit(x)
        for x in node.body:
            self.visit(x)
        self.scope.pop()
        self.kinds.pop()

    def visit_ClassDef(self, node):
        self.define(node, "class")

    def visit_FunctionDef(self, node):
        self.define(node, "method" if self.kinds[-1] == "class" else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):
        if len(self.scope) == 1:
            for a in node.names:
                self.imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]

    def visit_ImportFrom(self, node):
        if len(self.scope) > 1:
            return
        base = node.module or ""
        if node.level:
            up = self.module.split(".")[: -node.level]
            base = ".".join([*up, *([base] if base else [])])
        for a in node.names:
            if a.name != "*":
                self.imports[a.asname or a.name] = base

    def visit_Assign(self, node):
        if len(self.scope) == 1 and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and re.fullmatch(r"[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*", node.targets[0].id) and isinstance(node.value, (ast.Subscript, ast.Name, ast.Attribute, ast.BinOp)):
            n = node.targets[0].id
            self.symbols.append({"name": n, "qualified_name": f"{self.module}.{n}", "kind": "type_alias", "signature": ast.unparse(node)[:300], "docstring": None, "decorators": [], "start_line": node.lineno, "end_line": node.end_lineno, "param_names": [], "body": ast.unparse(node), "seed": ast.unparse(node)})
        self.generic_visit(node)

    def refer(self, target: str, left: str, kind: str, line: int) -> None:
        self.refs.append({"scope": self.scope[-1], "target_name": target, "ref_type": kind, "scope_module": self.imports.get(target) or self.imports.get(left), "line": line})

    def visit_Call(self, node):
        name = dotted(node.func)
        if name:
            parts = name.split(".")
            self.refer(parts[-1], parts[0], "call", node.lineno)
            if len(parts) > 1 and parts[-1] in VERBS and parts[-2].lower() in CLIENTS and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                self.routes.append({"scope": self.scope[-1], "role": "client", "method": parts[-1].upper(), "path": node.args[0].value, "line": node.lineno})
            called_back = [k.value for k in node.keywords if k.arg and (k.arg in CALLBACKS or k.arg.startswith("on_"))]
            called_back += node.args if parts[-1] in REGISTRARS else []
            for x in called_back:
                if isinstance(x, (ast.Name, ast.Attribute)) and dotted(x):
                    p = dotted(x).split(".")
                    self.refer(p[-1], p[0], "callback_arg", x.lineno)
        self.generic_visit(node)

    def route(self, d, scope: str) -> None:
        if not isinstance(d, ast.Call) or not d.args or not isinstance(d.args[0], ast.Constant) or not isinstance(d.args[0].value, str):
            return
        last = dotted(d.func).split(".")[-1].lower()
        methods = [last.upper()] if last in VERBS else []
        if last in ("route", "api_route"):
            given = next((k.value for k in d.keywords if k.arg == "methods"), None)
            methods = [e.value.upper() for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, (ast.List, ast.Tuple, ast.Set)) else ["ROUTE"]
        if last == "websocket":
            methods = ["WEBSOCKET"]
        self.routes += [{"scope": scope, "role": "server", "method": m, "path": d.args[0].value, "line": d.lineno} for m in methods]


def extract_python(source: str, module: str) -> dict:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return {"parse_error": True, "symbols": [], "refs": [], "routes": []}
    v = _Python(source, module)
    v.visit(tree)
    return {"parse_error": False, "symbols": v.symbols, "refs": v.refs, "routes": v.routes}


_NAME = r"([A-Za-z_$][\w$]*)"
#: Declarations by language: (kind, pattern whose first group is the name).
DECLARATIONS = {
    "javascript": [("class", rf"\bclass\s+{_NAME}"), ("function", rf"\bfunction\s*\*?\s*{_NAME}\s*\("), ("function", rf"\b(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*=>"), ("method", rf"^\s+(?:async\s+|static\s+|get\s+|set\s+)*{_NAME}\s*\([^;{{}}]*\)\s*\{{")],
    "go": [("function", rf"^func\s+{_NAME}\s*\("), ("method", rf"^func\s+\([^)]*\)\s*{_NAME}\s*\("), ("class", rf"^type\s+{_NAME}\s+(?:struct|interface)")],
    "java": [("class", rf"\b(?:class|interface|enum|record)\s+{_NAME}"), ("method", rf"^\s+(?:[\w<>\[\],.@]+\s+)+{_NAME}\s*\([^;{{}}]*\)\s*(?:throws[^{{]+)?\{{")],
    "rust": [("function", rf"\bfn\s+{_NAME}"), ("class", rf"\b(?:struct|enum|impl)\s+{_NAME}"), ("interface", rf"\btrait\s+{_NAME}")],
    "ruby": [("class", rf"^\s*(?:class|module)\s+{_NAME}"), ("function", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)")],
    "php": [("class", rf"\b(?:class|interface|trait)\s+{_NAME}"), ("function", rf"\bfunction\s+&?{_NAME}\s*\(")],
}
DECLARATIONS["typescript"] = [*DECLARATIONS["javascript"], ("class", rf"\b(?:interface|enum)\s+{_NAME}")]
DECLARATIONS["tsx"] = DECLARATIONS["typescript"]
_VALUES = frozenset("true false null undefined this".split())
_RESERVED = frozenset("if for while switch catch return function new await typeof sizeof match else do try super with".split())
_CALL = re.compile(rf"(?:([A-Za-z_$][\w$]*)\s*(?:\.|::)\s*)?{_NAME}\s*\(")
_IMPORT = {
    "java": re.compile(r"^import\s+(?:static\s+)?([\w.]+)\.(\w+);", re.M),
}
_SCRIPT_IMPORT = re.compile(r"""\bimport\s+(?:type\s+)?([^'";()]+?)\s+from\s*['"]([^'"]+)['"]|\b(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*require\(\s*['"]([^'"]+)['"]\s*\)""")


def _script_imports(source: str, module: str) -> dict[str, str]:
    """Local name to dotted module of this project, or to a package's name. Names in braces, defaults and ``* as`` alike."""
    out = {}
    for m in _SCRIPT_IMPORT.finditer(source):
        target = re.sub(r"\.\w+$", "", m[2] or m[4])
        base = module.split(".")[:-1]
        for part in target.split("/"):
            base = base[:-1] if part == ".." else base if part in (".", "index") else [*base, part]
        where = ".".join(base) if target.startswith(".") else target
        for n in re.sub(r"[{}]", ",", m[1] or m[3]).split(","):
            local = re.split(r"\s+as\s+|\s*:\s*", re.sub(r"^type\s+", "", n.strip()))[-1].strip()
            if local:
                out[local] = where
    return out


#: What routes are registered on, and endings of such names. Fixed values.
ROUTERS = ("app", "router", "server", "api", "route", "routes", "web", "http")
ROUTER_ENDS = ("router", "app", "server", "routes")
_REGISTERED = re.compile(rf"(?<![\w$.)\]])({_NAME[1:-1]})(?:\.[\w$]+)*\.(get|post|put|patch|delete|all|options|on|route)\(", re.I)
_TEXT = re.compile(r"""\s*(['"`])((?:\\.|(?!\1).)*)\1\s*\Z""", re.S)
_CLIENT = re.compile(r"""\b(?:fetch|axios|http|\$http|client|api|request)(?:\.(get|post|put|patch|delete|head|request))?\s*(?:<[^>]*>)?\(\s*(['"`])((?:https?:/)?/[^'"\n]*?|\$\{[^'"\n]*?)\2""")
_HANDED = re.compile(r"\b(?:on|once|use|addEventListener|addListener|subscribe|register|then|catch|map|filter|forEach|setTimeout|setInterval|get|post|put|patch|delete)\s*\(([^()]*)\)")
_JSX = re.compile(r"<([A-Z][\w$]*)(?:[.\s/>])")
_ANNOTATION = re.compile(r"^\s*@([A-Za-z_][\w.]*)\s*(\(.*\))?\s*$")
_SCRIPT = ("javascript", "typescript", "tsx")
#: Methods of Go routers, names of what they are called on, and endings of such names. Fixed values.
GO_VERBS = ("get", "post", "put", "delete", "patch", "head", "options", "any", "handlefunc", "handle", "method")
GO_ROUTERS = ("r", "router", "mux", "e", "engine", "app", "api", "http", "group", "g")
GO_ROUTER_ENDS = ("router", "mux", "engine", "group", "server")
_GO_TEXT = r"""(?:"((?:\\.|[^"\\\n])*)"|`([^`]*)`)"""
_GO_ROUTE = re.compile(rf"(?<![\w.)])(\w+)(?:\.\w+)?\.({'|'.join(GO_VERBS)})\(\s*{_GO_TEXT}\s*,(?:\s*{_GO_TEXT})?", re.I)


def _annotations(lines: list[str], start: int) -> list[tuple[str, str]]:
    """(name, whole text) of the annotations on the lines right above a declaration."""
    out, i = [], start - 1
    while i >= 0 and (m := _ANNOTATION.match(lines[i])):
        out.append((m[1], lines[i].strip()))
        i -= 1
    return out[::-1]


def _seed(body: str, language: str) -> str:
    """A body's words, texts and signs without comments and layout: what its hash goes by."""
    comment = r"#[^\n]*" if language == "ruby" else r"//[^\n]*|/\*.*?\*/"
    found = re.finditer(rf"({comment})|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[\w$]+|[^\s\w$]", body, re.S)
    return " ".join(m[0] for m in found if m[1] is None) or body


def _go_routes(source: str, code: str) -> Iterator[tuple[int, dict]]:
    """(place, route) of router calls in Go; handlers of any method are ALL. A ``METHOD /path`` pattern is split."""
    for at, method, path, receiver, verb, opens in _go_calls(source, code):
        handler = next((re.findall(_NAME, a)[-1] for x, y in reversed(arguments(code, opens)) if re.fullmatch(rf"{_NAME}(?:\.{_NAME})*", a := code[x:y].strip())), None)
        yield at, {"role": "server", "method": method, "path": path, "framework": _go_framework(source, receiver, verb), "handler_name": handler, "handler_module": None}


def _go_calls(source: str, code: str) -> Iterator[tuple[int, str, str, str, str, int]]:
    """(place, method, path, receiver, verb, where the arguments begin)."""
    for m in _GO_ROUTE.finditer(source):
        router, verb = m[1].lower(), m[2].lower()
        if code[m.start()] == " " or not (router in GO_ROUTERS or router.endswith(GO_ROUTER_ENDS)):
            continue
        texts = [a if a is not None else b for a, b in ((m[3], m[4]), (m[5], m[6])) if a is not None or b is not None]
        more = router, verb, source.index("(", m.end(2)) + 1
        if verb == "method":
            if len(texts) == 2:
                yield m.start(), texts[0].upper(), texts[1], *more
        elif verb in ("handle", "handlefunc", "any"):
            named = re.fullmatch(r"([A-Z]+)\s+(/.*)", texts[0])
            yield m.start(), named[1] if named else "ALL", named[2] if named else texts[0], *more
        else:
            yield m.start(), verb.upper(), texts[0], *more


def arguments(code: str, at: int) -> list[tuple[int, int]]:
    """(start, end) of the arguments of a call whose list opens right before ``at``, cut at commas of its own level."""
    out, depth, begin = [], 0, at
    for i in range(at, len(code)):
        c = code[i]
        if depth == 0 and c in ",)":
            if code[begin:i].strip() or c == ",":
                out.append((begin, i))
            begin = i + 1
            if c == ")":
                return out
        depth += (c in "([{") - (c in ")]}")
    return []


def _closes(code: str, at: int) -> int:
    """Where the bracket that opens right before ``at`` closes; -1 if it doesn't."""
    depth = 0
    for i in range(at, len(code)):
        if depth == 0 and code[i] == ")":
            return i
        depth += (code[i] in "([{") - (code[i] in ")]}")
    return -1


def handler_of(argument: str) -> tuple[str | None, str | None]:
    """(the name a handler is known by, the name it is imported under) of an argument with its strings blanked out.

    ``show`` is itself, ``ctrl.show`` is show of ctrl, ``wrap(ctrl.show)`` what its first telling argument is, or wrap;
    functions written in place, objects and texts are nothing.
    """
    a = argument.strip()
    if re.fullmatch(rf"{_NAME}(?:\s*\??\.\s*{_NAME})*", a):
        names = re.findall(_NAME, a)
        return (None, None) if names[0] in _VALUES and len(names) == 1 else (names[-1], names[0])
    call = re.match(rf"(?:await\s+)?({_NAME}(?:\.{_NAME})*)\s*\(", a)
    if call and _closes(a, call.end()) == len(a) - 1 and call[1].split(".")[0] not in _RESERVED:
        for begin, end in arguments(a, call.end()):
            if (inner := handler_of(a[begin:end]))[0]:
                return inner
        return handler_of(call[1])
    return None, None


def _script_routes(source: str, code: str, imports: dict[str, str]) -> Iterator[tuple[int, dict]]:
    """(place, route) of registrations on an app or router. ``on`` and ``route`` mount: they say no method that a client
    could ask for."""
    low = source.lower()
    framework = "hono" if "hono" in low else "express" if "express" in low else None
    for m in _REGISTERED.finditer(code):
        receiver, verb = m[1].lower(), m[m.lastindex].lower()
        if not (receiver in ROUTERS or receiver.endswith(ROUTER_ENDS)):
            continue
        given = arguments(code, m.end())
        texts = [t[2] if (t := _TEXT.match(source[a:z])) else None for a, z in given[:2]]
        method, path = (texts[0] or "ON", texts[1]) if verb == "on" and len(texts) > 1 else (verb, texts[0] if texts and verb != "on" else None)
        if path is None:
            continue
        name, local = next((h for a, z in reversed(given) if (h := handler_of(code[a:z]))[0]), (None, None))
        yield m.start(), {"role": "mount" if verb in ("on", "route") else "server", "method": method.upper(), "path": path, "framework": framework, "handler_name": name, "handler_module": imports.get(local)}


def _visibility(line: str, language: str) -> str | None:
    """What a declaration's line says about who may use it."""
    if language == "rust":
        m = re.match(r"\s*pub\b(\s*\()?", line)
        return m and ("restricted" if m[1] else "pub")
    if language in _SCRIPT:
        return "exported" if re.match(r"\s*export\b", line) else None
    m = re.search(r"\b(public|protected|private)\b", line.split("(")[0]) if language in ("java", "php") else None
    return m and m[1]


def _go_framework(source: str, receiver: str, verb: str) -> str:
    low = source.lower()
    known = (("gin-gonic/", "gin"), ("labstack/echo", "echo"), ("go-chi/chi", "chi"))
    return "nethttp" if verb in ("handle", "handlefunc") or receiver in ("http", "mux") else next((name for mark, name in known if mark in low), "nethttp")


def _java_route(text: str) -> tuple[str, str] | None:
    m = re.match(r"@(Get|Post|Put|Patch|Delete|Request)Mapping", text)
    if not m:
        return None
    asked, path = re.search(r"RequestMethod\.([A-Z]+)", text), re.search(r'"([^"]*)"', text)
    return (m[1].upper() if m[1] != "Request" else asked[1] if asked else "ROUTE"), path[1] if path else "/"


def _blank(source: str, language: str) -> str:
    """Comments and strings blanked out, places kept."""
    comment = r"#[^\n]*" if language in ("ruby",) else r"//[^\n]*|/\*.*?\*/"
    return re.sub(rf"{comment}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def extract_lexical(source: str, module: str, language: str) -> dict:
    code = _blank(source, language)
    lines = source.split("\n")
    found = []
    for kind, pattern in DECLARATIONS.get(language, []):
        for m in re.finditer(pattern, code, re.M):
            if m[1] in _RESERVED or any(m.start(1) == f[0] for f in found):
                continue
            start = code.count("\n", 0, m.start(1))
            if language == "ruby":
                pad = len(lines[start]) - len(lines[start].lstrip())
                end = next((i for i in range(start + 1, len(lines)) if re.match(rf"\s{{{pad}}}end\b", lines[i])), len(lines) - 1)
            else:
                depth, i, opened = 0, m.end(), False
                while i < len(code):
                    depth += (code[i] == "{") - (code[i] == "}")
                    opened = opened or code[i] == "{"
                    if (opened and depth == 0) or (not opened and code[i] == ";"):
                        break
                    i += 1
                end = code.count("\n", 0, min(i, len(code) - 1)) if code else start
            found.append((m.start(1), kind, m[1], start, end))
    found.sort()
    symbols, stack, routes, prefix = [], [], [], {}
    for _, kind, name, start, end in found:
        while stack and stack[-1][1] < start:
            stack.pop()
        owner = stack[-1] if stack else None
        q = f"{owner[0] if owner else module}.{name}"
        if kind == "function" and owner and owner[2] == "class":
            kind = "method"
        marks = _annotations(lines, start)
        symbols.append({"name": name, "qualified_name": q, "kind": kind, "signature": lines[start].strip()[:300], "docstring": None, "decorators": [m for m, _ in marks], "start_line": start + 1, "end_line": end + 1, "param_names": [], "body": "\n".join(lines[start : end + 1]), "seed": _seed("\n".join(lines[start : end + 1]), language), "visibility": _visibility(lines[start], language)})
        stack.append((q, end, kind))
        above = prefix.get(owner[0], "") if owner else ""
        for _, text in marks if language == "java" else ():
            if (found_route := _java_route(text)) and kind == "class":
                prefix[q] = found_route[1].rstrip("/")
            elif found_route:
                routes.append({"scope": q, "role": "server", "method": found_route[0], "path": above + found_route[1], "line": start + 1, "framework": "spring"})
    imports = _script_imports(source, module) if language in _SCRIPT else {m[2]: m[1] for m in _IMPORT["java"].finditer(source)} if language == "java" else {}
    refs, declared = [], {f[0] for f in found}

    def place(at: int) -> tuple[str, int]:
        line = code.count("\n", 0, at) + 1
        around = [s for s in symbols if s["start_line"] <= line <= s["end_line"] and s["kind"] != "class"]
        return (min(around, key=lambda s: s["end_line"] - s["start_line"])["qualified_name"] if around else f"{module}.__module__"), line

    def refer(name: str, left: str | None, kind: str, at: int) -> None:
        scope, line = place(at)
        refs.append({"scope": scope, "target_name": name, "ref_type": kind, "scope_module": imports.get(name) or imports.get(left), "line": line})

    for m in _CALL.finditer(code):
        if m[2] not in _RESERVED and m.start(2) not in declared:
            refer(m[2], m[1], "call", m.start(2))
    for at, route in _go_routes(source, code) if language == "go" else ():
        scope, line = place(at)
        routes.append({"scope": scope, "line": line, **route})
    if language in _SCRIPT:
        symbols.append({"name": "__module__", "qualified_name": f"{module}.__module__", "kind": "module", "signature": module, "docstring": None, "decorators": [], "start_line": 1, "end_line": len(lines), "param_names": [], "body": "", "seed": "module"})
        for m in _JSX.finditer(code):
            refer(m[1], m[1], "jsx", m.start(1))
        for m in _HANDED.finditer(code):
            for a in re.finditer(rf"(?:^|,)\s*{_NAME}\s*(?=,|$)", m[1]):
                refer(a[1], a[1], "callback_arg", m.start(1) + a.start(1))
        served = set()
        for at, route in _script_routes(source, code, imports):
            if not (route["framework"] is None and route["handler_name"] is None and len(arguments(code, code.index("(", at) + 1)) < 2):  # one argument: a client's call
                served.add(at)
                scope, line = place(at)
                routes.append({"scope": scope, "line": line, **route})
        for m in _CLIENT.finditer(source):
            path = template_path(m[3]) if code[m.start()] != " " and m.start() not in served else None
            if path:
                scope, line = place(m.start())
                routes.append({"scope": scope, "role": "client", "method": (m[1] or "").upper().replace("REQUEST", ""), "path": path, "line": line})
    return {"parse_error": False, "symbols": symbols, "refs": refs, "routes": routes}


def extract(files: DataFrame) -> DataFrame:
    """One row per file (path, language, content) with its symbols, refs and routes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, language, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = extract_python(content or "", module_name(path)) if language == "python" else extract_lexical(content or "", module_name(path), language)
                rows.append({"path": path, **got})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    struct = lambda **k: pa.list_(pa.struct(list(k.items())))
    s, i = pa.string(), pa.int32()
    arrow = pa.schema([
        ("path", s), ("parse_error", pa.bool_()),
        ("symbols", struct(name=s, qualified_name=s, kind=s, signature=s, docstring=s, decorators=pa.list_(s), start_line=i, end_line=i, param_names=pa.list_(s), body=s, seed=s, visibility=s)),
        ("refs", struct(scope=s, target_name=s, ref_type=s, scope_module=s, line=i)),
        ("routes", struct(scope=s, role=s, method=s, path=s, line=i, framework=s, handler_name=s, handler_module=s)),
    ])
    return files.select("path", "language", "content").mapInArrow(run, SCHEMA.replace("\n", " "))


def index(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, refs, routes) with stable ids: a hash of path, qualified name and start line. See ``tables``."""
    return tables(extract(files))


def tables(got: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, refs, routes) of extracted files. Of symbols with one name on one line the first counts."""
    s = got.where("not parse_error").select("path", F.posexplode("symbols").alias("at", "s")).select(F.col("path").alias("file_path"), "at", "s.*")
    first = Window.partitionBy("file_path", "qualified_name", "start_line").orderBy("at")
    s = s.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "at")
    s = s.withColumn("symbol_id", F.xxhash64("file_path", "qualified_name", "start_line")).withColumn("body_hash", F.sha2("seed", 256)).drop("seed")
    owner = s.groupBy("file_path", "qualified_name").agg(F.min("symbol_id").alias("src"))
    r = got.select("path", F.posexplode("refs").alias("at", "r")).select(F.col("path").alias("file_path"), "at", F.col("r.scope").alias("qualified_name"), "r.target_name", "r.ref_type", "r.scope_module", "r.line")
    r = r.join(owner, ["file_path", "qualified_name"]).withColumn("ref_id", F.xxhash64("file_path", "at", "target_name"))
    t = got.select("path", F.posexplode("routes").alias("at", "r")).select(F.col("path").alias("file_path"), "at", F.col("r.scope").alias("qualified_name"), "r.role", "r.method", F.col("r.path").alias("route"), "r.line", "r.framework", "r.handler_name", "r.handler_module")
    t = t.join(owner, ["file_path", "qualified_name"]).withColumnRenamed("src", "symbol_id").withColumn("route_id", F.xxhash64("file_path", "at", "route")).drop("at")
    return s, r, t


#: Names of files that stand for their folder. Fixed values.
INDEX_FILES = ("index.ts", "index.js", "index.tsx", "index.jsx", "index.mjs")


def only_passes_on(source: str) -> bool:
    """A script without a statement of its own: nothing, or names of other files handed on. Statements are told apart on the
    source with comments and texts blanked out: each begins with ``export``, then names in braces or a star."""
    code = re.sub(r"[{][^{}]*[}]", "{}", _blank(source, "javascript"))
    for statement in re.split(r";|\n(?=\s*\S+)", code):
        words = statement.split()
        if words and not (words[0].startswith("export") and "".join(words)[6:].startswith(("{}", "*", "type{}")) and "=" not in statement):
            return False
    return True


def marker_files(files: DataFrame) -> DataFrame:
    """(path) of index scripts that hold nothing of their own. files: path, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [p for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if only_passes_on(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], names=["path"])

    named = files.where(F.element_at(F.split("path", "/"), -1).isin(*INDEX_FILES))
    return named.select("path", "content").mapInArrow(run, "path string")
