"""Python source as rows: the structure of modules, and what scripts use.

One Arrow pass parses each file once and emits tagged rows; typed tables are
filters of it. Source that doesn't parse gives one row of kind 'error'.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.validation import CLASS_PATTERNS

STRUCTURE = "path string, kind string, name string, full_name string, owner string, line int, args array<string>, params_detailed array<string>, type string"
USAGE = "path string, kind string, name string, full_name string, target string, object string, line int, end_line int, seq int, args array<string>, kwargs map<string,string>, object_type string, instance boolean, imported array<string>"


def rendered(node: ast.AST | None, default: str = "Any") -> str:
    """An annotation as text."""
    return default if node is None else ast.unparse(node)


def parameters(args: ast.arguments) -> list[dict]:
    """name, type, kind, optional, default of each, without self; positional-only ones aren't listed."""
    found = []
    late = len(args.args) - len(args.defaults)
    for i, a in enumerate(args.args):
        if i == 0 and a.arg == "self":
            continue
        default = args.defaults[i - late] if i >= late else None
        found.append({"name": a.arg, "type": rendered(a.annotation), "kind": "positional", "optional": default is not None, "default": default})
    if args.vararg:
        found.append({"name": f"*{args.vararg.arg}", "type": rendered(args.vararg.annotation), "kind": "var_positional", "optional": True, "default": None})
    for a, default in zip(args.kwonlyargs, args.kw_defaults, strict=True):
        found.append({"name": a.arg, "type": rendered(a.annotation), "kind": "keyword_only", "optional": default is not None, "default": default})
    if args.kwarg:
        found.append({"name": f"**{args.kwarg.arg}", "type": rendered(args.kwarg.annotation, "Dict[str, Any]"), "kind": "var_keyword", "optional": True, "default": None})
    return found


def parameter_text(p: dict) -> str:
    """'[kind] name:type=default'; the kind of positional ones isn't written."""
    text = f"{p['name']}:{p['type']}"
    if p["optional"] and p["kind"] in ("positional", "keyword_only"):
        text += f"={rendered(p['default'], 'None')}"
    return text if p["kind"] == "positional" else f"[{p['kind']}] {text}"


def structure_of(source: str, module: str) -> Iterator[tuple]:
    """Public classes, their methods and attributes, functions and imports."""
    tree = ast.parse(source)
    inside: set[ast.AST] = set()
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def callable_row(kind: str, f: ast.FunctionDef | ast.AsyncFunctionDef, owner: str) -> tuple:
        params = parameters(f.args)
        return kind, f.name, f"{owner}.{f.name}", owner, f.lineno, [p["name"] for p in params], [parameter_text(p) for p in params], rendered(f.returns)

    for node in ast.walk(tree):
        if not isinstance(node, ast.ClassDef):
            continue
        full = f"{module}.{node.name}"
        yield "class", node.name, full, module, node.lineno, [], [], ""
        for item in node.body:
            if isinstance(item, functions):
                inside.add(item)
                if not item.name.startswith("_"):
                    yield callable_row("method", item, full)
            elif isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name) and not item.target.id.startswith("_"):
                yield "attribute", item.target.id, f"{full}.{item.target.id}", full, item.lineno, [], [], rendered(item.annotation)
    for node in ast.walk(tree):
        if isinstance(node, functions) and node not in inside and not node.name.startswith("_"):
            yield callable_row("function", node, module)
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.name, a.name, module, node.lineno, [], [], ""
        elif isinstance(node, ast.ImportFrom) and (node.module or node.level):
            name = "." * node.level + (node.module or "")
            yield "import", name, name, module, node.lineno, [], [], ""


def shown(node: ast.AST) -> str:
    """An argument as text."""
    if isinstance(node, ast.Constant):
        return repr(node.value)
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return chain(node) or "<?>"
    if isinstance(node, ast.Call):
        return f"{chain(node.func) or 'call'}(...)"
    return f"<{type(node).__name__}>"


#: Types of what methods and context managers give, and of an agent's streamed result.
METHOD_RESULT, CONTEXT_RESULT, STREAMED = "method_result", "context_manager_result", "pydantic_ai.StreamedRunResult"


class _Usage:
    """What a script uses, in one walk by breadth, with a table of the types of names as it stands at each visit.

    A name takes the class (or function) that it was last assigned a call of, a
    placeholder for results of methods and of `with` on methods, and, between
    the lines of an `async with` on run_stream of an agent, a streamed result's
    type. What had no type when it was visited takes the scope's or else the
    last one of all. Imports count from the start, wherever they stand.
    """

    def __init__(self, source: str) -> None:
        self.aliases: dict[str, str] = {}
        self.types: dict[str, str] = {}
        self.scopes: dict[str, tuple[int, int, str]] = {}
        self.done: set[int] = set()  # calls that their assignment or with has taken
        self.methods: set[int] = set()  # attributes that a call of their own has taken
        self.rows: list[list] = []
        nodes = list(ast.walk(ast.parse(source)))
        for node in nodes:
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                self._import(node)
        self.imported = sorted({(r[2] or r[1]).partition(".")[0] for r in self.rows})
        for node in nodes:
            self._visit(node)
        for row in self.rows:
            name, line = row[OBJECT], row[LINE]
            if name is not None and not row[TYPE]:
                first, last, kind = self.scopes.get(name, (1, 0, ""))
                row[TYPE] = kind if first <= line <= last else self.types.get(name)
            row.append(self.imported)

    def _full(self, name: str) -> str | None:
        top, dot, rest = name.partition(".")
        return self.aliases.get(name) or (self.aliases[top] + dot + rest if dot and top in self.aliases else None)

    def _row(self, kind: str, name: str, node: ast.AST, full: str | None = None, target: str | None = None, owner: str | None = None, call: ast.Call | None = None, instance: bool = False) -> None:
        line, end = getattr(node, "lineno", 0), getattr(node, "end_lineno", 0) or 0
        args = [shown(a) for a in call.args] if call else []
        kwargs = {k.arg: shown(k.value) for k in call.keywords if k.arg} if call else {}
        self.rows.append([kind, name, full, target, owner, line, end, len(self.rows), args, kwargs, self.types.get(owner) if owner else None, instance])

    def _import(self, node: ast.Import | ast.ImportFrom) -> None:
        module = (node.module or "") if isinstance(node, ast.ImportFrom) else None
        for a in node.names:
            alias = a.asname or a.name
            self.aliases[alias] = f"{module}.{a.name}" if module else a.name
            self._row("import" if module is None else "import_from", a.name, node, a.name if module is None else module, alias)

    def _method(self, call: ast.Call, target: str | None = None) -> None:
        owner, name = chain(call.func.value), chain(call.func)
        if owner:
            self._row("method_call", call.func.attr, call, self._full(name), target, owner, call)

    def _assign(self, node: ast.Assign) -> None:
        target, call = node.targets[0].id, node.value
        self.done.add(id(call))
        if isinstance(call.func, ast.Name):
            self._row("call", call.func.id, node, self._full(call.func.id), target, call=call, instance=True)
            self.types[target] = self._full(call.func.id) or call.func.id
        else:
            self.types[target] = METHOD_RESULT
            self._method(call, target)

    def _with(self, node: ast.With | ast.AsyncWith) -> None:
        for item in node.items:
            call, target = item.context_expr, item.optional_vars
            if not (isinstance(target, ast.Name) and isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute)):
                continue
            self.done.add(id(call))
            self._method(call, target.id)
            if isinstance(node, ast.With):
                self.types[target.id] = CONTEXT_RESULT
            elif call.func.attr == "run_stream" and "pydantic_ai" in self.types.get(chain(call.func.value) or "", ""):
                self.scopes[target.id] = node.lineno, node.end_lineno or node.lineno, STREAMED

    def _visit(self, node: ast.AST) -> None:
        if isinstance(node, ast.Assign):
            if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Call) and isinstance(node.value.func, (ast.Name, ast.Attribute)):
                self._assign(node)
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            self._with(node)
        elif isinstance(node, ast.Call) and id(node) not in self.done:
            if isinstance(node.func, ast.Attribute):
                self._method(node)
                self.methods.add(id(node.func))
            elif isinstance(node.func, ast.Name):
                full = self._full(node.func.id)
                self._row("call", node.func.id, node, full, call=node, instance=makes_object(node.func.id, full))
        elif isinstance(node, ast.Attribute) and id(node) not in self.methods:
            owner = chain(node.value)
            if owner:
                self._row("attribute", node.attr, node, self._full(chain(node)), owner=owner)


OBJECT, LINE, TYPE = 4, 5, 10


def chain(node: ast.AST) -> str | None:
    """A name with its attributes, if nothing else is in it."""
    if isinstance(node, ast.Name):
        return node.id
    before = chain(node.value) if isinstance(node, ast.Attribute) else None
    return f"{before}.{node.attr}" if before else None


def makes_object(name: str, full_name: str | None) -> bool:
    """As validation.is_class_call."""
    return name[:1].isupper() or any(p in (full_name or "") for p in CLASS_PATTERNS)


def usage_of(source: str) -> list[list]:
    """Imports, calls (assigned or not) and attribute uses, with the types of the objects that they are of."""
    return _Usage(source).rows


def _parsed(files: DataFrame, of, extra: tuple[str, ...], schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.replace("map<string,string>", "map").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, made = len(names) - 1, _arrow(schema)
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                path = batch.column("path")[i].as_py()
                rest = [batch.column(c)[i].as_py() or "" for c in extra]
                try:
                    rows += [(path, *r) for r in of(batch.column("source")[i].as_py() or "", *rest)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    blank: list = [None] * width
                    blank[0], blank[1] = "error", str(e)
                    rows.append((path, *blank))
            columns = zip(*map(_mapped, rows), strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    return files.select("path", "source", *extra).mapInArrow(run, schema)


def _mapped(row: tuple) -> list:
    return [list(v.items()) if isinstance(v, dict) else v for v in row]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [f.strip().split(" ", 1) for f in schema.replace("map<string,string>", "map<string;string>").split(",")]
    return pa.schema([(n, kinds[k.replace(";", ",")]) for n, k in fields])


def structure(files: DataFrame) -> DataFrame:
    """files: path, source, module. One row per class, method, attribute, function, import."""
    return _parsed(files, structure_of, ("module",), STRUCTURE)


def usage(scripts: DataFrame) -> DataFrame:
    """scripts: path, source. One row per import, call and attribute use, in order of
    their visit (seq), with object_type, for calls whether they make an object (instance),
    and the first segments of all that the script imports (imported)."""
    return _parsed(scripts, usage_of, (), USAGE)


def module_name(path: Column, package_dirs: Column) -> Column:
    """The dotted module of a file: from its outermost package folder, else
    without leading source folders. package_dirs: folders with an __init__.py."""
    parts = F.split(F.regexp_replace(path, r"(/__init__)?\.py$", ""), "/")
    folder = lambda i: F.array_join(F.slice(parts, 1, i), "/")
    outer = F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(F.array_contains(package_dirs, folder(i)), i)), lambda i: i.isNotNull()))
    bare = F.array_join(F.when(F.element_at(parts, 1).isin("src", "lib", "source", "python", "pkg", "packages") & (F.size(parts) > 1), F.slice(parts, 2, F.size(parts))).otherwise(parts), ".")
    return F.when(outer.isNotNull(), F.array_join(F.slice(parts, outer, F.size(parts)), ".")).otherwise(bare)
