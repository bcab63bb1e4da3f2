"""Source code as tables: one parse a file on the executors, all questions after that in DataFrame operations."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specto.functions import costs
from specto.functions.text import extension, root_segment
from specto.operators import scripts
from specto.operators.storage import cut
from specto.sources.python_path import importable

#: Calls by risk (a name without a dot stands for all calls on it), and type variables that say nothing about a function.
HIGH = ["subprocess", "os.system", "os.popen", "os.execv", "os.execve", "eval", "exec", "compile", "pickle.loads", "pickle.load", "pickle.dumps", "__import__", "importlib.import_module", "ctypes"]
MEDIUM = ["socket", "requests.get", "requests.post", "requests.put", "requests.delete", "requests.request", "httpx.get", "httpx.post", "httpx.Client", "urllib.request.urlopen", "urllib.urlopen", "paramiko", "ftplib", "smtplib"]
NOISE = ["T", "R", "V", "K", "S", "U", "_", "P"]

WORDS = "array<string>"
FUNCTION_SQL = f"struct<name:string,line:int,owner:string,params:{WORDS},calls:{WORDS},bare:{WORDS},names:{WORDS},roots:{WORDS},selfs:{WORDS},raises:{WORDS},warns:{WORDS},yields:boolean,doc:string,signature:string,open_write:boolean,source:string,shape:string>"
CLASS_SQL = f"struct<name:string,line:int,methods:{WORDS},attrs:{WORDS},doc:string,source:string>"
MODULE = f"file string, error string, imports {WORDS}, aliases {WORDS}, data {WORDS}, top_classes {WORDS}, top_functions {WORDS}, classes array<{CLASS_SQL}>, functions array<{FUNCTION_SQL}>"

LINE_END = re.compile(rb"\r\n|\n|\r")
Def = (ast.FunctionDef, ast.AsyncFunctionDef)
#: What a file may do to the parser; anything of it makes an error row.
TROUBLE = (SyntaxError, ValueError, RecursionError, MemoryError, AttributeError, TypeError)


def unique(items) -> list:
    return list(dict.fromkeys(items))


def own_nodes(function: ast.AST) -> Iterator[ast.AST]:
    """What belongs to a function itself, without the functions and lambdas inside it, from left to right."""
    todo = list(ast.iter_child_nodes(function))[::-1]
    while todo:
        node = todo.pop()
        if not isinstance(node, (*Def, ast.Lambda)):
            yield node
            todo += list(ast.iter_child_nodes(node))[::-1]


def writes(call: ast.Call) -> bool:
    """Whether an open() may write: a mode with w, a, x or +, or one that can't be read from the code."""
    mode = call.args[1] if len(call.args) > 1 else next((k.value for k in call.keywords if k.arg == "mode"), None)
    return mode is not None and not (isinstance(mode, ast.Constant) and isinstance(mode.value, str) and not set("wax+") & set(mode.value))


def signature(function: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """The head in one line. Positional-only parameters, annotations of keyword-only ones and a bare star aren't shown."""
    args = function.args
    value = lambda default: f" = {ast.unparse(default)}" if default is not None else ""
    optional = dict(zip([a.arg for a in reversed(args.args)], reversed(args.defaults), strict=False))
    shown = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") + value(optional.get(a.arg)) for a in args.args]
    shown += [f"*{args.vararg.arg}"] if args.vararg else []
    shown += [a.arg + value(d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    shown += [f"**{args.kwarg.arg}"] if args.kwarg else []
    back = f" -> {ast.unparse(function.returns)}" if function.returns else ""
    return f"{'async ' if isinstance(function, ast.AsyncFunctionDef) else ''}def {function.name}({', '.join(shown)}){back}:"


def first_line(node: ast.AST) -> str | None:
    doc = (ast.get_docstring(node) or "").strip()
    return doc.splitlines()[0] if doc else None


class Source:
    """The text of a file, from which definitions are cut by line and byte."""

    def __init__(self, text: str) -> None:
        self.data = text.encode("utf-8", "surrogatepass")
        self.starts = [0, *(m.end() for m in LINE_END.finditer(self.data))]

    def of(self, node: ast.AST) -> str:
        a, b = self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset
        return self.data[a:b].decode("utf-8", "surrogatepass")


def dotted(node: ast.AST) -> str:
    """An expression as text; names with attributes, as most calls are, without the general printer."""
    parts, at = [], node
    while type(at) is ast.Attribute:
        parts.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(parts)]) if type(at) is ast.Name else ast.unparse(node)


def shape(function: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """A hash of what a function does: its syntax below the head, without places, comments, format and docstring."""
    body = function.body[1:] if ast.get_docstring(function, clean=False) is not None else function.body
    return hashlib.md5("\n".join(map(ast.dump, body)).encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


def describe(function: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None, source: Source) -> dict:
    args = function.args
    bound = {a.arg for a in (*args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg)))}
    calls, loads, on_names = [], [], []
    for n in ast.walk(function):
        kind = type(n)
        if kind is ast.Name:
            if type(n.ctx) is ast.Load:
                loads.append(n.id)
            elif type(n.ctx) is ast.Store:
                bound.add(n.id)
        elif kind is ast.Call:
            calls.append(n)
        elif kind is ast.Attribute:
            if type(n.value) is ast.Name:
                on_names.append(n)
        elif kind in Def and n is not function:
            bound.add(n.name)
    raises, warns, yields = [], [], False
    for n in own_nodes(function):
        if isinstance(n, ast.Call):
            warns.append(dotted(n.func))
        elif isinstance(n, ast.Raise):
            raises += [dotted(n.exc.func if isinstance(n.exc, ast.Call) else n.exc)] if n.exc else []
        elif isinstance(n, (ast.Yield, ast.YieldFrom)):
            yields = True
    return {
        "name": function.name,
        "line": function.lineno,
        "owner": owner,
        "params": [a.arg for a in args.args],
        "calls": unique(dotted(n.func) for n in calls),
        "bare": unique(n.func.id for n in calls if type(n.func) is ast.Name),
        "names": unique(x for x in loads if x not in bound and x not in NOISE),
        "roots": unique(n.value.id for n in on_names if n.value.id not in bound),
        "selfs": unique(n.attr for n in on_names if n.value.id == "self" and type(n.ctx) is ast.Load),
        "raises": unique(raises),
        "warns": unique(c for c in warns if "warn" in c.lower()),
        "yields": yields,
        "doc": first_line(function),
        "signature": signature(function),
        "open_write": any(type(n.func) is ast.Name and n.func.id == "open" and writes(n) for n in calls),
        "source": source.of(function),
        "shape": shape(function),
    }


def assigned(body: list[ast.stmt]) -> list[str]:
    """Plain names that assignments of a body give values to; targets in tuples and augmented ones are none."""
    targets = [t for n in body for t in (n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else [])]
    return unique(t.id for t in targets if isinstance(t, ast.Name))


def set_on_self(method: ast.AST) -> list[str]:
    return [n.attr for n in ast.walk(method) if type(n) is ast.Attribute and type(n.ctx) is ast.Store and type(n.value) is ast.Name and n.value.id == "self"]


def describe_class(node: ast.ClassDef, source: Source) -> dict:
    """A class's methods, and its attributes: those of its body and those that methods store on self."""
    methods = [m for m in node.body if isinstance(m, Def)]
    stored = [x for m in methods for x in set_on_self(m)]
    return {"name": node.name, "line": node.lineno, "methods": [m.name for m in methods], "attrs": unique(assigned(node.body) + stored), "doc": first_line(node), "source": source.of(node)}


def found_imports(node: ast.Import | ast.ImportFrom) -> list[str]:
    """Modules by their first segment."""
    named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module] if node.module else []
    return [m.split(".")[0] for m in named]


def full_imports(node: ast.Import | ast.ImportFrom) -> list[str]:
    return [a.name if isinstance(node, ast.Import) else f"{node.module or ''}.{a.name}" for a in node.names]


@lru_cache(4_096)
def statement(text: str) -> str:
    """A statement of the top level as it is printed; the same imports and values stand in many files."""
    return ast.unparse(ast.parse(text))


def by_depth(tree: ast.AST) -> tuple[list[ast.AST], list[int]]:
    """The nodes of a tree in the order of ast.walk(), and how deep each is."""
    every, depths, level, depth = [], [], [tree], 0
    while level:
        every += level
        depths += [depth] * len(level)
        level, depth = [child for n in level for child in ast.iter_child_nodes(n)], depth + 1
    return every, depths


class Module:
    """A Python file, parsed once and described once, for all that is asked of it."""

    def __init__(self, text: str) -> None:
        self.tree = ast.parse(text)
        self.every, self.depths = by_depth(self.tree)
        source = self.source = Source(text)
        self.lines = len(source.starts) - 1
        owners = {id(m): c.name for c in self.every if isinstance(c, ast.ClassDef) for m in c.body if isinstance(m, Def)}
        self.classes = {id(n): describe_class(n, source) for n in self.every if isinstance(n, ast.ClassDef)}
        self.functions = {id(n): describe(n, owners.get(id(n)), source) for n in self.every if isinstance(n, Def)}

    def found(self) -> dict:
        """What the file defines and uses.

        imports: modules by their first segment, from anywhere; aliases, data, top_classes, top_functions: the vocabulary of
        the top-level statements, where a plain import binds its first segment; classes and functions: all of them, methods
        and nested ones too, breadth first.
        """
        top = self.tree.body
        return {
            "imports": unique(x for n in self.every if isinstance(n, (ast.Import, ast.ImportFrom)) for x in found_imports(n)),
            "aliases": unique((a.asname or a.name).split(".")[0] if isinstance(n, ast.Import) else a.asname or a.name for n in top if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names),
            "data": assigned(top),
            "top_classes": unique(n.name for n in top if isinstance(n, ast.ClassDef)),
            "top_functions": unique(n.name for n in top if isinstance(n, Def)),
            "classes": list(self.classes.values()),
            "functions": list(self.functions.values()),
        }

    def compress(self, tags: bool = False, resolve_self: bool = False) -> str:
        """The module in short: imports, assignments and pure functions stay; of other functions the signature, first doc line and needs.

        With `tags`, the needs tell raised exceptions, generators and warnings. With `resolve_self`, methods are judged by what
        they take from self, and the class keeps its assignments, its constructor and a list of attributes set elsewhere.
        Other statements are left out.
        """
        found = self.found()
        return "\n".join(line for part in self.short(tags, resolve_self) for line in part(found))

    def short(self, tags: bool = False, resolve_self: bool = False) -> list[Callable[[dict], list[str]]]:
        """The parts of compress(): each gives its lines by what the whole module has, as found() tells it."""
        out: list[Callable[[dict], list[str]]] = []

        def whole(node: ast.AST, indent: str) -> None:
            lines = [indent + line for line in ast.unparse(node).splitlines()]
            out.append(lambda _: lines)

        def put(node: ast.AST, indent: str, known: dict | None = None) -> None:
            f, kept = self.functions[id(node)], []

            def lines(module: dict) -> list[str]:
                found = needs(f, module, known)
                if len(found["interne"]) < 2 and not (found["data"] or found["type"] or found["externe"]):
                    if not kept:
                        kept.append([indent + line for line in ast.unparse(node).splitlines()])
                    return kept[0]
                shown = {k: v for k, v in found.items() if v} | ({k: f[k] for k in ("raises", "yields", "warns") if f[k]} if tags else {})
                doc = [f'    """{f["doc"]}"""'] if f["doc"] else []
                return [indent + line for line in [f["signature"], *doc, f"    # needs: {json.dumps(shown)}"]]

            out.append(lines)

        def put_class(node: ast.ClassDef) -> None:
            own = self.classes[id(node)]
            makers = [m for m in node.body if isinstance(m, Def) and m.name in ("__init__", "__new__")] if resolve_self else []
            head = [f"class {node.name}({', '.join(map(ast.unparse, node.bases))}):"]
            if own["doc"]:
                head.append(f'    """{own["doc"]}"""')
            out.append(lambda _: head)
            if resolve_self:
                for inner in node.body:
                    if isinstance(inner, (ast.Assign, ast.AnnAssign)):
                        whole(inner, "    ")
                if rest := sorted(set(own["attrs"]).difference(*map(set_on_self, makers))):
                    out.append(lambda _: [f"    # attrs: {', '.join(rest)}"])
            for inner in node.body:
                if inner in makers:
                    whole(inner, "    ")
                elif isinstance(inner, Def):
                    put(inner, "    ", own if resolve_self else None)

        for node in self.tree.body:
            if isinstance(node, Def):
                put(node, "")
            elif isinstance(node, ast.ClassDef):
                put_class(node)
            elif isinstance(node, (ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign)):
                own = self.source.of(node)
                text = statement(own) if len(own) <= LENGTH else ast.unparse(node)
                out.append(lambda _, text=text: [text])
        return out


#: Where a definition of the top level may begin; what is before it is a piece of the module if it parses by itself.
START = re.compile(r"^(?:@|(?:async[ \t]+def|def|class)[ \t])", re.MULTILINE)
PIECES = 4_096  # definitions that a Python worker remembers, of at most
LENGTH = 8_192  # characters


def pieces(text: str) -> list[str]:
    """A text cut before its definitions of the top level, with their decorators; a cut may be wrong, within a string or a statement."""
    cuts, decorated = [0], False
    for m in START.finditer(text):
        if not decorated:
            cuts.append(m.start())
        decorated = m[0] == "@"
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class Piece:
    """Statements of the top level, read by themselves, for any module that has them; what they hold is told with its depth in the tree."""

    def __init__(self, text: str) -> None:
        module = Module(text)
        self.lines, self.found, self.short = module.lines, module.found(), module.short()
        some = [(d, n) for d, n in zip(module.depths, module.every, strict=True) if isinstance(n, (ast.Import, ast.ImportFrom, ast.ClassDef, *Def))]
        at = lambda kinds: [(d, n) for d, n in some if isinstance(n, kinds)]
        out = outlined([n for _, n in some])
        methods = {id(m) for _, c in at(ast.ClassDef) for m in ast.walk(c)}
        free = [d for d, n in at(ast.FunctionDef) if id(n) not in methods]
        self.imports = [(d, found_imports(n)) for d, n in at((ast.Import, ast.ImportFrom))]
        self.full_imports = [(d, full_imports(n)) for d, n in at((ast.Import, ast.ImportFrom))]
        self.classes = [(d, module.classes[id(n)]) for d, n in at(ast.ClassDef)]
        self.functions = [(d, module.functions[id(n)]) for d, n in at(Def)]
        self.outlined_classes = [(d, c) for (d, _), c in zip(self.classes, out["classes"], strict=True)]
        self.outlined_functions = list(zip(free, out["functions"], strict=True))

    @classmethod
    @lru_cache(PIECES)
    def known(cls, text: str) -> Piece:
        return cls(text)


class Pieces:
    """A Python file of pieces that parse by themselves, each of which is read once for all files that have it; says what Module says of the whole."""

    def __init__(self, text: str) -> None:
        if "barry_as_FLUFL" in text:
            raise SyntaxError("an import that changes the grammar of what follows")
        first, *rest = pieces(text)  # what is before the first definition is rarely the same in two files
        self.pieces = [Piece(first), *(Piece.known(x) if len(x) <= LENGTH else Piece(x) for x in rest)]

    def placed(self, name: str) -> list:
        """A list of all pieces in the order of a walk over the whole tree: by depth, then by place."""
        return [x for _, x in sorted((x for p in self.pieces for x in getattr(p, name)), key=lambda x: x[0])]

    def found(self) -> dict:
        after, out = 0, {"imports": unique(x for names in self.placed("imports") for x in names)}
        for k in ("aliases", "data", "top_classes", "top_functions"):
            out[k] = unique(x for p in self.pieces for x in p.found[k])
        places: dict[str, list] = {"classes": [], "functions": []}
        for p in self.pieces:
            for k, own in places.items():
                own += [(d, x | {"line": x["line"] + after}) for d, x in getattr(p, k)]
            after += p.lines
        return out | {k: [x for _, x in sorted(own, key=lambda x: x[0])] for k, own in places.items()}

    def outline(self) -> dict:
        return {"imports": [x for names in self.placed("full_imports") for x in names], "classes": self.placed("outlined_classes"), "functions": self.placed("outlined_functions")}

    def compress(self, found: dict) -> str:
        return "\n".join(line for p in self.pieces for part in p.short for line in part(found))


def parse(text: str) -> dict:
    return Module(text).found()


def compress(text: str, tags: bool = False, resolve_self: bool = False) -> str:
    return Module(text).compress(tags, resolve_self)


def needs(f: dict, module: dict, known: dict | None = None) -> dict[str, list[str]]:
    """What a function takes from its module, each name under the first kind that knows it; with a class, also what it takes from self."""
    found: dict[str, set[str]] = {"data": set(), "type": set(), "interne": set(), "externe": set()}
    kinds = [("data", module["data"]), ("interne", module["top_functions"]), ("type", module["top_classes"]), ("externe", module["aliases"])]
    for name in f["names"]:
        if kind := next((k for k, names in kinds if name in names), None):
            found[kind].add(name)
    found["externe"] |= set(f["roots"]) & set(module["aliases"])
    for name in f["selfs"] if known else []:
        if name in known["methods"]:
            found["interne"].add(f"self.{name}")
        elif name in known["attrs"]:
            found["data"].add(f"self.{name}")
    return {k: sorted(v) for k, v in found.items()}


def outline(text: str) -> dict:
    return outlined(list(ast.walk(ast.parse(text))))


def outlined(every: list[ast.AST]) -> dict:
    """The tree of a module, given all its nodes: full imports, classes with their functions, free functions, their calls and what they raise by name.

    Only plain functions count, not async ones. A call on something that is no name has `?` for it.
    """

    def function(node: ast.FunctionDef) -> dict:
        inside = list(ast.walk(node))
        calls = [n.func for n in inside if isinstance(n, ast.Call)]
        names = [c.id if isinstance(c, ast.Name) else f"{c.value.id if isinstance(c.value, ast.Name) else '?'}.{c.attr}" for c in calls if isinstance(c, (ast.Name, ast.Attribute))]
        raised = [n.exc.func.id for n in inside if isinstance(n, ast.Raise) and isinstance(n.exc, ast.Call) and isinstance(n.exc.func, ast.Name)]
        return {"name": node.name, "params": [a.arg for a in node.args.args], "calls": unique(names), "raises": raised}

    classes = [(c, [n for n in ast.walk(c) if isinstance(n, ast.FunctionDef)]) for c in every if isinstance(c, ast.ClassDef)]
    inside = {id(n) for _, methods in classes for n in methods}
    return {
        "imports": [x for n in every if isinstance(n, (ast.Import, ast.ImportFrom)) for x in full_imports(n)],
        "classes": [{"name": c.name, "methods": [function(m) for m in methods]} for c, methods in classes],
        "functions": [function(n) for n in every if isinstance(n, ast.FunctionDef) and id(n) not in inside],
    }


def message(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def each_file(files: DataFrame, one: dict[str, Callable[[str], dict]], schema: str) -> DataFrame:
    """file, error and what the function for its language in `one` makes of each file; a file that it can't take has an error and nulls, the job goes on."""
    kinds = files.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([pa.field(f.name, t) for f, t in zip(kinds.fields, map(arrow_type, (f.dataType for f in kinds.fields)), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, error, lang in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                try:
                    rows.append({"error": error} | (one[lang](text or "") if error is None else {}))
                except TROUBLE as e:
                    rows.append({"error": message(e)})
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in arrow if f.name != "file"]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *columns], schema=arrow)

    importable(files.sparkSession)
    lang = language(F.col("file"))
    error = F.when(~lang.isin(*one), F.concat(F.lit("not done for "), lang))
    error = F.coalesce("error", error) if "error" in files.columns else error
    return files.select("file", "text", error.alias("error"), lang.alias("lang")).mapInArrow(run, schema)


def for_all(python: Callable[[str], dict], script: Callable[[str], dict]) -> dict[str, Callable[[str], dict]]:
    return {lang: python if lang == "python" else script for lang in languages().values()}


def arrow_type(kind) -> pa.DataType:
    from pyspark.sql import types as T

    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[kind.simpleString()]


def modules(files: DataFrame) -> DataFrame:
    """What parse() finds in each file (file, text and, if there is one, the error of reading it), one row a file."""
    return each_file(files, for_all(parse, scripts.parse), MODULE)


def compressed(files: DataFrame, tags: bool = False, resolve_self: bool = False) -> DataFrame:
    """file, error, compressed of each file."""
    return each_file(files, for_all(lambda text: {"compressed": compress(text, tags, resolve_self)}, lambda text: {"compressed": scripts.compress(text)}), "file string, error string, compressed string")


OUTLINE_FUNCTION = f"struct<name:string,params:{WORDS},calls:{WORDS},raises:{WORDS}>"
OUTLINE = f"struct<imports:{WORDS},classes:array<struct<name:string,methods:array<{OUTLINE_FUNCTION}>>>,functions:array<{OUTLINE_FUNCTION}>>"


def outlines(files: DataFrame) -> DataFrame:
    """file, error, imports, classes (with their methods), functions: the tree of each Python module."""
    return each_file(files, {"python": outline}, f"file string, error string, imports {WORDS}, classes array<struct<name:string,methods:array<{OUTLINE_FUNCTION}>>>, functions array<{OUTLINE_FUNCTION}>")


def with_sizes(files: DataFrame, short: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    """sizes() of files and their compressed forms (file, compressed, error), joined by file."""
    return sizes(files.select("file", "text").join(short.select("file", "compressed", "error"), "file"), count)


def sizes(both: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    """file, error, compressed, tokens_before, tokens_after and the percentage saved, by any counter of tokens, of rows that hold text and compressed."""
    out = both.select("file", count(F.col("text")).alias("tokens_before"), "compressed", "error", count(F.col("compressed")).alias("tokens_after"))
    return out.withColumn("reduction_pct", costs.reduction_pct(F.col("tokens_before"), F.col("tokens_after")))


def file_costs(sized: DataFrame) -> DataFrame:
    """file and what a request costs with the file as it is and compressed, from the tokens that with_sizes() gives."""
    found = costs.request_cost(F.col("tokens_before"), F.col("tokens_after"))
    return sized.select("file", *[c.alias(k) for k, c in found.items()])


def functions(parsed: DataFrame) -> DataFrame:
    """One row a function, in the order of the walk."""
    return parsed.select("file", F.posexplode("functions").alias("ord", "f")).select("file", "ord", "f.*")


def names_in(functions: Column | str) -> Column:
    return F.transform(functions, lambda f: f["name"])


def call_edges(parsed: DataFrame) -> DataFrame:
    """file, caller, callee of calls by bare name to functions of the same file; definitions of one name are taken together.

    A file is one row, so its calls meet its functions there (a semi join) and nothing is shuffled.
    """
    own = lambda f: F.transform(F.filter(f["bare"], lambda c: F.array_contains(F.col("known"), c)), lambda c: F.struct(f["name"].alias("caller"), c.alias("callee")))
    return parsed.select("file", "functions", names_in("functions").alias("known")).select("file", F.inline(F.array_distinct(F.flatten(F.transform("functions", own)))))


KINDS = ("data", "type", "interne", "externe")


def needs_of(f: Column, resolve_self: bool = False) -> list[Column]:
    """data, type, interne, externe of a function, beside the columns of its module: its names that are no locals, by the first kind that knows them."""
    data, functions, classes, aliases = (F.col(c) for c in ("data", "top_functions", "top_classes", "aliases"))
    unknown = F.array_except(f["names"], data)
    outer = F.array_except(unknown, functions)
    found = {
        "data": F.array_intersect(f["names"], data),
        "type": F.array_intersect(outer, classes),
        "interne": F.array_intersect(unknown, functions),
        "externe": F.array_union(F.array_intersect(F.array_except(outer, classes), aliases), F.array_intersect(f["roots"], aliases)),
    }
    if resolve_self:
        own = F.try_element_at(F.filter("classes", lambda c: c["name"] == f["owner"]), F.lit(1))
        none = F.array().cast(WORDS)
        methods, attrs = F.coalesce(own["methods"], none), F.coalesce(own["attrs"], none)
        named = lambda names: F.transform(names, lambda x: F.concat(F.lit("self."), x))
        found["interne"] = F.array_union(found["interne"], named(F.array_intersect(f["selfs"], methods)))
        found["data"] = F.array_union(found["data"], named(F.array_intersect(F.array_except(f["selfs"], methods), attrs)))
    return [F.sort_array(found[k]).alias(k) for k in KINDS]


def dependencies(parsed: DataFrame, resolve_self: bool = False) -> DataFrame:
    """file, ord, name, data, type, interne, externe, role of each function: its names that are no locals, by the first kind that knows them.

    Known are the names of top-level statements. With `resolve_self`, methods also depend on what they take from self.
    """
    own = F.transform("functions", lambda f, i: F.struct(i.alias("ord"), f["name"].alias("name"), *needs_of(f, resolve_self)))
    role = costs.role(F.size("interne"), F.size("data") + F.size("type") + F.size("externe"))
    return parsed.select("file", F.inline(own)).withColumn("role", role)


def matches(call: Column, names: list[str]) -> Column:
    return call.isin(names) | root_segment(call).isin(names)


def scanned(parsed: DataFrame) -> DataFrame:
    """file, risks: name, line, high, medium of each function of the Python files that parse, one row a file.

    A call of high risk is no medium one, and an open() counts where it may write. Line and mode are those of the first
    function of the name in the file.
    """

    def one(f: Column) -> Column:
        first = F.try_element_at("functions", F.array_position("known", f["name"]).cast("int"))
        risky = F.filter(f["calls"], lambda c: c != "open")
        medium = F.filter(risky, lambda c: ~matches(c, HIGH) & matches(c, MEDIUM))
        opens = F.array_contains(f["calls"], "open") & first["open_write"]
        return F.struct(f["name"].alias("name"), first["line"].alias("line"), F.filter(risky, lambda c: matches(c, HIGH)).alias("high"), F.when(opens, F.array_append(medium, F.lit("open"))).otherwise(medium).alias("medium"))

    own = parsed.where(F.col("error").isNull() & F.col("file").endswith(".py")).select("file", "functions", names_in("functions").alias("known"))
    return own.select("file", F.transform("functions", one).alias("risks"))


def security_surface(parsed: DataFrame) -> DataFrame:
    """file, name, line, level (high, medium, clean), calls: the risky calls of each function; high ones hide medium ones."""
    level = F.when(F.size("high") > 0, "high").when(F.size("medium") > 0, "medium").otherwise("clean")
    hit = F.when(F.size("high") > 0, F.col("high")).otherwise(F.col("medium"))
    return scanned(parsed).select("file", F.inline("risks")).select("file", "name", "line", level.alias("level"), hit.alias("calls"))


def is_high(r: Column) -> Column:
    return F.size(r["high"]) > 0


def is_medium(r: Column) -> Column:
    return ~is_high(r) & (F.size(r["medium"]) > 0)


def security_summary(parsed: DataFrame) -> DataFrame:
    """One row: functions of high and of medium risk, functions and files scanned, and files without a risky function."""
    counts = scanned(parsed).select(F.size(F.filter("risks", is_high)).alias("high"), F.size(F.filter("risks", is_medium)).alias("medium"), F.size("risks").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    clean = F.count_if(F.col("high") + F.col("medium") == 0)
    return counts.agg(total("high").alias("high_risk_count"), total("medium").alias("medium_risk_count"), total("n").alias("total_functions_scanned"), F.count("*").alias("total_files_scanned"), clean.alias("clean_files"))


def clean_files(parsed: DataFrame) -> DataFrame:
    """The Python files without a risky function."""
    return scanned(parsed).where(~F.exists("risks", lambda r: is_high(r) | is_medium(r))).select("file")


def risk_histogram(parsed: DataFrame) -> DataFrame:
    """Risky calls, high and medium ones, by their root module."""
    calls = F.flatten(F.transform("risks", lambda r: F.concat(r["high"], r["medium"])))
    return scanned(parsed).select(F.explode(calls).alias("call")).groupBy(root_segment(F.col("call")).alias("module")).agg(F.count("*").alias("n"))


def repo_totals(parsed: DataFrame) -> DataFrame:
    """Files that parse, their different top-level functions and classes, different names (of scripts: modules) that they import, and files with errors.

    Methods of scripts count as functions.
    """
    good = parsed.where("error is null")
    totals = parsed.agg(F.count_if(F.col("error").isNull()).alias("files"), F.coalesce(F.sum(F.size("top_functions")), F.lit(0)).alias("functions"), F.coalesce(F.sum(F.size("top_classes")), F.lit(0)).alias("classes"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    names = F.when(language(F.col("file")) == "python", F.col("aliases")).otherwise(F.col("imports"))
    imports = good.select(F.explode(names).alias("module")).agg(F.count_distinct("module").alias("imports"))
    return totals.crossJoin(F.broadcast(imports))  # one row each


def expand(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, name, kind, source, data, type, interne, externe, missing for the wanted (file, name): the first definition of each, or none.

    A class has no dependencies. Where a class and a function share a name, the one that stands first in the file is meant.
    """
    function = F.transform("functions", lambda f, i: F.struct(f["line"].alias("line"), F.lit("function").alias("kind"), f["name"].alias("name"), f["source"].alias("source"), i.alias("ord")))
    class_ = F.transform("classes", lambda c: F.struct(c["line"].alias("line"), F.lit("class").alias("kind"), c["name"].alias("name"), c["source"].alias("source"), F.lit(None).cast("int").alias("ord")))
    vocabulary = ("data", "top_functions", "top_classes", "aliases")
    own = wanted.withColumnRenamed("name", "wanted").join(parsed.select("file", "functions", F.concat(function, class_).alias("places"), *vocabulary), "file", "left")
    own = own.withColumn("place", F.array_min(F.filter("places", lambda p: p["name"] == F.col("wanted"))))  # the first by line
    own = own.withColumn("f", F.try_element_at("functions", F.col("place.ord") + 1))
    out = own.select("file", F.col("wanted").alias("name"), "place.kind", "place.source", *needs_of(F.col("f")))
    return out.withColumn("missing", F.col("source").isNull())


def flat_contract(parsed: DataFrame) -> DataFrame:
    """file, ord, name, params, calls: the calls of each function to functions of its file, in order of first use."""
    one = lambda f, i: F.struct(i.alias("ord"), f["name"].alias("name"), f["params"].alias("params"), F.filter(f["bare"], lambda c: F.array_contains(F.col("known"), c)).alias("calls"))
    return parsed.select("file", "functions", names_in("functions").alias("known")).select("file", F.inline(F.transform("functions", one)))


def contract_json(parsed: DataFrame) -> DataFrame:
    """file, contract: the imports and the functions with their parameters and all their calls, as JSON text; or the error."""
    entry = F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["params"].alias("params"), f["calls"].alias("calls"), f["doc"].alias("doc")))
    return parsed.select("file", F.to_json(F.struct("error", "imports", entry.alias("functions"))).alias("contract"))


def languages() -> dict[str, str]:
    """Language by extension."""
    return {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx"}


def language(file: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in languages().items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(file)), F.lit("python"))


def health(files: DataFrame, parsed: DataFrame, short: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    """language_sums() of files, modules() and compressed() of them, joined by file."""
    own = files.select("file", "text").join(parsed.select("file", "error", "top_functions", "top_classes"), "file").join(short.select("file", "compressed"), "file", "left")
    return language_sums(own, count)


def language_sums(rows: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    """Per language: files, functions, classes, raw and compressed tokens; a file that couldn't be compressed counts as it is. Files with errors are left out."""
    own = rows.where("error is null").select(language(F.col("file")).alias("lang"), F.size("top_functions").alias("f"), F.size("top_classes").alias("c"), count(F.col("text")).alias("raw"), F.when(F.col("compressed").isNotNull(), count(F.col("compressed"))).alias("short"))
    return own.groupBy("lang").agg(F.count("*").alias("files"), F.sum("f").alias("functions"), F.sum("c").alias("classes"), F.sum("raw").alias("raw"), F.sum(F.coalesce("short", "raw")).alias("compressed"))


def health_totals(by_language: DataFrame) -> DataFrame:
    """The rows of health() and one for all languages (whose lang is null), with the percentage gained."""
    sums = by_language.rollup("lang").agg(*[F.sum(c).alias(c) for c in ("files", "functions", "classes", "raw", "compressed")])
    return sums.withColumn("gain_pct", costs.reduction_pct(F.col("raw"), F.col("compressed")))


def status_json(by_language: DataFrame, histogram: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row of JSON text: languages, tokens, risky calls and the errors of a repository (lists by language, module and error; files with one error are counted)."""
    langs = by_language.agg(F.sort_array(F.collect_list(F.struct("lang", "files", "functions", "classes", "raw", "compressed"))).alias("by_language"), F.sum("raw").alias("raw"), F.sum("compressed").alias("short"))
    risks = histogram.agg(F.sort_array(F.collect_list(F.struct("module", "n"))).alias("security"))
    errors = parsed.where("error is not null").groupBy("error").agg(F.count("*").alias("files")).agg(F.sort_array(F.collect_list(F.struct("error", "files"))).alias("errors"))
    one = langs.crossJoin(F.broadcast(risks)).crossJoin(F.broadcast(errors))  # one row each
    tokens = F.struct("raw", F.col("short").alias("compressed"), costs.reduction_pct(F.col("raw"), F.col("short")).alias("gain_pct")).alias("tokens")
    return one.select(F.to_json(F.struct("by_language", tokens, "security", "errors")).alias("status"))


def status_lines(by_language: DataFrame, histogram: DataFrame, parsed: DataFrame, errors: int = 5) -> DataFrame:
    """section, ord, label, value: the same as a report, languages by name, risks by count and the first few errors with how many more there are."""
    from specto.functions.text import thousands

    langs = health_totals(by_language).select(F.lit("language").alias("section"), F.row_number().over(_by(F.col("lang").asc_nulls_last())).alias("ord"), F.coalesce("lang", F.lit("Total")).alias("label"), F.concat_ws(" ", thousands(F.col("files")), thousands(F.col("functions")), thousands(F.col("classes")), thousands(F.col("raw")), thousands(F.col("compressed")), F.concat("gain_pct", F.lit("%"))).alias("value"))
    risks = histogram.select(F.lit("security").alias("section"), F.row_number().over(_by(F.desc("n"), F.col("module"))).alias("ord"), F.col("module").alias("label"), thousands(F.col("n")).alias("value"))
    bad = parsed.where("error is not null").select("file", "error")
    few = bad.orderBy("file").limit(errors).select(F.lit("errors").alias("section"), F.row_number().over(_by(F.col("file"))).alias("ord"), F.col("file").alias("label"), F.col("error").alias("value"))
    more = bad.agg((F.count("*") - errors).alias("n")).where("n > 0").select(F.lit("errors").alias("section"), F.lit(errors + 1).alias("ord"), F.lit("more").alias("label"), thousands(F.col("n")).alias("value"))
    return langs.unionByName(risks).unionByName(few).unionByName(more)


def _by(*order):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*order)  # over a few rows: languages, modules of risk, or the errors shown


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, name, change, was: what became of each function between two versions of a source tree, both as modules() or parses.indexed() give them.

    Functions are the same by file, class, name and, where that repeats, order. Change is unchanged, body_only (another
    shape under the same signature), breaking (another signature), added or removed. A function that is gone and one that
    is new are one if they have the same shape and no other gone or new one has: in the same file it is renamed, under the
    same name in another file it is moved, and `was` tells its old name or file. Format, comments and docstrings are no
    change. Files that don't parse have no functions.
    """

    def listed(tree: DataFrame, side: str) -> DataFrame:
        one = lambda f, i: F.struct(F.coalesce(f["owner"], F.lit("")).alias("owner"), f["name"].alias("name"), F.size(F.filter(F.slice("functions", 1, i), lambda g: (g["name"] == f["name"]) & g["owner"].eqNullSafe(f["owner"]))).alias("nth"), F.struct(f["signature"].alias("head"), f["shape"].alias("shape")).alias(side))
        return tree.where("error is null").select("file", F.inline(F.transform("functions", one)))

    key = ["file", "owner", "name", "nth"]
    both = cut(listed(old, "a").join(listed(new, "b"), key, "full_outer"))
    plain = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.head") != F.col("b.head"), "breaking").when(F.col("a.shape") != F.col("b.shape"), "body_only").otherwise("unchanged")
    kept = both.where("a is not null and b is not null").select("file", "name", plain.alias("change"), F.lit(None).cast("string").alias("was"))
    apart = both.where("a is null or b is null").select(*key, plain.alias("change"), F.coalesce("a.shape", "b.shape").alias("shape"))

    def paired(by: list[str], rest: DataFrame, change: str, was: str) -> tuple[DataFrame, DataFrame]:
        """Those that are the only gone and the only new one by some columns, and the rest."""
        one = lambda side: F.count_if(F.col("change") == side) == 1
        of = lambda side: F.max(F.when(F.col("change") == side, F.struct(*key))).alias(side)
        pairs = cut(rest.groupBy(*by).agg(one("removed").alias("x"), one("added").alias("y"), of("removed"), of("added")).where("x and y"))
        taken = pairs.select("removed.*").unionByName(pairs.select("added.*"))
        return pairs.select("added.file", "added.name", F.lit(change).alias("change"), F.col(f"removed.{was}").alias("was")), rest.join(taken, key, "left_anti")

    renamed, apart = paired(["file", "owner", "shape"], apart, "renamed", "name")
    moved, apart = paired(["name", "shape"], apart, "moved", "file")
    return kept.unionByName(renamed).unionByName(moved).unionByName(apart.select("file", "name", "change", F.lit(None).cast("string").alias("was")))
