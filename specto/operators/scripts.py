"""JavaScript and TypeScript read by brackets: where declarations begin and end, without a grammar of expressions."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import cached_property

import regex

#: What declarations don't look into: comments, strings, templates, and regular expressions after an operator.
QUIET = regex.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?{}\n]\s*)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*""", regex.S)
NAME = r"[A-Za-z_$#][\w$]*"
TYPES = r"(?:\s*<[^(){}]*>)?"
FUNCTION = regex.compile(rf"(?:async\s+)?function\s*\*?\s*({NAME}){TYPES}\s*(?=\()")
CLASS = regex.compile(rf"(?:abstract\s+)?class\s+({NAME})[^{{]*(?=\{{)")
VALUE = regex.compile(rf"(?:const|let|var)\s+({NAME})\s*(?::[^=;{{}}]*)?=\s*(?:async\s*)?(?:function\s*\*?\s*(?:{NAME})?)?{TYPES}\s*(?=\(|({NAME})\s*=>)")
METHOD = regex.compile(rf"(?:(?:public|private|protected|static|async|abstract|override|get|set)\s+)*\*?\s*({NAME}){TYPES}\s*(?=\()")
WORD = regex.compile(r"(?<![\w$.])" + NAME)
CALL = regex.compile(rf"(?<![\w$.])({NAME})\s*\(")
IMPORT = regex.compile(r"""(?<![\w$.])(?:import\b(?:[^;'"`()]*?\bfrom\b)?\s*|(?:export\b[^;'"`(){}]*\{[^}]*\}|export\s*\*[^;'"`]*?)\s*from\s*|require\s*\(\s*)(["'`])([^"'`\n]+)\1""")
BINDINGS = regex.compile(r"(?<![\w$.])import\s+(?:type\s+)?([^;'\"`()]*?)\s+from\b")
#: Words of the language that stand before a bracket as a method's name does.
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "super", "new", "typeof", "await", "with"}


@dataclass
class Part:
    """A function, method or class: where it begins and ends, and its body if it has one."""

    kind: str
    name: str
    start: int
    end: int
    body: tuple[int, int] | None = None
    params: list[str] = field(default_factory=list)


class Script:
    def __init__(self, text: str) -> None:
        self.text = text
        quiet = QUIET.sub(lambda m: regex.sub(r"[^\n]", " ", m[0]), text)
        self.quiet = quiet
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in regex.finditer(r"[()\[\]{}]", quiet):
            if m[0] in "([{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
        if stack:
            raise SyntaxError(f"a bracket at {stack[0]} is never closed")
        self.parts = sorted(self.find(), key=lambda p: p.start)
        self.starts = [p.start for p in self.parts]

    def inside(self, p: Part) -> list[Part]:
        """The parts that begin within a part."""
        return self.parts[bisect_right(self.starts, p.start) : bisect_left(self.starts, p.end)]

    def after(self, i: int) -> int:
        while i < len(self.quiet) and self.quiet[i].isspace():
            i += 1
        return i

    def body_of(self, i: int, arrow: bool) -> tuple[int, int] | None:
        """The body that follows the parameters ending before i: in braces, or for an arrow the expression; none for a bare signature."""
        i = self.after(i)
        if i < len(self.quiet) and self.quiet[i] == ":":  # a return type: up to the brace or arrow that no type takes in
            i += 1
            while i < len(self.quiet) and not self.quiet.startswith("=>", i) and self.quiet[i] not in ";\n":
                if self.quiet[i] == "{" and not arrow and regex.search(r"[\w$>\])}]\s*$", self.quiet[max(0, i - 80) : i]):
                    break
                i = self.close.get(i, i) + 1
            i = self.after(i)
        if self.quiet.startswith("=>", i):
            i = self.after(i + 2)
        elif arrow:
            return None
        if i in self.close and self.quiet[i] == "{":
            return i, self.close[i] + 1
        return (i, self.statement_end(i)) if arrow else None

    def statement_end(self, i: int) -> int:
        """Where a statement from i on ends: at a semicolon, or at a line's end that nothing carries on."""
        while i < len(self.quiet):
            c = self.quiet[i]
            if c in ")]}":
                return i
            if c == ";":
                return i + 1
            if c == "\n" and not regex.search(r"[=+\-*/%&|?:,<.(]\s*$", self.quiet[max(0, i - 40) : i]) and not regex.match(r"\s*(?:[.?:=+*/%&|,)\]}]|=>)", self.quiet, pos=i):
                return i
            i = self.close.get(i, i) + 1
        return i

    def names(self, i: int) -> list[str]:
        """The names of the parameters in the brackets at i; a pattern is shown as it is, types and defaults aren't."""
        out, start, at, end = [], i + 1, i + 1, self.close[i]
        while at <= end:
            if at == end or self.quiet[at] == ",":
                item = regex.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", self.text[start:at].strip())
                shown = item if item.startswith(("{", "[")) else regex.split(r"\s*[?:=]", item, maxsplit=1)[0].strip()
                if shown.startswith(("{", "[")):
                    shown = self.text[start : self.close.get(self.after(start), at) + 1].strip()
                if shown:
                    out.append(shown)
                start = at + 1
            elif self.quiet[at] == "<":  # commas in type arguments
                m = regex.compile(r"<(?:[^<>()]|(?R))*>").match(self.quiet, at)
                at = m.end() - 1 if m and m.end() <= end else at
            else:
                at = self.close.get(at, at)
            at += 1
        return out

    def find(self) -> list[Part]:
        out = []
        for m in CLASS.finditer(self.quiet):
            if not regex.search(r"[\w$.]$", self.quiet[max(0, m.start() - 1) : m.start()]):
                body = (m.end(), self.close[m.end()] + 1)
                out.append(Part("class", m[1], m.start(), body[1], body))
                out += self.methods(body)
        for m in FUNCTION.finditer(self.quiet):
            if not regex.search(r"[\w$.]$", self.quiet[max(0, m.start() - 1) : m.start()]):
                body = self.body_of(self.close[m.end()] + 1, False)
                end = body[1] if body else self.statement_end(m.start())
                out.append(Part("function", m[1], m.start(), end, body, self.names(m.end())))
        for m in VALUE.finditer(self.quiet):
            single = m[2] is not None
            at = m.end() + len(m[2]) if single else self.close[m.end()] + 1
            arrow = "function" not in m[0]
            if (body := self.body_of(at, arrow)) and not regex.search(r"[\w$.]$", self.quiet[max(0, m.start() - 1) : m.start()]):
                out.append(Part("value", m[1], m.start(), max(body[1], self.statement_end(body[1])), body, [m[2]] if single else self.names(m.end())))
        return out

    def methods(self, body: tuple[int, int]) -> list[Part]:
        out, i, end = [], body[0] + 1, body[1] - 1
        while (i := self.after(i)) < end:
            m = METHOD.match(self.quiet, i)
            if m and m[1] not in KEYWORDS:
                block = self.body_of(self.close[m.end()] + 1, False)
                stop = block[1] if block else self.statement_end(self.close[m.end()] + 1)
                out.append(Part("method", m[1], i, stop, block, self.names(m.end())))
                i = stop
            else:
                stop = max(i + 1, self.statement_end(i))
                if self.quiet[i] != ";" and self.text[i:stop].strip():
                    out.append(Part("field", "", i, stop))
                i = stop
        return out

    @cached_property
    def functions(self) -> list[Part]:
        return [p for p in self.parts if p.kind in ("function", "value", "method")]

    @cached_property
    def callable_names(self) -> set[str]:
        return {p.name for p in self.parts if p.kind in ("function", "value")}

    @cached_property
    def imports(self) -> list[str]:
        """Module names of import and require, in order; only those that aren't in comments or strings."""
        own = [m for m in IMPORT.finditer(self.text) if self.quiet[m.start() : m.start() + 6].strip() in ("import", "export", "requir")]
        return list(dict.fromkeys(m[2] for m in own if not m[0].startswith("export")))

    @cached_property
    def bindings(self) -> set[str]:
        clauses = " ".join(m[1] for m in BINDINGS.finditer(self.quiet))
        return set(WORD.findall(regex.sub(rf"(?:{NAME}|\*)\s+as\s+", "", clauses))) - {"type"}

    def calls(self, p: Part) -> list[str]:
        """Functions of the file that a part calls by their bare names."""
        known = self.callable_names
        return list(dict.fromkeys(n for n in CALL.findall(self.quiet, *p.body) if n in known)) if p.body else []

    def foreign(self, p: Part) -> list[str]:
        """Imported names that a part uses."""
        known, (a, b) = self.bindings, p.body or (p.start, p.end)
        return list(dict.fromkeys(n for n in WORD.findall(self.quiet, a, b) if n in known))


def parse(text: str) -> dict:
    """What code.parse() tells of Python, for a script: imports, classes, functions and methods with their calls."""
    s = Script(text)
    breaks = [m.start() for m in regex.finditer("\n", text)]
    line = lambda i: bisect_left(breaks, i) + 1
    functions = [
        {"name": p.name, "line": line(p.start), "owner": None, "params": p.params, "calls": s.calls(p), "bare": s.calls(p), "names": s.calls(p) + s.foreign(p), "roots": [], "selfs": [], "raises": [], "warns": [], "yields": False, "doc": None, "signature": text[p.start : p.body[0] if p.body else p.end].rstrip(), "open_write": False, "source": text[p.start : p.end].rstrip(), "shape": hashlib.md5(" ".join(text[p.body[0] if p.body else p.end : p.end].split()).encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()}
        for p in s.functions
    ]
    classes = [p for p in s.parts if p.kind == "class"]
    return {
        "imports": s.imports,
        "aliases": sorted(s.bindings),
        "data": [],
        "top_classes": [p.name for p in classes],
        "top_functions": list(dict.fromkeys(p.name for p in s.functions)),
        "classes": [{"name": p.name, "line": line(p.start), "methods": [q.name for q in s.inside(p) if q.kind == "method"], "attrs": [], "doc": None, "source": text[p.start : p.end]} for p in classes],
        "functions": functions,
    }


def compress(text: str) -> str:
    """A script in short: bodies of functions and methods become { ... }; imports, types, data, fields and comments between declarations stay."""
    s, out, i = Script(text), [], 0
    by_start = {p.start: p for p in s.parts if p.kind in ("class", "function", "value")}

    def short(p: Part) -> str:
        return f"{text[p.start : p.body[0]].rstrip()} {{ ... }}" if p.body else text[p.start : p.end].rstrip()

    while i < len(text):
        if (comment := regex.compile(r"\s*(//[^\n]*|/\*.*?\*/)", regex.S).match(text, i)):
            out.append(comment[1])
            i = comment.end()
            continue
        i = s.after(i)
        if i >= len(text):
            break
        head = regex.compile(r"(?:export\s+)?(?:default\s+)?").match(s.quiet, i)
        p = by_start.get(head.end())
        if p and p.kind == "class":
            out.append(text[i : p.body[0]].rstrip() + " {")
            nested = [c for c in s.inside(p) if c.kind == "class"]
            out += [f"  {short(q)}" for q in s.inside(p) if q.kind in ("method", "field") and not any(c.start < q.start < c.end for c in nested)]
            out.append("}")
            i = p.end
        elif p:
            out.append(head[0] + short(p))
            i = p.end
        else:
            block = regex.compile(r"(?:declare\s+)?(?:const\s+)?(?:interface|enum|namespace|module)\s[^{;]*(?=\{)").match(s.quiet, head.end())
            end = s.close[block.end()] + 1 if block else max(i + 1, s.statement_end(i))
            if text[i:end].strip() not in ("", ";"):
                out.append(text[i:end].rstrip())
            i = end
    return "\n".join(out)
