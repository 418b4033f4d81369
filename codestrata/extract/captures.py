"""What the language readers report, and the reader of Python."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser


@dataclass
class Mark:
    """A decorator: its last name, whether it stands on one plain name (`@app.get`), its first argument where that is a text, all arguments as written, and texts given by name."""

    name: str
    on_name: bool = False
    first: str | None = None
    raw: str = ""
    named: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Capture:
    """One fact: its tag, its name, the range of its node and of its name (0-based lines and columns)."""

    tag: str
    name: str
    node: tuple[int, int, int, int]
    name_at: tuple[int, int, int, int]
    node_type: str = ""
    chain: list[str] = field(default_factory=list)
    import_path: str | None = None
    imported: str | None = None
    marks: list[Mark] = field(default_factory=list)
    bases: str = ""
    table: str | None = None
    type_chain: list[str] = field(default_factory=list)
    exported: bool = False
    visibility: str = "public"
    route: tuple[str, str] | None = None


def text_of(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def python_visibility(name: str) -> str:
    return "private" if name.startswith("_") and not (name.startswith("__") and name.endswith("__")) else "public"


#: Lines of a file that are passed over at most; beyond, the file is given up.
MOST_ERRORS = 200
#: What stands in for a wrong line; a header's body stays where it is.
HEADER = "if 1:"
NEUTRAL = ("", "pass", HEADER)


class PythonReader(ast.NodeVisitor):
    def __init__(self, source: str):
        self.source, self.lines, self.out = source, source.split("\n"), []

    def read(self) -> list[Capture]:
        """Captures of what can be parsed; a line that breaks the syntax is passed over and reported."""
        wrong = []
        while True:
            try:
                tree = ast.parse("\n".join(self.lines))
                break
            except SyntaxError as e:
                line = min(max(0, (e.lineno or 1) - 1), len(self.lines) - 1)
                cause = re.search(r"expected an indented block after .* on line (\d+)", str(e.msg))
                tries = [k for k in range(line, -1, -1) if self.lines[k].strip() == "try:"] if "expected 'except'" in str(e.msg) else []
                if cause:
                    line = int(cause[1]) - 1  # nothing stands below a header
                elif tries:
                    line = tries[0]
                elif self.lines[line].strip() in NEUTRAL and "indent" not in str(e.msg):
                    # what comes before makes it wrong
                    line = next((k for k in range(line - 1, -1, -1) if self.lines[k].strip() not in ("", "pass")), line)
                if (text := self.lines[line].strip()) not in NEUTRAL:
                    wrong.append(line)
                if not text or len(wrong) > MOST_ERRORS:
                    tree = ast.Module([], [])
                    break
                instead = "" if text == "pass" else "pass" if cause or text == HEADER or not text.endswith(":") else HEADER
                self.lines[line] = self.lines[line][: len(self.lines[line]) - len(self.lines[line].lstrip())] + instead
            except (ValueError, RecursionError):
                wrong.append(0)
                tree = ast.Module([], [])
                break
        self.source = "\n".join(self.lines)
        try:
            self.visit(tree)
        except RecursionError:
            wrong.append(0)
        return [*(Capture("error", "", (line, 0, line, 0), (line, 0, line, 0)) for line in sorted(set(wrong))), *self.out]

    def at(self, node) -> tuple[int, int, int, int]:
        """Columns in characters: the parser counts bytes."""
        column = lambda line, c: len(self.lines[line].encode()[:c].decode(errors="ignore")) if line < len(self.lines) and not self.lines[line].isascii() else c
        return node.lineno - 1, column(node.lineno - 1, node.col_offset), node.end_lineno - 1, column(node.end_lineno - 1, node.end_col_offset)

    def text(self, node) -> str:
        return ast.get_source_segment(self.source, node) or ""

    def chain(self, node) -> list[str]:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return [*reversed([*parts, node.id if isinstance(node, ast.Name) else self.text(node)])]

    def definition(self, node, tag: str):
        prefix = {"ClassDef": "class ", "FunctionDef": "def ", "AsyncFunctionDef": "async def "}[type(node).__name__]
        sl, sc, el, ec = self.at(node)
        name_at = (sl, sc + len(prefix), sl, sc + len(prefix) + len(node.name))
        bases = ", ".join(self.text(b) for b in node.bases) if isinstance(node, ast.ClassDef) else ""
        seen = python_visibility(node.name)
        self.out.append(Capture(tag, node.name, (sl, sc, el, ec), name_at, type(node).__name__, marks=[self.mark(d) for d in node.decorator_list], bases=bases, table=self.table_of(node), exported=seen == "public", visibility=seen))

    def mark(self, node) -> Mark:
        called = node.func if isinstance(node, ast.Call) else node
        found = Mark(called.attr if isinstance(called, ast.Attribute) else getattr(called, "id", ""), isinstance(called, ast.Attribute) and isinstance(called.value, ast.Name))
        if isinstance(node, ast.Call):
            found.raw = ", ".join(self.text(a) for a in node.args)
            found.first = text_of(node.args[0]) if node.args else None
            for k in node.keywords:
                values = k.value.elts if isinstance(k.value, ast.List) else [k.value]
                found.named[k.arg or ""] = [t for v in values if (t := text_of(v)) is not None]
        return found

    def table_of(self, node) -> str | None:
        """What a class says that its table is called."""
        for part in ast.walk(node) if isinstance(node, ast.ClassDef) else ():
            if isinstance(part, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in part.targets):
                return text_of(part.value)
        return None

    def visit_ClassDef(self, node):
        self.definition(node, "definition.class")
        for b in node.bases:
            if isinstance(b, (ast.Name, ast.Attribute)):
                self.out.append(Capture("inherit", self.text(b), self.at(b), self.at(b), "argument_list", self.chain(b)))
        self.generic_visit(node)

    def visit_FunctionDef(self, node):
        self.definition(node, "definition.function")
        self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node):
        for target in node.targets:
            self.variable(node, target, node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        self.variable(node, node.target, node.value)
        self.generic_visit(node)

    def variable(self, node, target, value):
        if isinstance(target, ast.Name):
            made = self.chain(value.func) if isinstance(value, ast.Call) and isinstance(value.func, (ast.Name, ast.Attribute)) else []
            seen = python_visibility(target.id)
            self.out.append(Capture("definition.variable", target.id, self.at(node), self.at(target), "assignment", type_chain=made if made and made[-1][:1].isupper() else [], exported=seen == "public", visibility=seen))

    def visit_Call(self, node):
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            self.out.append(Capture("call", self.text(node.func), self.at(node), self.at(node.func), "call", self.chain(node.func)))
        self.generic_visit(node)

    def visit_Import(self, node):
        for a in node.names:
            self.out.append(Capture("import", a.asname or a.name, self.at(node), self.at(a), "import_statement", (a.asname or a.name).split("."), a.name.replace(".", "/"), a.name if a.asname else None))

    def visit_ImportFrom(self, node):
        path = "/" * node.level + (node.module or "").replace(".", "/")
        for a in node.names:
            if a.name != "*":
                self.out.append(Capture("import", a.asname or a.name, self.at(node), self.at(a), "import_from_statement", [a.asname or a.name], path, a.name if a.asname else None))


class HtmlReader(HTMLParser):
    def __init__(self, source: str):
        super().__init__()
        self.source, self.out = source, []

    def read(self) -> list[Capture]:
        self.feed(self.source)
        self.close()
        return self.out

    def handle_starttag(self, tag, attrs):
        line, column = self.getpos()
        raw = self.get_starttag_text() or ""
        rows = raw.split("\n")
        at = (line - 1, column, line - 1 + len(rows) - 1, len(rows[-1]) + (column if len(rows) == 1 else 0))
        for key, value in attrs:
            if key == "id" and value:
                self.out.append(Capture("definition.variable", value, at, at, "attribute", exported=True))
            elif value and (tag, key) in (("script", "src"), ("link", "href")):
                self.out.append(Capture("import", value, at, at, "attribute", [value], value))

    handle_startendtag = handle_starttag
