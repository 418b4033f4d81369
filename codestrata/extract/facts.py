"""A file's captures as rows of the model: symbols, scopes, containments, references, local types, diagnostics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..model import TABLES
from .braces import Braces
from .captures import Capture, HtmlReader, PythonReader
from .frameworks import tags

REFERENCE = {"call": "call", "new": "instantiate", "import": "import", "inherit": "inherit", "implement": "implement", "type_use": "type_use", "renders": "renders"}
PER_FILE = 10**7


def captures(source: str, lang: str) -> list[Capture]:
    if lang == "python":
        return PythonReader(source).read()
    return HtmlReader(source).read() if lang == "html" else Braces(source, lang).read()


class FileFacts:
    """Rows of one file, in capture order; the sequence numbers of files never overlap."""

    def __init__(self, file_seq: int, path: str, lang: str, source: str):
        self.path, self.lang, self.seq = path, lang, file_seq * PER_FILE
        self.rows: dict[str, list[dict]] = {t: [] for t in TABLES}
        lines = source.split("\n")
        end = (0, 0, len(lines) - 1, len(lines[-1]))
        self.symbol("file", path, path, [path], end, True, "public")
        self.scope("global", None, f"{path}::{path}", end)
        if lang:
            self.read(captures(source, lang), end)

    def put(self, table: str, seq: str | None, row: dict) -> None:
        self.rows[table].append(({seq: self.seq + len(self.rows[table])} if seq else {}) | row)

    @staticmethod
    def ranged(at) -> dict:
        return dict(zip(("sl", "sc", "el", "ec"), at, strict=True))

    def symbol(self, kind, name, qname, chain, at, exported, visibility, found=None, declared=None) -> str:
        id_ = "::".join([self.path, *chain])
        api = (found or {}).get("api", (None, None))
        self.put("symbols", "sym_seq", {"id": id_, "kind": kind, "name": name, "qname": qname, "path": self.path, **self.ranged(at), "exported": exported, "visibility": visibility, "api_method": api[0], "api_path": api[1], "table_name": (found or {}).get("table"), "is_service": bool((found or {}).get("service")), "declared_chain": declared, "external": False})
        return id_

    def scope(self, kind, parent, owner, at) -> str:
        id_ = ":".join(["scope", self.path, kind, *map(str, at)])
        self.put("scopes", "scope_seq", {"id": id_, "kind": kind, "parent_scope_id": parent, "owner_symbol_id": owner, "path": self.path, **self.ranged(at)})
        return id_

    def read(self, found: list[Capture], end) -> None:
        file_id = f"{self.path}::{self.path}"
        routes = [c.route for c in found if c.route]
        # outer before inner; what begins together: the longer first
        order = sorted(range(len(found)), key=lambda i: (found[i].node[:2], [-x for x in found[i].node[2:]], i))
        open_: list[tuple] = []  # (range, symbol id, chain, kind, scope id or None, capture)
        for i in order:
            c = found[i]
            while open_ and not (open_[-1][0][:2] <= c.node[:2] and c.node[2:] <= open_[-1][0][2:]):
                open_.pop()
            scope = next((o[4] for o in reversed(open_) if o[4]), self.rows["scopes"][0]["id"])
            source = open_[-1][1] if open_ else file_id
            if c.tag == "error":
                self.put("diagnostics", None, {"kind": "parse_error", "severity": "error", "message": f"Syntax error at line {c.node[0] + 1}", "path": self.path, "sl": c.node[0], "sc": c.node[1]})
            elif c.tag.startswith("definition."):
                self.define(c, c.tag.split(".")[1], open_, scope, routes)
            elif c.tag != "renders" or len(c.chain) > 1 or c.name[:1] != c.name[:1].lower():
                self.put("refs", "ref_seq", {"id": ":".join(["ref", source, c.name, *map(str, c.name_at)]), "from_id": source, "kind": REFERENCE[c.tag], "raw_name": c.name, "chain": c.chain, "import_path": c.import_path, "imported_name": c.imported, "ast_node_type": c.node_type, "path": self.path, **self.ranged(c.name_at)})

    def define(self, c: Capture, kind: str, open_: list, scope: str, routes) -> None:
        parent = open_[-1] if open_ else None
        inside = any(o[3] in ("function", "method") for o in open_)
        if kind == "variable" and (inside or parent and parent[3] not in ("class", "interface")):
            # a local: only what it is matters
            if c.type_chain:
                owner = next((o[1] for o in reversed(open_) if o[4]), f"{self.path}::{self.path}")
                self.put("local_bindings", "bind_seq", {"owner_symbol_id": owner, "name": c.name, "path": self.path, **self.ranged(c.node), "type_chain": c.type_chain})
            return
        chain = [*(parent[2] if parent else ()), c.name]
        found = tags(c, self.path, self.lang, parent[5] if parent else None, routes)
        id_ = self.symbol(kind, c.name, ".".join(chain), chain, c.node, c.exported, c.visibility, found, c.type_chain or None)
        if parent:
            self.put("containments", "cont_seq", {"parent_id": parent[1], "child_id": id_, "kind": "has_member" if kind == "method" else "owns"})
        opened = None
        if kind in ("class", "interface", "function", "method"):
            opened = self.scope("class" if kind in ("class", "interface") else "function", scope, id_, c.node)
        if kind != "variable":
            open_.append((c.node, id_, chain, kind, opened, c))


def schema() -> str:
    return "file_seq long, path string, " + ", ".join(f"{t} array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in s.split(','))}>>" for t, s in TABLES.items())


def extract(files: DataFrame) -> DataFrame:
    """A row for each row of files(file_seq, path, lang, source), with its facts as arrays. A narrow stage."""
    arrow = to_arrow_schema(StructType.fromDDL(schema()))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(a, 64) for a in range(0, batch.num_rows, 64)):
                out = []
                for r in part.to_pylist():
                    out.append({"file_seq": r["file_seq"], "path": r["path"]} | FileFacts(r["file_seq"], r["path"], r["lang"] or "", r["source"] or "").rows)
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("file_seq", "path", "lang", "source").mapInArrow(run, schema())


def tables(extracted: DataFrame) -> dict[str, DataFrame]:
    """The facts as tables."""
    return {t: extracted.select(F.explode(t).alias("x")).select("x.*") for t in TABLES}
