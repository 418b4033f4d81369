"""Tables of the code model: schemas, kinds and fixed values."""

from __future__ import annotations

FILES = "file_seq long, path string, abs_path string, lang string, source string"
SYMBOLS = (
    "sym_seq long, id string, kind string, name string, qname string, path string, sl int, sc int, el int, ec int, exported boolean, visibility string, "
    "api_method string, api_path string, table_name string, is_service boolean, declared_chain array<string>, external boolean"
)
SCOPES = "scope_seq long, id string, kind string, parent_scope_id string, owner_symbol_id string, path string, sl int, sc int, el int, ec int"
CONTAINMENTS = "cont_seq long, parent_id string, child_id string, kind string"
REFS = "ref_seq long, id string, from_id string, kind string, raw_name string, chain array<string>, import_path string, imported_name string, ast_node_type string, path string, sl int, sc int, el int, ec int"
BINDINGS = "bind_seq long, owner_symbol_id string, name string, path string, sl int, sc int, el int, ec int, type_chain array<string>"
RESOLVED = "ref_seq long, candidate_id string, from_id string, to_id string, kind string, method string"
EXTERNALS = "id string, kind string, name string, qname string, path string"
DIAGNOSTICS = "kind string, severity string, message string, path string, sl int, sc int"
TABLES = {"symbols": SYMBOLS, "scopes": SCOPES, "containments": CONTAINMENTS, "refs": REFS, "local_bindings": BINDINGS, "diagnostics": DIAGNOSTICS}

# Results depend on them.
SYMBOL_KINDS = ("project", "package", "module", "file", "class", "interface", "method", "function", "variable", "type_alias", "enum")
DEFINITION_KINDS = ("class", "interface", "struct", "function", "method", "type_alias", "enum")
CONTAINMENT_KINDS = ("owns", "declares", "has_member")
REFERENCE_KINDS = ("call", "import", "inherit", "implement", "type_use", "instantiate", "renders")
FLOW_KINDS = ("call", "instantiate", "renders")
TESTABLE_KINDS = ("function", "method", "class", "interface")
LANGUAGES = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".py": "python", ".java": "java", ".html": "html"}
EXCLUDED = ("node_modules", "dist", "build", "__pycache__", ".git", "venv", ".venv", "env", ".env")
DISCOVERY_STOP_WORDS = (
    "add delete update fix remove get set support for in and the is to how does where a an of on with from into via flow data layer handle request response return value "
    "result config options params args item work file use make this that which what when why who class method function code way"
).split()
LOCATE_WORDS = "where find locate exist implement defined declare file symbol".split()
FLOW_WORDS = [*"how flow run execution path work trace".split(), "call graph", "process", "step"]
IMPACT_WORDS = "break impact modify change depend caller affect refactor use".split()
FLOW_STOP_WORDS = (
    "the a an and or of to in on for with how does do did is are was were be been being flow data across through from into onto between via work works working file files use "
    "uses used using get gets set sets make makes made why what when where which who this that these those it its we you they them i can could should would will shall may "
    "might must way ways thing things code about over under out up down off then else so than as at by but if not all any each"
).split()
BUILTINS = (
    "print len str int float dict list set tuple range enumerate zip getattr setattr hasattr any all min max sum open type id map filter next iter repr Exception ValueError "
    "TypeError KeyError bool abs round pow divmod sorted reversed slice ord chr isinstance issubclass callable locals globals hash classmethod staticmethod property super "
    "object console log error warn info dir Math Date JSON Map Set Promise Object Array String Number Boolean RegExp Error setTimeout setInterval clearTimeout clearInterval "
    "parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent"
).split()
QUIET_NAMES = "console print len range str int dict list set true false".split()
ROLE_PRIORITY = {"anchor": 100, "path": 80, "impacted": 70, "direct_neighbor": 50, "transitive_neighbor": 20}
LIMITS = {"depth": 6, "nodes": 200, "paths": 20, "edges": 120, "per_file": 30}
DEFAULTS = {"depth": 3, "nodes": 100, "paths": 10}
TOKEN_BUDGET, RESPONSE_CAP, SNIPPET, SPAN_GAP, RELATION_LINES, COMMENT_LINES = 8000, 40_000, 800, 5, 60, 6
AMBIGUOUS, ALTERNATIVES, FUZZY, MOST_ANCHORS, CLEAR_LEAD, BAG_LEAD = 10, 3, 20, 8, 2.0, 1.25
