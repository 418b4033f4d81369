"""From source trees to answers, on small projects written for these tests."""

import json

import pytest

from codestrata.plans import plan as plans
from codestrata.plans import server
from codestrata.plans.engine import Engine, build

PYTHON = {
    "main.py": "from services.account import AccountService, current\nfrom admin.account import AccountService as AdminService\n\n\ndef start():\n    service = AccountService()\n    admin = AdminService()\n    who = current()\n    service.store(who)\n    admin.drop(who)\n    print(who)\n\n\nstart()\n",
    "services/account.py": "class AccountService:\n    def __init__(self):\n        self.rows = []\n\n    def store(self, row):\n        print(row)\n\n\ndef current():\n    return 1\n",
    "admin/account.py": "class AccountService:\n    def __init__(self):\n        pass\n\n    def drop(self, row):\n        pass\n",
    "skip/__pycache__/x.py": "x = 1\n",
    ".hidden/y.py": "y = 1\n",
    "node_modules/z.js": "var z\n",
}
SCRIPT = {
    "src/index.ts": "import { AccountService } from './services/account.js';\nimport { Account } from './models/account.js';\n\nexport function main(): void {\n  const service = new AccountService();\n  service.store({ id: '1' } as Account);\n}\n",
    "src/services/account.ts": "import { Account } from '../models/account.js';\n\nexport class AccountService {\n  private rows: Account[] = [];\n\n  store(row: Account): void {\n    this.keep(row);\n    console.log('x');\n  }\n\n  keep(row: Account): void {\n    this.rows.push(row);\n  }\n}\n",
    "src/models/account.ts": "export interface Account {\n  id: string;\n}\n\nexport function make(id: string): Account {\n  return { id };\n}\n",
    "src/Panel.tsx": "export function Panel() {\n  return (<div><Legend/><Box.Head/></div>);\n}\n",
    "src/routes.js": "const app = express();\nfunction listAll(req, res) { res.send(1); }\napp.get('/all', listAll);\n",
}


def project(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def python_graph(spark, tmp_path_factory):
    return build(spark, project(tmp_path_factory.mktemp("py"), PYTHON))


@pytest.fixture(scope="module")
def script_graph(spark, tmp_path_factory):
    return build(spark, project(tmp_path_factory.mktemp("ts"), SCRIPT))


def resolved(graph):
    return {(r["from_id"], r["to_id"], r["kind"]): r["method"] for r in graph.tables["resolved_refs"].collect()}


def test_python_model(python_graph):
    g = python_graph
    ids = {r["id"]: r["kind"] for r in g.tables["symbols"].collect()}
    assert g.meta["fileCount"] == 3 and g.meta["symbolCount"] == 12
    assert ids["services/account.py::AccountService::store"] == "function" and ids["main.py::start"] == "function"
    kinds = [r["kind"] for r in g.tables["containments"].where("not child_id like 'external%'").collect()]
    assert kinds == ["owns"] * 7
    assert g.tables["local_bindings"].count() == 2
    found = resolved(g)
    assert found["main.py::start", "services/account.py::current", "call"] == "import"
    assert found["main.py::main.py", "main.py::start", "call"] == "scope"
    assert found["main.py::start", "external::builtin::print", "call"] == "global_fallback"
    assert ("main.py::main.py", "admin/account.py::AccountService", "import") in found
    left = sorted(r["raw_name"] for r in g.tables["unresolved_refs"].collect())
    assert left == ["admin.drop", "service.store"]


def test_script_model(script_graph):
    g = script_graph
    found = resolved(g)
    ids = {r["id"]: r for r in g.tables["symbols"].collect()}
    assert ids["src/services/account.ts::AccountService::store"]["kind"] == "method"
    assert ids["src/models/account.ts::Account"]["kind"] == "interface"
    assert found["src/index.ts::src/index.ts", "src/models/account.ts::Account", "import"] == "import"
    assert found["src/services/account.ts::AccountService::store", "src/services/account.ts::AccountService::keep", "call"] == "scope"
    assert found["src/index.ts::main", "src/services/account.ts::AccountService::store", "call"] == "scope"
    renders = {r["raw_name"] for r in g.tables["refs"].where("kind = 'renders'").collect()}
    assert renders == {"Legend", "Box.Head"}
    assert (ids["src/routes.js::listAll"]["api_method"], ids["src/routes.js::listAll"]["api_path"]) == ("GET", "/all")
    assert ids["src/services/account.ts::AccountService"]["is_service"]


def test_html_and_java(spark, tmp_path):
    g = build(spark, project(tmp_path, {"index.html": '<html><head><script src="app.js"></script><link href="style.css"></head><body id="root"><a href="x">x</a></body></html>', "app.js": "console.log(1);\n", "A.java": "package a;\nimport x.y.Repo;\npublic class AService extends Base implements Runs {\n  private Repo repo;\n  public void go(int n) { repo.save(n); }\n}\n"}))
    found = resolved(g)
    assert found["index.html::index.html", "app.js::app.js", "import"] == "import"
    assert ("index.html::index.html", "external::style.css::style.css", "import") in found
    ids = {r["id"] for r in g.tables["symbols"].collect()}
    assert {"index.html::root", "A.java::AService::repo", "A.java::AService::go"} <= ids
    kinds = sorted(r["kind"] for r in g.tables["refs"].where("path = 'A.java'").collect())
    assert kinds == ["call", "implement", "import", "inherit"]


def test_fastapi_tags(spark, tmp_path):
    g = build(spark, project(tmp_path, {"app.py": "class User(Base):\n    __tablename__ = 'users'\n\n@app.post('/users')\ndef add():\n    pass\n\nclass UserService:\n    pass\n", "broken.py": "def (:\n"}))
    ids = {r["id"]: r for r in g.tables["symbols"].collect()}
    assert ids["app.py::User"]["table_name"] == "users" and ids["app.py::UserService"]["is_service"]
    assert (ids["app.py::add"]["api_method"], ids["app.py::add"]["api_path"]) == ("POST", "/users")
    assert [r["kind"] for r in g.tables["diagnostics"].where("path = 'broken.py'").collect()] == ["parse_error"]


def test_answers(script_graph):
    e = Engine(script_graph)
    region = e.answer(plans.explore_region(["src/index.ts::main"], "outgoing", 2, callsites=True))
    ids = [n["id"] for n in region["nodes"]]
    assert ids[0] == "src/index.ts::main" and "src/services/account.ts::AccountService::store" in ids
    assert region["nodes"][0]["callsites"]["src/services/account.ts::AccountService::store"] == 6
    assert "# Relationships" in region["text"] and "service.store" in region["text"]
    path = e.answer(plans.trace_path("main", "keep", edge_kinds=("calls",)))
    assert path["paths"][0]["path"] == ["src/index.ts::main", "src/services/account.ts::AccountService::store", "src/services/account.ts::AccountService::keep"]
    impact = e.answer(plans.analyze_impact("keep"))
    assert {n["id"]: n["distance"] for n in impact["nodes"]}["src/index.ts::main"] == 2
    assert e.answer(plans.analyze_impact("nothing_like_this_anywhere"))["status"] == "not_found"
    assert e.answer(plans.Plan("path", (plans.Anchor("x"),)))["status"] == "invalid"
    found = e.retrieve("how does the AccountService store flow work")
    assert found["strategy"] == "flow" and found["symbols"]


def test_protocol(script_graph):
    e = Engine(script_graph)
    call = lambda m, **p: server.handle(e, json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": p}))
    assert server.handle(e, "{")["error"]["code"] == -32700
    assert server.handle(e, "[]")["error"]["code"] == -32600
    assert call("nope")["error"]["code"] == -32601
    assert call("tools/call", name="nope")["error"]["code"] == -32602
    assert len(call("tools/list")["result"]["tools"]) == 6
    text = call("tools/call", name="explore_flow", arguments={"query": "how does main reach AccountService"})["result"]["content"][0]["text"]
    assert json.loads(text)["status"] == "ok"
