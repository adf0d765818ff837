"""A tree on disk through scan, queries, contribution and the message shell."""

import os

from pyspark.sql import functions as F

from loomgraph import api
from loomgraph.operators import build, extract, graph
from loomgraph.operators.extract import lexical, python_ast

FILES = {
    "shop/models.py": "import os\nfrom .base import Base\n\nclass Cart(Base):\n    def total(self):\n        return Money.zero()\n\nclass Money:\n    @staticmethod\n    def zero():\n        return 0\n",
    "shop/base.py": "class Base:\n    pass\n",
    "shop/views.py": "from shop.models import Cart\n\ndef show(request):\n    cart = Cart()\n    return cart.total()\n",
    "web/app.ts": "import { Api } from './api';\nexport class App extends Api {\n  start(): void { new Client().run(); }\n}\n",
    "web/api.ts": "export class Api {\n  call(x: number) { return x; }\n}\n",
    "broken.py": "def (:\n",
    ".env": "SECRET=1\n",
    "build/out.py": "class Hidden: pass\n",
    "empty.py": "  \n",
}


def write(root, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}") or root, exist_ok=True)
        with open(f"{root}/{name}", "w", newline="") as f:
            f.write(text)


def test_scan_query_and_rescan(spark, tmp_path):
    root, store = str(tmp_path / "src"), str(tmp_path / "store")
    write(root, FILES)
    engine = api.Engine(spark, store)
    assert api.text(engine.stats()) == "nothing found"
    changes = {r["path"]: r["change"] for r in engine.scan(root).collect()}
    assert changes["shop/models.py"] == "new" and "build/out.py" not in changes and ".env" not in changes
    names = {r["name"]: r["status"] for r in engine.entities.collect()}
    assert names["Cart"] == names["Money"] == names["App"] == "active" and names["Client"] == "stub" and "Hidden" not in names
    kinds = {(r["src"], r["kind"], r["dst"]) for r in engine.edges.collect()}
    ids = {r["name"]: r["id"] for r in engine.entities.collect()}
    assert (ids["Cart"], "extends", ids["Base"]) in kinds and (ids["show"], "calls", ids["Cart"]) in kinds
    assert (ids["shop/views.py"], "imports", ids["shop/models.py"]) in kinds and (ids["web/app.ts"], "imports", ids["web/api.ts"]) in kinds
    assert (ids["shop/models.py"], "contains", ids["Cart"]) in kinds and (ids["shop/models.py"], "depends_on", ids["os"]) in kinds
    assert [r["name"] for r in engine.impact("Base", slim=True).collect()][0] == "Cart"
    assert {r["name"] for r in engine.find("total").collect()} == {"Cart"}
    assert engine.store.version() == 1 and engine.scan(root).isEmpty() and engine.store.version() == 1

    os.remove(f"{root}/web/app.ts")
    write(root, {"shop/base.py": "class Base:\n    def save(self):\n        pass\n"})
    os.utime(f"{root}/shop/base.py", (2_000_000_000, 2_000_000_000))
    again = {r["path"]: r["change"] for r in engine.scan(root).collect()}
    assert again == {"web/app.ts": "deleted", "shop/base.py": "modified"}
    status = {r["name"]: (r["status"], r["id"]) for r in engine.entities.collect()}
    assert status["App"][0] == "deleted" and status["Base"] == ("active", ids["Base"])


def test_contribution_and_messages(spark, tmp_path):
    root = str(tmp_path / "src")
    write(root, {"a.py": "class A:\n    pass\n"})
    engine = api.Engine(spark, str(tmp_path / "store"))
    engine.scan(root)
    row = engine.contribute("a", {"owner": "me"}, [{"target": "Elsewhere", "kind": "uses"}, {"target": ""}], "seen in review").first()
    assert row["version"] == 2 and row["custom"]["owner"] == "me" and row["timeline"][0]["event"] == "[agent] seen in review"
    engine.contribute("a", {}, [{"target": "Elsewhere", "kind": "uses"}], "again")
    assert engine.edges.filter("kind = 'uses'").count() == 1 and engine.entities.filter("status = 'stub'").count() == 1
    call = lambda m, p=None, i=1: api.handle(engine, {"jsonrpc": "2.0", "id": i, "method": m, "params": p or {}})
    tools = {t["name"]: t["inputSchema"] for t in call("tools/list")["result"]["tools"]}
    assert tools["path"]["required"] == ["from_entity", "to_entity"] and tools["path"]["properties"]["max_hops"] == {"type": "integer", "default": 6} and tools["context"]["properties"]["entities"]["type"] == "array"
    assert api.route(engine, "POST", "/query/impact", {"entity": "Elsewhere", "slim": True})[0] == 200 and api.route(engine, "GET", "/stats", {})[0] == 200
    assert api.route(engine, "GET", "/nowhere", {})[0] == 404 and api.route(engine, "POST", "/query/impact", {})[0] == 400
    assert api.route(engine, "GET", "/health", {})[1] == {"status": "ok"}
    assert [r["ext"] for r in api.route(engine, "POST", "/preview", {"project_root": root})[1]["rows"]] == [".py"]
    assert len(call("tools/list")["result"]["tools"]) == 12 and call("ping")["result"] == {}
    assert "Elsewhere" in call("tools/call", {"name": "find", "arguments": {"name": "elsewhere"}})["result"]["content"][0]["text"]
    assert call("tools/call", {"name": "impact", "arguments": {}})["result"]["isError"]
    assert call("tools/call", {"name": "nope"})["error"]["code"] == -32601 and call("nope")["error"]["code"] == -32601
    assert api.handle(engine, {"method": "ping"}) is None
    found = engine.security(root, severity="low")
    assert found.count() == 0


def test_a_rescan_keeps_what_was_contributed_and_opens_only_what_changed(spark, tmp_path):
    root = str(tmp_path / "src")
    write(root, {"a.py": "class A:\n    def go(self):\n        return B()\n", "b.py": "class B:\n    pass\n", "c.py": "from a import A\nclass C(A):\n    pass\n"})
    engine = api.Engine(spark, str(tmp_path / "store"))
    engine.scan(root)
    assert engine.counters["opened"] == engine.counters["parsed"] == 3
    engine.contribute("A", {"owner": "me"}, [{"target": "Ledger", "kind": "uses", "note": "by hand"}], "seen in review")
    engine.update("B", sections={"tags": ["core"], "custom": {"tier": "1"}})
    before = {r["name"]: r for r in engine.entities.collect()}
    edges = {(r["src"], r["kind"], r["dst"]) for r in engine.edges.collect()}
    write(root, {"b.py": "class B:\n    def more(self):\n        pass\n"})
    os.utime(f"{root}/b.py", (2_000_000_000, 2_000_000_000))
    assert [(r["path"], r["change"]) for r in engine.scan(root).collect()] == [("b.py", "modified")]
    assert (engine.counters["files"], engine.counters["opened"], engine.counters["parsed"], engine.counters["modified"]) == (3, 1, 1, 1)
    after = {r["name"]: r for r in engine.entities.collect()}
    a, b = after["A"], after["B"]
    assert a["version"] == before["A"]["version"] and a["custom"]["owner"] == "me" and a["custom"]["language"] == "python" and a["timeline"] == before["A"]["timeline"] != None  # noqa: E711
    assert b["version"] == before["B"]["version"] + 1 and b["methods"] == ["more"] and b["tags"] == ["core"] and b["custom"]["tier"] == "1" and b["created"] == before["B"]["created"]
    assert after["Ledger"]["status"] == "stub" and {(r["src"], r["kind"], r["dst"]) for r in engine.edges.collect()} == edges
    assert engine.edges.filter("source = 'agent'").count() == 1
    # the contributed target turns up in source: the stub is promoted in place, the relation stays
    write(root, {"ledger.py": "class Ledger:\n    pass\n"})
    engine.scan(root)
    again = {r["name"]: r for r in engine.entities.collect()}
    assert again["Ledger"]["status"] == "active" and again["Ledger"]["id"] == after["Ledger"]["id"] and again["Ledger"]["type"] == "class"
    assert (a["id"], "uses", after["Ledger"]["id"]) in {(r["src"], r["kind"], r["dst"]) for r in engine.edges.collect()}
    # a full scan opens everything and keeps the facts, too
    engine.scan(root, incremental=False)
    assert engine.counters["opened"] == 4 and {r["name"]: r["custom"] for r in engine.entities.collect()}["A"]["owner"] == "me"


def test_stubs_are_resolved_and_unused_ones_go(spark, tmp_path):
    root = str(tmp_path / "src")
    write(root, {"a.py": "import util.text\nclass A(Base):\n    pass\n"})
    engine = api.Engine(spark, str(tmp_path / "store"))
    engine.scan(root)
    assert {r["name"] for r in engine.entities.filter("status = 'stub'").collect()} == {"util", "Base"}
    write(root, {"a.py": "class A:\n    pass\n"})
    os.utime(f"{root}/a.py", (2_000_000_000, 2_000_000_000))
    engine.scan(root)
    assert engine.entities.filter("status = 'stub'").count() == 0


def test_update_rename_and_delete(spark, tmp_path):
    root = str(tmp_path / "src")
    write(root, {"a.py": "class A:\n    pass\nclass B(A):\n    pass\n"})
    engine = api.Engine(spark, str(tmp_path / "store"))
    engine.scan(root)
    row = engine.update("a", {"kind": ["service"], "name": "Account"}, {"aliases": ["Acc", "Acc"], "custom": {"x": 1}}).first()
    assert row["kind"] == ["service"] and row["name_key"] == "account" and row["version"] == 2 and row["aliases"] == ["Acc"] and row["custom"]["x"] == "1"
    assert graph.resolve(engine.entities, "acc").first()["id"] == row["id"]
    engine.delete("Account")
    assert engine.find("Account").isEmpty() and engine.entities.filter("name = 'Account'").first()["status"] == "deleted"
    engine.delete("B", hard=True)
    assert engine.entities.filter("name = 'B'").isEmpty()


SCRIPTS = {
    "Assets/Door.cs": "using UnityEngine;\npublic class Door : MonoBehaviour {\n  public void Open() {\n  }\n}\n",
    "Assets/Lamp.cs": "public class Lamp : MonoBehaviour {\n  public void Toggle() {\n  }\n}\n",
    "Assets/Hand.cs": "public class Hand {\n  [SerializeField] private Door door;\n  public void Push() {\n    door.Open();\n  }\n}\n",
    "Assets/Unused.cs": "public class Unused {\n}\n",
    "Assets/House.prefab": "%YAML 1.1\nMonoBehaviour:\n  m_Script: {fileID: 11500000, guid: " + "a" * 32 + ", type: 3}\n",
    "Assets/Town.unity": "%YAML 1.1\nMonoBehaviour:\n  m_Script: {fileID: 11500000, guid: " + "B" * 32 + ", type: 3}\n  m_PersistentCalls:\n    m_Calls:\n    - m_Target: {fileID: 5}\n      m_TargetAssemblyTypeName: Lamp, Assembly-CSharp\n      m_MethodName: Toggle\n    - m_TargetAssemblyTypeName: UnityEngine.GameObject, UnityEngine\n      m_MethodName: SetActive\n",
    "Assets/Door.cs.meta": "fileFormatVersion: 2\nguid: " + "a" * 32 + "\n",
    "Assets/Lamp.cs.meta": "fileFormatVersion: 2\nguid: " + "b" * 32 + "\n",
}


def test_assets_are_wired_to_scripts(spark, tmp_path):
    root = str(tmp_path / "src")
    write(root, SCRIPTS)
    engine = api.Engine(spark, str(tmp_path / "store"))
    engine.scan(root)
    ids = {r["name"]: r["id"] for r in engine.entities.collect()}
    edges = {(r["src"], r["kind"], r["dst"]) for r in engine.edges.collect()}
    assert (ids["Assets/House.prefab"], "uses", ids["Door"]) in edges and (ids["Assets/Town.unity"], "uses", ids["Lamp"]) in edges
    assert (ids["Assets/Town.unity"], "calls", ids["Lamp"]) in edges and "GameObject" not in ids
    assert {r["name"] for r in engine.impact("Lamp.Toggle", depth=1, slim=True).collect()} == {"Assets/Town.unity"}
    lone = {r["name"] for r in engine.orphans(types=["class"]).collect()}
    assert "Unused" in lone and not lone & {"Door", "Lamp"}


def test_extractors_never_fail(spark):
    rows = [("a.py", "python", "def (:"), ("b.py", "python", None), ("c.xyz", "", "x"), ("d.py", "python", "x = 1\n" * 2000)]
    rows += [(f"x.{k}", k, "class A { " * 50) for k in lexical.LANGUAGES] + [(None, "python", "x")]
    got = extract.extract(spark.createDataFrame(rows, "path string, language string, content string")).collect()
    assert len(got) == len(rows) and [r["parse_error"] for r in got][0].startswith("SyntaxError")
    entities, edges = build.build(extract.extract(spark.createDataFrame([], "path string, language string, content string")), F.lit("2030-01-01").cast("timestamp"))
    assert entities.count() == 0 and edges.count() == 0


def test_languages():
    def names(language, text, path="f"):
        defs, refs = lexical.extractor(language)(path, text)
        return {(d["kind"], d["subkind"], d["name"]) for d in defs if d["kind"] != "module"}, {(r["ref_kind"], r["target"]) for r in refs}, {m["name"] for d in defs for m in d["methods"]}

    d, r, m = names("java", "package p;\nimport java.util.List;\npublic abstract class A extends B implements C {\n  // class No {\n  public void go(int x) { new D(); }\n}\n")
    assert d == {("class", "abstract", "A")} and {("import", "java.util.List"), ("extends", "B"), ("extends", "C"), ("call", "D")} <= r and m == {"go"}
    d, r, m = names("go", 'package p\nimport "fmt"\ntype S struct {\n}\nfunc (s *S) Do() {}\nfunc Make() *S { return &S{} }\nfunc hidden() {}\n')
    assert ("class", "struct", "S") in d and ("function", "", "Make") in d and ("function", "", "hidden") not in d and m == {"Do"} and ("import", "fmt") in r
    d, r, m = names("csharp", "using System;\nclass P : Base {\n  [SerializeField] private List<Gun> guns;\n  public Door door;\n  public void Fire() { Game.Instance.Sound.Play(1); }\n}\n")
    assert ("class", "", "P") in d and {("field", "Gun"), ("field", "Door"), ("method_call", "Sound::Play"), ("extends", "Base")} <= r and "Fire" in m
    d, r, m = names("rust", "use crate::a::B;\npub struct T;\nimpl T {\n fn x(&self) { go(); }\n}\npub fn top() {}\n")
    assert ("class", "struct", "T") in d and ("function", "", "top") in d and ("call", "go") in r
    d, r, m = names("ruby", "require 'x'\nclass A < B\n  def go\n  end\nend\ndef top\nend\n")
    assert ("class", "", "A") in d and ("function", "", "top") in d and ("extends", "B") in r
    d, r, m = names("php", "<?php\nuse X\\Y;\nabstract class A extends B {\n function go() {}\n}\n")
    assert ("class", "abstract", "A") in d and ("import", "X\\Y") in r
    d, r, m = names("kotlin", "import a.B\ndata class A(val x: Int)\nfun top() {}\n")
    assert ("class", "data", "A") in d and ("function", "", "top") in d
    d, r, m = names("swift", "import Foundation\nstruct A: P {\n func go() {}\n}\nfunc top() {}\n")
    assert ("class", "struct", "A") in d and ("function", "", "top") in d and m == {"go"}
    d, r, m = names("c", '#include "a.h"\ntypedef struct { int x; } P;\nint go(int a) {\n  return run(a);\n}\n')
    assert ("class", "struct", "P") in d and ("function", "", "go") in d and ("call", "run") in r and ("import", "a.h") in r
    d, r, m = names("cpp", "#include <vector>\nclass A : public B {\n void go();\n};\n")
    assert ("class", "", "A") in d and ("extends", "B") in r
    d, r, m = names("typescript", "import x from './y';\nexport interface I {}\nexport class A extends B {\n  go(): void { new C(); }\n}\nconst f = (a) => a;\nfunction _no() {}\n")
    assert ("class", "interface", "I") in d and ("function", "", "f") in d and ("function", "", "_no") not in d and ("call", "C") in r and m == {"go"}


def test_python_rules():
    defs, refs = python_ast.extract("a.py", "class A(B, metaclass=M):\n    def __init__(self, a, b, c, d, e, f):\n        self.x = Client()\n    def go(self):\n        self.x.send()\n        get_user_service()\n    class Inner: pass\ndef f():\n    def g(): pass\n")
    assert [(d["kind"], d["name"]) for d in defs] == [("module", "a.py"), ("class", "A"), ("function", "f"), ("function", "g")]
    assert defs[1]["methods"][0]["signature"] == "__init__(self, a, b, c, d, e, ...)"
    got = {(r["ref_kind"], r["target"], r["via"]) for r in refs}
    assert {("extends", "B", ""), ("call", "Client", "__init__"), ("method_call", "Client::send", "go"), ("call", "UserService", "go")} <= got
    _, refs = python_ast.extract("b.py", "def f(a: Optional[Order], b: 'list[Part]') -> Path:\n    raise ValueError(Path(str(a)))\nclass C:\n    def m(self, d: Dict[str, Ledger]): return C, print(d)\n")
    assert {(r["target"], r["via"]) for r in refs if r["ref_kind"] == "call"} == {("Order", ""), ("Part", ""), ("Ledger", "m")}


def test_assets(spark):
    from loomgraph.operators.extract import assets

    guid = "0123456789abcdef0123456789ABCDEF"
    defs, refs = assets.extract("a.prefab", f"%YAML 1.1\nm_Script: {{fileID: 1, guid: {guid}}}\nm_TargetAssemblyTypeName: Game.Door, Assembly\nm_MethodName: Open\n")
    assert defs[0]["subkind"] == "unity.prefab" and ("guid", guid.lower()) in {(r["ref_kind"], r["target"]) for r in refs} and ("method_call", "Door::Open") in {(r["ref_kind"], r["target"]) for r in refs}
    assert assets.extract("a.asset", "x: 1") == ([], [])


def test_compact_summary_and_sizes(spark):
    from loomgraph.functions.text import byte_size
    from loomgraph.operators.extract.summary import compact_summary

    source = '"""Carts.\\n\\nMore."""\nimport os\nimport money.rates\nclass Cart(Base):\n    def total(self): return Rate()\n' + "".join(f"def f{i}(x): pass\n" for i in range(14))
    got = compact_summary("shop/cart.py", *python_ast.extract("shop/cart.py", source)).splitlines()
    assert got[0] == "shop/cart.py: Carts." and got[1] == "class Cart(Base): total(self)" and got[2].endswith("f11(x) and 2 more") and got[3:] == ["imports: money", "uses: Rate"]
    assert compact_summary("x.py", [], []) == "x.py"
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (3 << 20,), (5 << 30,)], "n bigint")
    assert [r[0] for r in sizes.select(byte_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.5 KB", "3.0 MB", "5.0 GB"]


def test_staged_tables_go_with_their_scope(spark):
    from loomgraph import session

    with session.scratch_scope(spark):
        df = session.stage(spark.range(5).toDF("n"), "scoped")
        files = [f.removeprefix("file://").removeprefix("file:") for f in df.inputFiles()]
        assert df.count() == 5 and all(os.path.exists(f) for f in files)
    assert files and not any(os.path.exists(f) for f in files)
