"""Extraction, graph build and rules over a small project in every language, whose answers are stored as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import security
from loomgraph.operators.build import build, guid_edges
from loomgraph.operators.extract import extract
from loomgraph.session import stage
from loomgraph.sources.files import scan_language

GUID = "0123456789abcdef0123456789abcdef"
FILES = {
    "shop/base.py": "class Base:\n    pass\n",
    "shop/models.py": "from .base import Base\nimport requests\n\nclass Cart(Base):\n    def __init__(self):\n        self.bank = Bank()\n    def total(self, item: Item) -> Money:\n        self.bank.charge(item)\n        return get_tax_rate()\n\ndef helper(x):\n    return Cart()\n",
    "web/api.ts": "export class Api {\n  call(x: number) { return x; }\n}\n",
    "web/app.ts": "import { Api } from './api';\nexport abstract class App extends Api {\n  start(): void { new Client().run(); }\n}\nconst boot = (a) => a;\nfunction _hidden() {}\n",
    "src/Order.java": "package p;\nimport java.util.List;\npublic class Order extends Entity implements Priced {\n  public void add(int n) {\n    new Line();\n  }\n}\n",
    "src/Point.kt": "import a.Shape\ndata class Point(val x: Int) : Shape\nfun origin() {}\n",
    "go/server.go": "package main\nimport \"fmt\"\ntype Server struct {\n  n int\n}\nfunc (s *Server) Run() {}\nfunc New() *Server {\n  return &Server{}\n}\nfunc hidden() {}\n",
    "rs/lib.rs": "use crate::shape::Area;\npub struct Square;\npub fn side() -> u32 { measure() }\n",
    "c/list.c": "#include \"list.h\"\ntypedef struct { int n; } List;\nint length(int n) {\n  return measure_all(n);\n}\n",
    "cpp/tree.cpp": "#include <vector>\nclass Tree : public Plant {\n  void grow();\n};\n",
    "cs/Door.cs": "using UnityEngine;\npublic class Door : MonoBehaviour {\n  public void Open() {\n  }\n}\n",
    "cs/Hand.cs": "public class Hand {\n  [SerializeField] private Door door;\n  public void Push() {\n    door.Open();\n  }\n}\n",
    "rb/car.rb": "require 'engine'\nclass Car < Vehicle\n  def drive\n  end\nend\ndef top\nend\n",
    "php/Page.php": "<?php\nuse App\\View;\nabstract class Page extends View {\n  function show() {}\n}\n",
    "sw/Bird.swift": "import Foundation\nstruct Bird: Animal {\n  func fly() {}\n}\nfunc nest() {}\n",
    "scene/House.prefab": "%YAML 1.1\nMonoBehaviour:\n  m_Script: {fileID: 1, guid: " + GUID.upper() + "}\n  m_Calls:\n  - m_TargetAssemblyTypeName: Door, Assembly-CSharp\n    m_MethodName: Open\n",
    "broken.py": "def (:\n",
}
UNSAFE = {
    "app/db.py": "# cursor.execute(f\"SELECT {x}\")\ncursor.execute(f\"SELECT * FROM t WHERE a = {x}\")\nsubprocess.run(cmd, shell=True)\nyaml.load(data)\nhashlib.md5(b'x')\n",
    "app/routes/pay.js": "const a = eval(input);\n// eval(other)\n",
    "tests/test_db.py": "hashlib.md5(b'x')\nsubprocess.run(cmd, shell=True)\n",
    "node_modules/x.js": "eval(input);\n",
    "plain.txt": "eval(input)\n",
}


def _rows(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), "path string, content string")


def _parsed(spark: SparkSession) -> DataFrame:
    files = _rows(spark, FILES)
    return stage(extract(files.withColumn("language", scan_language(F.col("path")))), "fixture")


def fixture_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and functions of every language, with their methods."""
    defs = _parsed(spark).select(F.inline("defs")).filter("kind != 'module'")
    return defs.select("path", "kind", "subkind", "name", F.array_join("bases", ",").alias("bases"), F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods"), "line_start")


def fixture_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the project: every relation by the names of its ends."""
    parsed = _parsed(spark)
    entities, edges = build(parsed, F.lit("2030-01-01").cast("timestamp"))
    guids = spark.createDataFrame([("cs/Door.cs", GUID)], "path string, guid string")
    edges = edges.unionByName(guid_edges(parsed.select(F.inline("refs")), guids, entities))
    name = lambda end: entities.select(F.col("id").alias(end), F.concat("name", F.when(F.col("status") == "stub", " (stub)").otherwise("")).alias(f"{end}_name"))
    return edges.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_name").alias("source"), "kind", F.col("dst_name").alias("target")).distinct()


def fixture_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in a few unsafe files: comments, dependencies and tests are treated as the rules say."""
    found = security.scan(_rows(spark, UNSAFE))
    return found.select("file", "line", "severity", F.split_part("owasp", F.lit(":"), F.lit(1)).alias("category"), "cwe", "taint_reachable").distinct()


QUERIES = {f.__name__: f for f in (fixture_definitions, fixture_relations, fixture_findings)}
# The answers, checked by eye against the files.
DEFINITIONS = [
    ("c/list.c", "class", "struct", "List", "", "", 2),
    ("c/list.c", "function", "", "length", "", "", 3),
    ("cpp/tree.cpp", "class", "", "Tree", "Plant", "grow", 2),
    ("cs/Door.cs", "class", "", "Door", "MonoBehaviour", "Open", 2),
    ("cs/Hand.cs", "class", "", "Hand", "", "Push", 1),
    ("go/server.go", "class", "struct", "Server", "", "Run", 3),
    ("go/server.go", "function", "", "New", "", "", 7),
    ("php/Page.php", "class", "abstract", "Page", "View", "show", 3),
    ("rb/car.rb", "class", "", "Car", "Vehicle", "drive", 2),
    ("rb/car.rb", "function", "", "top", "", "", 6),
    ("rs/lib.rs", "class", "struct", "Square", "", "", 2),
    ("rs/lib.rs", "function", "", "side", "", "", 3),
    ("shop/base.py", "class", "", "Base", "", "", 1),
    ("shop/models.py", "class", "", "Cart", "Base", "__init__,total", 4),
    ("shop/models.py", "function", "", "helper", "", "", 11),
    ("src/Order.java", "class", "", "Order", "Entity,Priced", "add", 3),
    ("src/Point.kt", "class", "data", "Point", "Shape", "", 2),
    ("src/Point.kt", "function", "", "origin", "", "", 3),
    ("sw/Bird.swift", "class", "struct", "Bird", "Animal", "fly", 2),
    ("sw/Bird.swift", "function", "", "nest", "", "", 5),
    ("web/api.ts", "class", "", "Api", "", "call", 1),
    ("web/app.ts", "class", "abstract", "App", "Api", "start", 2),
    ("web/app.ts", "function", "", "boot", "", "", 5),
]
RELATIONS = [
    ("App", "calls", "Client (stub)"),
    ("App", "extends", "Api"),
    ("Bird", "extends", "Animal (stub)"),
    ("Car", "extends", "Vehicle (stub)"),
    ("Cart", "calls", "Bank (stub)"),
    ("Cart", "calls", "Item (stub)"),
    ("Cart", "calls", "Money (stub)"),
    ("Cart", "calls", "TaxRate (stub)"),
    ("Cart", "extends", "Base"),
    ("Door", "extends", "MonoBehaviour (stub)"),
    ("Hand", "calls", "Door"),
    ("Hand", "uses", "Door"),
    ("New", "calls", "Server"),
    ("Order", "calls", "Line (stub)"),
    ("Order", "extends", "Entity (stub)"),
    ("Order", "extends", "Priced (stub)"),
    ("Page", "extends", "View (stub)"),
    ("Point", "extends", "Shape (stub)"),
    ("Tree", "extends", "Plant (stub)"),
    ("c/list.c", "contains", "List"),
    ("c/list.c", "contains", "length"),
    ("cpp/tree.cpp", "contains", "Tree"),
    ("cpp/tree.cpp", "depends_on", "vector (stub)"),
    ("cs/Door.cs", "contains", "Door"),
    ("cs/Door.cs", "depends_on", "UnityEngine (stub)"),
    ("cs/Hand.cs", "contains", "Hand"),
    ("go/server.go", "contains", "New"),
    ("go/server.go", "contains", "Server"),
    ("go/server.go", "depends_on", "fmt (stub)"),
    ("helper", "calls", "Cart"),
    ("php/Page.php", "contains", "Page"),
    ("php/Page.php", "depends_on", "App"),
    ("rb/car.rb", "contains", "Car"),
    ("rb/car.rb", "contains", "top"),
    ("rb/car.rb", "depends_on", "engine (stub)"),
    ("rs/lib.rs", "contains", "Square"),
    ("rs/lib.rs", "contains", "side"),
    ("scene/House.prefab", "calls", "Door"),
    ("scene/House.prefab", "uses", "Door"),
    ("shop/base.py", "contains", "Base"),
    ("shop/models.py", "contains", "Cart"),
    ("shop/models.py", "contains", "helper"),
    ("shop/models.py", "depends_on", "requests (stub)"),
    ("shop/models.py", "imports", "shop/base.py"),
    ("src/Order.java", "contains", "Order"),
    ("src/Order.java", "depends_on", "java (stub)"),
    ("src/Point.kt", "contains", "Point"),
    ("src/Point.kt", "contains", "origin"),
    ("src/Point.kt", "depends_on", "a (stub)"),
    ("sw/Bird.swift", "contains", "Bird"),
    ("sw/Bird.swift", "contains", "nest"),
    ("sw/Bird.swift", "depends_on", "Foundation (stub)"),
    ("web/api.ts", "contains", "Api"),
    ("web/app.ts", "contains", "App"),
    ("web/app.ts", "contains", "boot"),
    ("web/app.ts", "imports", "web/api.ts"),
]
FINDINGS = [
    ("app/db.py", 2, "critical", "A03", "CWE-89", False),
    ("app/db.py", 3, "high", "A03", "CWE-78", False),
    ("app/db.py", 4, "high", "A08", "CWE-502", False),
    ("app/db.py", 5, "medium", "A02", "CWE-327", False),
    ("app/routes/pay.js", 1, "high", "A03", "CWE-95", True),
    ("tests/test_db.py", 2, "medium", "A03", "CWE-78", False),
]


def _table(columns: str, rows: list[tuple], types: dict[str, str]) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    names = columns.split()
    return f"SELECT {', '.join(f'CAST({c} AS {types[c]}) AS {c}' if c in types else c for c in names)} FROM (VALUES {', '.join(f'({", ".join(map(cell, r))})' for r in rows)}) AS t({', '.join(names)})"


ORACLES = {
    "fixture_definitions": _table("path kind subkind name bases methods line_start", DEFINITIONS, {"line_start": "INTEGER"}),
    "fixture_relations": _table("source kind target", RELATIONS, {}),
    "fixture_findings": _table("file line severity category cwe taint_reachable", FINDINGS, {"line": "INTEGER", "taint_reachable": "BOOLEAN"}),
}
