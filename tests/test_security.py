from datetime import datetime

from pyspark.sql import functions as F

from loomgraph.operators import security
from loomgraph.operators.rules import RULES

MATCH = security.matcher(RULES)


def hit(language, text):
    return {r for r, _, _ in MATCH(language, text)}


def test_rules_fire():
    assert "py_sql_fstring" in hit("python", 'cur.execute(f"select {x}")')
    assert "py_sql_concat" in hit("python", 'cur.execute("select " + x)')
    assert "py_sql_format" in hit("python", 'cur.execute("select %s" % x)')
    assert "py_eval_exec" in hit("python", "eval(name)") and "py_eval_exec" not in hit("python", "eval('1')")
    assert "py_subprocess_shell_true" in hit("python", "subprocess.run(cmd, shell=True)")
    assert "js_sql_tpl_literal" in hit("javascript", "db.query(`select ${x}`)") and "js_eval_dynamic" in hit("javascript", "eval(code)")
    assert "java_ssl_trust_all" in hit("java", "void checkClientTrusted(X[] c, String a) {\n}")


def test_what_does_not_count():
    for text in ("", "   \n", None):
        assert MATCH("python", text) == []
    assert MATCH("cobol", "eval(x)") == [] and hit("python", "\x00\x01" * 90) == set()
    assert hit("python", "# eval(name)") == set() and hit("javascript", "// eval(code)") == set()
    assert "py_yaml_unsafe_load" not in hit("python", "yaml.load(f, Loader=SafeLoader)")
    assert "py_yaml_unsafe_load" in hit("python", "yaml.load(f,\n  Loader=SafeLoader)")
    assert not hit("python", "x = 1\n")  # no match of nothing
    assert [n for r, n, _ in MATCH("python", "\n\neval(a); eval(b)\n") if r == "py_eval_exec"] == [3]


def test_scan_downgrade_identity_and_order(spark):
    files = spark.createDataFrame(
        [
            ("api/a.py", "import os\nos.system(cmd)\ncur.execute(f'x')\n"), ("tests/a.py", "cur.execute(f'x')\nhashlib.md5(x)\n"), ("node_modules/x.js", "eval(a)"), ("w.min.js", "eval(a)"),
            ("n.py", None), ("e.py", ""), (".git/x.py", "eval(a)"), ("b.py", "\n\nos.system(cmd)\n"),
        ],
        "path string, content string",
    )
    got = {(r["file"], r["pattern_id"]): r for r in security.scan(files).collect()}
    assert got["api/a.py", "py_sql_fstring"]["severity"] == "critical" and got["api/a.py", "py_sql_fstring"]["taint_reachable"]
    assert got["tests/a.py", "py_sql_fstring"]["severity"] == "high" and ("tests/a.py", "py_weak_hash") not in got
    assert {f for f, _ in got} == {"api/a.py", "tests/a.py", "b.py"}
    moved = spark.createDataFrame([("b.py", "x = 1\nos.system(cmd)\n")], "path string, content string")
    assert security.scan(moved).first()["id"] == got["b.py", "py_os_system"]["id"]
    shown = security.display(security.scan(files).withColumn("status", F.lit("unreviewed")), severity="low").collect()
    assert [r["severity"] for r in shown] == sorted((r["severity"] for r in shown), key=["critical", "high", "medium", "low"].index)
    assert security.risk_level(security.scan(files)).first()[0] == "critical" and security.risk_level(security.scan(files.limit(0))).first()[0] == "none"


def test_review_is_carried(spark):
    t = datetime(2030, 1, 1)
    before = spark.createDataFrame([("a", "x", "false_positive", "n", t), ("b", "x", "resolved", None, t), ("c", "x", "verified_vulnerability", None, t), ("d", "x", "unreviewed", None, t)], "id string, file string, status string, notes string, first_seen timestamp")
    now = spark.createDataFrame([("a", "x"), ("b", "x"), ("e", "x")], "id string, file string")
    got = {r["id"]: (r["status"], r["notes"], r["first_seen"]) for r in security.carry_review(now, before, F.lit("2030-02-01").cast("timestamp")).collect()}
    assert got == {"a": ("false_positive", "n", t), "b": ("unreviewed", None, t), "c": ("resolved", None, t), "e": ("unreviewed", None, datetime(2030, 2, 1))}
    set_ = security.triage(before, "resolved", file="X").groupBy("status").count().collect()
    assert [tuple(r) for r in set_] == [("resolved", 4)]
