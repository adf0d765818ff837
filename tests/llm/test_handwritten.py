import base64
import random

import numpy as np

from loomgraph.llm import handwritten as H

WORDS = "total index limit record offset window batch option detail value".split()


def hand(rng, n=14):
    out = ["import os", ""]
    for _ in range(n):
        a, b, c = rng.choices(WORDS, k=3)
        out.append(rng.choice([f"def {a}_{b}({c}):\n    return {c}.{a} + {rng.randint(1, 99)}", f"{a} = [{b}.{c} for {b} in {a} if {b} > {rng.randint(1, 9)}]", f"if {a} is None:\n    raise ValueError({b!r})", f"for {a} in {b}:\n    {c}({a}, {rng.randint(1, 99)})", f"{a}[{b!r}] = {c}"]))
    return "\n".join(out) + "\n"


def getters(rng):
    return "\n".join(f"def get_{rng.choice(WORDS)}_{i}(msg):\n    return msg[{i}]\n" for i in range(15))


def blob(rng):
    data = base64.b64encode(rng.randbytes(900)).decode()
    return "DATA = (\n" + "".join(f'    "{data[i : i + 60]}"\n' for i in range(0, len(data), 60)) + ")\n"


def minified(rng):
    return "".join(f"function a{i}(b,c){{return b.{rng.choice(WORDS)}?c(b.{rng.choice(WORDS)},{i}):void 0}}" for i in range(25))


def corpus():
    rng = random.Random(3)
    rows, want = [], {}

    def add(text, reason, path="a/b.py", owner=None):
        i = len(rows)
        rows.append((i, path, owner if owner is not None else f"r{i % 40}", text))
        if reason:
            want[i] = reason

    for _ in range(60):
        add(hand(rng), None)
    for _ in range(6):
        add(getters(rng), "generated")
        add(blob(rng), "blob")
        add(minified(rng), "minified", "a/b.js")
    library = hand(rng, 30)
    for i in range(7):
        lines = library.split("\n")
        lines[i + 3] += "  # here"
        add(f"# version {i}\n" + "\n".join(lines[i:]), "vendored", owner=f"v{i}")
    copied = hand(rng)
    for i in range(3):  # copies in a few repositories are no library
        add(copied, None, owner=f"w{i}")
    add("X = [\n" + "".join("    " + ", ".join(f"{rng.random():.5f}" for _ in range(8)) + ",\n" for _ in range(40)) + "]\n", "generated")
    add(getters(rng), None, "notes.md")  # prose repeats itself
    add("", None)
    add(None, None)
    return rows, want


def test_reasons(spark):
    rows, want = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id bigint, path string, owner string, text string, reason string, rule int")
    got = H.not_handwritten(df, key="id", path="path", owner="owner", text="text")
    assert {r["id"]: r["reason"] for r in got.collect()} == want


def test_edges(spark):
    schema = "id bigint, path string, owner string, text string"
    where = {"key": "id", "path": "path", "owner": "owner", "text": "text"}
    assert H.not_handwritten(spark.createDataFrame([], schema), **where).count() == 0
    rng = random.Random(1)
    odd = [(1, None, None, getters(rng)), (1, None, None, getters(rng)), (2, "x.py", None, "x"), (3, "y.py", None, "  é" * 4000), (4, "z.py", None, "a\n" * 30_000), (5, "w.py", None, '"' * 999)]
    got = H.not_handwritten(spark.createDataFrame(odd, schema), **where)
    assert sorted(r["id"] for r in got.collect()) == [1, 1, 3, 4]  # one letter over and over is no more hand-written than a table


def expand(symbols, rules):
    return [x for s in symbols for x in (expand(rules[s], rules) if s in rules else [s])]


def test_repair_sizes():
    rng = np.random.default_rng(0)
    texts = [np.array([1, 2, 3, 4] * 50), rng.integers(0, 1000, 200), np.array([7] * 64), np.array([5]), np.array([], dtype=np.int64)]
    symbols = np.concatenate(texts).astype(np.uint64)
    files = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n, size, share = H.repair(symbols, files, len(texts))[:3]
    assert n.tolist() == [200, 200, 64, 1, 0]
    assert size[0] < 30 and size[2] < 20 and size[1] > 180 and size[3] == 1 and size[4] == 0 and share[0] > 0.9


def test_repair_does_not_depend_on_company():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 6, 150).astype(np.uint64) for _ in range(8)]
    files = np.repeat(np.arange(8), 150)
    together = H.repair(np.concatenate(texts), files, 8)
    for i, t in enumerate(texts):
        alone = H.repair(t, np.zeros(150, dtype=np.int64), 1)
        assert alone[0][0] == together[0][i] and abs(int(alone[1][0]) - int(together[1][i])) <= 0.1 * alone[1][0]


def test_consistent_rules_are_shared():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 50, 400).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 50, 37).astype(np.uint64), shared])
    b = np.concatenate([shared, rng.integers(0, 50, 11).astype(np.uint64)])
    rules = []
    for x in (a, b):
        s, length, _ = H.consistent_rules(x, np.zeros(len(x), dtype=np.int64))
        assert length.sum() == len(x)
        rules.append(dict(zip(s.tolist(), length.tolist())))
    common = sum(n for s, n in rules[0].items() if s in rules[1])
    assert common >= 300


def words(text):
    return [w for w in H._TOKEN.findall(H._COMMENT.sub(r"\1 ", text)) if w != "\n"]


def test_no_comment_starts_within_a_literal(spark):
    body = minified(random.Random(4))
    starts = ['fetch("https://x.example/api");', "fetch('//x.example');", "var a=`//${b}`;", r"var a=/^https?:\/\//i;", "if(/[/]//.test(b))c();", "return /a\\//;", 'var a="/*";', "a{background:url(//x.example/a.png)}"]
    for start in starts:
        assert words(start + body)[-40:] == words(body)[-40:], start
    rows = [(i, "a/b.js", "r1", start + body) for i, start in enumerate(starts)]
    got = H.not_handwritten(spark.createDataFrame(rows, "id bigint, path string, owner string, text string"), key="id", path="path", owner="owner", text="text")
    assert {r["id"]: r["reason"] for r in got.collect()} == dict.fromkeys(range(len(starts)), "minified")


def test_comments_are_no_tokens():
    for text in ("a = 1 // don't 'b\nc", "a = 1 /* \"b\n */ c", "a = 1\n  # it's\nc", 'a = 1 """b\n\'""" c', "a = 1 //// b\nc", "a = 1 // ```b\nc"):
        assert words(text) == ["a", "=", "1", "c"], text
    assert words("a = b / c // d / e\nf") == ["a", "=", "b", "/", "c", "f"]


def test_data_is_data_at_any_length(spark):
    rng = random.Random(5)
    for n in (60, 250, 1000, 20_000, 150_000):
        data = rng.randbytes(n)
        for text in (data.hex(), base64.b64encode(data).decode(), "".join(f"\\x{b:02x}" for b in data), "".join(f"0x{b:02x},\n" for b in data)):
            assert H.literal_share(text) > 0.99, (n, text[:20])
    for text in ("0123456789abcdef" * 2000, "\\x00\\x01" * 500, "0x00, " * 500, "a" * 900, "src/main/java/org/index/" * 90):
        assert H.literal_share(text) == 0.0, text[:20]
    rows = [(1, "a.py", "r1", f'DATA = "{rng.randbytes(20_000).hex()}"\n'), (2, "a.c", "r1", 'char *a = "' + "".join(f"\\x{b:02x}" for b in rng.randbytes(999)) + '";\n')]
    got = H.not_handwritten(spark.createDataFrame(rows, "id bigint, path string, owner string, text string"), key="id", path="path", owner="owner", text="text")
    assert {r["id"]: r["reason"] for r in got.collect()} == {1: "blob", 2: "blob"}


def test_libraries_of_few_owners(spark):
    rng = random.Random(7)
    pair, headed, plain, lone, api = (hand(rng, 30) for _ in range(5))
    header = "# oakum v1.2.3\n# (c) The oakum contributors\n#   Released under the permissive licence found beside the upstream sources.\n"
    rows = [
        (1, "app/vendor/oakum/a.py", "r1", pair), (2, "lib/b.py", "r2", pair),  # shared by two, one of them in a folder
        (3, "lib/c.py", "r1", header + headed), (4, "lib/d.py", "r2", header + headed),  # shared by two, with a header
        (5, "src/external/oakum/e.py", "r3", header + lone),  # once; the header names the folder
        (6, "node_modules/oakum/f.py", "r3", hand(rng, 30)), (7, "vendor/oakum/f.py", None, hand(rng, 30)),  # once, where nothing else stands
        (8, "lib/g.py", "r1", plain), (9, "lib/g.py", "r2", plain),  # copies without a hint
        (10, "vendors_api/part/h.py", "r1", api), (11, "vendors_api/part/h.py", "r2", api), (12, "src/external/h.py", "r1", hand(rng, 30)), (13, "app/vendor/part/i.py", "r1", hand(rng, 30)),
        (14, "lib/j.py", "r1", header + hand(rng, 30)), (15, None, "r1", hand(rng, 30)), (16, "lib/k.py", "r1", "LICENCE = 'copyright'\n" + plain),
    ]
    got = H.not_handwritten(spark.createDataFrame(rows, "id bigint, path string, owner string, text string"), key="id", path="path", owner="owner", text="text")
    assert {r["id"]: r["reason"] for r in got.collect()} == dict.fromkeys((1, 3, 4, 5, 6, 7), "vendored")


def test_plain_text_is_not_searched_for_data(monkeypatch):
    rng = random.Random(8)
    searched, slow = [], H._DATA

    class Spy:
        def finditer(self, text):
            searched.append(text)
            return slow.finditer(text)

    monkeypatch.setattr(H, "_DATA", Spy())
    assert {H.literal_share(hand(rng)) for _ in range(20)} == {0.0} and not searched
    assert H.literal_share(blob(rng)) > 0.5 and H.literal_share("0x1f, " * 9) == 0.0 and len(searched) == 2


def test_long_runs_are_what_the_search_finds():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choices(["a", "é", " ", "\n", "+/=_-", "Z9" * 11, "x" * 23, "b" * 24, "(", '"'], k=40))
        assert H._long_runs(text) == sum(len(m.group()) for m in H._DATA.finditer(text)), text


def test_only_pairs_that_may_repeat_are_sorted():
    rng = np.random.default_rng(3)
    once = H._mix(np.arange(50_000, dtype=np.uint64), np.arange(50_000, dtype=np.uint64))
    again = rng.choice(once, 3000)
    kept = H._may_repeat(np.concatenate([once, again]))
    assert kept[np.isin(once, again).nonzero()[0]].all() and kept[50_000:].all() and kept.mean() < 0.4
    assert H._may_repeat(once[:0]).tolist() == [] and not H._may_repeat(once[:1]).any()


def test_pairs_win_against_both_neighbours():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(0, 30))
        keys, given = rng.integers(1, 4, n), rng.random(n) < 0.8
        got = np.zeros(n, dtype=bool)
        at = np.flatnonzero(given)
        got[at] = H._alternate(at, keys[at], keys[at].astype(float))
        rank = [0, *np.where(given, keys, 0), 0]
        begin = 0
        for i in range(1, n + 1):
            begin = begin if rank[i] == rank[i - 1] else i
            beaten = begin == i and rank[i - 1] > rank[i] or rank[i + 1] > rank[i]
            assert got[i - 1] == (rank[i] > 0 and (i - begin) % 2 == 0 and not beaten)


def test_paths_and_headers_in_any_case():
    header = "// Licence: free. Copyright by oakum\n"
    for path in ("a/Node_Modules/x/b.js", "a/ſite-packages/x/b.py", "Vendor/x/b.go", "THIRDPARTY/x/b.c", "jspm_packages/x/b.js", "bower_components/x/b.js"):
        assert H.origin(path, "x") == "library", path
    for path in ("a/External/x/b.c", "a/extern/x/b.c", "deps/x/b.c"):
        assert H.origin(path, "x") == "hint" and H.origin(path, header.replace("oakum", "X")) == "library", path
    for text in (header, header.upper(), header.replace("Licence", "ſPDX"), "\ufeff" + header):
        assert H.origin("a/b.c", text) == "hint" and H.origin("a/vendored/b.c", text) == "hint", text
    assert H.origin(None, "x") is None and H.origin("a/vendor", "// free, (c) oakum") is None
