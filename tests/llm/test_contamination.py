import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import contamination as C


def brute(docs, items, k):
    out = set()
    for d, text in docs:
        w = C.words_of(text)
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i, t in items:
            v = C.words_of(t)
            if any(tuple(v[j : j + k]) in grams for j in range(len(v) - k + 1)):
                out.add((d, i))
    return sorted(out)


def run(spark, docs, items, k=4, **more):
    d = spark.createDataFrame(docs, "id bigint, text string")
    i = spark.createDataFrame(items, "item bigint, words string")
    got = C.leaked_items(d, i, doc_key="id", doc_text="text", item_key="item", item_text="words", min_words=k, **more)
    return sorted((r["id"], r["item"]) for r in got.collect())


def sample(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(25)]
    docs = [(i, rng.choice([" ", ", ", "_", "\n# "]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"pre {t.upper()} post") for i, t in items[:5]]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = sample(1)
    want = brute(docs, items, 4)
    assert want and run(spark, docs, items) == want
    assert run(spark, docs, items, index_items=7) == want  # several blocks of items


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (4, "A-b_c/d é e"), (4, "A-b_c/d é e"), (5, "x " * 20_000)]
    items = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "a b c"), (5, "b c d e")]
    assert run(spark, docs, items) == [(4, 3), (4, 5)]
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=25))
def test_tiles(doc, item):
    tiles = C.tile(doc, item, 3)
    used_d, used_i = set(), set()
    for i, j, n in tiles:
        assert n >= 3 and doc[i : i + n] == item[j : j + n]
        assert not used_d & set(range(i, i + n)) and not used_i & set(range(j, j + n))
        used_d |= set(range(i, i + n))
        used_i |= set(range(j, j + n))
    longest = max((n for i in range(len(doc)) for j in range(len(item)) for n in range(1, 26) if len(doc[i : i + n]) == n and doc[i : i + n] == item[j : j + n]), default=0)
    assert (tiles[0][2] if tiles else 0) == (longest if longest >= 3 else 0)


def test_reordered_passages_count():
    item = list("abcdefghijklmnop")
    doc = item[8:] + ["x"] + item[:8]
    assert sum(n for _, _, n in C.tile(doc, item, 5)) == len(item)


def test_rolling_hash():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 200)
    for k in (1, 2, 5, 13, 16):
        h = C.rolling(x, k)
        assert len(h) == 200 - k + 1
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(int(h[i]), tuple(x[i : i + k])) == tuple(x[i : i + k])
        assert len(seen) == len({tuple(x[i : i + k]) for i in range(len(h))})
    assert len(C.rolling(x[:3], 13)) == 0
