import random

from loomgraph.llm import subjects as S

AREAS = {"law": "court juror verdict clause statute appeal", "music": "violin chord tempo octave choir sonata", "space": "comet orbit nebula quasar pulsar zenith", "farm": "barley tractor hay silo herd wheat"}
COMMON = "the value index record total limit option window result batch count page row name key state".split()


def text(rng, subjects, n=60, strays=()):
    own = [w for s in subjects for w in AREAS[s].split()]
    words = [rng.choice(own) if own and rng.random() < 0.35 else rng.choice(COMMON) for _ in range(n)]
    words += [rng.choice(AREAS[s].split()) for s in strays]
    return " ".join(rng.choice([w, f"{w}_{rng.choice(COMMON)}", f"get{w.capitalize()}"]) for w in words)


def sample(n, seed):
    rng = random.Random(seed)
    names = sorted(AREAS)
    rows = []
    for i in range(n):
        kind = rng.random()
        subjects = [] if kind < 0.1 else rng.sample(names, 2) if kind < 0.3 else [rng.choice(names)]
        strays = [rng.choice([x for x in names if x not in subjects])] if subjects else []
        rows.append((i, text(rng, subjects, rng.randint(60, 120), strays), sorted(subjects)))
    return rows


def tables(spark, train, test):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in test], "id bigint, text string, subject string, terms int")
    labelled = spark.createDataFrame([(i, t, s) for i, t, s in train if s], "sample_id bigint, text string, subjects array<string>")
    areas = spark.createDataFrame([(s, f"About {d.split()[0]}.") for s, d in AREAS.items()], "subject string, description string")
    return docs, labelled, areas


def test_held_out_accuracy(spark):
    train, test = sample(120, 1), sample(300, 2)
    got = S.document_subjects(*tables(spark, train, test), key="id", text="text")
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], set()).add(r["subject"])
        assert 0 < r["share"] <= 1
    right = sum(by.get(i, set()) == set(s) for i, _, s in test)
    assert right >= 0.93 * len(test)
    assert {r["subject"] for r in S.composition(got).collect()} == set(AREAS)


def test_edges(spark):
    train = sample(60, 3)
    docs, labelled, areas = tables(spark, train, [(1, None, []), (2, "", []), (3, "1 2 3 {}", []), (4, "violin chord " * 20_000, []), (5, "é ü " * 50, [])] * 2)
    got = S.document_subjects(docs, labelled, areas, key="id", text="text")
    assert sorted((r["id"], r["subject"]) for r in got.collect()) == [(4, "music"), (4, "music")]
    assert S.document_subjects(docs.limit(0), labelled, areas, key="id", text="text").count() == 0
    assert S.document_subjects(docs, labelled, areas.limit(0), key="id", text="text").count() == 0
    assert S.document_subjects(docs, labelled.limit(0), areas, key="id", text="text").count() >= 0


def test_rounds_end_when_the_loss_settles_and_no_term_is_left_out(spark):
    train, test = sample(80, 5), sample(200, 6)
    docs, labelled, areas = tables(spark, train, [(i, f"{t} rare{chr(97 + i % 26)}{chr(97 + i // 26)}", s) for i, t, s in test])
    vectors = S._vectors(docs, ["id"], "text")
    seeds = [(r["text"], list(r["subjects"])) for r in labelled.collect()]
    named = [(r["subject"], r["description"]) for r in areas.collect()]
    model = S.fit(vectors, seeds, named)
    assert len(model.losses) > 2 and model.losses[-1] < model.losses[0] and model.losses[-2] - model.losses[-1] < 0.001 * model.losses[-2]
    # every term has a column, whatever its frequency, and the columns are as many for any corpus
    assert S._document_frequency(vectors, 1 << 18).sum() == sum(len(S.term_counts(r["text"], S._Ids())[0]) for r in docs.collect())
    small = S.fit(vectors, seeds, named, n_columns=4096)
    assert small.h.shape == (4, 4096) and model.h.shape == (4, 1 << 18)


def test_the_cut_is_fitted_on_texts_held_out(spark):
    train = sample(120, 7)
    docs, labelled, areas = tables(spark, train, sample(100, 8))
    seeds = [(r["text"], list(r["subjects"])) for r in labelled.collect()]
    model = S.fit(S._vectors(docs, ["id"], "text"), seeds, [(r["subject"], r["description"]) for r in areas.collect()])
    assert 0.05 <= model.least_share <= 0.45 and model.least_share != S.Model.least_share
