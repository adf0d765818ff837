"""Ranked text search and symbol lookup over entities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import name_key, name_words, query_tokens, with_synonyms
from loomgraph.functions.vocab import DETAIL_TYPES, IMPACT_KINDS, OUTBOUND_KINDS
from loomgraph.operators.graph import resolve

TOKENS_PER_ENTITY = 80  # fixed value


def token_estimate(found: DataFrame) -> DataFrame:
    """One row ``n, tokens``: entities of a result and about how many tokens their text takes."""
    return found.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * TOKENS_PER_ENTITY).alias("tokens"))


def last_events(entities: DataFrame, n: int = 3) -> DataFrame:
    """``id, events``: the last ``n`` events of each timeline, in order."""
    t = F.col("timeline")
    return entities.select("id", F.when(t.isNotNull(), F.slice(t, F.greatest(F.size(t) - n + 1, F.lit(1)), n)).alias("events"))


def grouped(found: DataFrame, by: str) -> DataFrame:
    """``by, n, names``: a small result grouped for display, names in order."""
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))


def tokens_of(spark, query: str) -> list[str]:
    """Tokens and synonyms of a query; driver-side, a query being one short text."""
    row = spark.range(1).select(with_synonyms(query_tokens(F.lit(query))).alias("t")).first()
    return list(row["t"])


def _has(entities: DataFrame, column: str, empty: Column) -> Column:
    return F.coalesce(F.col(column), empty) if column in entities.columns else empty


def score_twentieths(entities: DataFrame, tokens: list[str]) -> Column:
    """Score of an entity against the tokens in twentieths, exact: name, summary, tags, bases, aliases, methods, file and signature."""
    none = F.array().cast("array<string>")
    name = F.lower("name")
    summary = F.lower(_has(entities, "summary", F.lit("")))
    tags = F.lower(F.concat_ws(" ", _has(entities, "tags", none)))
    aliases = F.lower(F.concat_ws(" ", _has(entities, "aliases", none)))
    bases = F.lower(_has(entities, "base_classes", F.lit("")))
    methods = F.transform(_has(entities, "methods", none), lambda m: F.lower(F.trim(m)))
    files = F.filter(F.split(F.lower(_has(entities, "file_path", F.lit(""))), r"[/._\\]"), lambda p: F.length(p) >= 2)
    signature = F.lower(_has(entities, "signature", F.lit("")))

    def one(t: str) -> Column:
        part_hits = F.filter(files, lambda p: p.contains(t))
        return (
            F.when(name == t, 20).when(name.contains(t), 14).when(F.array_contains(name_words(F.col("name")), t), 10).otherwise(0)
            + F.when(F.substring(summary, 1, 300).contains(t), F.when(F.length(summary) > 60, 12).otherwise(8)).otherwise(0)
            + F.when(tags.contains(t), 8).otherwise(0)
            + F.when(bases.contains(t), 9).otherwise(0)
            + F.when(aliases.contains(t), 7).otherwise(0)
            + F.when(F.exists(methods, lambda m: m.contains(t) | ((m != "") & F.lit(t).contains(m))), 7).otherwise(0)
            # the first part that holds the token decides
            + F.when(F.size(part_hits) == 0, 0).when(F.element_at(part_hits, 1) == t, 6).otherwise(3)
            + F.when(signature.contains(t), 3).otherwise(0)
        )

    return sum((one(t) for t in tokens), F.lit(0))


def context(entities: DataFrame, edges: DataFrame, query: str, *, anchors: list[str] = (), max_seeds: int = 8, hops: int = 1, detail: str = "medium", max_results: int = 40) -> DataFrame:
    """Entities that matter for a task: ``id, hop, score`` (twentieths), best first.

    The ``max_seeds`` best entities and the ``anchors`` (30 twentieths) are
    seeds; with ``hops`` their direct targets join with 2 twentieths.  A seed
    stays a seed.  Stubs and deleted entities are no seeds, deleted ones no
    neighbours.  Neighbours are limited to the types of ``detail``.  Ties go to
    the first inserted.  Without tokens only the anchors count.
    """
    tokens = tokens_of(entities.sparkSession, query)
    live = entities.filter("status != 'deleted'")
    scored = live.filter("status != 'stub'").select("id", "seq", score_twentieths(live, tokens).alias("score")).filter("score > 0")
    seeds = scored.orderBy(F.desc("score"), "seq", "id").limit(max_seeds).select("id", "seq", "score")
    for a in anchors:
        seeds = seeds.unionByName(resolve(entities, a).select("id", "seq", F.lit(30).alias("score")))
    # a scored seed keeps its score over an anchor's
    seeds = seeds.groupBy("id").agg(F.min("seq").alias("seq"), F.min_by("score", F.when(F.col("score") == 30, 1).otherwise(0)).alias("score")).withColumn("hop", F.lit(0))
    out = seeds
    if hops > 0:
        near = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        near = near.join(seeds.select("id"), "id", "left_anti").join(live.filter(F.col("type").isin(DETAIL_TYPES.get(detail, DETAIL_TYPES["medium"]))).select("id", "seq"), "id")
        out = seeds.unionByName(near.select("id", "seq", F.lit(2).alias("score"), F.lit(1).alias("hop")))
    return out.orderBy(F.desc("score"), "hop", "seq", "id").limit(max_results).select("id", "hop", "score")


def find(entities: DataFrame, name: str, *, max_results: int = 10) -> DataFrame:
    """``id, tier``: entities of this name (0), with it as last part (1), or containing it (2); best first, then first inserted."""
    low = name.lower()
    ename = F.lower("name")
    inside = ename.contains(low)
    if "::" in low:
        inside = inside & ~ename.rlike("(?s)" + re.escape(low) + "[a-z0-9_]")
    tier = F.when(ename == low, 0).when(ename.endswith(f".{low}") | ename.endswith(f"_{low}"), 1).when(inside, 2)
    found = entities.filter("status != 'deleted'").withColumn("tier", tier).filter("tier is not null")
    return found.orderBy("tier", "seq", "id").limit(max_results).select("id", "tier")


def callers(matches: DataFrame, edges: DataFrame, *, per_match: int = 15) -> DataFrame:
    """``id, caller, via, rank``: the first ``per_match`` sources of impact edges to each match."""
    w = Window.partitionBy("id").orderBy("src", "pos", "kind")
    hit = edges.filter(F.col("kind").isin(IMPACT_KINDS)).select("src", "pos", "kind", F.col("dst").alias("id")).join(matches.select("id"), "id", "left_semi")
    # window top-k is limited inside each task before the shuffle
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_match).select("id", F.col("src").alias("caller"), F.col("kind").alias("via"), "rank")


def callees(matches: DataFrame, edges: DataFrame, *, first: int = 12) -> DataFrame:
    """``id, callee, via``: targets among the first ``first`` relations of each match that are of an outbound kind."""
    return edges.filter((F.col("pos") < first) & F.col("kind").isin(OUTBOUND_KINDS)).join(matches.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("callee"), F.col("kind").alias("via"))


def split_method(query: str) -> tuple[str, str]:
    """(class hint, method) of ``Class::m``, ``Class.m`` or ``m``."""
    for cut in ("::", "."):
        if cut in query and not query.startswith("."):
            hint, _, method = query.rpartition(cut)
            return hint.strip(), method.strip()
    return "", query.strip()


def method_definitions(entities: DataFrame, query: str) -> DataFrame:
    """``id, method, priority``: classes that define the method; the hinted class alone if it does, else all."""
    hint, method = split_method(query)
    live = entities.filter("status not in ('deleted', 'stub')")
    low = method.lower()
    has = F.filter("methods", lambda m: F.lower(F.trim(m)) == low)
    every = live.withColumn("m", has).filter(F.size("m") > 0).select("id", F.element_at("m", 1).alias("method"), F.lit(1).alias("priority"))
    if not hint:
        return every
    hinted = resolve(live, hint).withColumn("m", has).filter(F.size("m") > 0).select("id", F.element_at("m", 1).alias("method"), F.lit(0).alias("priority"))
    same = every.join(live.filter(F.lower("name") == hint.lower()).select("id"), "id", "left_semi")
    # the hinted one wins; the others count only without it
    return hinted.unionByName(same.join(hinted.select(F.lit(1).alias("k")), F.lit(True), "left_anti"))


def method_callers(entities: DataFrame, edges: DataFrame, definitions: DataFrame, method: str) -> DataFrame:
    """``class_id, id, via, line``: who calls the method on the classes of ``definitions`` (``id``).

    A call triple counts for the class that its receiver names and for classes
    to which its owner has any relation; one without a receiver counts for every
    other class, which is one row whose ``class_id`` is null.  Owners without
    such a triple count if a relation to the class lists the method or names it
    in its note.  Every step is an equality join.
    """
    low = method.lower()
    live = entities.filter("status not in ('deleted', 'stub')")
    classes = definitions.join(live.select("id", F.lower("name").alias("cname")), "id").select(F.col("id").alias("class_id"), "cname").distinct()
    triples = live.select("id", "line_start", "method_details", F.explode("called_methods").alias("c")).filter(F.lower("c.method") == low).withColumn("receiver", F.lower(F.coalesce("c.receiver", F.lit(""))))
    related = edges.join(classes.select(F.col("class_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("class_id"), "kind", "note", "called_methods", "pos")
    # a class calling its own method without a receiver means another class only if there is one
    lone = classes.agg(F.min("class_id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("id")
    cols = ["class_id", "id", "line_start", "method_details", "c"]
    free = triples.filter("receiver = ''").join(lone, "id", "left_anti").withColumn("class_id", F.lit(None).cast("string")).select(*cols)
    named = triples.filter("receiver != ''").join(classes.withColumnRenamed("cname", "receiver"), "receiver").select(*cols)
    linked = triples.filter("receiver != ''").join(related.select("id", "class_id").distinct(), "id").select(*cols)
    direct = free.unionByName(named).unionByName(linked).filter("class_id is null or id != class_id")
    if classes.limit(1).isEmpty():
        direct = direct.limit(0)
    via_fn = F.coalesce("c.via", F.lit(""))
    own = F.filter(F.coalesce("method_details", F.array().cast("array<struct<name:string,signature:string,line_start:int,line_end:int>>")), lambda d: F.lower(d["name"]) == F.lower(via_fn))
    line = F.get(F.transform(own, lambda d: d["line_start"]), F.lit(0))
    a = direct.select("class_id", "id", F.when(via_fn == "", F.concat(F.lit(f"calls {method}"))).otherwise(F.concat(F.lit(f"calls {method} (in "), via_fn, F.lit(")"))).alias("via"), F.coalesce(line, F.col("line_start")).alias("line"))
    listed = F.exists(F.coalesce("called_methods", F.array().cast("array<string>")), lambda m: F.lower(m) == low)
    noted = F.lower(F.coalesce("note", F.lit(""))).contains(low)
    known = a.select("class_id", "id").distinct()
    b = related.filter("id != class_id").filter(listed | noted).join(known.filter("class_id is not null"), ["class_id", "id"], "left_anti").join(known.filter("class_id is null").select("id"), "id", "left_anti").join(live.select("id", "line_start"), "id")
    b = b.select("class_id", "id", F.when(listed, F.lit(f"calls {method}")).otherwise(F.concat(F.col("kind"), F.lit(" ("), F.col("note"), F.lit(")"))).alias("via"), F.col("line_start").alias("line"))
    return a.unionByName(b).groupBy("class_id", "id", "via").agg(F.min("line").alias("line"))


def stats_by_type(entities: DataFrame) -> DataFrame:
    """``type, n, n_stubs`` over live entities."""
    return entities.filter("status != 'deleted'").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "stub").alias("n_stubs"))


def search(entities: DataFrame, *, type: str | None = None, kind: str | None = None, tag: str | None = None) -> DataFrame:
    """Live entities by type, member of kind, and tag in any case."""
    out = entities.filter("status != 'deleted'")
    if type:
        out = out.filter(F.col("type") == type)
    if kind:
        out = out.filter(F.array_contains("kind", kind))
    if tag:
        out = out.filter(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    return out


def stub_names(entities: DataFrame) -> DataFrame:
    return entities.filter("status = 'stub'").select("id", "name", name_key(F.col("name")).alias("name_key"))
