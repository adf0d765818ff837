"""Definitions and references to a property graph: entities, edges, stubs.

Every step is a join over all definitions at once, so the result does not depend
on the order in which files were read.  Names are the identity of entities; of
several definitions of a name the first by (path, line) counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import entity_id, module_path, name_key
from loomgraph.schema import ENTITIES, conform
from loomgraph.session import stage

# Bases that are never entities.
PLAIN_BASES = ["object", "ABC", "BaseModel"]
SUFFIXES = [".py", "/__init__.py", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.js", ".java", ".rs", "/mod.rs", ".rb"]


def import_base(path: Column, target: Column, level: Column) -> tuple[Column, Column]:
    """The file that an import names as it is written, and the path without suffix that it else means."""
    bare = F.translate(F.regexp_replace(target, "::", "/"), ".\\", "//")
    folder = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    up = F.array_join(F.slice(folder, 1, F.greatest(F.size(folder) - level + 1, F.lit(0))), "/")
    base = F.when(level > 0, F.concat_ws("/", F.when(up != "", up), F.when(bare != "", bare))).otherwise(bare)
    return F.concat_ws("/", F.when(up != "", up), F.translate(target, "\\", "/")), base  # includes name the file itself


def base_candidates(base: Column, root: Column) -> Column:
    """Files that such a path may mean, in the order in which they are tried; ``root``: the import is not relative."""
    short = F.regexp_replace(base, r"/?[^/]*$", "")
    direct = [F.concat(base, F.lit(s)) for s in SUFFIXES]
    dropped = [F.when(short != "", F.concat(short, F.lit(s))) for s in (".rs", "/mod.rs", ".py")]
    library = [F.when(root, F.concat(F.lit("lib/"), base, F.lit(".rb")))]
    return F.filter(F.array(*direct, *dropped, *library), lambda c: c.isNotNull())


def _sorted(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and merged at every size.

    Staged tables are small on disk and large in memory (compressed, and the
    optimizer does not see how often ``explode`` repeats a row), so it would
    broadcast what the driver cannot hold.
    """
    return df.hint("merge")


def build(parsed: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of parsed files (``path, language, defs, refs``).

    Edges: contains (module to class and function), imports (resolved file),
    depends_on (first part of an import that is no file), extends, uses
    (field types and guid references), calls.  Bases and capitalised callees
    without a definition become stubs; lower-case ones and ALL-CAPS names are
    left out.  A method call reaches the class of its receiver, else the only
    one to three classes that define the method.
    """
    defs = stage(parsed.select("language", F.inline("defs")), "defs")
    refs = stage(parsed.select("language", F.inline("refs")), "refs")
    order = F.struct("path", "line_start", "name")
    own = defs.withColumn("name_key", name_key(F.col("name"))).filter("name_key != ''")
    fields = ["name", "path", "kind", "subkind", "bases", "decorators", "docstring", "line_start", "line_end", "signature", "methods", "language"]
    first = own.groupBy("name_key").agg(F.min_by(F.struct(*fields), order).alias("d")).select("name_key", "d.*")
    # a total order without a sort of all rows in one task
    first = first.withColumn("seq", F.xxhash64("path", "line_start", "name"))
    active = first.select(
        entity_id(F.col("name")).alias("id"), "seq", F.col("kind").alias("type"), F.when(F.col("subkind") != "", F.array("subkind")).alias("kind"), "name", "name_key",
        F.lit("active").alias("status"), F.lit(1).alias("version"), F.lit("scanner").alias("source"), F.col("docstring").alias("summary"), F.col("path").alias("file_path"),
        "line_start", "line_end", "signature", F.array_join("bases", ",").alias("base_classes"), F.transform("methods", lambda m: m["name"]).alias("methods"),
        F.col("methods").alias("method_details"), F.array_join("decorators", ",").alias("decorators"),
        F.create_map(F.lit("language"), F.col("language"), F.lit("module_path"), F.when(F.col("kind") == "module", module_path(F.col("path")))).alias("custom"),
        at.alias("created"), at.alias("updated"),
    )
    active = stage(active, "entities")
    keys = active.select("name_key", F.col("id").alias("dst"), "type", "file_path")

    module_of = lambda path: entity_id(path)
    source = F.when(F.coalesce("owner", F.lit("")) == "", module_of(F.col("path"))).otherwise(entity_id(F.col("owner")))
    contains = own.filter("kind != 'module'").select(module_of(F.col("path")).alias("src"), F.lit("contains").alias("kind"), entity_id(F.col("name")).alias("dst"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("method"))

    # the paths that imports mean are few and are tried once each; what an import names as written depends on its file
    named, base = import_base(F.col("path"), F.col("target"), F.col("level"))
    imports = refs.filter("ref_kind = 'import'").select("path", "target", "is_relative", name_key(named).alias("named_key"), base.alias("base"), F.coalesce(F.col("level") == 0, F.lit(False)).alias("root"))
    files = keys.filter("type = 'module'").select(F.col("name_key").alias("candidate_key"), "dst")
    tried = imports.select("base", "root").distinct().select("base", "root", F.posexplode(base_candidates(F.col("base"), F.col("root"))).alias("n", "candidate")).withColumn("candidate_key", name_key(F.col("candidate")))
    meant = tried.join(_sorted(files), "candidate_key").groupBy("base", "root").agg(F.min_by("dst", "n").alias("meant"))
    resolved = imports.join(_sorted(meant), ["base", "root"], "left").join(_sorted(files.select(F.col("candidate_key").alias("named_key"), F.col("dst").alias("written"))), "named_key", "left")
    resolved = stage(resolved.select("path", "target", "is_relative", F.coalesce("written", "meant").alias("dst")), "imports")
    import_edges = resolved.filter("dst is not null").select(module_of(F.col("path")).alias("src"), F.lit("imports").alias("kind"), "dst", F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("method"))
    outside = resolved.filter("dst is null and not is_relative and target != ''")
    package = F.regexp_extract("target", r"^([^./:\\]+)", 1)
    depends = outside.select(module_of(F.col("path")).alias("src"), F.lit("depends_on").alias("kind"), package.alias("name")).filter("name != ''")

    plain = F.regexp_extract("target", r"([^.:]+)$", 1)
    wanted = refs.filter(F.col("ref_kind").isin("extends", "call", "field")).select(source.alias("src"), F.element_at(F.create_map(F.lit("extends"), F.lit("extends"), F.lit("call"), F.lit("calls"), F.lit("field"), F.lit("uses")), F.col("ref_kind")).alias("kind"), plain.alias("name"), F.when(F.col("serialized"), F.lit("serialized")).alias("note"))
    wanted = wanted.filter(~F.col("name").isin(PLAIN_BASES) & ~F.col("name").rlike("^[A-Z0-9_]{2,}$")).withColumn("name_key", name_key(F.col("name")))
    # ids are functions of names, so only what makes no stub must be looked up
    certain = (F.col("kind") == "extends") | F.col("name").rlike("^[A-Z]")
    known = wanted.filter(certain).unionByName(wanted.filter(~certain).join(_sorted(keys.select("name_key")), "name_key", "left_semi"))
    stub_names = wanted.filter(certain).select("name_key", "name").unionByName(depends.select(name_key(F.col("name")).alias("name_key"), "name")).distinct()
    stubs = stub_names.groupBy("name_key").agg(F.min("name").alias("name")).join(_sorted(keys.select("name_key")), "name_key", "left_anti").select(
        entity_id(F.col("name")).alias("id"), F.xxhash64("name_key").alias("seq"), F.lit("other").alias("type"), "name", "name_key", F.lit("stub").alias("status"), F.lit(1).alias("version"), F.lit("stub").alias("source"), F.lit("").alias("file_path"), at.alias("created"), at.alias("updated")
    )
    stubs = stage(stubs, "stubs")
    to_names = known.select("src", "kind", entity_id(F.col("name")).alias("dst"), "note", F.lit(None).cast("string").alias("method"))
    to_packages = depends.select("src", "kind", entity_id(F.col("name")).alias("dst"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("method"))

    calls = refs.filter("ref_kind = 'method_call'").select(source.alias("src"), F.split_part("target", F.lit("::"), F.lit(1)).alias("receiver"), F.split_part("target", F.lit("::"), F.lit(2)).alias("m"), "via")
    classes = keys.filter("type = 'class'").select("name_key", "dst")
    received = calls.select("src", "receiver", "m").distinct().withColumn("name_key", name_key(F.col("receiver"))).join(_sorted(classes), "name_key", "left")
    # read twice: for receivers and for guesses
    received = stage(received.select("src", "m", "dst").distinct(), "calls")
    owners = active.filter("type = 'class'").select(F.col("id").alias("dst"), F.explode("methods").alias("method_name")).select("dst", F.lower("method_name").alias("mk")).distinct()
    # classes per method first: a name that many classes define is dropped before it meets its calls
    rare = owners.groupBy("mk").agg(F.count(F.lit(1)).alias("n")).filter("n <= 4").select("mk")
    guess = received.filter("dst is null").select("src", "m", F.lower("m").alias("mk")).join(_sorted(owners.join(_sorted(rare), "mk")), "mk").filter("src != dst")
    guess = guess.groupBy("src", "m").agg(F.collect_set("dst").alias("found")).filter("size(found) <= 3").select("src", F.explode("found").alias("dst"), "m")
    method_edges = received.filter("dst is not null").select("src", "dst", "m").unionByName(guess).select("src", F.lit("calls").alias("kind"), "dst", F.lit(None).cast("string").alias("note"), F.col("m").alias("method"))

    # every dst is an entity: taken from one, or an id of a name that is one or became a stub
    every = reduce(DataFrame.unionByName, [contains, import_edges, to_packages, to_names, method_edges]).filter("src != dst")
    ids = active.select("id").union(stubs.select("id"))
    numbered = every.groupBy("src", "kind", "dst").agg(F.max("note").alias("note"), F.array_sort(F.collect_set("method")).alias("called_methods"))
    rank = {"contains": 0, "imports": 1, "depends_on": 2, "extends": 3, "uses": 4, "calls": 5}
    position = F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col("kind"))
    edges = numbered.join(_sorted(ids.select(F.col("id").alias("src"))), "src", "left_semi").select("src", position.alias("pos"), "kind", "dst", "note", "called_methods")
    triples = calls.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct(F.col("receiver").alias("receiver"), F.col("m").alias("method"), F.coalesce("via", F.lit("")).alias("via")))).alias("called_methods"))
    entities = conform(active.join(_sorted(triples), "id", "left"), ENTITIES).unionByName(conform(stubs, ENTITIES))
    return entities, edges


def guid_edges(refs: DataFrame, guids: DataFrame, entities: DataFrame) -> DataFrame:
    """``uses`` edges from assets to the class, else the module, of the file that carries the guid (``path, guid``)."""
    wanted = refs.filter("ref_kind = 'guid'").select(entity_id(F.col("path")).alias("src"), F.col("target").alias("guid"))
    best = entities.filter("status = 'active' and type in ('class', 'module')").groupBy(F.col("file_path").alias("path")).agg(F.min_by("id", F.struct(F.when(F.col("type") == "class", 0).otherwise(1), F.col("line_start"))).alias("dst"))
    return wanted.join(guids, "guid").join(best, "path").filter("src != dst").select("src", F.lit(4).alias("pos"), F.lit("uses").alias("kind"), "dst", F.lit(None).cast("string").alias("note"), F.array().cast("array<string>").alias("called_methods")).distinct()
