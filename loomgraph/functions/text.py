"""Column functions on names, paths and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)\s+"


def name_key(name: Column) -> Column:
    """Identity of a name: outer blanks trimmed, inner blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, BLANKS, " ")))


def clean_path(path: Column) -> Column:
    """Path with single forward slashes and no leading ``./``."""
    slashed = F.regexp_replace(path, r"[\\/]+", "/")
    return F.regexp_replace(slashed, r"^(\./)+", "")


def clean_hash(value: Column) -> Column:
    """Digest without case and ``sha256:`` prefix; null if it was not computed."""
    bare = F.regexp_replace(F.lower(F.trim(value)), "^sha256:", "")
    return F.when(bare != "", bare)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name with its dot, '' for none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]+)$", 1), r".(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """Lower-case file name without its last suffix."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def lookup(key: Column, table: dict[str, object], default: object = "") -> Column:
    """Value of a small fixed table; a literal map, so no join."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def _spaced(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z\d])([A-Z])", "$1 $2")


def name_words(name: Column) -> Column:
    """Lower-case words of an identifier."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_spaced(name)), F.lit("([a-z0-9]{2,})"), F.lit(1)))


def query_tokens(text: Column) -> Column:
    """Tokens of a query text: identifiers split, stop words out, first places kept."""
    from loomgraph.functions.vocab import STOP_WORDS

    found = F.regexp_extract_all(F.lower(_spaced(text)), F.lit("([a-z0-9_]{2,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def with_synonyms(tokens: Column) -> Column:
    """Tokens followed by what they stand for, without repeats."""
    from loomgraph.functions.vocab import SYNONYMS

    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(tokens, more))


def module_path(path: Column) -> Column:
    """Dotted module name of a file."""
    from loomgraph.functions.vocab import SCAN_SUFFIXES

    known = "|".join(s[1:] for s in SCAN_SUFFIXES)
    bare = F.regexp_replace(F.regexp_replace(clean_path(path), rf"\.(?:{known})$", ""), r"/(?:index|__init__)$", "")
    return F.translate(bare, "/", ".")


def factory_class(name: Column) -> Column:
    """Class that a factory function by its name makes, '' if it is none."""
    bare = F.regexp_extract(name, r"^(?:get|create|build|make|load|init|setup)_([a-z0-9_]+)$", 1)
    return F.replace(F.initcap(F.translate(bare, "_", " ")), F.lit(" "), F.lit(""))


def is_test_path(path: Column) -> Column:
    """Path of a test entity."""
    return path.contains("tests/") | path.contains("/test_") | path.startswith("test_")


def is_test_file(path: Column) -> Column:
    """File in which findings count one level less."""
    from loomgraph.functions.vocab import TEST_PARTS

    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, TEST_PARTS))) | stem(path).rlike(r"\.test|\.spec|_test|_spec")


def is_handler_file(path: Column) -> Column:
    """File that requests reach, judged by its path."""
    from loomgraph.functions.vocab import HANDLER_AFFIXES, HANDLER_DIRS, HANDLER_STEMS

    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ends = "|".join(HANDLER_AFFIXES)
    return F.arrays_overlap(folders, F.array(*map(F.lit, HANDLER_DIRS))) | stem(path).isin(HANDLER_STEMS) | stem(path).rlike(f"^(?:{ends})|(?:{ends})$")


def is_exception_name(name: Column) -> Column:
    return name.rlike(r"(?i)(?:error|exception|warning|notfound|notsupported|forbidden|denied|invalid)$")


def content_hash(text: Column) -> Column:
    """Digest of a text after its line ends are made one kind."""
    return F.concat(F.lit("sha256:"), F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256))


def finding_id(path: Column, rule: Column, snippet: Column) -> Column:
    """Identity of a finding that outlives moved lines."""
    return F.substring(F.sha2(F.concat_ws(":", path, rule, F.substring(F.trim(snippet), 1, 120)), 256), 1, 8)


def entity_id(name: Column) -> Column:
    """Stable id of a name."""
    return F.concat(F.lit("ws_"), F.substring(F.sha2(name_key(name), 256), 1, 16))


def byte_size(n: Column) -> Column:
    """A number of bytes as text: whole bytes, else one decimal of KB, MB or GB."""
    unit = lambda power, name: F.concat(F.format_number(n / F.lit(1024.0**power), 1), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))
