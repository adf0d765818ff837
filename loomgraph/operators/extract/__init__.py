"""Source files to definitions and references, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.extract import assets, lexical, python_ast
from loomgraph.schema import DEFS, REFS

Extractor = Callable[[str, str], tuple[list[dict], list[dict]]]

EXTRACTORS: dict[str, Extractor] = {"python": python_ast.extract, "unity": assets.extract, **{language: lexical.extractor(language) for language in lexical.LANGUAGES}}

# what is found in so many files is held as Python objects
FILES_AT_ONCE = 1000


def register_extractor(language: str, extract: Extractor) -> None:
    """Add or replace the extractor of a language: (path, text) to definition and reference dicts."""
    EXTRACTORS[language] = extract


def _struct(schema: str) -> pa.StructType:
    method = pa.struct([("name", pa.string()), ("signature", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = []
    for part in schema.split(", "):
        name, _, kind = part.partition(" ")
        fields.append((name, pa.list_(method) if kind.startswith("array<struct") else kinds[kind]))
    return pa.struct(fields)


def extract(files: DataFrame) -> DataFrame:
    """``path, language, defs, refs, parse_error`` of files with ``path, language, content``.

    Never fails on a file: what cannot be parsed has no definitions and a
    ``parse_error``.  Unknown languages, null and blank texts give empty lists.
    """
    chosen = dict(EXTRACTORS)
    defs_type, refs_type = _struct(DEFS), _struct(REFS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, FILES_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, FILES_AT_ONCE)):
            defs, refs, errors = [], [], []
            for path, language, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                d, r, e = [], [], None
                if path and text and text.strip() and language in chosen:
                    try:
                        d, r = chosen[language](path, text)
                    except Exception as ex:  # noqa: BLE001 - a file must not end the scan
                        e = f"{type(ex).__name__}: {ex}"[:200]
                defs.append(d)
                refs.append(r)
                errors.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(defs, pa.list_(defs_type)), pa.array(refs, pa.list_(refs_type)), pa.array(errors, pa.string())], names=["path", "language", "defs", "refs", "parse_error"])

    shape = lambda s: ",".join(p.replace(" ", ":", 1) for p in s.split(", "))
    return files.select("path", "language", "content").mapInArrow(run, f"path string, language string, defs array<struct<{shape(DEFS)}>>, refs array<struct<{shape(REFS)}>>, parse_error string")


def definitions(parsed: DataFrame) -> DataFrame:
    return parsed.select("language", F.inline("defs"))


def references(parsed: DataFrame) -> DataFrame:
    return parsed.select("language", F.inline("refs"))
