"""Source files that do not parse in the language their path names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.syntax import grammars, lexers
from loomgraph.llm.syntax.tables import Tables

LANGUAGES = {
    "py": (grammars.PYTHON, lexers.PythonLexer),
    "js": (grammars.JAVASCRIPT, lexers.JsLexer),
    "ts": (grammars.TYPESCRIPT, lexers.TsLexer),
    "java": (grammars.JAVA, lexers.JavaLexer),
    "go": (grammars.GO, lexers.GoLexer),
    "c": (grammars.C, lexers.CLexer),
    "json": (grammars.JSON, lexers.JsonLexer),
}
SUFFIX = r"\.(" + "|".join(LANGUAGES) + ")$"


@cache
def tables(language: str) -> Tables:
    """Parse tables of a language, built once a process."""
    return Tables(LANGUAGES[language][0])


class Checker:
    """First unrecoverable error of a file, by language; lexers are made when first met."""

    def __init__(self, made: dict[str, Tables]) -> None:
        self.made, self.lexers = made, {}

    def lexer(self, language: str) -> lexers.Lexer:
        if language not in self.lexers:
            self.lexers[language] = LANGUAGES[language][1](self.made[language])
        return self.lexers[language]

    def error_line(self, language: str, text: str) -> int:
        """1-based line of the first token that no parse can take; 0 if the file parses."""
        lexer = self.lexer(language)
        at = lexer.first_error(text)
        return lexer.line_of(text, at) if at >= 0 else 0


_checkers: dict[int, Checker] = {}


def parse_errors(files: DataFrame, *, key: str, path: str, text: str) -> DataFrame:
    """``key, language, error_line``: a row per file that does not parse.

    The language is that of the path's suffix; files of other suffixes, and null
    or empty texts or paths, are no cases.  Unresolved names are no errors.
    Repeated files give repeated rows.  There is no shuffle: the parse tables,
    of fixed size, are sent to the executors.
    """
    held = files.sparkSession.sparkContext.broadcast({language: tables(language) for language in LANGUAGES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = held.value
        if id(made) not in _checkers:
            _checkers.clear()
            _checkers[id(made)] = Checker(made)
        error_line = _checkers[id(made)].error_line
        for batch in batches:
            lines = [error_line(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2))]
            bad = pa.array([i for i, n in enumerate(lines) if n], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(bad), batch.column(1).take(bad), pa.array([n for n in lines if n], pa.int32())], names=[key, "language", "error_line"])

    language = F.regexp_extract(F.col(path), SUFFIX, 1)
    code = files.select(F.col(key), language.alias("language"), F.col(text)).filter("language != ''").filter(F.col(text) != "")
    return code.mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, language string, error_line int")


def error_rates(files: DataFrame, errors: DataFrame, *, key: str, path: str, text: str, by: list[str]) -> DataFrame:
    """``by..., n_files, n_bad, rate`` over the files that could be checked."""
    known = files.filter((F.regexp_extract(F.col(path), SUFFIX, 1) != "") & (F.col(text) != ""))
    marked = known.select(key, *by).join(errors.select(key).distinct().withColumn("_bad", F.lit(1)), key, "left")
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.count("_bad").alias("n_bad")).withColumn("rate", F.col("n_bad") / F.col("n_files"))
