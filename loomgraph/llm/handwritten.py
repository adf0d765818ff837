"""Generated, minified, vendored and data files among source files.

Three grammars are inferred from the tokens of each file, many files at a time:

* a Re-Pair grammar over token classes (names, numbers and strings each one
  class): files that a tool writes are one rule used over and over, and the
  rules of minified files meet no line ends;
* the same over the characters of long literals: what stays near its own length
  is random or encoded data;
* a grammar by locally consistent pairing over the tokens themselves.  Equal
  stretches of two files get equal rules wherever they stand, so rules that many
  repositories share tell third-party copies, changed lines and headers or not.

All three replace pairs in rounds on arrays; only (rule, owner, file) rows of
the third are shuffled, pre-aggregated per rule and owner.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage

# the most frequent first, with the blanks behind them: fast
_TOKEN = re.compile(r"([a-zA-Z_][a-zA-Z0-9_$]*+[\w$]*+|\n|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|[^\w\s])[ \t]*+")
# Literals stand beside comments, so that no comment starts within one; group 1 is what stays.  A regular expression
# stands where no division can; `//` after a colon is an address in plain text.  The lookahead has the first characters of all: fast.
_COMMENT = re.compile(
    r"(?=[/\"'`u# \t])(?:/\*.*?\*/|\"\"\".*?\"\"\"|^[ \t]*#[^\n]*"
    r"|(\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|```|`(?:[^`\\]++|\\.)*+`"
    r"|/(?![/*])(?:(?<=[(,=:\[!&|?{};+~>\n]/)|(?<=[(,=:\[!&|?{};+~>] /)|(?<=\breturn/)|(?<=\breturn /)|(?<=\bcase /)|(?<=\btypeof /))(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/"
    r"|url\([^()\"'\n]*\))"
    r"|(?<![:/])//[^\n]*)",
    re.S | re.M,
)
# words that are tokens of their own; all others are names
_WORDS = frozenset("def class return if else elif for while in not and or import from package public private protected static final const let var function func int char short long float double void struct enum new this self None True False true false nil null type interface export extends implements case switch default break continue range try except catch finally throw raise with as is lambda await async yield typedef unsigned signed defer go map chan boolean String".split())
_PROSE = r"\.(?:md|txt|rst|env|ini)$"
# folders of dependencies, of which the first hold nothing else, and the name of the library in them
_DEPENDENCY = re.compile(r"(?:(?P<sure>(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|third[_-]?party)|^vendor)|(?:^|/)(?:vendor|external|extern|deps))/(?P<name>@[^/]+/[^/]+|[^/]+)/", re.I)
_OPENING = re.compile(r"\ufeff?\s*(?://|/\*|#|--|\"\"\"|'''|<!--)")
_LICENCE = re.compile(r"licen[cs]e|spdx", re.I)
_HOLDER = re.compile(r"copyright|\(c\)|upstream|\bv\d+\.\d+", re.I)
HEAD = 1000  # characters in which a header stands
NAME, NUMBER, STRING, BLOB = 1, 2, 3, 4
LONG = 24  # characters from which a literal may be data
LEAST_CODED = 0.9  # bits of a literal's grammar, to those of random data, from which it is data however long
LEAST_SHARED = 60  # shared tokens from which a text is a copied file and no common page or preamble


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of a pair; the symbol of the rule a b."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _alternate(at: np.ndarray, keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at positions ``at`` win against both neighbours; in a run of equal pairs every other one.

    Positions that are not given lose.
    """
    n = len(at)
    beside = at[1:] == at[:-1] + 1
    start = np.ones(n, dtype=bool)
    start[1:] = ~beside | (keys[1:] != keys[:-1])
    first = np.flatnonzero(start)
    offset = np.arange(n) - np.repeat(first, np.diff(first, append=n))
    left = np.ones(n, dtype=bool)
    left[1:] = ~start[1:] | ~beside | (rank[1:] > rank[:-1])
    right = np.ones(n, dtype=bool)
    right[:-1] = ~beside | (rank[:-1] > rank[1:]) | ~start[1:]
    return (offset % 2 == 0) & left & right


def _may_repeat(keys: np.ndarray) -> np.ndarray:
    """False only for keys that occur once: those alone in their bucket, which need not be sorted."""
    bits = min(20, (4 * len(keys)).bit_length())
    bucket = (keys >> np.uint64(64 - bits)).view(np.int64)
    return np.bincount(bucket)[bucket] > 1


class Grammars(NamedTuple):
    """Of each file: its symbols, its grammar's size, the share of its symbols under its most used rule, its rules, symbols under rules, and line ends in or behind these."""

    n: np.ndarray
    size: np.ndarray
    share: np.ndarray
    rules: np.ndarray
    covered: np.ndarray
    breaks: np.ndarray


def repair(symbols: np.ndarray, files: np.ndarray, n_files: int, ends: np.ndarray | None = None, least: int = 8) -> Grammars:
    """Re-Pair on many files, until no pair of any file repeats.

    Each round replaces, in every file, the pairs that occur at least half as
    often as its most frequent one.  The share counts rules of ``least`` symbols
    or more at the time they are made.  ``ends``: whether a line ends behind each
    symbol.
    """
    n = np.bincount(files, minlength=n_files)
    length = np.ones(len(symbols), dtype=np.int64)
    after = np.zeros(len(symbols), dtype=np.int64) if ends is None else ends.astype(np.int64)
    within = np.zeros(len(symbols), dtype=np.int64)  # line ends between the tokens of a symbol
    rules = np.zeros(n_files, dtype=np.int64)
    share = np.zeros(n_files)
    left = np.ones(n_files, dtype=bool)  # files in which a pair still repeats
    done, covered, breaks = (np.zeros(n_files, dtype=np.int64) for _ in range(3))

    def finish(which: np.ndarray) -> None:
        made = which & (length > 1)
        done[:] += np.bincount(files[which], minlength=n_files)
        covered[:] += np.bincount(files[made], length[made], n_files).astype(np.int64)
        breaks[:] += np.bincount(files[made], within[made] + after[made], n_files).astype(np.int64)

    while len(symbols) > 1:
        pairs = _mix(symbols[:-1], symbols[1:])
        keys = _mix(pairs, files[:-1].astype(np.uint64))
        at = np.flatnonzero((files[1:] == files[:-1]) & _may_repeat(keys))
        key, of = keys[at], files[at]
        order = np.argsort(key)
        ordered, new = key[order], np.ones(len(at), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        counts = np.append(first[1:], len(at))[: len(first)] - first
        group, count = np.empty_like(order), np.empty_like(order)
        group[order], count[order] = np.repeat(np.arange(len(first)), counts), np.repeat(counts, counts)
        most = np.zeros(n_files, dtype=np.int64)
        np.maximum.at(most, of, count)
        good = np.flatnonzero((count >= 2) & (2 * count >= most[of]))
        at, key, group, count = at[good], key[good], group[good], count[good]
        chosen = _alternate(at, key, count + (key >> np.uint64(11)).astype(np.float64) / 2.0**53)
        used = np.bincount(group[chosen], minlength=len(first))
        chosen &= used[group] >= 2
        if not chosen.any():
            break
        where, group = at[chosen], group[chosen]
        uses, of = used[group], files[where]
        long = length[where] + length[where + 1]
        symbols = symbols.copy()
        symbols[where], length[where] = pairs[where], long
        within[where] += after[where] + within[where + 1]
        after[where] = after[where + 1]
        big = long >= least
        np.maximum.at(share, of[big], uses[big] * long[big] / n[of[big]])
        one = np.empty(len(first), dtype=np.int64)
        one[group] = of
        rules += np.bincount(one[used >= 2], minlength=n_files)
        keep = np.ones(len(symbols), dtype=bool)
        keep[where + 1] = False
        # files without a repeated pair are finished
        moved = np.zeros(n_files, dtype=bool)
        moved[of] = True
        if (left & ~moved).any():
            finish(keep & ~moved[files])
            left &= moved
            keep &= moved[files]
        kept = np.flatnonzero(keep)
        symbols, files, length, after, within = (x[kept] for x in (symbols, files, length, after, within))
    finish(np.ones(len(symbols), dtype=bool))
    return Grammars(n, done + 2 * rules, share, rules, covered, breaks)


def consistent_rules(symbols: np.ndarray, files: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules by locally consistent pairing: symbol, length and file of each stretch of about ``least`` symbols or more.

    A pair is replaced where its hash is greater than those of the pairs beside
    it, which depends on nothing but the text around it.  Stretches that are long
    enough are left alone, so all files are cut at the same places.
    """
    length = np.ones(len(symbols), dtype=np.int64)
    while len(symbols) > 1:
        short = length < least
        at = np.flatnonzero((files[1:] == files[:-1]) & short[1:] & short[:-1])
        pair = _mix(symbols[at], symbols[at + 1])
        chosen = _alternate(at, pair, (pair >> np.uint64(11)).astype(np.float64))
        where = at[chosen]
        if not len(where):
            break
        symbols = symbols.copy()
        symbols[where] = pair[chosen]
        length[where] += length[where + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[where + 1] = False
        kept = np.flatnonzero(keep)
        symbols, files, length = symbols[kept], files[kept], length[kept]
    return symbols, length, files


class _Tokens(dict):
    """Token text to (class, hash), packed; remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c in "\"'" and len(token) > 1:
            kind = STRING
        elif c.isdigit():
            kind = NUMBER
        elif (c.isalpha() or c in "_$") and token not in _WORDS:
            kind = NAME
        else:
            kind = 16 + (zlib.crc32(token.encode("utf-8", "replace")) & 0xFFFFF)
        packed = (kind << 32) | zlib.crc32(token.encode("utf-8", "replace"))
        if len(self) > 200_000:
            self.clear()
        if len(token) < 100:
            self[token] = packed
        return packed


_DATA = re.compile(r"(?P<escapes>(?:\\x[0-9a-fA-F]{2}){6,})|(?P<array>(?:0[xX][0-9a-fA-F]{2},\s*){8,})|(?P<text>[A-Za-z0-9+/=_-]{%d,})" % LONG)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_FORMAT = re.compile(r"\\x|0[xX]|[,\s]+")
_NO_TEXT = np.array([not re.fullmatch(r"[A-Za-z0-9+/=_-]", chr(b)) for b in range(256)])


def coded_share(symbols: np.ndarray) -> tuple[float, float]:
    """Of the symbols' Re-Pair grammar: its size to their number, and its bits to those of random symbols of the same alphabet.

    The grammar takes the logarithm of its distinct symbols, rules included, for
    each symbol.  No code is shorter than random data, so the bits stay near 1 or
    above at any length and of any alphabet, while the size falls.
    """
    distinct = len(np.unique(symbols))
    if distinct < 2:
        return 0.0, 0.0
    made = repair(symbols.astype(np.uint64), np.zeros(len(symbols), dtype=np.int64), 1)
    share = float(made.size[0] / len(symbols))
    return share, share * float(np.log2(distinct + made.rules[0]) / np.log2(distinct))


def _long_runs(text: str) -> int:
    """Characters in runs of ``LONG`` or more that ``text`` of ``_DATA`` consists of, which it finds but slowly."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    runs = np.diff(np.flatnonzero(_NO_TEXT[data]), prepend=-1, append=len(data)) - 1
    return int(runs[runs >= LONG].sum())


def literal_share(text: str) -> float:
    """Share of the text in long literals without blanks that Re-Pair cannot shorten; escapes and arrays as the bytes they give."""
    # without escapes and arrays, all that can be found is runs
    if not any(x in text for x in ("\\x", "0x", "0X")) and _long_runs(text) < 0.3 * len(text):
        return 0.0
    kinds: dict[str, list[str]] = {"bytes": [], "hex": [], "text": []}
    total = 0
    for m in _DATA.finditer(text):
        total += len(m.group())
        kind = "bytes" if m.lastgroup != "text" else "hex" if _HEX.fullmatch(m.group()) else "text"
        kinds[kind].append(m.group())
    if total < 0.3 * len(text):
        return 0.0
    share = 0.0
    for kind, parts in kinds.items():
        joined = "".join(parts)
        plain = bytes.fromhex(_FORMAT.sub("", joined)) if kind == "bytes" else joined.encode("ascii")
        size, bits = coded_share(np.frombuffer(plain, dtype=np.uint8))
        if size > 0.6 or bits > LEAST_CODED:
            share += len(joined) / len(text)
    return share


def _search(pattern: re.Pattern, words: tuple[str, ...], text: str) -> re.Match | None:
    """The pattern, none of whose matches is without one of the words, in any case; ASCII is asked for these first, which is fast."""
    low = text.lower()
    return pattern.search(text) if not text.isascii() or any(w in low for w in words) else None


def origin(path: str | None, text: str) -> str | None:
    """``library``: path, or path and header, say that the file is a third party's; ``hint``: one of them may say so."""
    folder = _search(_DEPENDENCY, ("modules", "components", "packages", "party", "vendor", "extern", "deps"), path or "")
    head = text[:HEAD] if _OPENING.match(text) else ""
    header = bool(_search(_LICENCE, ("licen", "spdx"), head) and _HOLDER.search(head))
    if folder and (folder["sure"] is not None or header and folder["name"].lower() in head.lower()):
        return "library"
    return "hint" if folder or header else None


# line ends a token in written and in minified code: the two models between which a file's rules decide
WRITTEN, MINIFIED = 0.08, 0.002
SIGNALS = "origin string, n_tokens int, reuse double, rule_share double, minified double, blob double"


def minified_odds(covered: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Logarithm of the odds that line ends at a file's rules are as rare as in minified code, not as in written code.

    Line ends are Poisson events of either rate, so the odds grow with what the
    rules cover: a file whose rules cover little says little.
    """
    return covered * (WRITTEN - MINIFIED) - breaks * np.log(WRITTEN / MINIFIED)


def _measure(texts: list[str | None], memory: _Tokens) -> tuple[list[np.ndarray], tuple]:
    found = [_TOKEN.findall(_COMMENT.sub(r"\1 ", t)) if t else [] for t in texts]
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    packed = np.fromiter(map(memory.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(sizes.sum())).astype(np.uint64)
    files = np.repeat(np.arange(len(texts)), sizes)
    line = packed == np.uint64(memory["\n"])
    # whether a line ends behind each token
    ends = np.append(line[1:], False)[~line]
    packed, files = packed[~line], files[~line]
    made = repair(packed >> np.uint64(32), files, len(texts), ends)
    signals = [made.n, made.n / np.maximum(made.size, 1), made.share, minified_odds(made.covered, made.breaks), np.array([literal_share(t) if t else 0.0 for t in texts])]
    return signals, consistent_rules(packed & np.uint64(0xFFFFFFFF), files)


def file_signals(files: DataFrame, *, key: str, path: str, owner: str, text: str, batch: int = 1000) -> DataFrame:
    """``key, path, owner``, the signals, and ``rules``: (rule, length) of the consistent grammar."""
    kinds = dict(files.dtypes)
    schema = f"{key} {kinds[key]}, {path} {kinds[path]}, {owner} {kinds[owner]}, {SIGNALS}, rules array<struct<rule:bigint,length:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Tokens()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = part.column(3).to_pylist()
                signals, (symbols, length, of) = _measure(texts, memory)
                # a rule counts once a file, with all it covers there
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=part.num_rows))])
                rules = pa.StructArray.from_arrays([pa.array(symbols.view(np.int64)), pa.array(length.astype(np.int32))], names=["rule", "length"])
                columns = [pa.array([origin(p, t) for p, t in zip(part.column(1).to_pylist(), texts)], pa.string()), pa.array(signals[0].astype(np.int32)), *[pa.array(np.asarray(s, dtype=np.float64)) for s in signals[1:]]]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rules)], schema=pa.schema([*[whole.schema.field(c) for c in range(3)], *[pa.field(n, t) for n, t in (("origin", pa.string()), ("n_tokens", pa.int32()), ("reuse", pa.float64()), ("rule_share", pa.float64()), ("minified", pa.float64()), ("blob", pa.float64()))], pa.field("rules", pa.list_(pa.struct([("rule", pa.int64()), ("length", pa.int32())])))]))

    return files.select(key, path, owner, text).filter(F.col(text) != "").mapInArrow(run, schema)


def not_handwritten(files: DataFrame, *, key: str, path: str, owner: str, text: str, min_owners: int = 5, min_shared: float = 0.3, min_odds: float = 7.0, hot_from: int = 1_000_000) -> DataFrame:
    """``key, reason`` and the signals of each file that was not written by hand.

    ``reason`` is ``vendored`` (at least ``min_shared`` of its tokens under rules
    that ``min_owners`` owners or more share, or two or more if its path or header
    hints at a library; or these say so by themselves), ``minified`` (with at
    least ``min_odds``), ``blob`` or ``generated``, the first that holds.  Rules
    of ``hot_from`` files or more are split over as many tasks as they fill.  Null and empty texts are no cases, nor
    are prose and settings files, whose repeats say nothing.  A null owner is one
    owner, a null path one without a suffix.  Repeated files give repeated rows.
    """
    measured = stage(file_signals(files, key=key, path=path, owner=owner, text=text), "file-signals")
    code = measured.filter(~F.coalesce(F.col(path), F.lit("")).rlike(_PROSE))
    rows = code.select(key, F.coalesce(F.xxhash64(owner), F.lit(0)).alias("owner"), F.inline("rules"))
    # per rule and owner first, so that a rule found everywhere is a few rows before it meets its files
    owned = rows.groupBy("rule", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("rule").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("n"))
    several = stage(owned.filter(F.col("owners") >= min(2, min_owners)), "shared-rules")
    hot = several.filter(F.col("n") >= hot_from).select("rule", (F.floor(F.col("n") / F.lit(hot_from)) + 1).cast("int").alias("salts"))  # at most all rows / hot_from
    salts = F.coalesce("salts", F.lit(1))
    spread = several.join(F.broadcast(hot), "rule", "left").select("rule", "owners", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    lengths = rows.join(F.broadcast(hot), "rule", "left").withColumn("salt", F.pmod(F.xxhash64(key), salts).cast("int")).groupBy(key, "rule", "salt").agg(F.sum("length").alias("length")).join(spread, ["rule", "salt"])
    shared = lengths.groupBy(key).agg(F.sum(F.when(F.col("owners") >= min_owners, F.col("length"))).alias("shared"), F.sum("length").alias("shared_few"))
    tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    judged = code.drop("rules").join(shared, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) / tokens for c in ("shared", "shared_few")})
    copied = {c: (F.col(c) >= min_shared) & (F.col(c) * F.col("n_tokens") >= LEAST_SHARED) for c in ("shared", "shared_few")}
    reason = (
        F.when(copied["shared"] | F.col("origin").eqNullSafe("library") | F.col("origin").eqNullSafe("hint") & copied["shared_few"], "vendored")
        .when(F.col("minified") >= min_odds, "minified")
        .when(F.col("blob") >= 0.5, "blob")
        .when((F.col("reuse") >= 4.5) | (F.col("reuse") >= 2.4) & (F.col("rule_share") >= 0.65), "generated")
    )
    return judged.withColumn("reason", reason).filter("reason is not null").select(key, "reason", "n_tokens", "reuse", "rule_share", "minified", "blob", "shared")
