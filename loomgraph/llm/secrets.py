"""Credentials in source text: index literals, confirm the rare ones, scan again for them.

1. Every quoted literal of the corpus is indexed by its owners, wherever it
   stands; those that stand where a credential may, or have the structure of
   one, with their place.
2. Literals that many owners share are placeholders and are dropped, but for
   structured values of no placeholder's shape; of the rest structured values
   count as they are, others if they look like generated or chosen secrets.
3. All texts are scanned again for the confirmed secrets, in one pass whatever
   their number: each secret is known by one pair of words in it, the words of
   every text are looked up in a bit field of those pairs, and texts with a hit
   meet their secrets in a join and are searched with an Aho-Corasick automaton.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage

# Public formats of credentials.
_PROVIDER = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|gh[pousr]_[A-Za-z0-9]{30,}"
    r"|github_pat_[A-Za-z0-9_]{30,}"
    r"|glpat-[A-Za-z0-9_-]{18,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{20,}"
    r"|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|sk-[A-Za-z0-9_-]{32,}"
    r"|AIza[A-Za-z0-9_-]{35}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}"
    r")"
)
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]*)?")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = re.compile(r"(?:[A-Za-z0-9+/=]|\\[nr]|[\s\"'+,;\\])*+")
_USERINFO = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s:/@\"'<>]*:([^\s/@\"'<>]+)@[^\s\"'<>]")
_QUERY = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s\"'<>?]+\?[^\s\"'<>]*?\b(?:token|key|sig|secret|password|passwd|pwd|api_?key|access_token|auth|signature)=([^\s&\"'<>#]{8,})", re.I)
_BASIC = re.compile(r"\bBasic\s+([A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])")
_BEARER = re.compile(r"\bBearer\s+([A-Za-z0-9._~+/-]{16,}=*)")
_PROSE = (
    re.compile(r"\bpass(?:word|phrase|wd)?\s+(?:is\s+)?(?![=:])[\"'`]?([^\s\"'`]{8,})[\"'`]?", re.I),
    re.compile(r"\bIDENTIFIED\s+BY\s+[\"']([^\"'\n]+)[\"']", re.I),
    re.compile(r"\bcurl\b[^\n]*?\s(?:-u|--user)[\s=]+[\"']?[^\s:\"']+:([^\s\"']+)", re.I),
    re.compile(r"\blogin\b[^\n]{0,40}?\s/\s(\S+)", re.I),
    re.compile(r"--?(?:password|passwd|token|secret)[\s=]+[\"']?([^\s\"']{8,})", re.I),
)
# Words that name credentials, and words that say a name is about something else.
_NAMES = {"password", "passwd", "passphrase", "passwort", "kennwort", "pwd", "pw", "pass", "secret", "token", "cred", "creds", "credential", "credentials", "bearer", "apikey", "authorization", "auth"}
_KEYS = {"api", "access", "signing", "encryption", "private", "master", "secret", "shared", "session", "deploy", "service", "client"}
_OTHER = {"column", "prompt", "kind", "hint", "field", "label", "name", "type", "half", "count", "length", "len", "hash", "url", "uri", "path", "file", "env", "policy", "regex", "pattern", "header", "prefix", "public", "placeholder", "param", "index", "class", "limit", "size", "max", "min", "expiry", "ttl", "format", "title", "text", "message", "id"}
_PLACEHOLDER = re.compile(
    r"<.*>?|.*[$%#]\{.*|\{\{.*|\$[A-Za-z_(].*|%[A-Za-z_]+%|%\(.*|\*+|[xX]+|\.+|-+|_+|(?:vault|env|secret|secrets|ssm|op|arn|aws|file|keyring|kms|ref)[:/].*"
    r"|(?:change|replace|your|todo|insert|enter|put|set|my|example|dummy|sample|fake|test|fixme|placeholder|redacted|none|null|undefined|true|false)(?:$|[\W_].*|me.*|this.*)"
    r"|(?:os|process)\.env.*|getenv.*|System\.getenv.*|.*\.(?:get|getenv|environ)\(.*",
    re.I | re.S,
)
# example values of documentation, counted-up letters and digits, omissions; one character over and over
_FILLER = re.compile(r"example|placeholder|dummy|changeme|redacted|your[_-]|12345678|abcdefgh|\.\.\.|[<*]{3}|\$\{", re.I)
_RUN = re.compile(r"(.)\1{7}")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_DIGEST = re.compile(r"(?:sha\d*[-:$]|md5[-:]|blake2\w*[-:])", re.I)
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_STRING = r"[a-zA-Z]{0,2}\"((?:[^\"\\\n]|\\.)*)\"|[a-zA-Z]{0,2}'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`"
_LITERAL = re.compile(_STRING)
# name = "literal", name: "literal", ["name"] = ..., name := ..., String name = ..., name: type = ...
_ASSIGN = re.compile(rf"[\"']?(?P<name>[A-Za-z_$][\w$.-]*)[\"']?\s*\]?\s*(?:\[\])?(?:\s*:\s*[A-Za-z_][\w.<>\[\]| ]*?)?\s*(?::=|=>|=(?!=)|:)\s*(?=[a-zA-Z]{{0,2}}[\"'`])")
_SETTER = re.compile(r"[\"'](?P<name>[A-Za-z][\w.-]*)[\"']\s*,\s*(?=[a-zA-Z]?[\"'])")
_CALL = re.compile(r"\b(?P<name>set_?[A-Za-z]+|login|connect|authenticate|sign_?in|log_?in)\s*\(", re.I)
_COMPARE = re.compile(r"(?:strcmp\s*\([^,()]*,\s*|\.equals\s*\(\s*|[=!]==?\s*)(?=[\"'])")
_GRANT = re.compile(r"unlock|authenticat|grant|sign_?in|log_?in|admin", re.I)
_PLAIN = re.compile(r"^[\s#/*;>-]*(?:export\s+|set\s+)?(?P<name>[A-Za-z][\w .-]{0,40}?)\s*[=:]\s*(?P<value>[^\s\"'`][^\s]*)\s*$")
_JOIN = re.compile(r"\s*(?:\+|\.|\|\||&|\\)?\s*(?:\\?\r?\n[ \t]*(?:\+|\.)?[ \t]*)?")
# a quoted literal without blanks: what the corpus-wide index counts
_QUOTED = re.compile(r"[\"'`]([^\"'`\s]{8,})[\"'`]")
# every rule above needs one of these, so a line without any of them, in lower case, has no place for a credential
_HINTS = "pass secret token cred kennwort pwd pw key auth bearer basic login log_in connect identified curl unlock grant admin strcmp signin sign_in :// eyj akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat- xox k_live_ k_test_ aiza sg. npm_ pypi- hf_ dop_v1 sk- private".split()
_HINT = re.compile("|".join(map(re.escape, _HINTS)), re.I)
_HINT_AUTOMATON = ahocorasick.Automaton()
for _hint in _HINTS:
    _HINT_AUTOMATON.add_word(_hint, len(_hint))
_HINT_AUTOMATON.make_automaton()


def _hinted(text: str) -> Iterator[int]:
    """Offsets in lines that deserve a closer look."""
    low = text.lower()
    if len(low) != len(text):  # lower case of another length moves the offsets
        return (m.start() for m in _HINT.finditer(text))
    return (end for end, _ in _HINT_AUTOMATON.iter(low))


def credential_name(name: str) -> bool:
    """Does this identifier, setting or phrase name a credential?"""
    words = [w.lower() for w in _PART.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in _OTHER or "public" in words:
        return False
    if any(w in _NAMES for w in words):
        return True
    return any(b == "key" and a in _KEYS for a, b in pairwise(words))


def looks_live(value: str) -> bool:
    """Is this literal, standing where a credential may, a generated or chosen secret?"""
    if len(value) < 8 or any(c.isspace() for c in value) or _PLACEHOLDER.fullmatch(value) or _UUID.fullmatch(value) or _DIGEST.match(value):
        return False
    digits, lower, upper = (any(map(f, value)) for f in (str.isdigit, str.islower, str.isupper))
    if digits and (lower or upper):
        return True
    if lower and upper and any(not c.isalnum() and c not in "_-.:/ " for c in value):
        return True
    # letters only: changes of case or runs of consonants that no spelling of words has
    return lower and upper and (len(re.findall(r"[A-Z]{2,}[a-z]|[a-z][A-Z](?![a-z]{2})", value)) >= 2 or bool(_CONSONANTS.search(value)))


def _userpass(value: str) -> str | None:
    """The password in a Basic header's value."""
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4)).decode("ascii")
    except ValueError:
        return None
    user, colon, password = plain.partition(":")
    return password if colon and plain.isprintable() else None


def _basic(value: str) -> bool:
    password = _userpass(value)
    return bool(password) and not _PLACEHOLDER.fullmatch(password)


def stands_in(value: str) -> bool:
    """Has this structured value the shape of a placeholder, so that many owners make it one?"""
    if _BLOCK.match(value):  # keys hold runs of one character, too
        return bool(_FILLER.search(value)) or len(set(_BLOCK_END.sub("", _BLOCK.sub("", value)))) < 16
    if _FILLER.search(value) or _RUN.search(value):
        return True
    if _PROVIDER.match(value) or _JWT.match(value):
        return False
    # within URLs and headers words are defaults
    password = _userpass(value)
    return not looks_live(value if password is None else password)


def _joined(text: str, at: int) -> tuple[str, int, int] | None:
    """The literal that starts at ``at``, with those concatenated to it: value, start and end within the quotes."""
    m = _LITERAL.match(text, at)
    if not m:
        return None
    value, start, end = m.group(m.lastindex), m.start(m.lastindex), m.end(m.lastindex)
    while True:
        gap = _JOIN.match(text, m.end())
        # a template never joins by standing next to a string
        m = _LITERAL.match(text, gap.end()) if text[gap.end() : gap.end() + 1] in ("'", '"') else None
        if not m:
            return value, start, end
        value, end = value + m.group(m.lastindex), m.end(m.lastindex)


def _last_string(text: str, at: int) -> tuple[str, int, int] | None:
    """Last string argument of the call whose parenthesis opens before ``at``."""
    found, depth = None, 1
    while at < len(text) and depth:
        c = text[at]
        if c in "\"'":
            got = _joined(text, at)
            if not got:
                return found
            found, at = got, got[2] + 1
            continue
        if c == "\n":
            return found
        depth += (c in "([{") - (c in ")]}")
        at += 1
    return found


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(value, start, end, structured) of every literal that may be a credential."""
    out: dict[tuple[int, int], tuple[str, bool]] = {}

    def add(value: str, start: int, end: int, structured: bool) -> None:
        # within a structured value nothing else starts
        out[start, end] = (value, structured or out.get((start, end), ("", False))[1])

    done = -1
    ends = [(m.start(), m.end()) for m in _BLOCK_END.finditer(text)] if "PRIVATE KEY" in text else []
    begins = [m.start() for m in _BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    for spot in _hinted(text):
        if spot < done:
            continue
        a = text.rfind("\n", 0, spot) + 1
        b = text.find("\n", spot)
        b = len(text) if b < 0 else b
        done = b + 1
        line = text[a:b].rstrip("\r")
        for m in _BLOCK.finditer(line):
            after = a + m.end()
            end = next(iter(ends[bisect_left(ends, (after,)) :][:1]), None)
            begin = next(iter(begins[bisect_left(begins, after) :][:1]), len(text))
            closed = end is not None and end[0] < begin
            # without an end the key goes on as far as its characters do
            body = text[after : end[0]] if closed else _KEY_BODY.match(text, after, begin).group()
            if len(re.sub(r"\\n|[^A-Za-z0-9+/=]", "", body)) >= 20:
                stop = end[1] if closed else a + len(line)
                add(text[a + m.start() : stop], a + m.start(), stop, True)
        for rx in (_PROVIDER, _JWT):
            for m in rx.finditer(line):
                add(m.group(), a + m.start(), a + m.end(), True)
        if "://" in line:
            for rx in (_USERINFO, _QUERY):
                for m in rx.finditer(line):
                    if not _PLACEHOLDER.fullmatch(m.group(1)) and (rx is _USERINFO or looks_live(m.group(1))):
                        add(m.group(1), a + m.start(1), a + m.end(1), True)
        for m in _BASIC.finditer(line):
            if _basic(m.group(1)):
                add(m.group(1), a + m.start(1), a + m.end(1), True)
        for m in _BEARER.finditer(line):
            if looks_live(m.group(1)):
                add(m.group(1), a + m.start(1), a + m.end(1), True)
        for rx in _PROSE:
            for m in rx.finditer(line):
                value = m.group(1).rstrip(".,;)")
                add(value, a + m.start(1), a + m.start(1) + len(value), False)
        for rx in (_ASSIGN, _SETTER):
            for m in rx.finditer(line):
                if credential_name(m["name"]) or (rx is _SETTER and m["name"].lower().startswith("x-") and "key" in m["name"].lower()):
                    got = _joined(text, a + m.end())
                    if got:
                        add(*got, False)
        for m in _CALL.finditer(line):
            if m["name"][:3].lower() != "set" or credential_name(m["name"][3:]):
                got = _last_string(text, a + m.end())
                if got:
                    add(*got, False)
        if _GRANT.search(line):
            for m in _COMPARE.finditer(line):
                got = _joined(text, a + m.end())
                if got:
                    add(*got, False)
        m = _PLAIN.match(line)
        if m and credential_name(m["name"]):
            add(m["value"], a + m.start("value"), a + m.end("value"), False)
    spans = sorted(out.items())
    strong = [(s, e) for (s, e), (_, hard) in spans if hard]
    return [(v, s, e, hard) for (s, e), (v, hard) in spans if hard or not any(x <= s < y or s <= x < e for x, y in strong)]


_PLACES = "src string, rec_id string, owner string, key bigint, value string, structured boolean, live boolean, sure boolean, first int, last int, line_no int"
_KINDS = (pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())


def _key(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "replace")) - (1 << 63)


def index_literals(texts: DataFrame) -> DataFrame:
    """The literals of ``src, rec_id, owner, text``: ``key`` is their hash.

    Candidates have their place (``first`` and ``last`` are offsets in the text)
    and value; all other quoted literals only their key and owner, once a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, plain = [], [], {}
            owners = batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(3).to_pylist()):
                if text:
                    for value, s, e, hard in candidates(text):
                        rows.append((_key(value), value, hard, looks_live(value), hard and not stands_in(value), s, e, text.count("\n", 0, s) + 1))
                        at.append(i)
                    for value in set(_QUOTED.findall(text)):
                        plain.setdefault((owners[i], value), i)
            for (_, value), i in plain.items():
                rows.append((_key(value), *[None] * 7))
                at.append(i)
            columns = list(zip(*rows)) or [()] * len(_KINDS)
            named = ["src", "rec_id", "owner", "key", "value", "structured", "live", "sure", "first", "last", "line_no"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at, pa.int64())) for c in range(3)], *[pa.array(c, k) for c, k in zip(columns, _KINDS)]], names=named)

    return texts.select("src", "rec_id", "owner", "text").mapInArrow(run, _PLACES)


def confirmed(places: DataFrame, max_owners: int) -> DataFrame:
    """Secrets (``value, alone``): values that are structured, or look live where a credential stands, and are rare or sure.

    Owners are counted over all literals of the corpus, not only those where a
    credential stands.  Rare is up to ``max_owners`` owners, or a fifth of all
    where that is more.  Structured values that are no placeholders are sure
    whatever their owners.  ``alone``: the value gives itself away, so it is a
    secret wherever it stands; others are words that only their place makes one.
    """
    flags = [F.max(c).alias(c) for c in ("structured", "live", "sure")]
    wanted = places.filter("structured or live").groupBy("key", "value").agg(*flags)
    limit = max(max_owners, places.select("owner").distinct().count() // 5)
    owners = places.select("key", "owner").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("owners"))
    return wanted.join(owners, "key").filter((F.col("owners") <= limit) | F.col("sure")).select("value", (F.col("live") | F.col("sure")).alias("alone"))


def _automaton(values: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for v in values:
        made.add_word(v, len(v))
    made.make_automaton()
    return made


def occurrences(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Places of confirmed secrets that are whole words of the text."""
    out = []
    for end, n in automaton.iter(text):
        s = end + 1 - n
        if (s == 0 or not text[s - 1].isalnum() or not text[s].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum() or not text[end].isalnum()):
            out.append((s, end + 1))
    return out


# looking up the words of all texts ------------------------------------------

_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_OF_BYTE = _scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (longest runs of ASCII letters and digits) of many texts, of each with the one after it, and the text of each word.

    ``data`` are the bytes of all texts, ``ends`` where each starts and the last
    ends.  The last word of a text has the pair hash 0.
    """
    inside = _ALNUM[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    start[heads] = inside[heads]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(start[at])
    length = np.diff(np.append(first, len(at)))
    where = np.arange(len(at)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(length.max()), 0x100000001B3, dtype=np.uint64))])
        word = _scramble(np.add.reduceat(_OF_BYTE[data[at]] * powers[where], first) + length.astype(np.uint64))
        text = np.searchsorted(ends, at[first], side="right") - 1
        pair = np.zeros(len(word), np.uint64)
        pair[:-1] = np.where(text[1:] == text[:-1], _scramble(word[:-1] * np.uint64(3) + word[1:]), np.uint64(0))
    return word, pair, text


def window_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every four bytes, and the text of each; windows over the border of two texts are harmless."""
    if len(data) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = data.astype(np.uint64)
    four = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)
    return _scramble(four + np.uint64(1 << 40)), np.searchsorted(ends, np.arange(len(four)), side="right") - 1


def value_anchors(value: str) -> tuple[list[int], bool]:
    """What a text that holds the value as a whole word holds too: pairs of its words, else its word, else (True) any four bytes of it."""
    data = np.frombuffer(value.encode("utf-8", "replace"), dtype=np.uint8)
    word, pair, _ = word_anchors(data, np.array([0, len(data)]))
    found = pair[:-1] if len(word) > 1 else word
    windows = not len(found)
    if windows:
        found = window_anchors(data, np.array([0, len(data)]))[0]
    return [int(x) for x in found.view(np.int64)], windows


TURNS = 3


def _bit(anchors: np.ndarray, turn: int, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One of the TURNS bits that stand for each anchor: its word of 32 bits in the field, and mask."""
    bit = _scramble(anchors + np.uint64(turn + 1)) % np.uint64(n_bits)
    return (bit >> np.uint64(5)).astype(np.int64), np.uint32(1) << (bit & np.uint64(31)).astype(np.uint32)


def _anchored(secrets: DataFrame) -> DataFrame:
    """``anchor, value, windows``: each secret under that of its anchors which the fewest secrets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, v, w) for v in batch.column(0).to_pylist() if v for found, w in [value_anchors(v)] for a in found]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=["anchor", "value", "windows"])

    every = stage(secrets.select("value").distinct().mapInArrow(run, "anchor bigint, value string, windows boolean"), "secret-anchors")
    shared = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    return every.join(shared, "anchor").groupBy("value").agg(F.min_by(F.struct("anchor", "windows"), F.struct("n", "anchor")).alias("a")).select("a.anchor", "value", "a.windows")


def _field(anchors: DataFrame, n_bits: int) -> np.ndarray:
    """The bit field of all anchors, put together in tasks; the driver gets its words that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            word, mask = (np.concatenate(x) for x in zip(*[_bit(some, turn, n_bits) for turn in range(TURNS)]))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.astype(np.int64))], names=["word", "mask"])

    found = anchors.select("anchor").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(n_bits // 32, np.uint32)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return out


def rescan(texts: DataFrame, secrets: DataFrame, *, max_bits: int = 1 << 28) -> DataFrame:
    """``src, rec_id, first, last, line_no`` of every secret (``value``) in every text, in one pass for any number of secrets.

    A bit field of at most ``max_bits`` (32 MB) goes to the executors.  Texts none
    of whose words are in it hold no secret; the others meet the secrets of their
    words in a join, which is exact however full the field is.
    """
    spark = texts.sparkSession
    anchors = stage(_anchored(secrets), "secret-words")
    known = anchors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("windows"), F.lit(False)).alias("windows")).first()
    n_bits = min(max_bits, max(1 << 10, 1 << (32 * known["n"] - 1).bit_length() if known["n"] else 0))
    held = spark.sparkContext.broadcast(_field(anchors, n_bits))
    windows = known["windows"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.value
        for batch in batches:
            column = batch.column(2)
            column = column if column.null_count == 0 else column.fill_null("")
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            word, pair, text = word_anchors(data, ends)
            found, of = np.concatenate([word, pair]), np.concatenate([text, text])
            if windows:
                more, where = window_anchors(data, ends)
                found, of = np.concatenate([found, more]), np.concatenate([of, where])
            for turn in range(TURNS):  # each looks only at what the one before let through
                at, mask = _bit(found, turn, n_bits)
                keep = (field[at] & mask) != 0
                found, of = found[keep], of[keep]
            order = np.lexsort((found, of))
            found, of = found[order], of[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
            found, of = found[new], of[new]
            rows, count = np.unique(of, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows, pa.int64())) for c in batch.columns], lists], names=["src", "rec_id", "text", "anchors"])

    hit = texts.select("src", "rec_id", "text").mapInArrow(look, "src string, rec_id string, text string, anchors array<bigint>")
    hit = stage(hit.withColumn("row", F.monotonically_increasing_id()), "secret-texts")
    # bounded by the words of one text and the secrets of a word
    per = hit.select("row", F.explode("anchors").alias("anchor")).join(anchors.select("anchor", "value"), "anchor").groupBy("row").agg(F.collect_set("value").alias("values"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, (text, values) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for s, e in occurrences(text, _automaton(values)):
                    rows.append((s, e, text.count("\n", 0, s) + 1))
                    at.append(i)
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at, pa.int64())) for c in range(2)], *[pa.array(c, pa.int32()) for c in columns]], names=["src", "rec_id", "first", "last", "line_no"])

    return hit.join(per, "row").select("src", "rec_id", "text", "values").mapInArrow(search, "src string, rec_id string, first int, last int, line_no int")


def find_credentials(texts: DataFrame, *, max_owners: int = 8) -> DataFrame:
    """``src, rec_id, first, last, line_no``: each place where a credential stands, once.

    ``texts`` has ``src, rec_id, owner, text``.  ``first`` and ``last`` are
    character offsets of the value, ``line_no`` the 1-based line it starts on,
    lines ending with a line feed.  A value of more than ``max_owners`` owners
    and a fifth of all is a placeholder, unless it has a structure of its own.  Null and empty texts hold nothing; a null owner is an owner;
    repeated rows give their places once; other columns are ignored.
    """
    places = stage(index_literals(texts), "secret-places")
    secrets = stage(confirmed(places, max_owners), "secrets")
    direct = places.filter("structured or live").join(secrets.select("value"), "value", "left_semi").select("src", "rec_id", "first", "last", "line_no")
    return direct.union(rescan(texts, secrets.filter("alone"))).distinct()


def redact_spans(text: str, spans: list[tuple[int, int]], mark: str = "*") -> str:
    """The text with every character of the spans masked; line ends, quotes and operators between joined literals stay."""
    out = list(text)
    for s, e in spans:
        piece = text[s:e]
        inner = [(0, len(piece))]
        joints = list(re.finditer(r"[\"'](?:\s*(?:[+.\\|&]+\s*)?(?:\\?\r?\n[ \t]*)?)*[\"']", piece))
        if joints:
            ends = [0, *[x for j in joints for x in (j.start(), j.end())], len(piece)]
            inner = list(zip(ends[::2], ends[1::2]))
        for a, b in inner:
            for i in range(s + a, s + b):
                if out[i] not in "\r\n" and not (out[i] == "\\" or (i and text[i - 1] == "\\")):
                    out[i] = mark
    return "".join(out)


def redact(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``src, rec_id, text`` of the texts that hold credentials, with these masked by as many characters."""
    spans = places.groupBy("src", "rec_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))  # bounded by the length of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [redact_spans(t, sorted((p["first"], p["last"]) for p in s)) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], names=["src", "rec_id", "text"])

    return texts.join(spans, ["src", "rec_id"]).select("src", "rec_id", "text", "spans").mapInArrow(run, "src string, rec_id string, text string")
