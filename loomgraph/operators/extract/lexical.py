"""Other languages, by their visible structure: comments and strings blanked, blocks matched by braces (or ``end``)."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

from loomgraph.operators.extract.common import definition, reference, unique

_BLANK_C = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_BLANK_HASH = re.compile(r"#(?!\{)[^\n]*|^=begin.*?^=end|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S | re.M)
_WORD = re.compile(r"[A-Za-z_]\w*")
_MARKS = re.compile(r"[\n\"'`]")


class Language(NamedTuple):
    types: str  # groups: kind, name, bases
    functions: str  # group: name
    methods: str  # group: name, inside a type
    imports: tuple[str, ...]  # group: target
    calls: str  # group: target
    braces: bool = True
    upper_functions: bool = False


# a quantifier that gives nothing back (``*+``, ``++``) stands where giving back could never match
_NAME = r"[A-Za-z_$][\w$]*"
_GENERIC = r"(?:\s*<[^{}()>]*(?:<[^<>]*>[^{}()>]*)*>)?"
_NOT = r"(?!(?:if|for|while|switch|catch|return|else|do|new|throw|typeof|sizeof|function|await|super|using|lock|foreach|match|when|guard|defer|select)\b)"
_JS = Language(
    rf"\b(?:export\s+)?(?:default\s+)?(?:(?P<mod>abstract)\s+)?(?P<kind>class|interface)\s+(?P<name>{_NAME}){_GENERIC}\s*(?P<bases>(?:extends\s+[\w$.<>, ]+?)?\s*(?:implements\s+[\w$.<>, ]+?)?)\s*\{{",
    rf"(?:\bfunction\s*\*?\s*(?P<name>{_NAME})\s*\(|\b(?:const|let|var)\s+(?P<name2>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()\n]*\)|{_NAME})\s*(?::[^=\n]+)?=>)",
    rf"^[ \t]*+(?:(?:public|private|protected|static|async|readonly|get|set|override|abstract)\s++)*{_NOT}(?P<name>#?{_NAME}+){_GENERIC}\s*\([^()\n]*(?:\([^()]*\)[^()\n]*)*\)\s*(?::[^{{;\n]+)?\{{",
    (r"\bimport\s+(?:[^;\n]*?\s+from\s+)?[\"'](?P<target>[^\"'\n]+)[\"']",),
    rf"\bnew\s+(?P<target>[A-Z][\w$]*)|(?<![.\w$])(?P<target2>[A-Z][\w$]*)(?=\.{_NAME}\s*\(|\s*\()",
)
LANGUAGES: dict[str, Language] = {
    "javascript": _JS,
    "typescript": _JS,
    "java": Language(
        rf"(?P<mod>abstract\s+)?\b(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>{_NAME}){_GENERIC}\s*(?:\([^)]*\)\s*)?(?P<bases>(?:extends\s+[\w.<>,\s?&]+?)?\s*(?:implements\s+[\w.<>,\s?&]+?)?)\s*\{{",
        r"(?!)",
        rf"(?:^|[;{{}}])[ \t\n]*+(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s++)*(?:<[^>]+>\s*)?{_NOT}(?:[\w.<>\[\],?]++\s++)?{_NOT}(?P<name>{_NAME}+)\s*+\([^()]*+\)\s*+(?:throws\s+[\w.,\s]++)?\{{",
        (r"\bimport\s+(?:static\s+)?(?P<target>[\w.]+)",),
        r"\bnew\s+(?P<target>[A-Z]\w*)",
    ),
    "kotlin": Language(
        rf"\b(?:(?P<mod>abstract|data|sealed|open|enum)\s+)?(?P<kind>class|interface|object)\s+(?P<name>{_NAME}){_GENERIC}\s*(?:(?:(?:private|internal|protected)\s+)?constructor\s*)?(?:\([^)]*\))?[ \t]*(?::\s*(?P<bases>[^{{\n]+))?\{{?",
        rf"^(?:(?:public|private|internal|suspend|inline)\s+)*fun\s+(?:<[^>]+>\s*)?(?:[\w.<>]+\.)?(?P<name>{_NAME})\s*\(",
        rf"\bfun\s+(?:<[^>]+>\s*)?(?P<name>{_NAME})\s*\(",
        (r"^\s*import\s+(?P<target>[\w.]+)",),
        r"(?!)",
    ),
    "go": Language(
        rf"\btype\s+(?P<name>{_NAME})(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\s*(?P<bases>)\{{",
        r"^func\s+(?P<name>[A-Z]\w*)\s*(?:\[[^\]]*\])?\(",
        r"^func\s+\([^)]*\)\s*(?P<name>\w+)\s*\(",
        (r"^\s*import\s+(?:\w+\s+)?\"(?P<target>[^\"]+)\"", r"^\s+(?:[\w.]+\s+)?\"(?P<target>[\w./-]+)\"\s*$"),
        r"(?<![\w.])(?P<target>[A-Z]\w*)\{",
    ),
    "rust": Language(
        rf"\b(?P<kind>struct|enum|trait|impl|type)\s+(?:<[^>]*>\s*)?(?P<name>{_NAME})(?:<[^>]*>)?(?P<bases>(?:\s+for\s+\w+)?)",
        rf"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>{_NAME})",
        rf"\bfn\s+(?P<name>{_NAME})",
        (r"^\s*(?:pub\s+)?use\s+(?P<target>[\w:]+)",),
        rf"(?<!fn )\b(?!(?:if|while|for|match|fn|let|return)\b)(?P<target>{_NAME})\s*\(",
    ),
    "c": Language(
        rf"\btypedef\s+(?P<kind>struct|enum)\s*\w*\s*\{{[^{{}}]*\}}\s*(?P<name>{_NAME})(?P<bases>)",
        rf"^(?:[\w*]+[\s*]+)+{_NOT}(?P<name>{_NAME})\s*\([^;{{}}]*\)\s*\{{",
        r"(?!)",
        (r"^\s*#\s*include\s*(?P<target>[<\"][^>\"\n]+[>\"])",),
        rf"\b{_NOT}(?P<target>{_NAME})\s*\(",
    ),
    "cpp": Language(
        rf"(?<!enum )\b(?P<kind>class|struct)\s+(?P<name>{_NAME})(?:\s+final)?\s*(?::\s*(?P<bases>[^{{;]+))?\{{",
        rf"^(?:[\w:*&<>,]+[\s*&]+)+{_NOT}(?P<name>(?:{_NAME}::)*~?{_NAME})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{",
        rf"\b{_NOT}(?P<name>~?{_NAME})\s*\([^;{{}}()]*\)\s*(?:const\s*)?(?:override\s*)?(?:\{{|;)",
        (r"^\s*#\s*include\s*(?P<target>[<\"][^>\"\n]+[>\"])", r"^\s*using\s+(?:namespace\s+)?(?P<target>[\w:]+)\s*;"),
        rf"\b(?!std::|boost::)(?P<target>[A-Z]\w*)(?=::\w+\s*\()|\b{_NOT}(?P<target2>{_NAME})\s*\(",
    ),
    "csharp": Language(
        rf"\b(?:(?P<mod>abstract|static|sealed)\s+)?(?:partial\s+)?(?P<kind>class|interface|struct|enum|record(?:\s+struct)?)\s+(?P<name>{_NAME}){_GENERIC}\s*(?:\([^)]*\)\s*)?(?::\s*(?P<bases>[^{{;]+?))?\s*(?:where[^{{]+)?\{{",
        r"(?!)",
        rf"^[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+(?:[\w.<>\[\],?]+\s+)?{_NOT}(?P<name>{_NAME}){_GENERIC}\s*\([^()]*\)\s*(?:where[^{{]+)?(?:\{{|=>)",
        (r"^\s*using\s+(?:static\s+)?(?P<target>[\w.]+)\s*;",),
        r"\bnew\s+(?P<target>[A-Z]\w*)|(?<![.\w])(?P<target2>[A-Z]\w*)(?=(?:\.\w+)*\.\w+\s*(?:<[^>()]*>)?\()|\b(?:GetComponent|FindObjectOfType)<(?P<target3>\w+)>",
    ),
    "ruby": Language(
        r"^\s*(?P<kind>class|module)\s+(?P<name>[A-Z][\w:]*)\s*(?:<\s*(?P<bases>[A-Z][\w:]*))?",
        r"^def\s+(?P<name>(?:self\.)?\w+[?!=]?)",
        r"^\s+def\s+(?P<name>(?:self\.)?\w+[?!=]?)",
        (r"^\s*require(?:_relative)?\s*\(?\s*[\"'](?P<target>[^\"'\n]+)[\"']", r"^\s*(?:include|extend)\s+(?P<target>[A-Z][\w:]*)"),
        r"\b(?P<target>[A-Z]\w*)(?=\.\w+)",
        braces=False,
    ),
    "php": Language(
        rf"\b(?:(?P<mod>abstract)\s+)?(?:final\s+)?(?P<kind>class|interface|trait|enum)\s+(?P<name>{_NAME})\s*(?P<bases>(?:extends\s+[\w\\, ]+?)?\s*(?:implements\s+[\w\\, ]+?)?)\s*\{{",
        rf"^function\s+&?(?P<name>{_NAME})\s*\(",
        rf"\bfunction\s+&?(?P<name>{_NAME})\s*\(",
        (r"^\s*use\s+(?P<target>[\w\\]+)",),
        r"(?!)",
    ),
    "swift": Language(
        rf"\b(?P<kind>class|struct|enum|actor|extension|protocol)\s+(?P<name>{_NAME}){_GENERIC}\s*(?::\s*(?P<bases>[^{{]+?))?\s*(?:where[^{{]+)?\{{",
        rf"^(?:(?:public|private|internal|open|static|@\w+)\s+)*func\s+(?P<name>{_NAME})",
        rf"\bfunc\s+(?P<name>{_NAME})",
        (r"^\s*import\s+(?P<target>[\w.]+)",),
        rf"\b{_NOT}(?P<target>{_NAME})\s*\(",
    ),
}
# Names that are never entities.
IGNORED = frozenset("Array Boolean Date Error Function JSON Map Math Number Object Promise Proxy RegExp Set String Symbol WeakMap WeakSet BigInt Intl Reflect Console".split())


def _spaces(m: re.Match) -> str:
    found = m.group()
    if found[0] in "\"'`":
        return re.sub(r"[^\n\"'`]", " ", found) if _MARKS.search(found, 1, len(found) - 1) else f"{found[0]}{' ' * (len(found) - 2)}{found[-1]}"
    return re.sub(r"[^\n]", " ", found) if "\n" in found else " " * len(found)


def _blank(text: str, pattern: re.Pattern) -> str:
    """Comments and string contents as blanks; offsets and lines stay."""
    return pattern.sub(_spaces, text)


class _Layout:
    """Lines and matching braces of a text, found once."""

    def __init__(self, code: str) -> None:
        self.breaks = [m.start() for m in re.finditer("\n", code)]
        self.ends: dict[int, int] = {}
        self.last = len(code) - 1
        open_: list[int] = []
        self.opens = []
        for m in re.finditer("[{}]", code):
            if m.group() == "{":
                open_.append(m.start())
                self.opens.append(m.start())
            elif open_:
                self.ends[open_.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def close(self, at: int) -> int:
        """Where the first block that opens from ``at`` on ends; the end of the text if it does not."""
        i = bisect_left(self.opens, at)
        return self.ends.get(self.opens[i], self.last) if i < len(self.opens) else self.last


def _named(m: re.Match, group: str) -> str:
    return next((v for k, v in m.groupdict().items() if k.rstrip("0123456789") == group and v), "") or ""


def extractor(language: str):
    spec = LANGUAGES[language]
    types, functions, methods, calls = (re.compile(x, re.M) for x in (spec.types, spec.functions, spec.methods, spec.calls))
    imports = [re.compile(x, re.M) for x in spec.imports]
    blank = _BLANK_C if spec.braces else _BLANK_HASH

    def extract(path: str, text: str) -> tuple[list[dict], list[dict]]:
        code = _blank(text, blank)
        layout = _Layout(code)
        line, close = layout.line, layout.close
        defs = [definition(path, "module", path, 1, line(len(text)))]
        refs, spans = [], []
        for rx in imports:
            for m in rx.finditer(text if "[\"']" in rx.pattern or "\\\"" in rx.pattern or "include" in rx.pattern else code):
                target = m.group("target")
                relative = target.startswith(".") or target.startswith('"') or target.split("::")[0] in ("crate", "self", "super") or "require_relative" in m.group()
                level = 1 if relative else 0
                if target.startswith("../"):
                    level = 1 + target.count("../")
                refs.append(reference(path, "", "import", target.strip("<>\"").lstrip("./"), "", level, relative))
        for m in types.finditer(code):
            start = m.start("name")
            open_ = code.find("{", m.end() - 1) if spec.braces else -1
            end = close(open_) if open_ >= 0 and open_ - m.end() <= 1 else m.end()
            if not spec.braces:
                # the block ends with the "end" at the indentation of its head
                indent = re.match(r"\n?([ \t]*)", code[m.start() :]).group(1)
                closing = re.compile(rf"^{indent}end\b", re.M).search(code, m.end())
                end = closing.start() if closing else len(code)
            bases = [re.sub(r"<.*", "", b).strip().rpartition(".")[2].rpartition("\\")[2] for b in re.split(r",|\bextends\b|\bimplements\b|\bwith\b", re.sub(r"\([^)]*\)|\b(?:public|private|protected|virtual)\b", "", m.group("bases") or ""))]
            bases = [b for b in bases if _WORD.fullmatch(b)]
            found = [x for x in methods.finditer(code, m.end(), end)] if end > m.end() else []
            listed = [{"name": _named(x, "name"), "signature": f"{_named(x, 'name')}()", "line_start": line(x.start("name")), "line_end": line(close(x.end() - 1)) if code[x.end() - 1 : x.end()] == "{" else line(x.end())} for x in found]
            mod = (m.groupdict().get("mod") or "").strip()
            kind = mod or m.group("kind").strip()
            defs.append(definition(path, "class", m.group("name"), line(start), line(end), subkind="" if kind == "class" else kind, bases=bases, methods=listed))
            refs += [reference(path, m.group("name"), "extends", b) for b in bases]
            spans.append((m.start(), end, m.group("name"), [(x.start("name"), _named(x, "name")) for x in found]))
        if language == "go":
            receivers = re.compile(r"^func\s+\(\s*\w*\s*\*?(\w+)[^)]*\)\s*(\w+)\s*\(", re.M)
            for m in receivers.finditer(code):
                owner = next((d for d in defs if d["name"] == m.group(1)), None)
                if owner:
                    owner["methods"].append({"name": m.group(2), "signature": f"{m.group(2)}()", "line_start": line(m.start()), "line_end": line(close(m.end()))})
        bodies, named_at = [], {x for _, _, _, found in spans for x, _ in found}
        for m in functions.finditer(code):
            name = _named(m, "name")
            named_at.update(m.start(g) for g in m.groupdict() if g.startswith("name") and m[g])
            if any(a < m.start() < b for a, b, *_ in spans) or not name or (language in ("javascript", "typescript") and name.startswith("_")):
                continue
            at = code.find("{", m.end() - 1) if spec.braces else -1
            if at >= 0:
                bodies.append((m.start(), close(at), name, []))
            defs.append(definition(path, "function", name.replace("self.", ""), line(m.start()), line(close(code.find("{", m.end() - 1))) if spec.braces and code.find("{", m.end() - 1) >= 0 else line(m.end()), signature=f"{name}()"))
        for m in calls.finditer(code):
            target = _named(m, "target")
            owner = next(((n, ms) for a, b, n, ms in spans + bodies if a < m.start() < b), ("", []))
            # a definition's own name is no call of it
            if target and target not in IGNORED and target != owner[0] and not any(m.start(g) in named_at for g in m.groupdict() if m[g]):
                via = next((n for at, n in reversed(owner[1]) if at < m.start()), "")
                refs.append(reference(path, owner[0], "call", target, via))
        if language == "csharp":
            refs += _csharp_members(path, code, spans)
        return defs, unique(refs)

    return extract


_FIELD = re.compile(r"(?P<attrs>(?:\[[^\]]*\]\s*)*)(?P<mod>(?:(?:public|private|protected|internal|static|readonly|const)\s+)+)(?P<type>[A-Z]\w*(?:<\s*(?P<inner>\w+)\s*>)?)(?:\[\])?\s+(?P<name>\w+)\s*(?:=[^;{]*)?;", re.M)
_CHAIN = re.compile(r"\b(?P<root>[A-Za-z_]\w*)(?P<mid>(?:\.\w+(?:<[^>()]*>)?(?:\(\))?)*?)\.(?P<method>[A-Z]\w*)\s*\(")
_ASSIGNED = re.compile(r"\b(?P<name>\w+)\s*=\s*(?:\w+\.)*(?:GetComponent\w*|FindObjectOfType)<(?P<type>\w+)>")


def _csharp_members(path: str, code: str, spans: list) -> list[dict]:
    """Typed fields and (receiver, method, via) calls of C# classes."""
    out = []
    for start, end, owner, methods in spans:
        fields = {}
        for m in _FIELD.finditer(code, start, end):
            kind = m.group("inner") or m.group("type")
            fields[m.group("name")] = kind
            out.append(reference(path, owner, "field", kind, m.group("name"), serialized="SerializeField" in m.group("attrs") or "public" in m.group("mod")))
        fields |= {m.group("name"): m.group("type") for m in _ASSIGNED.finditer(code, start, end) if m.group("name") in fields or m.group("name").startswith("_")}
        for m in _CHAIN.finditer(code, start, end):
            root = m.group("root")
            middle = [x for x in re.findall(r"\.(\w+)", m.group("mid")) if x not in ("Instance", "instance", "Current", "Main")]
            made = re.search(r"<(\w+)>", m.group("mid"))
            receiver = made.group(1) if made else middle[-1] if middle else fields.get(root, root if root[0].isupper() else "")
            via = next((n for at, n in reversed(methods) if at < m.start()), "")
            if receiver and receiver != owner:
                out.append(reference(path, owner, "method_call", f"{receiver}::{m.group('method')}", via))
                target = fields.get(root, root)
                if target[:1].isupper() and target != owner:
                    out.append(reference(path, owner, "call", target, via))
    return out
