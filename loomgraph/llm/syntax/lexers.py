"""From source text to token classes.

One regular expression per language takes blanks and comments away and leaves
the tokens; a token's class depends on its text alone and is remembered.
Whatever is no token becomes the class ERROR, which no grammar has.
"""

from __future__ import annotations

import re

from loomgraph.llm.syntax.tables import END, Tables

_ID = r"[^\W\d]\w*"
_NUMBER = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?\w*|0[bBoO][0-7_]+\w*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[a-zA-Z]*"
_C_COMMENTS = r"//[^\n\r]*|/\*(?s:.*?)\*/"
_DQ = r'"(?:[^"\\\n\r]++|\\(?:\r\n|(?s:.)))*+"'
_SQ = r"'(?:[^'\\\n\r]++|\\(?:\r\n|(?s:.)))*+'"


class Lexer:
    """Token classes of one language."""

    blanks = r"\s+"
    comments = _C_COMMENTS
    words: str = ""
    classes: dict[str, str] = {}
    strings = (_DQ,)
    operators: str = ""
    number = _NUMBER
    ident = _ID
    extra: tuple[str, ...] = ()

    def __init__(self, tables: Tables) -> None:
        self.tables = tables
        self.keywords = {t for t in tables.terminals if t[0].isalpha() and not t.isupper()}
        ops = sorted(self.operators.split(), key=len, reverse=True)
        body = "|".join([*self.extra, *self.strings, self.ident, self.number, *map(re.escape, ops), r"\S"])
        self.find = re.compile(rf"(?:{self.blanks}|{self.comments})*+({body}|\Z)").findall
        self.scan = re.compile(rf"(?:{self.blanks}|{self.comments})*+({body}|\Z)")
        self.number_of = tables.number
        self.error = len(tables.terminals)
        lexer = self

        class Kinds(dict):
            def __missing__(self, token: str) -> int:
                kind = lexer.number_of.get(lexer.kind(token), lexer.error)
                if len(self) >= 200_000:
                    self.clear()
                if len(token) < 80:
                    self[token] = kind
                return kind

        self.kinds = Kinds()

    def kind(self, token: str) -> str:
        if not token:
            return END
        if token in self.classes:
            return self.classes[token]
        first = token[0]
        if first == "_" or first.isalpha():
            if len(token) > 1 and token[-1] in "\"'":
                return "STRING"
            return token if token in self.keywords else "NAME"
        if first.isdigit() or (first == "." and len(token) > 1 and token[1].isdigit()):
            return "NUMBER" if self.is_number(token) else "ERROR"
        if len(token) > 1 and first in "\"'`":
            return "STRING"
        return token if token not in "\"'`" else "ERROR"

    def is_number(self, token: str) -> bool:
        return True

    def tokens(self, text: str) -> list[int]:
        found = self.find(text)
        out = list(map(self.kinds.__getitem__, found))
        end = out.index(self.number_of[END])
        del out[end + 1 :]
        return out

    def first_error(self, text: str) -> int:
        return self.tables.first_error(self.tokens(text))

    def line_of(self, text: str, index: int) -> int:
        """1-based line of the token with this index."""
        for i, m in enumerate(self.scan.finditer(text)):
            if i == index:
                return text.count("\n", 0, m.start(1)) + 1
        return text.count("\n") + 1


class JsonLexer(Lexer):
    blanks, comments = r"[ \t\n\r]+", r"(?!)"
    strings = (r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"',)
    number = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])"
    ident = r"[a-zA-Z_]\w*"

    def kind(self, token: str) -> str:
        if token[:1] in "-0123456789" and token:
            return "NUMBER" if token[-1].isdigit() else "ERROR"
        return super().kind(token)


_DIGITS = r"\d(?:_?\d)*"
_PY_NUMBER = re.compile(
    rf"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0(?:_?0)*|[1-9](?:_?\d)*"
    rf"|(?:(?:{_DIGITS})?\.{_DIGITS}|{_DIGITS}\.)(?:[eE][+-]?{_DIGITS})?[jJ]?|{_DIGITS}[eE][+-]?{_DIGITS}[jJ]?|{_DIGITS}[jJ]"
)


class PythonLexer(Lexer):
    blanks, comments = r"[ \t\f]+", r"\\\r?\n|\\\r"
    _body = {q: rf"(?:[^{q}\\\n\r]++|\\(?:\r\n|(?s:.)))*+" for q in "'\""}
    _hole = r"\{(?:[^{}\"']++|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}]*\})*+\}"
    strings = (
        r'(?i:[rbuft]|[bft]r|r[bft])?"""(?s:(?:[^\\"]++|\\.|"(?!""))*+)"""',
        r"(?i:[rbuft]|[bft]r|r[bft])?'''(?s:(?:[^\\']++|\\.|'(?!''))*+)'''",
        rf'(?i:[ft]|[ft]r|r[ft])"(?:[^"\\\n\r{{]++|\\(?:\r\n|(?s:.))|\{{\{{|{_hole})*+"',
        rf"(?i:[ft]|[ft]r|r[ft])'(?:[^'\\\n\r{{]++|\\(?:\r\n|(?s:.))|\{{\{{|{_hole})*+'",
        rf'(?i:[rbu]|br|rb)?"{_body[chr(34)]}"',
        rf"(?i:[rbu]|br|rb)?'{_body[chr(39)]}'",
    )
    # a line end with the blank and comment lines after it, and the next line's indentation
    extra = (r"(?:(?:#[^\n\r]*)?(?:\r\n|\n|\r)[ \t\f]*)+(?:#[^\n\r]*\Z)?|#[^\n\r]*",)
    operators = "**= //= >>= <<= ... -> := == != <= >= += -= *= /= %= &= |= ^= @= ** // << >> + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; = !"
    classes = {
        **dict.fromkeys("**= //= >>= <<= += -= *= /= %= &= |= ^= @=".split(), "AUG"),
        **dict.fromkeys("== != <= >= < > // % << >> & | ^ and or".split(), "BINOP"),
        **dict.fromkeys("+ -".split(), "ADDOP"),
    }

    def __init__(self, tables: Tables) -> None:
        super().__init__(tables)
        n = self.number_of
        self.newline, self.indent, self.dedent, self.end = n["NEWLINE"], n["INDENT"], n["DEDENT"], n[END]
        self.depth = {**{n[x]: 1 for x in "([{"}, **{n[x]: -1 for x in ")]}"}}

    def kind(self, token: str) -> str:
        if token[:1] in "\n\r#" and token:
            return "NEWLINE"
        return super().kind(token)

    def is_number(self, token: str) -> bool:
        return bool(_PY_NUMBER.fullmatch(token))

    def tokens(self, text: str) -> list[int]:
        return self._lay(text)[0]

    def _lay(self, text: str) -> tuple[list[int], list[int]]:
        """Classes with line ends and indentation, and the index of the raw token behind each."""
        found = self.find("\n" + text.removeprefix("﻿"))
        newline, end, depth_of, error = self.newline, self.end, self.depth, self.error
        out: list[int] = []
        at: list[int] = []
        margins, depth, kinds = [0], 0, self.kinds
        add, mark = out.append, at.append
        for i, token in enumerate(found):
            k = kinds[token]
            if k == newline:
                if depth or "\n" not in token and "\r" not in token:
                    continue
                width = token[max(token.rfind("\n"), token.rfind("\r")) + 1 :]
                if "#" in width:
                    continue  # a comment at the end of the text
                n = len(width.expandtabs(8)) if "\f" not in width else len(width.rpartition("\f")[2].expandtabs(8))
                if i + 1 < len(found) and found[i + 1] == "":
                    n = 0
                if out and out[-1] != newline:
                    add(newline)
                    mark(i)
                if n > margins[-1]:
                    margins.append(n)
                    add(self.indent)
                    mark(i)
                else:
                    while n < margins[-1]:
                        margins.pop()
                        add(self.dedent)
                        mark(i)
                    if n != margins[-1]:
                        add(error)
                        mark(i)
                continue
            if k == end:
                if out and out[-1] not in (newline, self.dedent):
                    add(newline)
                    mark(i)
                for _ in margins[1:]:
                    add(self.dedent)
                    mark(i)
                add(end)
                mark(i)
                break
            if k in depth_of:
                depth = max(0, depth + depth_of[k])
            add(k)
            mark(i)
        return out, at

    def line_of(self, text: str, index: int) -> int:
        at = self._lay(text)[1]
        raw = at[min(index, len(at) - 1)] if at else 0
        return max(1, super().line_of("\n" + text.removeprefix("﻿"), raw) - 1)


class JsLexer(Lexer):
    blanks = r"[\s﻿]+"
    comments = _C_COMMENTS + r"|\A\#![^\n]*"
    _template = r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^`\\]|\\(?s:.))*`|\{(?:[^{}`]|\{[^{}`]*\})*\})*\})*`"
    strings = (_DQ, _SQ, _template)
    ident = r"#?(?:[^\W\d]|\$)(?:\w|\$)*"
    _regex = r"/(?![*/])(?:[^\\/\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[a-z]*"
    # a regular expression literal is told from a division by what stands before it
    extra = (rf"(?:[(,=:\[!&|?{{}};+]|return|typeof|case)[ \t]*{_regex}",)
    operators = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << >> + - * / % & | ^ ~ ! < > ( ) [ ] { } , : . ; = ? @"
    classes = {
        **dict.fromkeys(">>>= === !== **= <<= >>= >>> &&= ||= ??= == != <= >= && || ?? += -= *= /= %= &= |= ^= ** << >> / % & | ^".split(), "BINOP"),
        **dict.fromkeys("+ -".split(), "ADDOP"),
        **dict.fromkeys("++ --".split(), "INCR"),
    }
    split = re.compile(r"([(,=:\[!&|?{};+]|return|typeof|case)[ \t]*(/.+)", re.S)

    def __init__(self, tables: Tables) -> None:
        super().__init__(tables)
        n = self.number_of
        self.end, self.brace = n[END], n["}"]
        self.pair = self.error + 1

    def kind(self, token: str) -> str:
        if token[:1] == "`":
            return "TEMPLATE" if len(token) > 1 else "ERROR"
        if token[:1] == "#" and len(token) > 1:
            return "PRIVATE"
        if token[:1] == "$":
            return "NAME"
        return super().kind(token)

    def _raw(self, text: str) -> list[str]:
        out = []
        for t in self.find(text):
            m = self.split.fullmatch(t) if len(t) > 2 and "/" in t and t[0] not in "\"'`/" else None
            out += m.groups() if m else [t]
            if not t:
                break
        return out

    def tokens(self, text: str) -> list[int]:
        get = self.kinds.__getitem__
        return [self.number_of["REGEX"] if t[:1] == "/" and len(t) > 2 else get(t) for t in self._raw(text)]

    def first_error(self, text: str) -> int:
        """A first run supplies ";" only before "}" and the end; where that fails, line ends are looked up as well."""
        tokens = self.tokens(text)
        insert = [t == self.brace or t == self.end for t in tokens]
        bad = self.tables.first_error(tokens, insert)
        if bad >= 0 and tokens[bad] != self.error:
            broken = self._line_starts(text)
            if len(broken) == len(tokens):
                bad = self.tables.first_error(tokens, [a or b for a, b in zip(insert, broken)])
        return bad

    def _line_starts(self, text: str) -> list[bool]:
        out, last = [], 0
        for m in self.scan.finditer(text):
            out.append("\n" in text[last : m.start(1)] or "\r" in text[last : m.start(1)])
            last = m.end(1)
            t = m.group(1)
            if len(t) > 2 and "/" in t and t[0] not in "\"'`/" and self.split.fullmatch(t):
                out.append(False)
            if not t:
                break
        return out


class TsLexer(JsLexer):
    classes = {k: v for k, v in JsLexer.classes.items() if k not in ("&", "|", ">>", ">>>", ">>=", ">>>=", ">=")} | {">=": "BINOP"}
    operators = " ".join(x for x in JsLexer.operators.split() if x not in (">>", ">>>", ">>=", ">>>="))


class JavaLexer(Lexer):
    blanks = r"[ \t\n\r\f\x1a]+"
    ident = r"(?:[^\W\d]|\$)(?:\w|\$)*"
    strings = (r'"""(?s:(?:[^\\"]++|\\.|"(?!""))*+)"""', _DQ, r"'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'")
    extra = (r"\.[ \t]*class\b",)
    operators = ">>>= ... <<= >>= -> :: == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << + - * / % & | ^ ~ ! < > ( ) [ ] { } , : . ; = ? @"
    classes = {
        **dict.fromkeys(">>>= <<= >>= == != <= >= && || += -= *= /= %= &= |= ^= << / % ^".split(), "BINOP"),
        **dict.fromkeys("+ -".split(), "ADDOP"),
        **dict.fromkeys("++ --".split(), "INCR"),
        **dict.fromkeys("public private protected abstract native transient volatile strictfp".split(), "MODIFIER"),
        **dict.fromkeys("boolean byte char short int long float double".split(), "PRIMITIVE"),
        **dict.fromkeys("const goto _".split(), "ERROR"),
    }

    def kind(self, token: str) -> str:
        if token[:1] == "." and token.endswith("class"):
            return ".class"
        return "NAME" if token[:1] == "$" else super().kind(token)


class CLexer(Lexer):
    blanks = r"[ \t\n\r\f\v﻿]+"
    # directives end with their line; backslashes join lines
    comments = _C_COMMENTS + r"|\#(?:[^\n\\/]|\\\r?\n|\\.|/\*(?s:.*?)\*/|/)*|\\\r?\n"
    ident = r"(?:[^\W\d]|\$)(?:\w|\$)*"
    strings = (rf"(?:u8|[uUL])?{_DQ}", rf"(?:[uUL])?{_SQ}")
    operators = "... <<= >>= -> == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << >> + - * / % & | ^ ~ ! < > ( ) [ ] { } , : . ; = ?"
    classes = {
        **dict.fromkeys("<<= >>= == != <= >= && || += -= *= /= %= &= |= ^= << >> / % | ^ < >".split(), "BINOP"),
        **dict.fromkeys("+ -".split(), "ADDOP"),
        **dict.fromkeys("++ --".split(), "INCR"),
        "->": "ARROW",
        **dict.fromkeys("void char short int long float double signed unsigned _Bool bool _Complex __int128".split(), "TYPE"),
        **dict.fromkeys("const volatile restrict _Atomic __restrict __const".split(), "QUALIFIER"),
        **dict.fromkeys("static typedef register auto inline _Noreturn _Thread_local __inline thread_local constexpr".split(), "STORAGE"),
        **dict.fromkeys("__attribute__ _Alignas alignas".split(), "ATTRIBUTE"),
        **dict.fromkeys("_Static_assert static_assert".split(), "ASSERT"),
    }


class GoLexer(Lexer):
    blanks, comments = r"[ \t\r]+", r"(?!)"
    strings = (_DQ, r"'(?:[^'\\\n]|\\[^\n]+?)'", r"`[^`]*`")
    extra = (r"(?://[^\n]*|/\*(?s:.*?)\*/|\n|[ \t\r]+)+",)
    operators = "<<= >>= &^= ... := == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << >> &^ <- + - * / % & | ^ ~ ! < > ( ) [ ] { } , : . ; ="
    classes = {
        **dict.fromkeys("== != <= >= && || << >> &^ / % < >".split(), "BINOP"),
        **dict.fromkeys("<<= >>= &^= += -= *= /= %= &= |= ^=".split(), "ASSIGN"),
        **dict.fromkeys("+ -".split(), "ADDOP"),
        **dict.fromkeys("++ --".split(), "INCR"),
    }

    def __init__(self, tables: Tables) -> None:
        super().__init__(tables)
        n = self.number_of
        self.gap, self.broken = self.error + 1, self.error + 2
        self.semicolon = n[";"]
        self.ends = {n[x] for x in ("NAME", "NUMBER", "STRING", "break", "continue", "fallthrough", "return", "INCR", ")", "]", "}")}
        kinds = self.kinds

        class Gaps(dict):
            def __missing__(gaps, token: str) -> int:
                blank = token[:1] in " \t\r\n" and token or token[:2] in ("//", "/*")
                k = kinds[token] if not blank else self.broken if "\n" in token else self.gap
                if len(gaps) < 200_000 and len(token) < 80:
                    gaps[token] = k
                return k

        self.gaps = Gaps()

    def tokens(self, text: str) -> list[int]:
        return self._lay(text)[0]

    def _lay(self, text: str) -> tuple[list[int], list[int]]:
        """Classes with the semicolons that line ends stand for."""
        out: list[int] = []
        at: list[int] = []
        gap, broken, ends, end = self.gap, self.broken, self.ends, self.number_of[END]
        for i, k in enumerate(map(self.gaps.__getitem__, self.find(text.removeprefix("﻿")))):
            if k == gap:
                continue
            if k == broken or k == end:
                if out and out[-1] in ends:
                    out.append(self.semicolon)
                    at.append(i)
                if k == broken:
                    continue
            out.append(k)
            at.append(i)
            if k == end:
                break
        return out, at

    def line_of(self, text: str, index: int) -> int:
        at = self._lay(text)[1]
        return super().line_of(text.removeprefix("﻿"), at[min(index, len(at) - 1)])
