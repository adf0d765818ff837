"""From a grammar text to parse tables, and a recogniser that runs them.

Grammar text: one rule per line, ``name: alternatives``; continuation lines are
indented.  ``"x"`` is the token x, UPPER a token class, lower a rule; ``?``,
``*``, ``+``, ``|`` and parentheses have their usual meaning.  ``%shift a b``
names tokens on which shifting wins over reducing.

The tables are LR(0) automata with LALR(1) lookaheads.  A table entry may hold
several actions: the recogniser then follows all of them on stacks that share
their tails, and goes on with one stack as soon as one is left, so ambiguous
places cost a little and the rest of a file runs as plain LR.
"""

from __future__ import annotations

import re

END = "<end>"
_PIECE = re.compile(r'"[^"]+"|[A-Za-z_]+|[()?*+|]')


def _expand(text: str) -> tuple[list[tuple[str, tuple[str, ...]]], set[str], str]:
    """Productions (name, symbols), tokens preferred to shift, and the start rule."""
    rules: list[list[str]] = []
    shift: set[str] = set()
    for line in text.splitlines():
        line = re.sub(r"(^|\s)//.*", "", line)
        if line.startswith("%shift"):
            shift |= set(line.split()[1:])
        elif line[:1].isspace() and line.strip():
            rules[-1][1] += " " + line
        elif line.strip():
            name, body = line.split(":", 1)
            rules.append([name.strip(), body])
    out: list[tuple[str, tuple[str, ...]]] = []
    made: dict[tuple, str] = {}

    def alternatives(pieces: list[str], at: int) -> tuple[list[tuple[str, ...]], int]:
        every, now = [], [()]
        while at < len(pieces) and pieces[at] != ")":
            p = pieces[at]
            if p == "|":
                every += now
                now, at = [()], at + 1
                continue
            if p == "(":
                inner, at = alternatives(pieces, at + 1)
                at += 1
            else:
                # a rule may be named like a token: rules carry a "$"
                inner, at = [(p.strip('"') if p[0] == '"' else p if p.isupper() else f"${p}",)], at + 1
            if at < len(pieces) and pieces[at] in "?*+":
                mark, at = pieces[at], at + 1
                if mark == "?":
                    inner = [*inner, ()]
                else:
                    key = (tuple(inner), "+")
                    if key not in made:
                        made[key] = name = f"$_{len(made)}"
                        for i in inner:
                            out.append((name, i))
                            out.append((name, (name, *i)))
                    inner = [(made[key],)] if mark == "+" else [(made[key],), ()]
            now = [a + b for a in now for b in inner]
        return every + now, at

    for name, body in rules:
        for alt in alternatives(_PIECE.findall(body), 0)[0]:
            out.append((f"${name}", alt))
    return list(dict.fromkeys(out)), shift, f"${rules[0][0]}"


class Tables:
    """LALR(1) tables of a grammar; plain lists and dicts, so they can be sent to executors."""

    def __init__(self, text: str) -> None:
        productions, prefer, start = _expand(text)
        productions = [("<start>", (start,)), *productions]
        by: dict[str, list[int]] = {}
        for i, (lhs, _) in enumerate(productions):
            by.setdefault(lhs, []).append(i)
        undefined = {s for _, rhs in productions for s in rhs if s[0] == "$" and s not in by}
        if undefined:
            raise ValueError(f"rules without a definition: {sorted(undefined)}")
        self.terminals = sorted({s for _, rhs in productions for s in rhs if s not in by} | {END})

        # LR(0) automaton on kernels
        def closure(kernel: frozenset) -> set:
            items, todo = set(kernel), list(kernel)
            while todo:
                p, d = todo.pop()
                rhs = productions[p][1]
                if d < len(rhs):
                    for q in by.get(rhs[d], ()):
                        if (q, 0) not in items:
                            items.add((q, 0))
                            todo.append((q, 0))
            return items

        first_state = frozenset({(0, 0)})
        states, ids, goto = [first_state], {first_state: 0}, []
        closures = []
        for kernel in states:
            moves: dict[str, set] = {}
            items = closure(kernel)
            closures.append(items)
            for p, d in items:
                rhs = productions[p][1]
                if d < len(rhs):
                    moves.setdefault(rhs[d], set()).add((p, d + 1))
            row = {}
            for symbol in sorted(moves):
                nxt = frozenset(moves[symbol])
                if nxt not in ids:
                    ids[nxt] = len(states)
                    states.append(nxt)
                row[symbol] = ids[nxt]
            goto.append(row)

        nullable: set[str] = set()
        grown = True
        while grown:
            grown = False
            for lhs, rhs in productions:
                if lhs not in nullable and all(s in nullable for s in rhs):
                    nullable.add(lhs)
                    grown = True

        # lookaheads by the relations of DeRemer and Pennello on nonterminal transitions
        transitions = [(s, a) for s, row in enumerate(goto) for a in row if a in by]
        index = {t: i for i, t in enumerate(transitions)}
        reads: list[list[int]] = [[] for _ in transitions]
        includes: list[list[int]] = [[] for _ in transitions]
        look: list[set[str]] = [set() for _ in transitions]
        lookback: dict[tuple[int, int], list[int]] = {}
        for i, (s, a) in enumerate(transitions):
            r = goto[s][a]
            for b in goto[r]:
                if b not in by:
                    look[i].add(b)
                elif b in nullable:
                    reads[i].append(index[r, b])
            if s == 0 and a == start:
                look[i].add(END)
            for p in by[a]:
                q, rhs = s, productions[p][1]
                for k, x in enumerate(rhs):
                    if x in by and all(y in nullable for y in rhs[k + 1 :]):
                        includes[index[q, x]].append(i)
                    q = goto[q][x]
                lookback.setdefault((q, p), []).append(i)
        for edges in (reads, includes):
            grown = True
            while grown:
                grown = False
                for i, to in enumerate(edges):
                    before = len(look[i])
                    for j in to:
                        look[i] |= look[j]
                    grown |= len(look[i]) != before

        number = {t: i for i, t in enumerate(self.terminals)}
        self.number = number
        self.action: list[dict[int, object]] = []
        self.conflicts = 0
        for s, items in enumerate(closures):
            row: dict[int, list[int]] = {number[t]: [g] for t, g in goto[s].items() if t not in by}
            for p, d in items:
                if d == len(productions[p][1]):
                    if p == 0:
                        row.setdefault(number[END], []).append(0)  # accept: state 0 is never shifted to
                        continue
                    for t in {t for i in lookback.get((s, p), ()) for t in look[i]}:
                        at = row.setdefault(number[t], [])
                        if not (at and t in prefer and at[0] > 0):
                            at.append(~p)
            self.conflicts += sum(len(v) > 1 for v in row.values())
            self.action.append({t: v[0] if len(v) == 1 else v for t, v in row.items()})
        self.length = [len(rhs) for _, rhs in productions]
        names = {n: i for i, n in enumerate(by)}
        self.lhs = [names[lhs] for lhs, _ in productions]
        self.goto = [{names[a]: g for a, g in row.items() if a in by} for row in goto]
        self.semicolon = number.get(";", -1)

    def first_error(self, tokens: list[int], insert: list[bool] | None = None) -> int:
        """Index of the first token (END comes last) that no parse can take; -1 if the tokens are a sentence.

        ``insert`` says before which tokens a missing ";" may be supplied.
        """
        action, goto, length, lhs = self.action, self.goto, self.length, self.lhs
        stack = [0]
        push = stack.append
        heads: list | None = None  # linked stacks (state, tail), while there are several
        for at, token in enumerate(tokens):
            if heads is None:
                while True:
                    a = action[stack[-1]].get(token)
                    if a is None:
                        if insert is not None and insert[at]:
                            heads = self._step([self._linked(stack)], self.semicolon)
                            if heads:
                                heads = self._step(heads, token)
                            if heads:
                                break
                        return at
                    if a.__class__ is int:
                        if a > 0:
                            push(a)
                            break
                        if a == 0:
                            return -1
                        n = length[~a]
                        if n:
                            del stack[-n:]
                        push(goto[stack[-1]][lhs[~a]])
                    else:
                        heads = self._step([self._linked(stack)], token)
                        break
            else:
                before = heads
                heads = self._step(before, token)
                if not heads and insert is not None and insert[at]:
                    heads = self._step(before, self.semicolon)
                    heads = heads and self._step(heads, token)
            if heads is not None:
                if heads is True:
                    return -1
                if not heads:
                    return at
                if len(heads) == 1:
                    node, stack = heads[0], []
                    while node is not None:
                        stack.append(node[0])
                        node = node[1]
                    stack.reverse()
                    push = stack.append
                    heads = None
        return len(tokens) - 1

    @staticmethod
    def _linked(stack: list[int]) -> tuple:
        node = None
        for s in stack:
            node = (s, node)
        return node

    def _step(self, heads: list, token: int):
        """All stacks after shifting ``token``; True once a whole sentence is accepted."""
        action, goto, length, lhs = self.action, self.goto, self.length, self.lhs
        shifted: dict = {}
        seen = {(h[0], id(h[1])) for h in heads}
        todo = list(heads)
        while todo:
            node = todo.pop()
            acts = action[node[0]].get(token)
            if acts is None:
                continue
            for a in (acts,) if acts.__class__ is int else acts:
                if a > 0:
                    shifted[a, id(node)] = (a, node)
                elif a == 0:
                    return True
                else:
                    tail = node
                    for _ in range(length[~a]):
                        tail = tail[1]
                    state = goto[tail[0]][lhs[~a]]
                    key = (state, id(tail))
                    if key not in seen:
                        seen.add(key)
                        new = (state, tail)
                        todo.append(new)
        # equal states on equal tails are one stack
        return list(shifted.values())
