"""Definitions and uses of variables in Go and JS/TS source: one walk over a file's tokens with a stack of scopes.

Every use is tied to the innermost definition of its name that is in force there; names without one in the file
(functions, types, packages) give no use. A definition is in force from the end of its statement on.
"""

from __future__ import annotations

from codeloom.sources import golang, script
from codeloom.sources.scan import GO, JS, Source

#: Scopes of variables, and kinds of uses.
LOCAL, PARAM, GLOBAL = 0, 1, 2
READ, WRITE, CALL_ARG, RETURN = 0, 1, 2, 3
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=", "++", "--", "&&=", "||=", "??="}
HEADERS = {"if", "for", "switch", "select"}
JS_WORDS = script.NO_CALL | set("const let var class extends export default import from static get set break continue try finally this null undefined true false interface type enum".split())


class Walk:
    """defs: (name, type, scope, func_id, line); uses: (name, line, kind, func_id, def), def being an index into defs."""

    def __init__(self, s: Source, go: bool):
        self.s, self.go, self.defs, self.uses = s, go, [], []
        self.scopes: list[tuple[int, dict[str, int]]] = [(1 << 60, {})]  # where each ends, and its names
        self.pending: list[tuple[int, int, str, int]] = []  # from which token, in which scope, a name's definition holds
        self.words = golang.KEYWORDS if go else JS_WORDS
        self.end = golang.statement_end if go else script.statement_end

    def define(self, name: str, kind: str, scope: int, func: str, line: int, at: int | None = None, inside: dict | None = None) -> None:
        if not name or name == "_":
            return
        self.defs.append((name, kind, scope, func, line))
        names = self.scopes[-1][1] if inside is None else inside
        if at is None:
            names[name] = len(self.defs) - 1
        else:
            self.pending.append((at, names, name, len(self.defs) - 1))

    def settle(self, i: int) -> None:
        for p in [p for p in self.pending if p[0] <= i]:
            p[1][p[2]] = p[3]
        self.pending = [p for p in self.pending if p[0] > i]
        while self.scopes[-1][0] <= i:
            self.scopes.pop()

    def found(self, name: str) -> int | None:
        return next((names[name] for _, names in reversed(self.scopes) if name in names), None)

    def params(self, i: int, func: str, scope: int = PARAM) -> None:
        """Defines the parameters in the brackets at i; they hold in the scope on top."""
        s = self.s
        if self.go:
            for names, a, b in golang.fields(s, i + 1, s.pair[i]):
                for n in names:
                    self.define(n, golang.type_text(s, a, b)[0], scope, func, s.tokens[i].line)
        else:
            for a, b in s.split(i + 1, s.pair[i]):
                for n, line in self.bound(a, b):
                    self.define(n, "", scope, func, line)

    def bound(self, a: int, b: int) -> list[tuple[str, int]]:
        """Names that a JS pattern binds: a name, or those in an object or array pattern; defaults and types are left out."""
        s = self.s
        while s.is_at(a, "...", "public", "private", "protected", "readonly"):
            a += 1
        if s.is_at(a, "{", "["):
            out = []
            for x, y in s.split(a + 1, s.pair[a]):
                colon = x + 2 if s.is_at(a, "{") and s.is_at(x + 1, ":") else x
                out += self.bound(colon, y)
            return out
        return [(s.word(a), s.tokens[a].line)] if a < b and s.word(a) else []

    def body(self, i: int, stop: int, func: str) -> None:
        """Definitions and uses in tokens [i, stop) of function func."""
        s, returning, open_at = self.s, -1, []
        while i < stop:
            self.settle(i)
            while open_at and s.pair[open_at[-1]] <= i:
                open_at.pop()
            word = s.word(i)
            if not self.go and (arrow := self.arrow(i, stop)):
                i = self.closure(arrow, stop, func, open_at)
                continue
            if s.is_at(i, "(", "[", "{"):
                open_at.append(i)
                if s.is_at(i, "{"):
                    self.scopes.append((s.pair[i], {}))
            elif word in HEADERS and not s.is_at(i - 1, "."):
                self.scopes.append((max(self.header_end(i, stop), i + 1), {}))
            elif word == "return":
                returning = self.end(s, i, stop)
            elif self.go and word == "func" and s.is_at(i + 1, "("):
                at = golang.function_text(s, i + 1, stop)[1]
                if s.is_at(at, "{"):
                    self.scopes.append((s.pair[at], {}))
                    self.params(i + 1, func)
                    open_at.append(at)
                i = at + 1
                continue
            elif word in ("var", "const", "let") and not s.is_at(i - 1, "."):
                self.declared(i, stop, func)
                i = self.skip_names(i)
                continue
            elif word and word not in self.words and not s.is_at(i - 1, "."):
                self.named(i, stop, func, i < returning, open_at)
            i += 1
        self.settle(stop)

    def header_end(self, i: int, stop: int) -> int:
        s = self.s
        if self.go:
            at = script.body_of(s, i, stop)
            return golang.statement_end(s, at, stop)
        at = script.body_of(s, s.after(i + 1), stop)
        near = at < stop and s.tokens[at].line <= s.end_line(s.after(i + 1) - 1)
        return s.pair[at] + 1 if near else script.statement_end(s, s.after(i + 1), stop)

    def arrow(self, i: int, stop: int) -> int:
        """The index of the brackets or the name that are the parameters of a JS function which starts at i, or 0."""
        s = self.s
        if s.is_at(i, "function"):
            return next((j for j in range(i + 1, min(i + 4, stop)) if s.is_at(j, "(")), 0)
        if s.is_at(i, "(") and s.is_at(s.pair[i] + 1, "=>") or s.word(i) and s.is_at(i + 1, "=>"):
            return i
        return 0

    def closure(self, at: int, stop: int, func: str, open_at: list[int]) -> int:
        s = self.s
        after = s.after(at)
        after += s.is_at(after, "=>")
        if s.is_at(at - 1, ":") or s.is_at(after, ":"):
            after = script.body_of(s, after, stop)
        end = s.pair[after] if s.is_at(after, "{") else self.expression_end(after, stop)
        self.scopes.append((max(end, after + 1), {}))
        if s.is_at(at, "("):
            self.params(at, func)
        else:
            self.define(s.word(at), "", PARAM, func, s.tokens[at].line)
        if s.is_at(after, "{"):
            open_at.append(after)
            return after + 1
        return after

    def expression_end(self, i: int, stop: int) -> int:
        s = self.s
        while i < stop and not s.is_at(i, ",", ";", ")", "]", "}"):
            i = s.after(i)
        return i

    def declared(self, i: int, stop: int, func: str) -> None:
        s = self.s
        end = self.end(s, i, stop)
        if self.go:
            spans = [(i + 1, end)]
            if s.is_at(i + 1, "("):
                spans, a = [], i + 2
                while a < s.pair[i + 1]:
                    b = golang.statement_end(s, a, s.pair[i + 1])
                    spans.append((a, b))
                    a = max(b, a + 1) + s.is_at(b, ";")
            for a, b in spans:
                names = [a]
                while s.is_at(names[-1] + 1, ",") and s.word(names[-1] + 2):
                    names.append(names[-1] + 2)
                kind = "" if s.is_at(names[-1] + 1, "=") or names[-1] + 1 >= b else golang.type_text(s, names[-1] + 1, b)[0]
                for n in names:
                    self.define(s.word(n), kind, LOCAL if func else GLOBAL, func, s.tokens[n].line, b if func else None)
            return
        for a, b in s.split(i + 1, end):
            loop = next((j for j in range(a, b) if s.is_at(j, "of", "in")), b)
            for n, line in self.bound(a, loop):
                self.define(n, "", LOCAL if func else GLOBAL, func, line, min(b, loop) if func else None)

    def skip_names(self, i: int) -> int:
        """Where the first value or type of a declaration can start."""
        s, j = self.s, i + 1
        if self.go:
            return j + 1 if s.word(j) else j
        return s.after(j)

    def named(self, i: int, stop: int, func: str, returned: bool, open_at: list[int]) -> None:
        """A name that is no keyword and no selector: part of a definition, or a use."""
        s, name, j = self.s, self.s.word(i), i + 1
        while s.is_at(j, ",") and s.word(j + 1):
            j += 2
        first = i
        while s.is_at(first - 1, ",") and s.word(first - 2) and not s.is_at(first - 3, "."):
            first -= 2
        leads = first == 0 or s.is_at(first - 1, "{", "}", ";", ":", "if", "for", "switch", "else", "case") or s.tokens[first - 1].line < s.tokens[first].line
        if self.go and s.is_at(j, ":=") and leads:
            inside = self.scopes[-1][1]
            if name not in inside or not any(s.word(k) not in inside for k in range(first, j, 2)):
                at = self.end(s, j, stop)
                brace = next((k for k in self.heads(j, at) if s.is_at(k, ";", "{")), at)
                self.define(name, "", LOCAL, func, s.tokens[i].line, min(at, brace))
            else:
                self.use(i, name, WRITE, func)
            return
        if s.is_at(i + 1, ":") and not s.is_at(i - 1, "?", "case") and open_at and s.is_at(open_at[-1], "{"):
            return  # a key or a label
        wrote = s.is_at(j, *ASSIGN) and leads or s.is_at(i + 1, "++", "--") or s.is_at(i - 1, "++", "--")
        inner = open_at[-1] if open_at else -1
        argument = inner >= 0 and s.is_at(inner, "(") and (s.is_at(inner - 1, ")", "]") or s.word(inner - 1) not in self.words | {""})
        self.use(i, name, WRITE if wrote else CALL_ARG if argument else RETURN if returned else READ, func)

    def heads(self, j: int, end: int):
        while j < end:
            yield j
            j = j + 1 if self.s.is_at(j, "{") else self.s.after(j)

    def use(self, i: int, name: str, kind: int, func: str) -> None:
        at = self.found(name)
        if at is not None:
            self.uses.append((name, self.s.tokens[i].line, kind, func, at))


def go(text: str) -> Walk:
    s = Source(text, GO)
    w, pkg, i = Walk(s, True), s.word(1), 2
    bodies = []
    while i < len(s):
        end = golang.statement_end(s, i, len(s))
        if s.is_at(i, "var", "const"):
            w.declared(i, end, "")
        elif s.is_at(i, "func"):
            bodies.append((i, end))
        i = max(end, i + 1)
    for i, end in bodies:
        j, recv, kept = i + 1, "", len(w.scopes)
        w.scopes.append((1 << 60, {}))
        heads = []
        if s.is_at(j, "("):
            types = golang.fields(s, j + 1, s.pair[j])
            recv = next((s.word(k) for _, a, b in types for k in range(a, b) if s.word(k)), "")
            heads, j = [j], s.pair[j] + 1
        func, j = f"{pkg}.{f'({recv}).' if recv else ''}{s.word(j)}", j + 1
        j = s.pair[j] + 1 if s.is_at(j, "[") else j
        at = golang.function_text(s, j, end)[1]
        for h in [*heads, j]:
            w.params(h, func)
        if s.is_at(s.pair[j] + 1, "(") and s.pair[j] + 1 < at:
            w.params(s.pair[j] + 1, func, LOCAL)
        if s.is_at(at, "{"):
            w.body(at + 1, s.pair[at], func)
        del w.scopes[kept:]
    return w


def js(path: str, text: str) -> Walk:
    """Functions and methods found by script.parse() are walked one by one; names at the top of the file are global."""
    s, found = Source(text, JS), script.parse(path, text)
    w, pkg, i, bodies = Walk(s, False), found["package"], 0, []
    methods = {(n, line): c for c, n, line in found.get("nodes", [])}
    functions = {(d[1], d[4]) for d in found["decls"] if d[0] == golang.FUNC}
    last = -1
    for i in range(len(s)):
        name, line = s.word(i), s.tokens[i].line
        if i <= last or not name:
            continue
        at = 0
        if (name, line) in methods and s.is_at(i + 1, "("):
            at, func = i + 1, f"{pkg}.({methods[name, line]}).{name}"
        elif s.is_at(i - 1, "const", "let", "var"):
            w.declared(i - 1, len(s), "")
            at = next((k for k in range(i + 1, script.statement_end(s, i, len(s))) if w.arrow(k, len(s))), 0) if (name, line) in functions else 0
            at, func = (w.arrow(at, len(s)) if at else 0), f"{pkg}.{name}"
        elif (name, line) in functions and (s.is_at(i - 1, "function") or s.is_at(i - 2, "function")):
            at, func = next(k for k in range(i + 1, len(s)) if s.is_at(k, "(")), f"{pkg}.{name}"
        if at:
            after = s.after(at) + s.is_at(s.after(at), "=>")
            start = after if not s.is_at(after, "{") and s.is_at(after - 1, "=>") else script.body_of(s, after, len(s))
            if start < len(s):
                last = s.pair[start] if s.is_at(start, "{") else w.expression_end(start, len(s))
                bodies.append((start, last, at, func))
    for start, end, at, func in bodies:
        kept = len(w.scopes)
        w.scopes.append((1 << 60, {}))
        w.params(at, func) if s.is_at(at, "(") else w.define(s.word(at), "", PARAM, func, s.tokens[at].line)
        w.body(start + s.is_at(start, "{"), end, func)
        del w.scopes[kept:]
    return w
