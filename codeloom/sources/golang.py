"""Go source text: package, imports, declarations, calls and type usage of one file."""

from __future__ import annotations

from codeloom.sources.scan import GO, Source

#: Declaration kinds.
FUNC, TYPE, STRUCT, INTERFACE, VAR, CONST, CLASS, ENUM = 1, 2, 3, 4, 5, 6, 7, 8
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
INIT = ":<package-init>"
#: A line that ends with one of these goes on.
GOES_ON = {"func", "struct", "interface", "map", "chan", "type", "var", "const", "import", "package"}


def statement_end(s: Source, i: int, stop: int) -> int:
    """The index after the statement that starts at i, outside brackets."""
    while i < stop:
        last = s.pair[i] if s.is_at(i, "(", "[", "{") else i
        i = last + 1
        if s.is_at(i, ";"):
            return i
        t = s.tokens[last]
        ends = t.string or t.text in (")", "]", "}", "++", "--") or t.text[0].isdigit() or (s.word(last) and t.text not in GOES_ON)
        if i < stop and ends and s.tokens[i].line > s.end_line(last):
            return i
    return stop


def type_text(s: Source, i: int, stop: int) -> tuple[str, int]:
    """The printed type at i ('?' for kinds that are not printed) and the index after it."""
    if i >= stop:
        return "?", i
    if s.is_at(i, "*"):
        inner, j = type_text(s, i + 1, stop)
        return "*" + inner, j
    if s.is_at(i, "["):
        inner, j = type_text(s, s.pair[i] + 1, stop)
        return "[]" + inner, j
    word = s.word(i)
    if word == "map" and s.is_at(i + 1, "["):
        key, _ = type_text(s, i + 2, s.pair[i + 1])
        value, j = type_text(s, s.pair[i + 1] + 1, stop)
        return f"map[{key}]{value}", j
    if word == "func":
        return function_text(s, i + 1, stop)
    if word in ("interface", "struct") and s.is_at(i + 1, "{"):
        return "interface{}" if word == "interface" else "?", s.pair[i + 1] + 1
    if word == "chan" or s.is_at(i, "<-", "..."):
        return "?", type_text(s, i + 1, stop)[1]
    if not word:
        return "?", s.after(i)
    while s.is_at(i + 1, ".") and s.word(i + 2):
        word, i = f"{word}.{s.word(i + 2)}", i + 2
    if s.is_at(i + 1, "[") and i + 1 < stop:
        return "?", s.pair[i + 1] + 1
    return word, i + 1


def fields(s: Source, i: int, stop: int) -> list[tuple[list[str], int, int]]:
    """Parameters of [i, stop): names (none if unnamed), and the range of their type; names that share a type are one field."""
    parts = s.split(i, stop)
    named = any(s.word(a) and s.word(a) not in KEYWORDS and b - a > 1 and not s.is_at(a + 1, ".") and not (s.is_at(a + 1, "[") and s.pair[a + 1] == b - 1 and b - a > 3) for a, b in parts)
    if not named:
        return [([], a, b) for a, b in parts]
    out, names = [], []
    for a, b in parts:
        names.append(s.word(a))
        if b - a > 1:
            out.append((names, a + 1, b))
            names = []
    return out


def function_text(s: Source, i: int, stop: int) -> tuple[str, int]:
    """The printed parameters and results of a function type whose parameters open at i, and the index after it."""
    params = ", ".join(type_text(s, a, b)[0] for _, a, b in fields(s, i + 1, s.pair[i]))
    j, text = s.pair[i] + 1, f"({params})"
    if s.is_at(j, "("):
        found = [type_text(s, a, b)[0] for _, a, b in fields(s, j + 1, s.pair[j])]
        j = s.pair[j] + 1
        return text + (f" ({', '.join(found)})" if len(found) > 1 else f" {found[0]}" if found else ""), j
    starts = s.word(j) not in KEYWORDS - {"map", "func", "chan", "interface", "struct"} if s.word(j) else s.is_at(j, "*", "[", "<-")
    if starts and j < stop and s.tokens[j].line == s.end_line(j - 1):
        found, j = type_text(s, j, stop)
        text += " " + found
    return text, j


def base(text: str) -> str:
    """The named type inside a printed one: without pointers, slices and map keys."""
    while text:
        if text.startswith("*"):
            text = text[1:]
        elif text.startswith("[]"):
            text = text[2:]
        elif text.startswith("map["):
            text = text.partition("]")[2]
        else:
            break
    return "" if text == "?" or text.startswith(("(", "interface{")) else text


def calls(s: Source, i: int, stop: int, nested: bool) -> list[tuple[str, int]]:
    """Callee and line of the calls in [i, stop). A call's inside counts only if nested; what has no name is left out."""
    out = []
    while i < stop:
        if s.word(i) == "func" and s.is_at(i + 1, "("):
            body = function_text(s, i + 1, stop)[1]
            if s.is_at(body, "{"):
                end = s.pair[body] + 1
                i = s.pair[end] + 1 if s.is_at(end, "(") and not nested else body + 1
                continue
        if not s.word(i) or s.word(i) in KEYWORDS:
            i += 1
            continue
        loose = s.is_at(i - 1, ".", "]")  # goes on from another expression, or is the element of a type
        names, j, found = ([] if loose else [s.word(i)]), i + 1, None
        last, bare = s.word(i), loose
        hidden = s.is_at(i - 1, "]")
        inner = []
        while j < stop:
            if s.is_at(j, ".") and s.word(j + 1):
                last, hidden = s.word(j + 1), False
                names.append(last)
                j += 2
            elif s.is_at(j, "(") and (s.tokens[j].line == s.end_line(j - 1)):
                found = ("" if hidden else last if bare else ".".join(names), s.tokens[i].line, s.pair[j] + 1)
                inner.append((j + 1, s.pair[j]))
                bare, hidden, j = True, True, s.pair[j] + 1
            elif s.is_at(j, "[") and s.tokens[j].line == s.end_line(j - 1):
                bare, hidden, j = True, True, s.pair[j] + 1
            else:
                break
        if not found:
            i += 1
            continue
        if found[0]:
            out.append(found[:2])
        if nested:
            for a, b in inner:
                out += calls(s, a, b, True)
        i = found[2]
    return out


def parse(path: str, text: str, nested_calls: bool = False) -> dict:
    """package, is_test, imports, decls (kind, name, signature, recv, start, end), calls (caller, callee, line), usage (type, role, user, line).

    Raises ValueError where the text has no package clause or unmatched brackets.
    """
    s = Source(text, GO)
    if s.word(0) != "package" or not s.word(1):
        raise ValueError("parse: no package clause")
    out = {"package": s.word(1), "is_test": path.endswith("_test.go"), "imports": [], "decls": [], "calls": [], "usage": []}
    i, n = 2, len(s)
    while i < n:
        word = s.word(i)
        end = statement_end(s, i, n)
        if word == "func":
            function(s, i, end, out, nested_calls)
        elif word in ("import", "type", "var", "const"):
            grouped = s.is_at(i + 1, "(")
            a, stop = (i + 2, s.pair[i + 1]) if grouped else (i + 1, end)
            while a < stop:
                b = statement_end(s, a, stop)
                if b > a:
                    {"import": imported, "type": type_decl}.get(word, values)(s, a, b, out, word)
                a = b + s.is_at(b, ";")
        i = max(end, i + 1)
    return out


def function(s: Source, i: int, end: int, out: dict, nested: bool) -> None:
    start, recv, shown, j = i, "", "func ", i + 1
    if s.is_at(j, "("):
        types = [type_text(s, a, b)[0] for _, a, b in fields(s, j + 1, s.pair[j])]
        shown += f"({', '.join(types)}) "
        _, a, b = (fields(s, j + 1, s.pair[j]) or [([], j, j)])[0]
        while s.is_at(a, "*"):
            a += 1
        recv, j = s.word(a), s.pair[j] + 1
    name, j = s.word(j), j + 1
    if s.is_at(j, "["):
        j = s.pair[j] + 1
    if not name or not s.is_at(j, "("):
        raise ValueError(f"parse: function in line {s.tokens[start].line}")
    text, body = function_text(s, j, end)
    out["decls"].append((FUNC, name, shown + name + text, recv, s.tokens[start].line, s.end_line(end - 1)))
    caller = f"{out['package']}.{f'({recv}).' if recv else ''}{name}"
    line = s.tokens[start].line
    for role, at in (("param", j), ("return", s.pair[j] + 1)):
        if s.is_at(at, "(") and at < body:
            found = [type_text(s, a, b)[0] for _, a, b in fields(s, at + 1, s.pair[at])]
        else:
            found = [type_text(s, at, body)[0]] if role == "return" and at < body else []
        out["usage"] += [(base(t), role, name, line) for t in found if base(t)]
    if s.is_at(body, "{"):
        out["calls"] += [(caller, callee, at) for callee, at in calls(s, body + 1, s.pair[body], nested) if callee != caller]


def imported(s: Source, a: int, b: int, out: dict, word: str) -> None:
    out["imports"] += [t.text.strip('"`') for t in s.tokens[a:b] if t.string]


def type_decl(s: Source, a: int, b: int, out: dict, word: str) -> None:
    name, j = s.word(a), a + 1
    if s.is_at(j, "[") and s.pair[j] - j > 1 and s.pair[j] < b - 1 and s.word(j + 1) and s.pair[j] - j > 2:
        j = s.pair[j] + 1  # type parameters
    j += s.is_at(j, "=")
    kind = STRUCT if s.word(j) == "struct" else INTERFACE if s.word(j) == "interface" else TYPE
    out["decls"].append((kind, name, type_text(s, j, b)[0], "", s.tokens[a].line, s.end_line(b - 1)))
    if kind == STRUCT and s.is_at(j + 1, "{"):
        at, stop = j + 2, s.pair[j + 1]
        while at < stop:
            end = statement_end(s, at, stop)
            tail = end - 1 if end - at > 1 and s.tokens[end - 1].string else end  # a tag
            names = fields(s, at, tail)
            if names and (found := base(type_text(s, names[-1][1], tail)[0])):
                out["usage"].append((found, "field", name, s.tokens[at].line))
            at = max(end, at + 1) + s.is_at(end, ";")


def values(s: Source, a: int, b: int, out: dict, word: str) -> None:
    i = a
    while s.word(i):
        out["decls"].append((CONST if word == "const" else VAR, s.word(i), "", "", s.tokens[a].line, s.end_line(b - 1)))
        if not s.is_at(i + 1, ","):
            break
        i += 2
    out["calls"] += [(INIT, callee, line) for callee, line in calls(s, i + 1, b, True)]
