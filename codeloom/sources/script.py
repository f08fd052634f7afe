"""JS and TS source text: imports, declarations and calls of one file.

Known limits: code inside template strings is text, and JSX text with unpaired quotes or brackets is a parse error.
"""

from __future__ import annotations

from codeloom.sources.golang import CLASS, ENUM, FUNC, INTERFACE, TYPE
from codeloom.sources.scan import JS, Source

NO_CALL = set("if for while switch catch return typeof await yield throw case in of instanceof void delete function new super import else do with async".split())
GOES_ON = set("= => , . + - * / % & | && || ? : < ( [ { ! == === != !== ??".split())
OPENED = {"function": FUNC, "class": CLASS, "interface": INTERFACE, "enum": ENUM}


def cut(text: str) -> str:
    """At most 200 bytes, and a mark if there was more."""
    raw = text.encode()
    return text if len(raw) <= 200 else raw[:200].decode(errors="ignore") + "…"


def statement_end(s: Source, i: int, stop: int) -> int:
    """The index after the statement at i: past its semicolon, or where a line ends and the next one can't go on with it."""
    while i < stop:
        if s.is_at(i, ";"):
            return i + 1
        last = s.after(i) - 1
        i = last + 1
        if i < stop and s.tokens[i].line > s.end_line(last) and not s.is_at(i, *GOES_ON - {"{", "[", "("}) and (s.tokens[last].string or s.tokens[last].text not in GOES_ON):
            return i
    return stop


def body_of(s: Source, i: int, stop: int) -> int:
    """The index of the first { from i outside other brackets, or stop."""
    while i < stop and not s.is_at(i, "{"):
        i = s.after(i)
    return i


def calls(s: Source, i: int, stop: int, pkg: str, recv: str) -> list[tuple[str, int]]:
    """Callee and line of every call in [i, stop), those inside others included."""
    out = []
    while i < stop:
        if not s.word(i) or s.is_at(i - 1, ".") or s.word(i) in NO_CALL or s.is_at(i - 1, "new", "function"):
            i += 1
            continue
        names, j, plain, last = [s.word(i)], i + 1, True, i
        while j < stop:
            dot = j + 1 if s.is_at(j, "?") and s.is_at(j + 1, ".") else j
            if s.is_at(dot, ".") and s.word(dot + 1):
                last, j = dot + 1, dot + 2
                names.append(s.word(last))
            elif s.is_at(j, "(", "[") and s.tokens[j].line == s.end_line(j - 1):
                end = s.pair[j] + 1
                method = len(names) == 1 and s.is_at(end, "{") and s.tokens[end].line == s.end_line(end - 1)
                if s.is_at(j, "(") and not method and names[-1]:
                    left = s.text[s.tokens[i].at : s.tokens[last].at + len(s.tokens[last].text)]
                    if not plain:
                        callee = left
                    elif len(names) == 1:
                        callee = f"{pkg}.{names[0]}"
                    elif len(names) == 2 and names[0] == "this" and recv:
                        callee = f"{pkg}.({recv}).{names[1]}"
                    else:
                        callee = "" if len(names) == 2 and names[0] == "super" else ".".join(names)
                    if callee:
                        out.append((callee, s.tokens[i].line))
                out += calls(s, j + 1, s.pair[j], pkg, recv)
                plain, names, j = False, [*names, ""], end
            else:
                break
        i = j
    return out


def parse(path: str, text: str) -> dict:
    """As golang.parse(), without usage; package is the file's base name. Raises ValueError on unmatched brackets."""
    s, name = Source(text, JS), path.rpartition("/")[2]
    out = {"package": name.rpartition(".")[0] or name, "is_test": ".test." in name or ".spec." in name, "imports": [], "decls": [], "calls": [], "usage": []}
    block(s, 0, len(s), out, True)
    return out


def block(s: Source, i: int, stop: int, out: dict, top: bool) -> None:
    """The declarations among the statements of [i, stop): a file or a namespace."""
    while i < stop:
        start = i
        exported = s.is_at(i, "export")
        while s.is_at(i, "export", "default", "declare", "abstract"):
            i += 1
        word = s.word(i + 1) if s.is_at(i, "async") else s.word(i)
        if word == "const" and s.word(i + 1) == "enum":
            i, word = i + 1, "enum"
        if word in ("namespace", "module") and s.word(i + 1):
            at = body_of(s, i, stop)
            if at < stop:
                block(s, at + 1, s.pair[at], out, False)
            i = s.after(at)
        elif word in OPENED and (at := body_of(s, i, stop)) < stop:
            i = opened(s, i, at, OPENED[word], out)
        else:
            end = statement_end(s, i, stop)
            if word == "type" and s.word(i + 1):
                last = end - 2 if s.is_at(end - 1, ";") else end - 1
                whole = s.text[s.tokens[i].at : s.tokens[end - 1].at + len(s.tokens[end - 1].text)]
                out["decls"].append((TYPE, s.word(i + 1), cut(whole.strip()), "", s.tokens[i].line, s.end_line(last)))
            elif word in ("const", "let", "var"):
                variables(s, i, end, out)
            elif top and (word == "import" or exported):
                paths = [t.text for t in s.tokens[start:end] if t.string and t.text[0] in "'\"`"]
                out["imports"] += [p[1:-1] for p in paths[-1:]]
            i = end
        i = max(i, start + 1)


def signature(s: Source, i: int, end: int) -> str:
    whole = s.text[s.tokens[i].at : s.tokens[end - 1].at + len(s.tokens[end - 1].text)]
    head = whole.partition("{")[0] or whole
    return cut(" ".join(head.split()))


def opened(s: Source, i: int, at: int, kind: int, out: dict) -> int:
    """A function, class, interface or enum whose body opens at token at; returns the index after it."""
    end = s.pair[at] + 1
    named = next((s.word(j) for j in range(i, at) if s.word(j) and s.word(j) not in ("async", "const", *OPENED)), "")
    if s.is_at(i + 1, "extends") or s.is_at(i + 1 + s.is_at(i, "async"), "(") or s.is_at(i + 1, "*") and s.is_at(i + 2, "("):
        named = ""
    if not named and kind in (INTERFACE, ENUM):
        return end
    out["decls"].append((kind, named or "<default>", signature(s, i, end), "", s.tokens[i].line, s.end_line(end - 1)))
    if kind == FUNC and named:
        called(s, next(j for j in range(i, end) if s.word(j) == named) + 1, end, "", named, out)
    if kind == CLASS and named:
        j = at + 1
        while j < end - 1:
            if s.is_at(j + 1, "(") and s.word(j):
                body = body_of(s, s.pair[j + 1] + 1, end - 1)
                if body < end - 1 and not any(s.is_at(x, ";", "=") for x in range(s.pair[j + 1] + 1, body)):
                    out["nodes"] = [*out.get("nodes", []), (named, s.word(j), s.tokens[j].line)]
                    called(s, j + 1, s.pair[body] + 1, named, s.word(j), out)
                    j = s.pair[body] + 1
                    continue
            j = s.after(j)
    return end


def variables(s: Source, i: int, end: int, out: dict) -> None:
    """Names that a const, let or var statement gives to functions."""
    for a, b in s.split(i + 1, end):
        equals = next((j for j in range(a, b) if s.is_at(j, "=")), None)
        if not s.word(a) or equals is None:
            continue
        value, arrow, j = equals + 1 + s.is_at(equals + 1, "async"), False, equals + 1
        while j < b and not arrow and not s.is_at(j, "{"):
            arrow, j = s.is_at(j, "=>"), s.after(j)
        arrow = arrow and (s.is_at(value, "(", "<") or s.is_at(value + 1, "=>"))
        if arrow or s.is_at(value, "function"):
            out["decls"].append((FUNC, s.word(a), signature(s, i, end), "", s.tokens[i].line, s.end_line(end - 1 - (s.is_at(end - 1, ";") and end - 1 > i))))
            called(s, equals + 1, b, "", s.word(a), out)


def called(s: Source, i: int, end: int, recv: str, name: str, out: dict) -> None:
    pkg = out["package"]
    caller = f"{pkg}.({recv}).{name}" if recv else f"{pkg}.{name}"
    out["calls"] += [(caller, callee, line) for callee, line in calls(s, i, end, pkg, recv) if callee != caller]
