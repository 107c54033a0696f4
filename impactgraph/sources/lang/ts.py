"""Extracting definitions, tests, imports and references from TypeScript and JavaScript source."""

from __future__ import annotations

import posixpath

from .tokens import Extraction, lex

KEYWORDS = set("abstract any as async await break case catch class const continue debugger default delete do else enum export extends false finally for from function get if implements import in instanceof interface let new null of package private protected public return set static super switch this throw true try type typeof undefined var void while with yield".split())
CONTINUES = set(") ] } , ; . ?. = => + - * / % & | ^ < > ? : && || ?? == === != !== in of instanceof as extends implements".split())
OPENS = set("( [ { , . ?. = => + - * / % & | ^ < > ? : && || ?? == === != !== in of instanceof as extends implements return new typeof await".split())
TESTS = {"describe": False, "it": True, "test": True}


def _end(t, at: int, stop: int) -> int:
    """The end of a statement: its semicolon, or a line's end where no expression goes on."""
    while at < stop:
        if t.text[at] == ";":
            return at + 1
        if t.kind[at] == "op" and t.text[at] in "([{":
            at = t.close(at)
        nxt = at + 1
        if nxt < stop and t.line[nxt] > t.line[at] and t.text[at] not in OPENS and t.text[nxt] not in CONTINUES and t.text[nxt] not in "([":
            return nxt
        at = nxt
    return stop


def _block(t, at: int, stop: int) -> tuple[int, int] | None:
    """The braces of a function or class from a token on; braces of types after a colon and whole type parameters are passed."""
    while at < stop:
        if t.text[at] == "<" and t.kind[at] == "op":
            at = t.angle(at)
            continue
        if t.text[at] == "{" and t.kind[at] == "op":
            if t.at(at - 1) in (":", "<", "|", "&", ","):
                at = t.close(at) + 1
                continue
            return at, t.close(at) + 1
        if t.text[at] == ";":
            return None
        at = t.close(at) + 1 if t.kind[at] == "op" and t.text[at] in "([" else at + 1
    return None


def _function_value(t, at: int) -> tuple[int, int] | None:
    """The span of an arrow or function expression that starts at a token."""
    start = at
    if t.at(at) == "async":
        at += 1
    if t.at(at) == "function":
        body = _block(t, at, len(t))
        return (start, body[1]) if body else None
    if t.at(at) == "<":
        at = t.angle(at)
    if t.at(at) == "(":
        at = t.close(at) + 1
        if t.at(at) == ":":
            while at < len(t) and t.text[at] not in ("=>", ";"):
                at = t.close(at) + 1 if t.kind[at] == "op" and t.text[at] in "([{" else at + 1
    elif t.kind_at(at) == "id":
        at += 1
    if t.at(at) != "=>":
        return None
    at += 1
    return (start, t.close(at) + 1) if t.at(at) == "{" else (start, _end(t, at, len(t)))


def extract(src: str, path: str = "") -> Extraction:
    t = lex(src, "ts")
    x = Extraction(t)
    skipped, tops, bindings = [], [], set()
    i, n = 0, len(t)
    while i < n:
        start, exported = i, False
        if t.text[i] == "export":
            exported, i = True, i + 1
            i += t.at(i) == "default"
        i += t.at(i) == "declare"
        j = i + (t.at(i) in ("async", "abstract"))
        word = t.at(j)
        if word == "function" and t.kind_at(j + 1 + (t.at(j + 1) == "*")) == "id":
            name, body = j + 1 + (t.at(j + 1) == "*"), _block(t, j, n)
            end = body[1] if body else _end(t, j, n)
            tops.append(("Function", (i, end), name, body, (i, end)))
            skipped.append((start, end))
        elif word == "class" and t.kind_at(j + 1) == "id" and t.at(j + 1) not in ("extends", "implements"):  # a nameless class is an expression
            body = _block(t, j, n)
            end = body[1] if body else _end(t, j, n)
            tops.append(("Class", (i, end), j + 1, body, (i, end)))
            skipped.append((start, end))
        elif word in ("const", "let", "var") and not exported or word in ("const", "let", "var"):
            end, at, values = _end(t, j, n), j + 1, []
            while at < end:  # declarators
                name, eq = at, None
                while at < end and t.text[at] not in (",", ";"):
                    if t.text[at] == "=" and eq is None:
                        eq = at
                        value = _function_value(t, at + 1)
                        if value:
                            at = min(value[1], end)
                            values.append((name, value))
                            continue
                        values.append((name, None))
                    at = t.close(at) + 1 if t.kind[at] == "op" and t.text[at] in "([{" else at + 1
                if eq is None and name < end and t.text[name] != ";":
                    values.append((name, None))
                at += 1
            end = max([end, *(v[1] for _, v in values if v)])
            end += t.at(end) == ";"
            for name, value in values:
                if value and t.kind_at(name) == "id":
                    tops.append(("Function", (i, end), name, None, value))
            if values and all(v for _, v in values) and word != "var":
                skipped.append((start, end))
        elif word == "import" and t.at(j + 1) not in ("(", "."):
            end = next((k + 1 for k in range(j, n) if t.kind[k] == "str"), n)
            end += t.at(end) == ";"
            skipped.append((start, end))
            for k in range(j + 1, end):
                x.names.add(k)
                if t.kind[k] == "id" and t.text[k] not in ("from", "as", "type") and t.at(k + 1) != "as":
                    bindings.add(t.text[k])
        else:
            end = _end(t, i, n)
        i = max(end, start + 1)
    x.module(skipped)
    for kind, span, name, body, scope in tops:
        x.names.add(name)
        d = x.add(t.text[name], kind, span, body)
        x.scopes.append((*scope, d))
        if kind == "Class" and body:
            _methods(x, body[0] + 1, body[1] - 1, d)
    # Methods of object literals and class expressions define; they call nothing.
    skip_calls = {k for k in range(1, n) if t.kind[k] == "id" and t.at(k + 1) == "(" and t.at(t.close(k + 1) + 1) == "{" and t.text[k - 1] in ("{", "}", ";", ",", "async", "static", "get", "set", "*")}
    _tests(x, 0, n, [], skip_calls)
    for k in range(n):  # import and export sources, anywhere
        if t.kind[k] == "str" and (t.at(k - 1) == "from" or t.at(k - 1) == "import" and t.kind_at(k - 1) == "id"):
            x.imports.append({"raw": t.text[k][1:-1], "line": t.line[k]})
    known = bindings | {d["name"] for d in x.defs if d["parent_idx"] is None and d["kind"] in ("Function", "Class")}
    x.scan(known, KEYWORDS, (".", "?."), skip_calls)
    return x


def _methods(x: Extraction, a: int, b: int, parent: int) -> None:
    t, i = x.tokens, a
    while i < b:
        start = i
        while t.at(i) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "*", "abstract") and t.at(i + 1) not in ("(", "=", ":", ";"):
            i += 1
        if t.kind_at(i) in ("id", "str", "num") and t.at(i + 1) in ("(", "<"):
            at = t.angle(i + 1) if t.at(i + 1) == "<" else i + 1
            body = _block(t, t.close(at) + 1, b)
            if body:
                x.names.add(i)
                x.scopes.append((start, body[1], x.add(t.text[i], "Method", (start, body[1]), body, parent=parent)))
                i = body[1]
                continue
        i = max(_end(t, i, b), start + 1)


def _tests(x: Extraction, a: int, b: int, stack: list[tuple[str, bool]], skip: set[int]) -> None:
    """Test calls in a span: describe opens a segment, it and test end a chain; a name that is no plain string is computed."""
    t, i = x.tokens, a
    while i < b:
        if t.kind[i] == "id" and t.text[i] in TESTS and t.at(i - 1) not in (".", "?.", "function", "new"):
            at = i + 1
            if t.at(at) == "." and t.kind_at(at + 1) == "id":
                at += 2
            if t.at(at) == "(":
                skip.update((i, at - 1))
                inner, curried = t.close(at) + 1, False
                if t.at(inner) == "(":
                    at, curried = inner, True
                end = t.close(at)
                literal = not curried and t.kind_at(at + 1) == "str" and t.at(at + 2) in (",", ")")
                segment = (t.text[at + 1][1:-1], False) if literal else ("<computed>", True)
                chain = [*stack, segment]
                if TESTS[t.text[i]]:
                    names = []
                    for s, computed in chain:
                        if computed:
                            break
                        names.append(s)
                    d = x.add(segment[0], "TestCase", (i, end + 1), None, names, any(c for _, c in chain))
                    x.scopes.append((i, end + 1, d))
                    _tests(x, at + 1, end, stack, skip)
                else:
                    _tests(x, at + 1, end, chain, skip)
                i = end + 1
                continue
        i += 1


def candidates(path: str, raw: str) -> list[str]:
    """Where a relative import may lead, best first."""
    if not raw.startswith(("./", "../")):
        return []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(path), raw))
    if base.startswith(".."):
        return []
    out = [base, *(f"{base}.{e}" for e in ("ts", "tsx", "js", "jsx", "mts", "cts"))]
    if base.endswith(".js"):
        out.append(base[:-3] + ".ts")
    if base.endswith(".jsx"):
        out.append(base[:-4] + ".tsx")
    return [*out, f"{base}/index.ts", f"{base}/index.tsx"]
