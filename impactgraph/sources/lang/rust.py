"""Extracting definitions, tests, imports and references from Rust source."""

from __future__ import annotations

from .tokens import Extraction, lex

KEYWORDS = set("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while true false".split())
MODIFIERS = {"pub", "async", "unsafe", "const", "extern", "default"}


def _body(t, at: int, end: int) -> tuple[int, int] | None:
    """The braces of an item's body from a token on, or None if it ends with a semicolon."""
    while at < end:
        if t.text[at] == "{" and t.kind[at] == "op":
            return at, t.close(at) + 1
        if t.text[at] == ";":
            return None
        at = t.close(at) + 1 if t.text[at] in "([" and t.kind[at] == "op" else at + 1
    return None


def _until(t, at: int, end: int) -> int:
    """The end of an item that a semicolon closes."""
    while at < end and t.text[at] != ";":
        at = t.close(at) + 1 if t.text[at] in "([{" and t.kind[at] == "op" else at + 1
    return min(at + 1, end)


def use_names(raw: str) -> list[str]:
    """The names that a use binds: aliases, last segments, members of a group; none for a glob."""
    if not raw.startswith("use "):
        return []
    text = raw[4:]
    if "{" in text and "}" in text:
        items = text[text.rindex("{") + 1 : text.rindex("}")].split(",")
    else:
        items = [text]
    out = [i.strip().rsplit(" as ", 1)[-1].rsplit("::", 1)[-1].strip() for i in items]
    return [n for n in out if n and n != "*"]


def extract(src: str, path: str = "") -> Extraction:
    t = lex(src, "rust")
    x = Extraction(t)
    skipped: list[tuple[int, int]] = []
    items, macros = [], []

    def walk(a: int, b: int, mods: list[str], top: bool) -> None:
        i, attrs = a, []
        while i < b:
            if t.text[i] == "#" and t.at(i + 1) in ("[", "!"):
                at = i + 1 if t.at(i + 1) == "[" else i + 2
                attrs.append((at + 1, t.close(at)))
                i = t.close(at) + 1
                continue
            start, j = i, i
            while t.at(j) in MODIFIERS and j < b:
                if t.at(j) == "const" and t.at(j + 1) not in MODIFIERS | {"fn"}:
                    break
                j += 1
                if t.at(j) == "(" and t.at(j - 1) == "pub":
                    j = t.close(j) + 1
                if t.kind_at(j) == "str":
                    j += 1
            word, end = t.at(j), None
            if word == "fn":
                body = _body(t, j, b)
                end = body[1] if body else _until(t, j, b)
                test = any(_test_attr(t, *at) for at in attrs)
                items.append(("test" if test else "fn", start, end, j + 1, body, mods, None))
            elif word == "impl":
                body = _body(t, j, b)
                end = body[1] if body else _until(t, j, b)
                if body:
                    header, k = [], j + 1
                    if t.at(k) == "<":
                        k = _angle(t, k)
                    while k < body[0] and t.text[k] != "where":
                        header = [] if t.text[k] == "for" else [*header, k]
                        k += 1
                    name = "".join(t.text[k] for k in header if t.text[k] not in ("&", "mut")).split("<", 1)[0]
                    methods(body[0] + 1, body[1] - 1, name)
            elif word in ("struct", "enum", "trait"):
                body = _body(t, j, b)
                end = body[1] if body else _until(t, j, b)
                items.append(("Class", start, end, j + 1, body, mods, None))
            elif word == "mod":
                if t.at(j + 2) == "{":
                    end = t.close(j + 2) + 1
                    walk(j + 3, end - 1, [*mods, t.at(j + 1)], False)
                else:
                    end = _until(t, j, b)
                    x.imports.append({"raw": f"mod {t.at(j + 1)}", "line": t.line[start]})
                x.names.add(j + 1)
            elif word == "use":
                end = _until(t, j, b)
                x.imports.append({"raw": "use " + _use_text(t, j + 1, end - 1), "line": t.line[start]})
            if end is None:
                i = t.close(i) + 1 if t.text[i] in "([{" and t.kind[i] == "op" else i + 1
            else:
                if top:
                    skipped.append((start, end))
                i = end
            attrs = []

    def methods(a: int, b: int, owner: str) -> None:
        i = start = a
        while i < b:
            if t.text[i] == "#" and t.at(i + 1) == "[":
                i = start = t.close(i + 1) + 1
                continue
            if t.text[i] == "fn" and t.kind[i] == "id":
                body = _body(t, i, b)
                end = body[1] if body else _until(t, i, b)
                items.append(("Method", start, end, i + 1, body, [], owner))
                i = start = end
                continue
            if t.text[i] == ";" or (t.text[i] in "([{" and t.kind[i] == "op"):
                closing = t.text[i] == "{" or t.text[i] == ";"
                i = (t.close(i) if t.text[i] != ";" else i) + 1
                start = i if closing else start
                continue
            i += 1

    walk(0, len(t), [], True)
    x.module(skipped)
    for kind, a, b, name_at, body, mods, owner in items:
        name = t.at(name_at)
        x.names.add(name_at)
        if kind == "Class":
            x.add(name, "Class", (a, b), body)
        elif kind == "test":
            x.scopes.append((a, b, x.add(name, "TestCase", (a, b), body, [*mods, name])))
        else:
            x.scopes.append((a, b, x.add(f"{owner}.{name}" if kind == "Method" else name, "Method" if kind == "Method" else "Function", (a, b), body)))
    templates, patterns, types = [], set(), []
    for i in range(len(t)):
        if t.kind[i] == "id" and t.text[i] in ("fn", "impl", "struct", "enum", "trait", "union") and t.at(i - 1) not in ("::", ".", ":", "->", "&", "<", ",", "("):  # names and types up to the body
            body = _body(t, i, len(t))
            types.append((i + 1 + (t.text[i] != "impl"), (body[0] if t.text[i] in ("fn", "impl", "trait") else body[1]) if body else _until(t, i, len(t))))
        if t.kind[i] == "id" and t.at(i + 1) == "{" and t.text[i][0].isupper():  # a struct's literal names a type
            types.append((i, i + 1))
        if t.kind[i] == "id" and (t.at(i - 1) == "fn" or t.text[i] in ("Fn", "FnMut", "FnOnce")):  # names of functions and their types
            patterns.add(i)
        if t.text[i] == "macro_rules" and t.at(i + 1) == "!" and t.kind_at(i + 2) == "id":
            templates.append((i, t.close(i + 3) + 1))
        if t.text[i] == "enum" and t.kind_at(i + 1) == "id" and (body := _body(t, i, len(t))):
            patterns.update(k for k in range(*body) if t.at(k - 1) in ("{", ",", "]") and t.close(body[0]) == body[1] - 1)
        if t.text[i] == "let":
            patterns.update(names := _pattern(t, i + 1, ("=", ":", ";")))
            end = names[-1] + 1 if names else i + 1
            if t.at(end) == ":":
                types.append((end, end + len(_pattern(t, end, ("=", ";")))))
        if t.text[i] == "=>" and t.kind[i] == "op":
            patterns.update(_arm(t, i))
        if t.text[i] == "!" and t.kind_at(i - 1) == "id" and t.at(i + 1) in ("(", "[", "{") and t.kind[i] == "op":
            macros.append((i + 1, t.close(i + 1) + 1))
            x.names.add(i - 1)
        if t.text[i] == "#" and t.at(i + 1) == "[":
            x.names.update(range(i + 1, t.close(i + 1)))
    known = {d["name"] for d in x.defs if d["kind"] in ("Function", "Class")} | {n for m in x.imports for n in use_names(m["raw"])}
    x.scan(known, KEYWORDS, (".", "::"), skipped=types, macros=macros, patterns=patterns, templates=templates)
    return x


def _pattern(t, at: int, stops: tuple[str, ...]) -> list[int]:
    """The tokens from one on up to the first of the stops outside brackets."""
    first = at
    while at < len(t) and t.text[at] not in stops:
        at = t.close(at) + 1 if t.kind[at] == "op" and t.text[at] in "([{" else at + 1
    return list(range(first, at))


def _arm(t, arrow: int) -> list[int]:
    """The tokens of the pattern before a match arm's arrow; a guard is no part of it."""
    at, guard = arrow - 1, arrow
    while at >= 0 and t.text[at] not in ("{", ",", ";"):
        if t.text[at] == "if" and t.kind[at] == "id":
            guard = at
        if t.kind[at] == "op" and t.text[at] in ")]}":
            if t.text[at] == "}" and t.pair.get(at, at) != at and t.at(at + 1) not in ("=>", "|", "if"):
                break  # the block of the arm before
            at = t.pair.get(at, at)
        at -= 1
    return list(range(at + 1, guard))


def _angle(t, at: int) -> int:
    depth = 0
    while at < len(t):
        depth += (t.text[at] == "<") - (t.text[at] == ">")
        at += 1
        if depth <= 0:
            break
    return at


def _test_attr(t, a: int, b: int) -> bool:
    words = []
    for i in range(a, b):
        if t.kind[i] != "id" and t.text[i] != "::":
            break
        words.append(t.text[i])
    path = "".join(words)
    return path == "rstest" or path.rsplit("::", 1)[-1] in ("test", "bench")


def _use_text(t, a: int, b: int) -> str:
    out = ""
    for i in range(a, b):
        word = t.text[i]
        out += f" {word} " if word == "as" else ", " if word == "," else word
    return out


def candidates(path: str, raw: str, roots: list[str]) -> list[str]:
    """Where an import may lead, best first. roots: directories with a lib.rs or main.rs."""
    folder, _, name = path.rpartition("/")
    join = lambda *p: "/".join(s for s in p if s)
    if raw.startswith("mod "):
        base = folder if name in ("lib.rs", "main.rs", "mod.rs") else join(folder, name.rsplit(".", 1)[0])
        return [join(base, f"{raw[4:]}.rs"), join(base, raw[4:], "mod.rs")]
    text = raw[4:].split("{", 1)[0].removesuffix("::")
    head, *rest = text.split("::")
    if head == "crate":
        at, known = folder, set(roots)
        while at not in known:
            if not at:
                return []
            at = at.rpartition("/")[0]
        start = at
    elif head in ("self", "super"):
        start = folder
    else:
        return []
    out = []
    for n in range(len(rest), 0, -1):
        out += [join(start, *rest[:n]) + ".rs", join(start, *rest[:n], "mod.rs")]
    return out
