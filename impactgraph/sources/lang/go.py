"""Extracting definitions, tests, imports and references from Go source."""

from __future__ import annotations

from .tokens import Extraction, lex

KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
PREFIXES = ("Test", "Benchmark", "Example", "Fuzz")


def _params(t, at: int) -> list[list[int]]:
    """The parameters of the list that opens at a token, as token indexes."""
    out, own, i = [], [], at + 1
    end = t.close(at)
    while i < end:
        if t.text[i] == ",":
            out.append(own)
            own = []
        else:
            own.append(i)
        i += 1
    return [p for p in [*out, own] if p]


def _testing_param(t, at: int) -> str:
    """The name of the first parameter, if it is a pointer to a testing type."""
    for p in _params(t, at)[:1]:
        words = [t.text[i] for i in p]
        if len(words) == 5 and words[1:4] == ["*", "testing", "."]:
            return words[0]
    return ""


def _is_test(t, name: str, params: int) -> bool:
    prefix = next((p for p in PREFIXES if name.startswith(p)), None)
    if prefix is None or not (name == prefix or name[len(prefix)].isupper()):
        return False
    found = _params(t, params)
    if not found:
        return prefix == "Example"
    words = [t.text[i] for i in found[0]]
    return len(found) == 1 and "*" in words and words[words.index("*") + 1 : words.index("*") + 3] == ["testing", "."]


def extract(src: str, path: str = "") -> Extraction:
    t = lex(src, "go")
    x = Extraction(t)
    skipped, functions, imports, depth_end = [], [], [], -1
    i = 0
    while i < len(t):
        if i <= depth_end:
            i += 1
            continue
        word = t.text[i]
        if t.kind[i] == "op" and word in "([{":
            depth_end = t.close(i)
        elif word == "import" and t.kind[i] == "id":
            end = t.close(i + 1) + 1 if t.at(i + 1) == "(" else next((j + 1 for j in range(i + 1, len(t)) if t.kind[j] in ("str", "raw")), len(t))
            imports.append((i, end))
            skipped.append((i, end))
            depth_end = end - 1
        elif word == "func" and t.kind[i] == "id" and (t.kind_at(i + 1) == "id" or t.at(i + 1) == "("):
            at, receiver = i + 1, None
            if t.at(at) == "(":
                words = [t.text[j] for j in range(at + 1, t.close(at)) if t.text[j] != "*"]
                words = words[: words.index("[")] if "[" in words else words
                receiver, at = words[-1] if words else "", t.close(at) + 1
            name_at = at
            at += 1
            if t.at(at) == "[":
                at = t.close(at) + 1
            params, at, body = at, t.close(at) + 1, None
            line = t.line[at - 1]
            while at < len(t):  # the result type, up to the body or the end of the line
                if t.text[at] == "{":
                    if t.at(at - 1) in ("interface", "struct"):
                        at = t.close(at) + 1
                        continue
                    body = (at, t.close(at) + 1)
                    break
                if t.line[at] != line:
                    break
                at = t.close(at) + 1 if t.text[at] in "([" and t.kind[at] == "op" else at + 1
                line = t.line[at - 1]
            end = body[1] if body else at
            functions.append((i, end, name_at, params, body, receiver))
            if not (receiver is None and t.at(name_at) == "init"):
                skipped.append((i, end))
            depth_end = end - 1
        i += 1
    x.module(skipped)
    subtests: set[int] = set()

    def subs(a: int, b: int, parent: int, chain: list[str], param: str) -> None:
        computed_used, j = False, a
        while j < b:
            if param and t.kind[j] == "id" and t.text[j] == param and t.at(j - 1) != "." and t.at(j + 1) == "." and t.at(j + 2) == "Run" and t.at(j + 3) == "(":
                end = t.close(j + 3)
                literal = t.kind_at(j + 4) == "str" and t.at(j + 5) in (",", ")")
                subtests.add(j + 2)
                if literal or not computed_used:
                    computed_used |= not literal
                    segment = t.text[j + 4][1:-1] if literal else "<computed>"
                    own = [*chain, segment]
                    d = x.add(segment, "TestCase", (j, end + 1), None, own, not literal, parent)
                    first = next((k for k in range(j + 4, end) if t.text[k] == "func" and t.at(k + 1) == "("), None)
                    if first is not None:
                        x.scopes.append((first, end, d))
                        subs(first + 2, end, d, own, _testing_param(t, first + 1))
                    j = end + 1
                    continue
            j += 1

    for a, end, name_at, params, body, receiver in functions:
        name = t.at(name_at)
        x.names.add(name_at)
        if receiver is not None:
            x.scopes.append((a, end, x.add(f"{receiver}.{name}", "Method", (a, end), body)))
        elif name == "init":
            continue
        elif _is_test(t, name, params):
            d = x.add(name, "TestCase", (a, end), body, [name])
            x.scopes.append((a, end, d))
            if body:
                subs(body[0], body[1], d, [name], _testing_param(t, params))
        else:
            x.scopes.append((a, end, x.add(name, "Function", (a, end), body)))
    aliases = set()
    for a, b in imports:
        for j in range(a, b):
            if t.kind[j] == "str":
                x.imports.append({"raw": t.text[j][1:-1], "line": t.line[j]})
                if t.kind_at(j - 1) == "id" and t.text[j - 1] != "import":
                    aliases.add(t.text[j - 1])
    known = {d["name"] for d in x.defs if d["kind"] == "Function"} | {m["raw"].rsplit("/", 1)[-1] for m in x.imports} | aliases
    x.scan(known - {""}, KEYWORDS, (".",), subtests, [*imports, *_signatures(t)])
    return x


def _signatures(t) -> list[tuple[int, int]]:
    """The receivers, parameters and results of functions: names and types, which are no references."""
    out = []
    for i in range(len(t)):
        if t.kind[i] == "id" and t.text[i] == "func":
            at = i + 1
            while at < len(t) and t.text[at] != "{" and not (t.line[at] != t.line[at - 1] and t.text[at] != ")") and t.text[at] not in (")", ",", ";"):
                if t.text[at] in ("interface", "struct") and t.at(at + 1) == "{":
                    at += 1
                    at = t.close(at) + 1
                else:
                    at = t.close(at) + 1 if t.kind[at] == "op" and t.text[at] in "([" else at + 1
            out.append((i, at))
    return out


def module_prefix(go_mod: str) -> str | None:
    """The module path on the first line of a go.mod."""
    first = go_mod.split("\n", 1)[0].strip()
    return first[7:].strip() if first.startswith("module ") else None


def candidates(path: str, raw: str, prefix: str | None) -> list[str]:
    """Where an import may lead, best first: a directory under the module's path."""
    return [raw[len(prefix) + 1 :]] if prefix and raw.startswith(f"{prefix}/") and len(raw) > len(prefix) + 1 else []
