"""Lexing source text into tokens with matched brackets; comments and white space are dropped."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

_NUMBER = r"\d[\w.]*"
PATTERNS = {
    "ts": re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<tmpl>`)|(?P<num>" + _NUMBER + r")|(?P<id>[^\W\d][\w$]*|[$#][\w$]*)|(?P<op>=>|\.\.\.|\?\.|[=!]==?|&&|\|\||\?\?|.)", re.S),
    "go": re.compile(r"(?P<skip>[ \t\r\n]+|//[^\n]*|/\*.*?\*/)|(?P<str>\"(?:\\.|[^\"\\\n])*\")|(?P<raw>`[^`]*`|'(?:\\.|[^'\\])+')|(?P<num>" + _NUMBER + r")|(?P<id>[^\W\d]\w*)|(?P<op>:=|<-|\.\.\.|[=!<>]=|&&|\|\||.)", re.S),
    "rust": re.compile(r"(?P<skip>\s+|//[^\n]*)|(?P<raw>b?r(?P<h>#*)\".*?\"(?P=h))|(?P<str>b?\"(?:\\.|[^\"\\])*\")|(?P<chr>b?'(?:\\[^\n]+?|[^'\\\n])')|(?P<life>'[^\W\d]\w*)|(?P<num>\d\w*(?:\.\d\w*)?)|(?P<id>r#\w+|[^\W\d]\w*)|(?P<op>::|->|=>|\.\.=?|[=!<>]=|&&|\|\||.)", re.S),
}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_VALUE = {"id", "num", "str", "raw", "tmpl"}
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


@dataclass
class Tokens:
    kind: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    pair: dict[int, int] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def kind_at(self, i: int) -> str:
        return self.kind[i] if 0 <= i < len(self.kind) else ""

    def close(self, i: int) -> int:
        """The partner of an opening bracket, or the last token if it is never closed."""
        return self.pair.get(i, len(self.text) - 1)

    def angle(self, i: int) -> int:
        """The place after the partner of the < at i; brackets inside are passed whole."""
        depth = 0
        while i < len(self.text):
            if self.kind[i] == "op":
                if self.text[i] in _OPEN:
                    i = self.close(i)
                depth += (self.text[i] == "<") - (self.text[i] == ">")
                if depth <= 0:
                    return i + 1
            i += 1
        return i

    def fingerprint(self, spans: list[tuple[int, int]]) -> str:
        """A hash of the kinds and texts of the tokens in half-open spans."""
        h = hashlib.sha256()
        for a, b in spans:
            for i in range(a, min(b, len(self.text))):
                h.update(f"{self.kind[i]}\x00{self.text[i]}\x01".encode("utf-8", "surrogatepass"))
        return h.hexdigest()


def _block_comment(src: str, at: int) -> int:
    """The end of a nested block comment."""
    depth, i = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(src, i):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(src)


def lex(src: str, lang: str) -> Tokens:
    out, pattern, at, line = Tokens(), PATTERNS[lang], 0, 1
    templates: list[int] = []  # bracket depths at which a template's ${ } closes
    depth = 0

    def put(kind: str, text: str) -> None:
        out.kind.append(kind)
        out.text.append(text)
        out.line.append(line)

    def template(i: int) -> int:
        """Reads template text from i to the closing backtick or the next ${."""
        nonlocal line, depth
        m = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*", re.S).match(src, i)
        put("tmpl", m[0])
        line += m[0].count("\n")
        i = m.end()
        if src.startswith("${", i):
            put("op", "{")
            depth += 1
            templates.append(depth)
            return i + 2
        return i + 1

    while at < len(src):
        if lang == "rust" and src.startswith("/*", at):
            end = _block_comment(src, at)
            line += src.count("\n", at, end)
            at = end
            continue
        m = pattern.match(src, at)
        kind, text = m.lastgroup if m.lastgroup != "h" else "raw", m[0]
        if kind == "op" and text == "/" and lang == "ts" and not (out.kind and (out.kind[-1] in _VALUE and out.text[-1] not in _BEFORE_REGEX or out.text[-1] in _CLOSE)):
            r = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(src, at)
            if r:
                kind, text = "raw", r[0]
        at += len(text)
        if kind == "skip":
            line += text.count("\n")
            continue
        if kind == "tmpl":
            at = template(at)
            continue
        if text == "}" and templates and depth == templates[-1]:
            put("op", "}")
            templates.pop()
            depth -= 1
            at = template(at)
            continue
        if kind == "op" and text in _OPEN:
            depth += text == "{"
        elif kind == "op" and text == "}":
            depth -= 1
        put(kind, text)
        line += text.count("\n")
    stack: list[int] = []
    for i, (k, t) in enumerate(zip(out.kind, out.text, strict=True)):
        if k != "op":
            continue
        if t in _OPEN:
            stack.append(i)
        elif t in _CLOSE:
            while stack:
                j = stack.pop()
                if _OPEN[out.text[j]] == t:
                    out.pair[j], out.pair[i] = i, j
                    break
    return out


@dataclass
class Extraction:
    """What one file holds: definitions in order (the first is the module initialiser), raw imports, and references."""

    tokens: Tokens
    defs: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    scopes: list[tuple[int, int, int]] = field(default_factory=list)  # (start, end, def): inner ones later
    names: set[int] = field(default_factory=set)  # tokens that name a definition or are no reference

    def add(self, name: str, kind: str, span: tuple[int, int], body: tuple[int, int] | None = None, test_id: list[str] | None = None, computed: bool = False, parent: int | None = None) -> int:
        t, (a, b) = self.tokens, span
        sig = [(a, b)] if body is None else [(a, body[0]), (body[1], b)]
        last = max(a, min(b, len(t)) - 1)
        self.defs.append({"name": name, "kind": kind, "start_line": t.line[a] if len(t) else 1, "end_line": t.line[last] if len(t) else 1, "test_id": test_id, "computed_name": computed, "parent_idx": parent, "sig_hash": t.fingerprint(sig), "body_hash": None if body is None else t.fingerprint([body])})
        return len(self.defs) - 1

    def module(self, skipped: list[tuple[int, int]]) -> None:
        """Puts the module initialiser first: the hash of the tokens outside the skipped spans."""
        spans, at = [], 0
        for a, b in sorted(skipped):
            spans.append((at, a))
            at = max(at, b)
        spans.append((at, len(self.tokens)))
        lines = self.tokens.line
        self.defs.insert(0, {"name": "<module>", "kind": "ModuleInit", "start_line": 1, "end_line": lines[-1] if lines else 1, "test_id": None, "computed_name": False, "parent_idx": None, "sig_hash": self.tokens.fingerprint(spans), "body_hash": None})

    def owner(self) -> list[int]:
        """The innermost definition of each token."""
        out = [0] * len(self.tokens)
        for a, b, d in sorted(self.scopes, key=lambda s: (s[0], -s[1])):
            out[a:b] = [d] * len(out[a:b])
        return out

    def scan(self, known: set[str], keywords: set[str], joins: tuple[str, ...], not_calls: set[int] = frozenset(), skipped: list[tuple[int, int]] = (), macros: list[tuple[int, int]] = (), patterns: set[int] = frozenset(), templates: list[tuple[int, int]] = ()) -> None:
        """Calls are names before an argument list; reads are other names, or members, that the allow-list knows. Each (def, kind, name, qualifier) is kept once.

        Names in patterns call nothing though brackets follow; in templates (bodies of macro definitions) known names are read and nothing is called.
        """
        t, owner, seen = self.tokens, self.owner(), set()
        hidden = {i for a, b in skipped for i in range(a, b)}
        inside = {i for a, b in macros for i in range(a, b)}
        loose = {i for a, b in templates for i in range(a, b)}

        def put(i: int, kind: str, qualifier: str | None) -> None:
            key = (owner[i], kind, t.text[i], qualifier)
            if key not in seen:
                seen.add(key)
                self.refs.append({"from_idx": owner[i], "ref_kind": kind, "name": t.text[i], "qualifier": qualifier, "line": t.line[i]})

        for i, kind in enumerate(t.kind):
            if kind != "id" or i in self.names or i in hidden or t.text[i] in keywords:
                continue
            if i in loose:
                if t.text[i] in known and t.at(i - 1) != "$":
                    put(i, "read", None)
                continue
            nxt, generic = i + 1, False
            if "::" in joins and t.at(nxt) == "::" and t.at(nxt + 1) == "<":  # turbofish
                depth = 0
                for nxt in range(i + 2, len(t)):
                    depth += (t.text[nxt] == "<") - (t.text[nxt] == ">")
                    if not depth:
                        break
                nxt, generic = nxt + 1, True  # such a call is a read of its name
            member = t.at(i - 1) in joins
            if t.at(nxt) == "(" and i not in patterns and not generic:
                if i in inside:
                    put(i, "call", None)
                elif i not in not_calls:
                    put(i, "call", self._operand(i - 2, joins) if member else None)
            elif i in inside:
                continue
            elif member:
                simple = t.kind_at(i - 2) == "id" and t.at(i - 3) not in joins
                whole = self._operand(i - 2, joins)
                if (generic or t.at(i + 1) not in joins) and (simple or t.at(i - 1) == "::") and (t.text[i] in known or whole in known):
                    put(i, "read", whole)
            elif (generic or t.at(i + 1) not in joins) and t.text[i] in known:
                put(i, "read", None)

    def _operand(self, i: int, joins: tuple[str, ...]) -> str:
        """The text of the operand that ends at token i."""
        t, end = self.tokens, i
        while i >= 0:
            if t.text[i] in _CLOSE and i in t.pair:
                i = t.pair[i]
                if t.kind_at(i - 1) == "id":
                    i -= 1
                elif "::" in joins and t.at(i - 1) == "!" and t.kind_at(i - 2) == "id":  # a macro
                    i -= 2
            if t.at(i - 1) in joins:
                i -= 2
                continue
            break
        return "".join(t.text[max(i, 0) : end + 1])
