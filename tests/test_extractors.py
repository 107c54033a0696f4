"""Extractors on the sample trees and on odd sources of each language."""

from impactgraph.plans import samples as S
from impactgraph.sources import repo as R
from impactgraph.sources.lang import go, rust, ts


def extracted():
    return {path: R.extract_source(path, lang, source.encode()) for lang, tree in S.TREES.items() for path, source in tree.items()}


def test_definitions():
    got = [(p, i, d["name"], d["kind"], d["test_id"] and "|".join(d["test_id"]), d["computed_name"], d["parent_idx"], d["start_line"], d["body_hash"] is not None) for p, x in extracted().items() for i, d in enumerate(x["defs"])]
    assert got == S.DEFS


def test_imports_in_order():
    assert [(p, m["raw"], m["line"]) for p, x in extracted().items() for m in x["imports"]] == S.IMPORTS


def test_references_once_each():
    got = [(p, r["from_idx"], r["ref_kind"], r["name"], r["qualifier"]) for p, x in extracted().items() for r in x["refs"]]
    assert sorted(map(str, got)) == sorted(map(str, S.REFS))


def test_import_candidates():
    there = set(S.TREE_PATHS)
    for lang, path, raw, target in S.TARGETS:
        options = ts.candidates(path, raw) if lang == "ts" else go.candidates(path, raw, "example.org/port") if lang == "go" else rust.candidates(path, raw, ["src"])
        assert next((c for c in options if c in there), None) == target
    assert ts.candidates("yard/crane.ts", "../rope/knot.js")[:2] == ["rope/knot.js", "rope/knot.js.ts"] and "rope/knot.ts" in ts.candidates("yard/crane.ts", "../rope/knot.js")
    assert rust.candidates("src/main.rs", "mod hull", ["src"]) == ["src/hull.rs", "src/hull/mod.rs"]
    assert rust.candidates("src/deck/mast.rs", "use crate::sail::jib", ["src"])[:3] == ["src/sail/jib.rs", "src/sail/jib/mod.rs", "src/sail.rs"]
    assert go.module_prefix("module example.org/port\n\ngo 1.22\n") == "example.org/port" and go.module_prefix("go 1.22") is None
    assert rust.use_names("use crate::deck::{mast, boom as spar, *}") == ["mast", "spar"]


def test_edits_show_where_they_are():
    for lang, path, old, new, want in S.EDITS:
        source = S.TREES[lang][path]
        assert old in source
        a, b = (R.extract_source(path, lang, s.encode())["defs"] for s in (source, source.replace(old, new)))
        changed = [f"{x['name']} {'signature' if x['sig_hash'] != y['sig_hash'] else 'body'}" for x, y in zip(a, b, strict=True) if (x["sig_hash"], x["body_hash"]) != (y["sig_hash"], y["body_hash"])]
        assert ",".join(changed) == want


def test_name_status():
    assert R.parse_status(S.STATUS.encode()) == S.CHANGES
    for raw in (b"U\0both.ts\0", b"X\0odd.ts\0"):
        try:
            R.parse_status(raw)
        except R.GitError as e:
            assert "unsupported" in str(e)
        else:
            raise AssertionError("no error")


def test_types_and_patterns_are_no_calls():
    x = rust.extract("trait Pump { fn prime(&self); }\nfn run<T: Fn(u8)>(t: T) { t(1) }\nenum Tank { Full(u8), Dry }\nfn f(t: Tank) { if let Full(n) = t { drain(n) } }\n")
    assert [(r["ref_kind"], r["name"]) for r in x.refs] == [("call", "t"), ("call", "drain")]
    x = ts.extract("export default class extends Hull { float() { return this.keel(); } }\nfunction load<B extends { mass: number }>(b: B): Map<string, { b: B }> { return stow(b); }\n")
    assert [d["name"] for d in x.defs] == ["<module>", "load"] and [(r["from_idx"], r["name"]) for r in x.refs] == [(0, "keel"), (1, "stow")]


def test_empty_and_odd_sources():
    for extract in (ts.extract, go.extract, rust.extract):
        assert [d["kind"] for d in extract("").defs] == ["ModuleInit"]
        for odd in ("}{)(\"'`/* unclosed", "fn func function class < impl <", "let x: =>", "match { => ,"):
            extract(odd)
