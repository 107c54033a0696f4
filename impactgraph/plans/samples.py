"""Small source trees of our own, about a harbour, that hold every construct the extractors know; queries and tests share them."""

from __future__ import annotations

TS = {
    "src/tide.ts": """import { warn as alarm } from "./bell";
import fallback, * as charts from "../charts/index.js";
export { moor } from "./quay";
// the height of the water
export function level(hour: number, range: { low: number }): number {
  return range.low + swing(hour);
}
const swing = (h: number) => charts.sine(h) * charts.reach;
let first = () => 1, second = 2;
export abstract class Gauge<T extends { unit: string }> extends Device<T> {
  zero = level(0, fallback);
  static async read(at: T): Promise<{ value: number }> { return alarm(this.raw(at).trim()); }
  raw(at) { return new Probe(at); }
}
export default class extends Gauge { idle() { rest(); } }
function pick<K extends { key: string }>(x: K) { return level(1, x); }
alarm("loaded");
""",
    "src/tide.test.ts": """import { level } from "./tide";
describe("level", () => {
  const at = level(3);
  it("rises", () => { expect(level(6)).toBe(2); level(7); });
  describe("at night", () => {
    test.only('falls', async () => { await level(18); });
    it(`drops ${level(1)}`, () => {});
  });
  it.each([[1, 2]])("moves %i", (a) => { shift(a); });
});
test("alone", helper);
""",
}
GO = {
    "dock/dock.go": """package dock

import (
	"testing"
	ropes "example.org/port/rope"
	"example.org/port/crane"
)

var spare = Count(crane.Limit)

func init() { warm() }

// Count counts berths.
func Count(n int) int { return n + ropes.Knots }

func (d *Dock[T]) Load(box Box) error { d.lift(box); return crane.Hoist(box) }

func Map[K comparable](in map[K]int) (out []K, err error) {
	return collect(in), nil
}
""",
    "dock/dock_test.go": """package dock

import "testing"

func TestCount(t *testing.T) {
	t.Run("empty", func(u *testing.T) {
		Count(0)
		u.Run("deep", func(t *testing.T) { Count(1) })
	})
	for _, c := range cases {
		t.Run(c.name, func(t *testing.T) { c.check() })
		t.Run(c.other, func(t *testing.T) { Load(c) })
	}
}

func BenchmarkLoad(b *testing.B) { Count(9) }
func ExampleDock() {}
func TestHelper(n int) {}
func Testing(t *testing.T) {}
""",
}
RUST = {
    "src/lib.rs": """mod buoy;
use crate::chart::{depth, mark as flag};
use std::fmt::*;

pub const DEEP: u32 = depth(7);

/// A light.
pub struct Lamp<T> { power: T }

pub trait Signal { fn flash(&self) -> u8; fn dim(&self) -> u8 { soften(1) } }

impl<T: Clone> Signal for Lamp<T> where T: Fn(u8) -> u8 {
    fn flash(&self) -> u8 { self.power.burn(flag::BRIGHT) }
}

macro_rules! twice { ($e:expr) => { depth($e); lost(1) }; }

pub fn sweep(l: &Lamp<u8>) -> Option<u8> {
    let Some(x) = Lamp::light::<u8>(l) else { return None };
    match x { 0 => None, n if dark(n) => Some(depth), _ => format!("{}",tone(inner(x))).len() }
}

#[cfg(test)]
mod checks {
    use super::*;
    mod night {
        #[tokio::test]
        async fn glows() { assert_eq!(sweep(&lamp()), x.y()); }
    }
    #[rstest]
    #[case(1)]
    fn turns(n: u8) { sweep(n); }
    fn lamp() -> u8 { DEEP }
}
""",
}
TREES = {"ts": TS, "go": GO, "rust": RUST}

#: (path, place in the file, name, kind, test id, computed, parent, first line, has a body hash), read off the sources by hand.
DEFS = [
    ("src/tide.ts", 0, "<module>", "ModuleInit", None, False, None, 1, False),
    ("src/tide.ts", 1, "level", "Function", None, False, None, 5, True),
    ("src/tide.ts", 2, "swing", "Function", None, False, None, 8, False),
    ("src/tide.ts", 3, "first", "Function", None, False, None, 9, False),
    ("src/tide.ts", 4, "Gauge", "Class", None, False, None, 10, True),
    ("src/tide.ts", 5, "read", "Method", None, False, 4, 12, True),
    ("src/tide.ts", 6, "raw", "Method", None, False, 4, 13, True),
    ("src/tide.ts", 7, "pick", "Function", None, False, None, 16, True),
    ("src/tide.test.ts", 0, "<module>", "ModuleInit", None, False, None, 1, False),
    ("src/tide.test.ts", 1, "rises", "TestCase", "level|rises", False, None, 4, False),
    ("src/tide.test.ts", 2, "falls", "TestCase", "level|at night|falls", False, None, 6, False),
    ("src/tide.test.ts", 3, "<computed>", "TestCase", "level|at night", True, None, 7, False),
    ("src/tide.test.ts", 4, "<computed>", "TestCase", "level", True, None, 9, False),
    ("src/tide.test.ts", 5, "alone", "TestCase", "alone", False, None, 11, False),
    ("dock/dock.go", 0, "<module>", "ModuleInit", None, False, None, 1, False),
    ("dock/dock.go", 1, "Count", "Function", None, False, None, 14, True),
    ("dock/dock.go", 2, "Dock.Load", "Method", None, False, None, 16, True),
    ("dock/dock.go", 3, "Map", "Function", None, False, None, 18, True),
    ("dock/dock_test.go", 0, "<module>", "ModuleInit", None, False, None, 1, False),
    ("dock/dock_test.go", 1, "TestCount", "TestCase", "TestCount", False, None, 5, True),
    ("dock/dock_test.go", 2, "empty", "TestCase", "TestCount|empty", False, 1, 6, False),
    ("dock/dock_test.go", 3, "deep", "TestCase", "TestCount|empty|deep", False, 2, 8, False),
    ("dock/dock_test.go", 4, "<computed>", "TestCase", "TestCount|<computed>", True, 1, 11, False),
    ("dock/dock_test.go", 5, "BenchmarkLoad", "TestCase", "BenchmarkLoad", False, None, 16, True),
    ("dock/dock_test.go", 6, "ExampleDock", "TestCase", "ExampleDock", False, None, 17, True),
    ("dock/dock_test.go", 7, "TestHelper", "Function", None, False, None, 18, True),
    ("dock/dock_test.go", 8, "Testing", "Function", None, False, None, 19, True),
    ("src/lib.rs", 0, "<module>", "ModuleInit", None, False, None, 1, False),
    ("src/lib.rs", 1, "Lamp", "Class", None, False, None, 8, True),
    ("src/lib.rs", 2, "Signal", "Class", None, False, None, 10, True),
    ("src/lib.rs", 3, "Lamp.flash", "Method", None, False, None, 13, True),
    ("src/lib.rs", 4, "sweep", "Function", None, False, None, 18, True),
    ("src/lib.rs", 5, "glows", "TestCase", "checks|night|glows", False, None, 28, True),
    ("src/lib.rs", 6, "turns", "TestCase", "checks|turns", False, None, 32, True),
    ("src/lib.rs", 7, "lamp", "Function", None, False, None, 33, True),
]
#: (path, raw text, line)
IMPORTS = [
    ("src/tide.ts", "./bell", 1),
    ("src/tide.ts", "../charts/index.js", 2),
    ("src/tide.ts", "./quay", 3),
    ("src/tide.test.ts", "./tide", 1),
    ("dock/dock.go", "testing", 4),
    ("dock/dock.go", "example.org/port/rope", 5),
    ("dock/dock.go", "example.org/port/crane", 6),
    ("dock/dock_test.go", "testing", 3),
    ("src/lib.rs", "mod buoy", 1),
    ("src/lib.rs", "use crate::chart::{depth, mark as flag}", 2),
    ("src/lib.rs", "use std::fmt::*", 3),
    ("src/lib.rs", "use super::*", 25),
]
#: (path, definition's place, kind, name, qualifier)
REFS = [
    ("src/tide.ts", 0, "call", "alarm", None),
    ("src/tide.ts", 0, "read", "Gauge", None),
    ("src/tide.ts", 0, "call", "rest", None),
    ("src/tide.ts", 1, "call", "swing", None),
    ("src/tide.ts", 2, "call", "sine", "charts"),
    ("src/tide.ts", 2, "read", "reach", "charts"),
    ("src/tide.ts", 4, "call", "level", None),
    ("src/tide.ts", 4, "read", "fallback", None),
    ("src/tide.ts", 5, "call", "alarm", None),
    ("src/tide.ts", 5, "call", "trim", "this.raw(at)"),
    ("src/tide.ts", 5, "call", "raw", "this"),
    ("src/tide.ts", 6, "call", "Probe", None),
    ("src/tide.ts", 7, "call", "level", None),
    ("src/tide.test.ts", 0, "call", "level", None),
    ("src/tide.test.ts", 1, "call", "toBe", "expect(level(6))"),
    ("src/tide.test.ts", 1, "call", "expect", None),
    ("src/tide.test.ts", 1, "call", "level", None),
    ("src/tide.test.ts", 2, "call", "level", None),
    ("src/tide.test.ts", 3, "call", "level", None),
    ("src/tide.test.ts", 4, "call", "shift", None),
    ("dock/dock.go", 0, "call", "Count", None),
    ("dock/dock.go", 0, "read", "Limit", "crane"),
    ("dock/dock.go", 0, "call", "warm", None),
    ("dock/dock.go", 1, "read", "Knots", "ropes"),
    ("dock/dock.go", 2, "call", "lift", "d"),
    ("dock/dock.go", 2, "call", "Hoist", "crane"),
    ("dock/dock.go", 3, "call", "collect", None),
    ("dock/dock_test.go", 2, "call", "Count", None),
    ("dock/dock_test.go", 3, "call", "Count", None),
    ("dock/dock_test.go", 4, "call", "check", "c"),
    ("dock/dock_test.go", 1, "call", "Load", None),
    ("dock/dock_test.go", 5, "call", "Count", None),
    ("src/lib.rs", 0, "call", "depth", None),
    ("src/lib.rs", 0, "call", "soften", None),
    ("src/lib.rs", 0, "read", "depth", None),
    ("src/lib.rs", 0, "read", "flag", None),
    ("src/lib.rs", 3, "call", "burn", "self.power"),
    ("src/lib.rs", 3, "read", "BRIGHT", "flag"),
    ("src/lib.rs", 4, "read", "light", "Lamp"),
    ("src/lib.rs", 4, "call", "dark", None),
    ("src/lib.rs", 4, "call", "Some", None),
    ("src/lib.rs", 4, "read", "depth", None),
    ("src/lib.rs", 4, "call", "len", 'format!("{}",tone(inner(x)))'),
    ("src/lib.rs", 4, "call", "tone", None),
    ("src/lib.rs", 4, "call", "inner", None),
    ("src/lib.rs", 5, "call", "sweep", None),
    ("src/lib.rs", 5, "call", "lamp", None),
    ("src/lib.rs", 5, "call", "y", None),
    ("src/lib.rs", 6, "call", "sweep", None),
]
#: (language, importing path, raw text, where it leads): among TREE_PATHS, with the Go module example.org/port.
TREE_PATHS = ["src/tide.ts", "src/bell.tsx", "charts/index.ts", "src/quay/index.ts", "rope", "crane", "src/lib.rs", "src/buoy/mod.rs", "src/chart.rs", "src/a/mod.rs", "src/a/b.rs", "tests/all.rs"]
TARGETS = [
    ("ts", "src/tide.ts", "./bell", "src/bell.tsx"),
    ("ts", "src/tide.ts", "../charts/index.js", "charts/index.ts"),
    ("ts", "src/tide.ts", "./quay", "src/quay/index.ts"),
    ("ts", "src/tide.test.ts", "./tide", "src/tide.ts"),
    ("ts", "src/tide.ts", "../../out", None),
    ("ts", "src/tide.ts", "lodash", None),
    ("go", "dock/dock.go", "example.org/port/rope", "rope"),
    ("go", "dock/dock.go", "example.org/portal/rope", None),
    ("go", "dock/dock.go", "testing", None),
    ("rust", "src/lib.rs", "mod buoy", "src/buoy/mod.rs"),
    ("rust", "src/lib.rs", "use crate::chart::{depth, mark as flag}", "src/chart.rs"),
    ("rust", "src/a/mod.rs", "mod b", "src/a/b.rs"),
    ("rust", "src/a/b.rs", "use crate::chart::depth", "src/chart.rs"),
    ("rust", "src/a/b.rs", "use std::fmt::*", None),
    ("rust", "tests/all.rs", "use crate::chart::depth", None),
]

#: Edits of a source and whether they show in a definition's signature or body: (language, source, old text, new text, changes by name).
EDITS = [
    ("ts", "src/tide.ts", "// the height of the water", "/* depth */", ""),
    ("ts", "src/tide.ts", "range.low + swing(hour)", "range.low  +\n swing(hour)", ""),
    ("ts", "src/tide.ts", "range.low + swing", "range.low - swing", "level body"),
    ("ts", "src/tide.ts", "hour: number, range", "hours: number, range", "level signature"),
    ("ts", "src/tide.ts", "charts.sine(h)", "charts.cosine(h)", "swing signature"),
    ("ts", "src/tide.ts", 'alarm("loaded")', 'alarm("ready")', "<module> signature"),
    ("ts", "src/tide.ts", 'from "./bell"', 'from "./horn"', ""),
    ("go", "dock/dock.go", "// Count counts berths.", "", ""),
    ("go", "dock/dock.go", "n + ropes.Knots", "n * ropes.Knots", "Count body"),
    ("go", "dock/dock.go", "warm()", "cool()", "<module> signature"),
    ("go", "dock/dock.go", "collect(in), nil", "collect(in), err", "Map body"),
    ("rust", "src/lib.rs", "/// A light.", "/* a /* nested */ lamp */", ""),
    ("rust", "src/lib.rs", "flag::BRIGHT", "flag::FAINT", "Lamp.flash body"),
    ("rust", "src/lib.rs", "depth(7)", "depth(8)", "<module> signature"),
    ("rust", "src/lib.rs", "power: T", "power: u8", "Lamp body"),
]
#: Name-status output of a listing, and the changes that it states.
STATUS = "M\0src/a.ts\0A\0b/c d.go\0D\0old.rs\0R087\0from.ts\0to.ts\0C100\0one.go\0two.go\0T\0link.ts\0"
CHANGES = [("src/a.ts", "Modified", None), ("b/c d.go", "Added", None), ("old.rs", "Deleted", None), ("to.ts", "Renamed", "from.ts"), ("two.go", "Added", None), ("link.ts", "Modified", None)]
#: A tree of files, and those that are indexed, with `ignore = ["**/skip_*"]` in the settings.
FILES = {".gitignore": "made/\n", "impactgraph.toml": 'ignore = ["**/skip_*"]\nalways-run = ["x/*"]\n', "z.ts": "", "a-b.go": "", "a/b.rs": "", "a/skip_me.ts": "", "made/x.ts": "", "node_modules/m.ts": "", "a/vendor/v.go": "", ".hidden/h.ts": "", "a/.h.ts": "", "a/UP.TSX": "", "notes.txt": "", "a/target/t.rs": "", "m.mts": "", "noext": ""}
INDEXED = [("a/UP.TSX", "ts"), ("a/b.rs", "rust"), ("a-b.go", "go"), ("m.mts", "ts"), ("z.ts", "ts")]

PORT = {
    ".gitignore": ".impactgraph/\n",
    "go.mod": "module example.org/port\n",
    "src/tide.ts": "export function level(h) {\n  return h + 1;\n}\nexport function range(a) {\n  return level(a) - level(0);\n}\nexport function still() {\n  return 0;\n}\n",
    "src/tide.test.ts": 'import { level, range, still } from "./tide";\ndescribe("tide", () => {\n  it("rises", () => { expect(level(1)).toBe(2); });\n  it("spans", () => { range(2); });\n  it("rests", () => { still(); });\n});\n',
    "src/other.test.ts": 'test("apart", () => { quiet(); });\n',
    "dock/dock.go": "package dock\n\nfunc Berths(n int) int { return n }\n",
    "dock/more.go": "package dock\n\nfunc Twice(n int) int { return Berths(n) + Berths(n) }\n",
    "dock/dock_test.go": 'package dock\n\nimport "testing"\n\nfunc TestTwice(t *testing.T) {\n\tt.Run("one", func(t *testing.T) { Twice(1) })\n}\n',
    "gate/gate.go": 'package gate\n\nimport "example.org/port/dock"\n\nfunc Open() int { return dock.Berths(2) }\n',
    "gate/gate_test.go": 'package gate\n\nimport "testing"\n\nfunc TestOpen(t *testing.T) { Open() }\n',
}
#: Steps over the port: edits of the working tree (None deletes; each step starts from the commit), the command, its exit code, and its lines.
STEPS = [
    ({}, ["index"], 0, ['{"version":1,"files":8,"defs":21,"tests":7,"parsed":8,"reused":0,"calls":11,"reads":0,"unresolved":3}']),
    ({"src/tide.ts": ("return h + 1", "return 1 + h")}, ["select", "--from", "HEAD", "--format", "text"], 0, ["src/tide.test.ts :: tide > rises", "src/tide.test.ts :: tide > spans"]),
    ({"src/tide.ts": ("return h + 1", "return 1 + h")}, ["why", "spans", "--from", "HEAD", "--format", "text"], 0, ["changed level (src/tide.ts)", "  called by range (src/tide.ts)", '  = test "tide > spans" (src/tide.test.ts)']),
    ({"src/tide.ts": ("return h + 1;", "return h + 1; // one")}, ["changes", "--from", "HEAD", "--format", "text"], 0, ["no impacted defs"]),
    ({"dock/dock.go": None}, ["changes", "--from", "HEAD"], 0, ['{"version":1,"mode":"selection","seeds":[{"def":"<module>","file":"dock/dock_test.go","kind":"module_init"},{"def":"<module>","file":"dock/more.go","kind":"module_init"},{"def":"<module>","file":"gate/gate.go","kind":"module_init"}],"stats":{"changed_files":1,"seeds":3}}']),
    ({"dock/dock.go": ("return n", "return 1 * n")}, ["select", "--from", "HEAD", "--format", "args"], 0, ["go test ./dock -run '^TestTwice$'", "go test ./dock -run '^TestTwice$/^one$'", "go test ./gate -run '^TestOpen$'"]),
    ({"go.mod": ("port", "harbour"), "src/tide.ts": ("return h + 1", "return 1 + h")}, ["select", "--from", "HEAD"], 2, ['{"version":1,"mode":"run_all","reason":"config file changed: go.mod"}']),
    ({"src/tide.ts": ("still()", "calm()")}, ["changes", "--from", "HEAD", "--format", "text"], 0, ["src/tide.ts :: calm [added]", "src/tide.ts :: <module> [module_init]"]),
    ({"src/ebb.test.ts": 'test("ebbs", () => {});\n'}, ["changes", "--from", "HEAD", "--format", "text"], 0, ["src/ebb.test.ts :: ebbs [added]", "src/ebb.test.ts :: <module> [added]"]),
    ({}, ["why", "apart", "--from", "HEAD"], 1, ['{"version":1,"mode":"not_selected","query":"apart"}']),
    ({}, ["select", "--from", "nowhere", "--to", "HEAD"], 2, None),
]
