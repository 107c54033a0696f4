"""A small port's repository end to end: changes, selection, explanation."""

import io
import json
import subprocess

import pytest

from impactgraph import cli
from impactgraph.plans import samples as S
from impactgraph.sources import repo as R


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def commit(repo, files, message="change"):
    for path, text in files.items():
        target = repo / path
        if text is None:
            target.unlink()
        else:
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(text)
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", message)


@pytest.fixture
def port(tmp_path):
    git(tmp_path, "init", "-q")
    commit(tmp_path, {**S.PORT, ".gitignore": ".impactgraph/\nmade/\n", "made/x.ts": "export function gone() {}\n"})
    return tmp_path


def run(spark, repo, *args):
    out, err = io.StringIO(), io.StringIO()
    code = cli.run(spark, ["--root", str(repo), *args], out, err)
    text = out.getvalue()
    return code, json.loads(text) if text.startswith("{") else text, err.getvalue()


def edit(repo, path, old, new):
    source = (repo / path).read_text()
    assert old in source
    (repo / path).write_text(source.replace(old, new))


def test_steps_over_git(spark):
    from impactgraph.plans import queries as Q

    got = sorted(tuple(r) for r in Q.QUERIES["commands_over_git"](spark, "").collect())
    want = sorted((i, code, n, line) for i, (_, _, code, lines) in enumerate(S.STEPS) for n, line in enumerate([""] if lines is None else lines))
    assert got == want


def test_selection_and_explanation_as_json(spark, port):
    edit(port, "src/tide.ts", "return h + 1", "return 1 + h")
    code, out, _ = run(spark, port, "select", "--from", "HEAD")
    assert code == 0 and [t["name"] for t in out["tests"]] == [["tide", "rises"], ["tide", "spans"]] and list(out["tests"][0]) == ["file", "name", "runner", "lang", "computed"]
    assert out["stats"] == {"total_known": 7, "selected": 2, "seeds": 1, "changed_files": 1}
    code, out, _ = run(spark, port, "why", "spans", "--from", "HEAD")
    assert code == 0 and [h["edge"] for h in out["path"]] == ["calls", "calls"] and out["path"][0]["from"]["name"] == "level"
    code, out, _ = run(spark, port, "why", "tide", "--from", "HEAD")
    assert code == 1 and out["mode"] == "ambiguous" and len(out["candidates"]) == 2
    code, out, _ = run(spark, port, "select", "--from", "HEAD", "--format", "args")
    assert out.splitlines() == ["vitest run src/tide.test.ts -t 'tide > rises'", "vitest run src/tide.test.ts -t 'tide > spans'"]


def test_reasons_to_run_everything_come_in_change_order(spark, port):
    git(port, "mv", "go.mod", "mod.txt")
    code, out, _ = run(spark, port, "changes", "--from", "HEAD")
    assert code == 2 and out["reason"] == "config file changed: go.mod"
    git(port, "reset", "-q", "--hard")
    commit(port, {"a.ts": "export const a = 1;\n", "zz.ts": "x();\n"})
    (port / "a.ts").unlink()
    (port / "zz.ts").write_bytes(b"y();\n")
    code, out, _ = run(spark, port, "changes", "--from", "HEAD")  # a.ts has a needle, its stem has none
    assert code == 0
    commit(port, {"b/q.go": "package q\n", "c.rs": "fn c() {}\n"})
    (port / "c.rs").unlink()
    (port / "b/q.go").unlink()
    code, out, _ = run(spark, port, "changes", "--from", "HEAD")
    assert code == 0 and out["seeds"] == []
    assert run(spark, port, "changes", "--from", "nowhere")[0] == 2


def test_old_sources_that_cannot_be_read(spark, port):
    (port / "src/bad.ts").write_bytes(b"\xff\xfe")
    git(port, "add", "-A")
    git(port, "commit", "-qm", "bad")
    (port / "src/bad.ts").write_text("good();\n")
    code, out, _ = run(spark, port, "changes", "--from", "HEAD")
    assert code == 2 and out["reason"].startswith("src/bad.ts: ")


def test_always_run_ignore_and_ranges(spark, port):
    commit(port, {"impactgraph.toml": 'always-run = ["src/other*"]\nignore = ["**/tide.test.ts"]\n'})
    code, out, _ = run(spark, port, "select", "--from", "HEAD")
    assert code == 0 and [t["name"] for t in out["tests"]] == [["apart"]] and out["stats"]["total_known"] == 4
    source = S.PORT["src/tide.ts"]
    commit(port, {"src/tide.ts": source.replace("return 0", "return 1"), "impactgraph.toml": None})
    commit(port, {"src/tide.ts": source})
    code, out, _ = run(spark, port, "select", "--from", "HEAD~2", "--to", "HEAD~1")
    assert code == 0 and [t["name"] for t in out["tests"]] == [["tide", "rests"]]
    (port / "impactgraph.toml").write_text("ignore = 3")
    assert run(spark, port, "index")[0] == 1


def test_incremental_index_and_stats(spark, port):
    code, first, _ = run(spark, port, "index")
    assert code == 0 and (first["files"], first["tests"], first["parsed"], first["reused"]) == (8, 7, 8, 0)
    edit(port, "src/tide.ts", "export function still", "export function surge() {}\nexport function still")
    code, again, _ = run(spark, port, "index")
    assert (again["parsed"], again["reused"], again["defs"]) == (1, 7, first["defs"] + 1)
    assert run(spark, port, "stats")[1]["defs"] == again["defs"]
    assert sorted(p.name for p in (port / ".impactgraph").iterdir()) == ["extractions-v1"]


def test_data_files_and_deletions_reach_importers(spark, port):
    commit(port, {"src/lamp.ts": 'import book from "./signals";\nimport { still } from "./tide";\nexport const lit = () => still(book);\n', "src/lamp.test.ts": 'import { lit } from "./lamp";\ntest("shines", () => { lit(); });\n', "src/signals.json": "{}"})
    (port / "src/signals.json").write_text('{"x": 1}')
    code, out, _ = run(spark, port, "changes", "--from", "HEAD")
    assert out["seeds"] == [{"def": "<module>", "file": "src/lamp.ts", "kind": "module_init"}]
    git(port, "checkout", "-q", "src/signals.json")
    (port / "src/tide.ts").unlink()
    code, out, _ = run(spark, port, "select", "--from", "HEAD")
    assert code == 0 and ["shines"] in [t["name"] for t in out["tests"]]


def test_a_deleted_go_file_reaches_all_files_of_its_directory(spark, port):
    commit(port, {"dock/paint.ts": "export const red = 1;\n", "pkg.v2/only.go": "package v2\n\nfunc Only() {}\n", "yard/yard.go": 'package yard\n\nimport "example.org/port/pkg"\n\nfunc Yard() {}\n'})
    (port / "dock/dock.go").unlink()
    (port / "pkg.v2/only.go").unlink()
    code, out, _ = run(spark, port, "changes", "--from", "HEAD")
    assert [(s["file"], s["kind"]) for s in out["seeds"]] == [(f, "module_init") for f in ("dock/dock_test.go", "dock/more.go", "dock/paint.ts", "gate/gate.go", "yard/yard.go")]


def test_files_at_a_revision(port):
    found = R.show_files(str(port), "HEAD", ["src/tide.ts", "nothing.ts", "go.mod", "src/tide.ts"])
    assert found == {"src/tide.ts": S.PORT["src/tide.ts"].encode(), "nothing.ts": None, "go.mod": S.PORT["go.mod"].encode()}
    with pytest.raises(R.GitError):
        R.show_files(str(port), "nowhere", ["go.mod"])
