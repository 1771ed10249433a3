import json
import os
import subprocess

import pytest

from docweave import cli
from docweave.api import Api
from docweave.sources.files import GraphStore
from test_index import A, DOC, LOG


def test_commands(spark, tmp_path, capsys, monkeypatch):
    root = str(tmp_path / "repo")
    os.makedirs(f"{root}/src")
    os.makedirs(f"{root}/docs")
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, text in (("src/a.ts", A), ("src/log.ts", LOG), ("docs/a.md", DOC)):
        open(f"{root}/{name}", "w").write(text)
    run("add", "-A")
    run("commit", "-qm", "one")
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["index", root]) == 0 and cli.main(["graph", root]) == 0
    open(f"{root}/src/a.ts", "w").write(A.replace("this.check()", "this.check(1)"))
    out = str(tmp_path / "report.md")
    assert cli.main(["report", root, "--base", "HEAD", "--out", out]) == 0
    text = open(out).read()
    assert "- Documentation findings: 3 (REVIEW: 3)" in text and "| modified | src/a.ts |" in text
    assert "### [REVIEW] docs/a.md — Tokens" in text and "Unresolved annotation in `docs/a.md`: `src/a.ts#Nope`" in text
    assert cli.main(["report", root, "--base", "HEAD", "--format", "annotations"]) == 0
    assert "::warning file=docs/a.md,line=3" in capsys.readouterr().out
    assert cli.main(["analyze", root, "--base", "HEAD"]) == 0
    assert "`Auth.refresh` changed in src/a.ts" in capsys.readouterr().out
    capsys.readouterr()
    assert cli.main(["index", root]) == 0
    assert "files_unchanged: 3" in capsys.readouterr().out

    # what the command line wrote is what the service reads
    api = Api.open(GraphStore(spark, f"{root}/.docweave/graph"))
    (own,) = api.repositories().collect()
    assert (own.repository_root, own.file_count) == (root, 3) and own.node_count > 8 and own.current_revision
    assert [r.path for r in api.files_of(own.id).collect()] == ["docs/a.md", "src/a.ts", "src/log.ts"]
    found = {r.name: r.node_id for r in api.search(own.id, "e").collect()}
    assert [r.node_id for r in api.path(own.id, found["refresh"], found["Tokens"]).collect()] == [found["refresh"], found["Tokens"]]
    assert len(api.node(own.id, found["refresh"]).first().out_edges) == 2 and api.graph(own.id)["nodes"].count() == own.node_count

    assert cli.main(["impact", root, "--base", "HEAD"]) == 0
    shown = capsys.readouterr().out
    assert "Documentation impact findings: 3" in shown and "  Path:      refresh -> Auth -> Classes" in shown
    assert cli.main(["report", root, "--base", "HEAD", "--format", "json", "--provider", "offline", "--out", out]) == 0
    whole = json.loads(open(out).read())
    assert whole["summary"]["findingsByAction"] == {"REVIEW": 3} and len(whole["findings"]) == 3 and whole["repositoryRoot"] == root
    assert {p["valid"] for p in whole["proposedPatches"]} == {True} and whole["unresolved"]["annotations"][0]["target"] == "src/a.ts#Nope"

    with pytest.raises(ValueError):
        cli.main(["generate", root, "--base", "HEAD", "--apply"])
    with pytest.raises(ValueError):
        cli.main(["generate", root, "--base", "HEAD", "--provider", "nobody"])
    assert cli.main(["generate", root, "--base", "HEAD"]) == 0
    assert open(f"{root}/docs/a.md").read() == DOC and "Validation: valid" in capsys.readouterr().out
    assert cli.main(["generate", root, "--base", "HEAD", "--apply", "--yes"]) == 0
    shown, now = capsys.readouterr().out, open(f"{root}/docs/a.md").read()
    # two patches of one section: the second is stale once the first is in
    assert shown.count("\nApplied: ") + shown.startswith("Applied: ") == 2 and shown.count("Not applied: docs/a.md — Classes") == 1
    assert now.count("> **Note:**") == 2 and now.startswith("intro\n\n# Tokens\n")
