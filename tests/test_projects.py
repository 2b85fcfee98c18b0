"""Projects under a budget: broken, oversized, tiny, slow and good ones give one status each."""

import json
import time

import pytest
from graphspan.sources import projects

GOOD = {"name": "a.ts", "stmts": [{"category": "CommentStmt", "text": "x"}]}


def test_statuses_of_a_folder(spark, tmp_path, monkeypatch):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("good/src/a.json", json.dumps(GOOD, indent=1))
    put("good/src/deep/b.json", json.dumps(GOOD | {"name": "deep/b.ts"}, indent=1))
    put("good/node_modules/c.json", "not read")
    put("good/notes.txt", "not read")
    put("broken/a.json", json.dumps(GOOD, indent=1))
    put("broken/b.json", '{"name": "b.ts",\n "stmts": [{"category": "NoSuch"}]\n\n}')
    put("wrong/a.json", "{{{\n\n\n\n")
    put("large/a.json", json.dumps(GOOD) + "\n" * 500)
    put("tiny/a.json", "{}")
    # numbers nested so deep that taking them apart takes seconds
    put("slow/a.json", '{"name": "s.ts",\n\n\n "stmts": [' + ", ".join(['{"category": "ExprStmt", "expr": ' + '{"category": "FuncCall", "mark": "missing", "f": {"category": "Var", "name": "f", "mark": "missing"}, "args": [' * 60 + "]}" * 60 + "}"] * 20_000) + "]}")
    files = projects.project_files(spark, str(tmp_path), skip=["/node_modules/"])
    assert {r.project for r in files.select("project").collect()} == {"good", "broken", "wrong", "large", "tiny", "slow"}
    rows = projects.parse_projects(files, most_lines=400, least_lines=3, seconds=0.5)
    found = rows.collect()
    status = {r.project: r for r in projects.statuses(rows).collect()}
    assert {k: r.status for k, r in status.items()} == {"good": "ok", "broken": "error", "wrong": "error", "large": "too_big", "tiny": "too_small", "slow": "timeout"}
    assert status["good"].modules == 2 and status["good"].nodes == 4 and status["large"].lines == 501
    assert "b.json" in status["broken"].reason and "NoSuch" in status["broken"].reason and "0.5 s" in status["slow"].reason
    assert {r.project for r in found if r.kind != projects.STATUS} == {"good"} and sum(r.kind != projects.STATUS for r in found) == 4


def test_no_budget_and_no_files(spark):
    files = spark.createDataFrame([("p", "a", json.dumps(GOOD)), (None, "b", json.dumps(GOOD)), ("empty", "c", None)], "project string, path string, text string")
    got = {r.project: r.status for r in projects.statuses(projects.parse_projects(files)).collect()}
    assert got == {"p": "ok", None: "ok", "empty": "error"}
    assert projects.parse_projects(files.limit(0)).count() == 0


def test_time_limits():
    with projects.limit_time(5.0):
        pass
    began = time.monotonic()
    with pytest.raises(TimeoutError), projects.limit_time(0.1):
        while True:
            sum(range(1000))
    assert time.monotonic() - began < 4
    with projects.limit_time(None):
        time.sleep(0.01)
