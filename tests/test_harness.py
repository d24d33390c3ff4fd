"""Verdicts on shell commands and on runners' summaries."""

import json

import pytest

from spanledger.functions import harness as h


@pytest.mark.parametrize("command,want", [
    (None, "no_runner"), ("ls -la", "no_runner"), ("echo cargo test", "no_runner"), ("cargo test", "observable:both"), ("cargo test && git push", "observable:success"), ("cd x && pytest -q", "observable:success"), ("cd x; pytest", "observable:both"),
    ("pytest | tail", "withheld:pipe"), ("pytest || true", "withheld:or_after"), ("pytest; echo done", "withheld:sequence"), ("pytest &", "withheld:background"), ("build || pytest", "withheld:after_or"), ("x=$(pytest)", "no_runner"), ("pytest $(ls)", "withheld:substitution"),
    ("cat <<EOF > f\npytest\nEOF", "no_runner"), ("cat <<EOF > f\nx\nEOF\npytest", "withheld:substitution"), ("FOO=1 timeout 60 npx vitest run", "observable:both"), ("npm run test:unit", "observable:both"), ("npm run build", "no_runner"),
    ("(cd a && go test ./...)", "observable:success"), ("pytest 2>&1", "observable:both"), ("just check", "observable:both"), ("pytest -q && pytest -x", "observable:success"),
])
def test_verdict(command, want):
    assert h.verdict(command) == want


@pytest.mark.parametrize("command,output,want", [
    ("cargo test | tail", "test result: ok. 2 passed", True), ("cargo test | tail", "test result: ok.\ntest result: FAILED. 1", False), ("cargo test | tail", "test a::b ... FAILED", False), ("cargo test", "error: 2 targets failed:", False), ("cargo test", "nothing", None),
    ("pytest | tail", "==== 3 passed in 0.10s ====", True), ("pytest", "1 failed, 3 passed in 0.10s", False), ("pytest", "3 passed, 1 warning in 0.1s", True), ("pytest", "2 passed, 1 error in 0.1s", False), ("pytest", "FAILED a.py::b - x", False), ("pytest", "no tests ran in 0.01s", None),
    ("go test ./...", "ok  \tpkg\t0.1s", True), ("go test ./...", "ok  \tpkg\t0.1s\nFAIL", False), ("deno test", "\x1b[32mok | 1 passed | 0 failed (1ms)\x1b[0m", True), ("make test", "FAILED | 1 passed | 1 failed", False),
    ("pytest | head -3", "1 passed in 0.1s", None), ("pytest | head -50", "1 passed in 0.1s", True), ("pytest | head", "\n" * 3 + "1 passed in 0.1s", True), ("pytest | head -c 10", "1 passed in 0.1s", None), ("pytest | grep ' passed in'", "1 passed in 0.1s", None), ("grep x", "test result: ok.", None), ("jest", "1 passed in 0.1s", None),
])
def test_summary(command, output, want):
    assert h.summary_verdict(command, output) is want


def test_observe(spark):
    def hook(event, command, **more):
        return (json.dumps({"hook_event_name": event, "tool_name": "Bash", "tool_input": {"command": command}, "session_id": "s", "tool_use_id": command, **more}),)

    rows = [
        hook("PostToolUse", "pytest"), hook("PostToolUseFailure", "cargo test"), hook("PostToolUseFailure", "cd a && go test"), hook("PostToolUse", "pytest | tail", tool_response={"stdout": "1 failed in 0.1s"}), hook("PostToolUse", "ls"),
        hook("PostToolUse", "tox", tool_response={"interrupted": True}), hook("PreToolUse", "jest"), (None,), ("{",),
    ]
    got = {r["tool_use_id"]: r["passed"] for r in h.observe(spark.createDataFrame(rows, "payload string")).collect()}
    assert got == {"pytest": True, "cargo test": False, "cd a && go test": None, "pytest | tail": False}
