"""What a recorded shell command says about the tests it ran: by its exit status, or by the runner's own summary.

A command is read as a sequence of symbols (test runs, other commands, operators) by a small automaton; a summary is
searched for the lines by which runners tell their result. The pandas UDFs below apply both to columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Test runners by the words that begin their command; a trailing * matches any ending.
RUNNERS = [
    "cargo test", "cargo nextest run", "pytest", "py.test", "python -m pytest", "python3 -m pytest", "python -m unittest", "python3 -m unittest", "tox", "npm test", "npm t", "npm run test*", "pnpm test", "pnpm t", "pnpm run test*",
    "yarn test", "yarn run test*", "bun test", "bun run test*", "deno test", "vitest", "jest", "mocha", "go test", "gotestsum", "just test*", "just check", "make test*", "make check", "ctest", "meson test", "mix test", "rspec",
    "rake test", "rails test", "dotnet test", "swift test", "gradle test", "./gradlew test", "gradlew test", "mvn test", "./mvnw test", "sbt test", "phpunit", "vendor/bin/phpunit", "php artisan test", "composer test", "zig build test",
    "dart test", "flutter test",
]
# Commands that run what follows them; * is any one word.
WRAPPERS = ["env", "time", "nice", "timeout *", "npx", "pnpm exec", "pnpm dlx", "bunx", "uv run", "poetry run", "pipenv run", "hatch run", "pdm run", "bundle exec"]
# Whose summaries the output of a runner may hold; scripts and task runners may run anything.
SUMMARIES = {
    "cargo test": ["libtest"], "pytest": ["pytest"], "py.test": ["pytest"], "python -m pytest": ["pytest"], "python3 -m pytest": ["pytest"], "go test": ["go"], "deno test": ["deno"],
    **{name: ["libtest", "pytest", "go", "deno"] for name in ("make test*", "make check", "just test*", "just check", "npm test", "npm t", "npm run test*", "pnpm test", "pnpm t", "pnpm run test*", "yarn test", "yarn run test*", "bun run test*", "tox", "composer test", "rake test")},
}
# The lines by which runners tell that a run failed or passed.
FAILED = {
    "libtest": r"test result: FAILED\.|error: test failed|test .* \.\.\. FAILED$|error: \d+ targets? failed",
    "pytest": r"FAILED |ERROR |=*\s*(?:\d+ [a-z]+, )*\d+ (?:failed|errors?)\b(?:, \d+ [a-z]+)* in [\d.]+s\b",
    "go": r"FAIL$|FAIL\t|--- FAIL: ",
    "deno": r"FAILED \| |error: Test failed$",
}
PASSED = {"libtest": r"test result: ok\.", "pytest": r"=*\s*(?:\d+ [a-z]+, )*\d+ passed(?:, \d+ [a-z]+)* in [\d.]+s\b", "go": r"ok {0,2}\t", "deno": r"ok \| .* passed \| "}
# Texts in a command that pick passing lines out of the output, and the blank lines that tools trim from its end.
SELECTS_PASSES = ["result: ok", "ok |", " passed in"]
TRIMMED_BLANKS = 2

# --- reading a command ----------------------------------------------------------------------------------------


def _either(patterns: list[str]) -> str:
    return "|".join(re.escape(p).replace(r"\*", r"\S*").replace(r"\ ", " ") for p in patterns)


#: A simple command, its words one blank apart: what may stand before a runner, and the runner.
_RUN = re.compile(rf"(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|{_either(WRAPPERS)}) )*?(?:{'|'.join(f'(?P<r{i}>{_either([p])})' for i, p in enumerate(RUNNERS))})(?= |$)")
_TOKEN = re.compile(r"(?P<op>&&|\|\||\||;|\n|(?<![<>|])&(?!>))|(?P<text>(?:(?!&&|\||;|\n|(?<![<>|])&(?!>)).)+)", re.S)
_OPERATORS = {"&&": "and", "||": "or", "|": "pipe", "&": "background", ";": "sequence", "\n": "sequence"}
_HEREDOC = re.compile(r"^((?:(?!<<)[^\n])*<<(?!<)-*\s*['\"]*([A-Za-z0-9_]+)[^\n]*)\n(?:.*?^[^\S\n]*\2[^\S\n]*$|.*)", re.M | re.S)
_EXPANSIONS = ("$(", "`", "<<")


def runner(text: str) -> str | None:
    """The runner (of RUNNERS) that a simple command is, behind assignments and wrappers."""
    m = _RUN.match(" ".join(text.strip().lstrip("({").rstrip(")}").split()))
    return RUNNERS[int(m.lastgroup[1:])] if m else None


def symbols(command: str) -> Iterator[str]:
    """A command as symbols: a runner, `other` for any other text, and operators. Quotes aren't read."""
    for m in _TOKEN.finditer(command):
        yield _OPERATORS[m["op"]] if m["op"] else runner(m["text"]) or "other"


def without_heredocs(command: str) -> str:
    """The command without the lines of heredoc bodies; the lines that open them stay."""
    return _HEREDOC.sub(r"\1", command)


# The automaton. Before a run a state says what its start depends on: nothing (free), what came before it in its list (gated), that this
# failed (spare). Behind one it says what the status of the whole speaks for: the run alone (both), or the run and more (success).
RUN = "run"
STEPS = {
    ("free", "and"): "gated", ("free", "or"): "spare", ("free", "pipe"): "free", ("free", "background"): "free", ("free", "sequence"): "free", ("free", RUN): "both",
    ("gated", "and"): "gated", ("gated", "or"): "spare", ("gated", "pipe"): "gated", ("gated", "background"): "gated", ("gated", "sequence"): "free", ("gated", RUN): "success",
    ("spare", "and"): "gated", ("spare", "or"): "spare", ("spare", "pipe"): "gated", ("spare", "background"): "gated", ("spare", "sequence"): "free", ("spare", RUN): "withheld:after_or",
    **{(ran, op): to for ran in ("both", "success") for op, to in (("and", "success"), ("pipe", "withheld:pipe"), ("or", "withheld:or_after"), ("background", "withheld:background"), ("sequence", "withheld:sequence"))},
    ("both", RUN): "both", ("success", RUN): "success",
}
VERDICTS = {"free": "no_runner", "gated": "no_runner", "spare": "no_runner", "both": "observable:both", "success": "observable:success"}


def verdict(command: str | None) -> str:
    """no_runner, withheld:<reason>, or observable: both when either status is the runner's, success when only a zero is.

    What an expansion or a heredoc does to the status can't be told from the text.
    """
    text = command or ""
    if any(x in text for x in _EXPANSIONS):
        return "withheld:substitution" if any(x in RUNNERS for x in symbols(without_heredocs(text))) else "no_runner"
    state = "free"
    for symbol in symbols(text):
        if symbol != "other":
            state = STEPS[state, RUN if symbol in RUNNERS else symbol]
            if state not in VERDICTS:
                return state
    return VERDICTS[state]


# --- the runners' own summaries -------------------------------------------------------------------------------

_ANSI = re.compile(r"\x1b\[[^A-Za-z]*[A-Za-z]?")
_ENDS = re.compile(r"[^\S\n]+$", re.M)
_HEAD = re.compile(r"(?:^|[|;&\n])[^\S\n]*head(?P<how>(?:[^\S\n]+[^|;&\n]*)?)(?=$|[|;&\n])")
_HOW_MANY = re.compile(r"(?:(?:-n|--lines)[ =]?|-)?(\d+)(?:\s|$)")


def families(command: str) -> set[str]:
    """Whose summaries the output may hold: a runner's own, or any for scripts that may run anything."""
    return {family for x in symbols(without_heredocs(command)) for family in SUMMARIES.get(x, [])}


def _told(lines: dict[str, str], kinds: set[str], output: str) -> bool:
    return any(re.search(rf"^(?:{lines[k]})", output, re.M) for k in kinds)


def _whole(command: str, lines: int) -> bool:
    """Whether no `head` on the command's line can have cut the end off so many lines."""
    for m in _HEAD.finditer(command):
        how = " ".join(m["how"].split()[:2])
        number = _HOW_MANY.match(how) if how else None
        if (number is None and how) or lines + TRIMMED_BLANKS >= (int(number[1]) if number else 10):
            return False
    return True


def summary_verdict(command: str | None, output: str | None) -> bool | None:
    """What the runner's summary says: a failure is always believed, a pass only if the end of the output is there."""
    kinds = families(command or "")
    text = _ENDS.sub("", _ANSI.sub("", "\n".join((output or "").splitlines())))
    if _told(FAILED, kinds, text):
        return False
    if not _told(PASSED, kinds, text) or any(x in command for x in SELECTS_PASSES):
        return None
    return True if _whole(command, text.rstrip("\n").count("\n") + 1) else None


@F.pandas_udf(T.StringType())
def shell_verdict(command: pd.Series) -> pd.Series:
    return pd.Series([verdict(c if isinstance(c, str) else None) for c in command.tolist()], dtype=object)


@F.pandas_udf(T.BooleanType())
def runner_summary(command: pd.Series, output: pd.Series) -> pd.Series:
    text = lambda x: x if isinstance(x, str) else None
    return pd.Series([summary_verdict(text(c), text(o)) for c, o in zip(command.tolist(), output.tolist())], dtype=object)


HOOK = T.StructType([
    T.StructField("hook_event_name", T.StringType()), T.StructField("tool_name", T.StringType()), T.StructField("tool_input", T.StructType([T.StructField("command", T.StringType()), T.StructField("run_in_background", T.BooleanType())])),
    T.StructField("tool_response", T.StructType([T.StructField("stdout", T.StringType()), T.StructField("stderr", T.StringType()), T.StructField("interrupted", T.BooleanType())])), T.StructField("error", T.StringType()), T.StructField("is_interrupt", T.BooleanType()),
    *(T.StructField(c, T.StringType()) for c in ("session_id", "tool_use_id", "agent_type", "agent_id")),
])


def observe(payloads, column: str = "payload"):
    """Hook payloads with `verdict` and `passed`: the exit status where it speaks for the runner, else the runner's summary.

    Only foreground shell commands that weren't interrupted count. passed is null where nothing can be said.
    """
    p = payloads.withColumn("_p", F.from_json(column, HOOK))
    event = F.col("_p.hook_event_name")
    counts = (F.col("_p.tool_name") == "Bash") & event.isin("PostToolUse", "PostToolUseFailure") & ~F.coalesce("_p.tool_input.run_in_background", "_p.is_interrupt", F.lit(False)) & ~F.coalesce("_p.tool_response.interrupted", F.lit(False))
    said = p.where(counts).withColumn("verdict", shell_verdict(F.col("_p.tool_input.command")))
    out = F.concat_ws("\n", "_p.tool_response.stdout", "_p.tool_response.stderr", "_p.error")
    said = said.where("verdict <> 'no_runner'").withColumn("_summary", runner_summary(F.col("_p.tool_input.command"), out))
    ok = event == "PostToolUse"
    status = F.when(ok & F.col("verdict").startswith("observable"), True).when(~ok & (F.col("verdict") == "observable:both"), False)
    return said.select(F.col("_p.session_id").alias("session_id"), F.col("_p.tool_use_id").alias("tool_use_id"), F.col("_p.agent_type").alias("agent_type"), "verdict", F.coalesce(status, "_summary").alias("passed"))
