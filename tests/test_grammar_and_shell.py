import pytest
from hypothesis import given
from hypothesis import strategies as st

from threadmill.functions import grammar as G
from threadmill.functions import shell as H
from threadmill.functions.textsearch import excerpt_of


def test_query_parts():
    q = G.parse_query('Fix "the Reader" tool_cmd:Cargo git-commit:ABCDEF1234 https://x.y since:2d a project:@me "open')
    assert q.terms == ["fix", "https://x.y"]
    assert q.phrases == ["the reader", "open"]
    assert q.facets == [("tool_cmd", "cargo"), ("git_commit", "abcdef1"), ("project", "me")]
    assert q.dates == [("since", "2d")]


def test_regex_tokens():
    assert G.parse_query(r"/a\s+b/").regexes == [r"a\s+b"]
    assert G.parse_query("/foo //").regexes == []
    with pytest.raises(G.QueryError):
        G.parse_query("/(/")


def test_glob_duration_and_dates():
    assert G.glob_pattern("plain") is None
    assert G.glob_pattern("a*.r?") == r"(?s)^a.*\.r.$"
    assert [G.duration_ms(x) for x in ("1.5h", "5m", "30", "2s")] == [5_400_000, 300_000, 30_000, 2_000]
    assert G.date_range([("when", "2024-01-02")], 0) == (1704153600000, 1704240000000)
    with pytest.raises(G.QueryError):
        G.date_range([("since", "2026-08-01"), ("before", "2026-07-01")], 0)


@pytest.mark.parametrize(
    "command, facets",
    [
        ("git push origin a:b", ["git_branch:b", "git_cmd:push", "git_remote:origin", "tool_cmd:git"]),
        ("ls | grep x", ["tool_cmd:ls"]),
        ("sudo git push", ["tool_cmd:git"]),
        ("git -C /x -c k=v worktree add ../p topic", ["git_branch:topic", "git_cmd:worktree", "tool_cmd:git"]),
        ("gh pr view https://github.com/o/r/pull/7", ["git_pr:view", "git_pr_num:7", "tool_cmd:gh"]),
        ("gh pr create 5 --base main --head=f/x", ["git_branch:f/x", "git_branch:main", "git_pr:create", "tool_cmd:gh"]),
        ("cat <<'E'\ngit push\nE\necho ok", ["tool_cmd:cat", "tool_cmd:echo"]),
        ("echo 'a; b' && it's broken", ["tool_cmd:echo", "tool_cmd:it's"]),
        ("git describe", ["tool_cmd:git"]),
    ],
)
def test_command_facets(command, facets):
    assert H.command_facets(command) == facets


def test_mined_output():
    assert H.mined_facets("see https://github.com/o/r/pull/48", ["git_pr:create"]) == ["git_pr:create-num:48", "git_pr_num:48"]
    assert H.mined_facets("[main abc1234] x", ["git_cmd:commit"]) == ["git_commit:abc1234"]
    assert H.mined_facets("[main abc1234] x", []) == []
    assert H.mined_facets("abc1234..def5678 main", []) == ["git_commit:abc1234", "git_commit:def5678"]


@given(st.text(max_size=200))
def test_commands_never_fail(command):
    facets = H.command_facets(command)
    assert facets == sorted(set(facets))
    H.described_facets("bash", command)


def test_excerpt_window():
    text = "é" * 400 + " needle " + "x" * 400
    shown, marks = excerpt_of(text, ["Needle"])
    start, length = marks[0]
    assert shown.encode()[start : start + length] == b"needle" and shown.startswith("…") and shown.endswith("…")
    assert excerpt_of("short\ntext", ["zzz"]) == ("short text", [])
