"""Facet columns, file references, the git timeline and trajectories."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadmill.functions import shell

STRINGS = T.ArrayType(T.StringType())
COMMAND_CHARS, HEAD_CHARS = 200, 240


@F.arrow_udf(STRINGS)
def command_facets(command: pa.Array) -> pa.Array:
    """Facets of shell commands; commands repeat, so each batch parses a distinct one once."""
    d = command.dictionary_encode()
    by = [shell.command_facets(c) for c in d.dictionary.to_pylist()]
    return pa.array([[] if i is None else by[i] for i in d.indices.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(STRINGS)
def described_facets(tool: pa.Array, command: pa.Array) -> pa.Array:
    return pa.array([shell.described_facets(t, c) for t, c in zip(tool.to_pylist(), command.to_pylist(), strict=True)], pa.list_(pa.string()))


@F.arrow_udf(STRINGS)
def mined_facets(output: pa.Array, facets: pa.Array) -> pa.Array:
    return pa.array([shell.mined_facets(o, f or []) for o, f in zip(output.to_pylist(), facets.to_pylist(), strict=True)], pa.list_(pa.string()))


def mutating(facets: Column) -> Column:
    def one(f: Column) -> Column:
        key, value = F.substring_index(f, ":", 1), F.expr("true")
        rest = F.substring(f, F.length(key) + 2, F.length(f))
        return ((key == "git_cmd") & ~rest.isin(*shell.GIT_READ_ONLY)) | ((key == "git_pr") & rest.isin(*shell.PR_MUTATING)) & value

    return F.exists(facets, one)


def is_shell(tool: Column) -> Column:
    return F.coalesce(F.lower(tool).isin(*shell.SHELL_TOOLS), F.lit(False))


def turn_facets(turns: DataFrame) -> DataFrame:
    """turns (tool_name, tool_direction, tool_status, command, skill, content_image, special_kind) with their sorted facets."""
    use, output = F.col("tool_direction") == "use", F.col("tool_direction") == "output"
    name = F.lower("tool_name")
    cmd = F.when(use & is_shell(F.col("tool_name")), F.col("command"))
    t = turns.withColumn("__cmd", F.coalesce(command_facets(cmd), F.array().cast(STRINGS)))
    one = lambda cond, value: F.when(F.coalesce(cond, F.lit(False)), F.array(value)).otherwise(F.array().cast(STRINGS))
    server = F.regexp_extract(name, r"^mcp__(.*?)__", 1)
    kind = F.col("special_kind")
    parts = [
        one(use, F.concat(F.lit("tool:"), name)), one(use & (server != ""), F.concat(F.lit("mcp:"), server)), one(use & (name == "skill") & F.col("skill").isNotNull(), F.concat(F.lit("skill:"), F.lower("skill"))), F.col("__cmd"),
        one(mutating(F.col("__cmd")), F.lit("tool_mutating:true")), one(use | output, F.concat(F.lit("tool_status:"), F.coalesce("tool_status", F.lit("unknown")))), one(F.col("content_image"), F.lit("content:image")),
        one(kind == "turn_aborted", F.lit("is:interrupted")), one(kind == "compact_boundary", F.lit("is:compacted")), one(kind.startswith("task_notification"), F.lit("is:notification")), one(kind.startswith("scheduled_prompt"), F.lit("is:scheduled")),
    ]
    return t.withColumn("facets", F.array_sort(F.array_distinct(F.concat(*parts)))).drop("__cmd")


def file_refs(turns: DataFrame) -> DataFrame:
    """(conversation_id, turn_index, path, mode) of tool calls with a path; relative paths stand in the turn's directory."""
    paths = F.array("file_path", "path", "notebook_path")
    t = turns.where(F.col("tool_direction") == "use").select("conversation_id", "turn_index", "cwd", F.when(F.lower("tool_name").isin(*shell.MUTATING_FILE_TOOLS), "mutate").otherwise("read").alias("mode"), F.explode(F.array_compact(paths)).alias("p"))
    p = F.trim("p")
    full = F.when(p.startswith("/"), p).when(F.col("cwd").isNotNull(), F.concat(F.regexp_replace("cwd", "/+$", ""), F.lit("/"), p))
    return t.where(p != "").select("conversation_id", "turn_index", full.alias("path"), "mode").where("path is not null").distinct()


def timeline(turns: DataFrame) -> DataFrame:
    """One row per shell call with git evidence; the first output of its pair in the conversation adds what it shows.

    Calls and outputs meet by (conversation_id, pair_id), so the join spreads by pairs, not by conversations.
    """
    calls = turns.where((F.col("tool_direction") == "use") & is_shell(F.col("tool_name")) & F.col("command").isNotNull())
    calls = calls.select("conversation_id", "turn_index", "ts_ms", "pair_id", F.col("tool_status").alias("own_status"), "command", F.filter(command_facets(F.col("command")), lambda f: f.startswith("git_")).alias("own")).where(F.size("own") > 0)
    first = F.min_by(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tool_status", F.lit("unknown")).alias("status")), "turn_index").alias("output")
    outputs = turns.where((F.col("tool_direction") == "output") & F.col("pair_id").isNotNull()).groupBy("conversation_id", "pair_id").agg(first)
    ops = calls.join(outputs, ["conversation_id", "pair_id"], "left")
    ops = ops.withColumn("mined", F.when(F.col("output").isNotNull(), mined_facets(F.col("output.text"), F.col("own"))))
    facets = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("mined", F.array().cast(STRINGS)))))
    ops = ops.withColumn("facets", facets)
    values = lambda prefix: F.transform(F.filter("facets", lambda f: f.startswith(prefix)), lambda f: F.substring(f, F.lit(len(prefix) + 1), F.length(f)))
    created = F.try_element_at(values("git_pr:create-num:"), F.lit(1)).cast("bigint")
    numbers = F.array_sort(F.array_distinct(F.array_compact(F.concat(values("git_pr_num:").cast("array<bigint>"), F.array(created)))))
    head = F.translate(F.substring(F.regexp_replace(F.col("output.text"), r"^\s+|\s+$", ""), 1, HEAD_CHARS), "\n", " ")
    return ops.select(
        "conversation_id", "turn_index", "ts_ms", F.substring(F.regexp_replace("command", r"^\s+|\s+$", ""), 1, COMMAND_CHARS).alias("command"), "facets", mutating(F.col("facets")).alias("mutating"),
        F.coalesce("output.status", "own_status", F.lit("unknown")).alias("status"), F.coalesce(head, F.lit("")).alias("output_head"), numbers.alias("pr_numbers"), created.alias("created_pr"), values("git_branch:").alias("branches"), values("git_commit:").alias("commits"),
    )


def touches_pr(n: int, strict: bool = False) -> Column:
    """The number among an op's pull requests, or its link in the command or output; ``strict`` wants the whole number."""
    if strict:
        link = f"/pull/{n}(?![0-9])"
        return F.array_contains("pr_numbers", F.lit(n).cast("bigint")) | F.col("output_head").rlike(link) | F.col("command").rlike(link)
    return F.array_contains("pr_numbers", F.lit(n).cast("bigint")) | F.contains("output_head", F.lit(f"/pull/{n}")) | F.contains("command", F.lit(f"/pull/{n}")) | F.contains("command", F.lit(f"#{n} "))


def filter_ops(ops: DataFrame, pr: int | None = None, branch: str | None = None, commit: str | None = None, mutating_only: bool = False) -> DataFrame:
    if mutating_only:
        ops = ops.where("mutating")
    if pr is not None:
        ops = ops.where(touches_pr(pr))
    if branch is not None:
        ops = ops.where(F.array_contains("branches", branch))
    if commit is not None:
        ops = ops.where(F.array_contains("commits", shell.short_sha(commit)))
    return ops.orderBy("conversation_id", "turn_index")


def ordered_union(parts: list[DataFrame], order: list[Column], limit: int, key: str = "conversation_id") -> DataFrame:
    """Distinct keys in the order of parts and, within a part, of ``order``; the first ``limit``, with the turn_index of the row that placed them.

    Only each key's first row of a part is ranked, and a part gives ``limit`` keys at most.
    """
    out = None
    for i, p in enumerate(parts):
        first = p.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").orderBy(*order).limit(limit)
        ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(key, F.lit(i).alias("priority"), "rank", F.col("turn_index").alias("turn"))
        out = ranked if out is None else out.unionByName(ranked)
    place = F.struct("priority", "rank")
    best = out.groupBy(key).agg(F.min(place).alias("place"), F.min_by("turn", place).alias("turn"))
    return best.orderBy("place").limit(limit)


def by_relevance(found: DataFrame, limit: int) -> DataFrame:
    """Candidates by relevance (0 text, 1 any git, 2 matching op, 3 origin), then first_seen; weak ones go where a matching op exists."""
    top = F.max("relevance").over(Window.partitionBy(F.lit(0)))  # a few dozen candidates
    kept = found.withColumn("__top", top).where((F.col("relevance") >= 2) | (F.col("__top") < 2)).drop("__top")
    return kept.orderBy(F.desc("relevance"), F.asc_nulls_first("first_seen"), "conversation_id").limit(limit)


def trajectory(candidates: DataFrame, ops: DataFrame, conversations: DataFrame, pr: int | None = None, branch: str | None = None, commit: str | None = None, limit: int = 8) -> DataFrame:
    """Candidate conversations (conversation_id, turn: where their text matched best) by their git evidence, as told forward in time.

    conversation_id, title, relevance, origin (it created the pull request), first_seen (its start), matching_ops, next_turn (of the first
    matching operation, else of the text), inspect (what shows that place) and summary (that operation's command).
    A branch or commit gives no origin.  Candidates without a conversation are left out.
    """
    match = F.lit(False)
    if pr is not None:
        match = match | touches_pr(pr)
    if branch is not None:
        match = match | F.array_contains("branches", branch)
    if commit is not None:
        match = match | F.array_contains("commits", shell.short_sha(commit))
    created = F.lit(False) if pr is None else F.coalesce(F.col("created_pr") == pr, F.lit(False))
    mine = ops.join(candidates.select("conversation_id"), "conversation_id", "left_semi").withColumn("__hit", F.coalesce(match, F.lit(False)))
    first = F.min(F.when(F.col("__hit"), F.struct("turn_index", "command"))).alias("first")
    g = mine.groupBy("conversation_id").agg(F.bool_or(created).alias("origin"), F.count_if("__hit").alias("matching_ops"), first)
    found = candidates.select("conversation_id", "turn").join(conversations.select("conversation_id", "title", "started_at"), "conversation_id").join(g, "conversation_id", "left")
    n = F.coalesce("matching_ops", F.lit(0)).cast("bigint")
    relevance = F.when(F.col("origin"), 3).when(n > 0, 2).when(F.col("matching_ops").isNotNull(), 1).otherwise(0)
    next_turn = F.coalesce("first.turn_index", "turn", F.lit(0)).cast("bigint")
    inspect = F.concat(F.lit("turns "), F.col("conversation_id"), F.lit(" --around "), next_turn.cast("string"), F.lit(" --limit 40"))
    found = found.select(
        "conversation_id", F.coalesce("title", F.lit("")).alias("title"), relevance.alias("relevance"), F.coalesce("origin", F.lit(False)).alias("origin"), F.col("started_at").alias("first_seen"),
        n.alias("matching_ops"), next_turn.alias("next_turn"), inspect.alias("inspect"), F.coalesce("first.command", F.lit("")).alias("summary"),
    )
    return by_relevance(found, limit)
