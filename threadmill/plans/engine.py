"""The engine: tables of a store folder, kept up to date by ``sync`` and asked by the query methods."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import columns as C
from threadmill.functions import grammar as G
from threadmill.functions import shell
from threadmill.functions import textsearch as X
from threadmill.operators import gitops, search, stats
from threadmill.operators import sequence as S
from threadmill.sources import discovery, normalize, records, sqlite
from threadmill.streaming import incremental as R

#: Part of the tables' path: another version derives everything anew.
STORE_VERSION = 2
TABLES = ("turns", "exchanges", "conversations", "tool_events", "file_refs", "git_ops", "search_docs", "postings")


class Engine:
    def __init__(self, spark: SparkSession, store: str, home: str | None = None, extra_roots: list[str] = (), databases: list[tuple[str, str]] = (), disabled: list[str] = (), zone: str = "UTC") -> None:
        self.spark, self.home, self.extra_roots, self.databases, self.disabled, self.zone = spark, home, list(extra_roots), list(databases), list(disabled), zone
        self.store = f"{store.rstrip('/')}/v{STORE_VERSION}"
        self.tables = R.Store(spark, self.store)

    # Ingestion

    def discovered(self) -> DataFrame:
        found = discovery.discover(self.spark, self.home or "/nonexistent", self.extra_roots, self.disabled)
        return R.with_versions(found)

    def derive(self, lines: DataFrame) -> dict[str, DataFrame]:
        """Every table from lines. Turns are computed once and shared; ``self.held`` keeps what to let go of later."""
        notes = normalize.annotate(records.emit(lines)).cache()
        turns = normalize.turns(notes).drop("input_fields").cache()
        self.held = [notes, turns]
        refs = gitops.file_refs(turns.withColumnRenamed("path", "source_path").withColumnRenamed("path_arg", "path"))
        convs = normalize.conversations(notes, turns)
        ops = gitops.timeline(turns).cache()
        self.held.append(ops)
        faceted = gitops.turn_facets(turns)
        use = faceted.where("tool_direction = 'use'")
        kind = lambda prefix: F.filter("facets", lambda f: f.startswith(prefix))
        events = use.select(
            "conversation_id", "turn_index", "exchange_ordinal", F.lower("tool_name").alias("tool"), F.coalesce(gitops.mutating(F.col("facets")), F.lit(False)).alias("mutating"), F.coalesce("tool_status", F.lit("unknown")).alias("status"),
            F.try_element_at(F.transform(kind("tool_cmd:"), lambda f: F.substring(f, F.lit(10), F.length(f))), F.lit(1)).alias("cmd_head"), F.nullif(F.array_join(kind("git_"), " "), F.lit("")).alias("git_facets"), "ts_ms",
        )
        files = refs.groupBy("conversation_id", "turn_index").agg(F.collect_set("path").alias("files"))
        mined = ops.select("conversation_id", "turn_index", F.col("facets").alias("op_facets"))
        described = gitops.described_facets(F.when(F.col("tool_direction") == "use", F.col("tool_name")), F.col("command"))
        docs = faceted.join(files, ["conversation_id", "turn_index"], "left").join(mined, ["conversation_id", "turn_index"], "left")
        docs = docs.join(convs.select("conversation_id", "normalized_project", "provider", "origin", F.col("cwd").alias("c_cwd"), F.col("model").alias("c_model")), "conversation_id")
        empty = F.array().cast("array<string>")
        docs = docs.select(
            "conversation_id", "turn_index", "exchange_ordinal", "ts_ms", "role", "visible", "text", F.array_sort(F.array_distinct(F.concat("facets", F.coalesce("op_facets", empty), F.coalesce(described, empty)))).alias("facets"), F.coalesce("files", empty).alias("files"),
            F.coalesce("cwd", "c_cwd").alias("cwd"), F.col("normalized_project").alias("project"), "provider", F.coalesce("model", "c_model").alias("model"), "origin", F.col("path").alias("source_path"), X.analyze(F.col("text")).alias("tokens"),
        ).withColumn("length", F.size("tokens"))
        exchanges = S.exchange_rollup(turns)
        docs = docs.cache()
        self.held.append(docs)
        return {"turns": turns, "exchanges": exchanges, "conversations": convs, "tool_events": events, "file_refs": refs, "git_ops": ops, "search_docs": docs, "postings": search.postings(docs)}

    def sync(self, full: bool = False) -> dict[str, int] | None:
        """Bring the tables up to date; only conversations of new or changed files are derived anew, vanished ones go.

        Counts of files by state, or None where another writer holds the store (queries then see its last tables).
        """
        with R.WriterLock(self.spark, f"{self.store}/writer.lock") as lock:
            return self._sync(full) if lock.held else None

    def _sync(self, full: bool) -> dict[str, int]:
        spark = self.spark
        before = self.tables.manifest()
        known = self.tables.read("checkpoints", before)
        known = spark.createDataFrame([], "path string, kind string, size bigint, mtime_ns bigint, version int") if known is None else known
        found = self._found()
        if not full and R.diff_files(known, found).isEmpty():
            return {"new": 0, "changed": 0, "removed": 0}
        size = found.agg(F.sum("size")).first()[0] or 0
        # the scan is written once: what is recorded as done is what was read, whatever grows meanwhile
        refresh = self.tables.begin(R.buckets_for(size), full)
        found = refresh.whole("checkpoints", found)
        states = refresh.whole("changes", R.diff_files(known, found))
        counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        del refresh.tables["changes"]
        wanted = found if full else found.join(states.where("state <> 'removed'").select("path"), "path", "left_semi")
        lines = discovery.read_lines(spark, wanted.where("session is null"))
        if self.databases:
            lines = lines.unionByName(sqlite.read_sessions(spark, self.databases, wanted.where("session is not null").select("path")))
        gone = states.where("state <> 'new'").select(C.stable_id(F.col("path")).alias("conversation_id"))
        try:
            for name, table in self.derive(lines).items():
                refresh.replace(name, table, gone)
        finally:
            for x in self.held:
                x.unpersist()
        refresh.commit()
        return {k: counts.get(k, 0) for k in ("new", "changed", "removed")}

    def _found(self) -> DataFrame:
        """Log files, and the sessions of databases as files whose time is their fingerprint."""
        files = self.discovered().withColumn("session", F.lit(None).cast("string"))
        if not self.databases:
            return files
        marks = sqlite.fingerprints(self.spark, self.databases)
        sessions = marks.select("path", "kind", F.length("fingerprint").cast("bigint").alias("size"), F.xxhash64("fingerprint").alias("mtime_ns"), F.col("session_id").alias("session"))
        return files.unionByName(R.with_versions(sessions).select(*files.columns))

    def table(self, name: str, conversation: str | None = None) -> DataFrame:
        """A table of the store; of one conversation, by its bucket alone."""
        if conversation is None:
            return self.tables.read(name).drop("bucket")
        return self.of_conversations(name, [conversation])

    def of_conversations(self, name: str, ids: list[str]) -> DataFrame:
        """The rows of a few conversations, from their buckets alone."""
        manifest = self.tables.manifest()
        own = self.tables.read(name, manifest, sorted({R.bucket_number(i, manifest["buckets"]) for i in ids}))
        return own.where(F.col("conversation_id").isin(*ids)).drop("bucket")

    def parse(self, path: str, provider: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(turns, conversations) of one file, without the store."""
        kind = F.lit(provider) if provider else F.coalesce(discovery.provider_of(F.col("path")), F.lit("generic"))
        files = self.spark.createDataFrame([(path,)], "path string").withColumn("kind", kind)
        notes = normalize.annotate(records.emit(discovery.read_lines(self.spark, files)))
        turns = normalize.turns(notes)
        return turns, normalize.conversations(notes, turns)

    # Queries

    def _now(self, now_ms: int | None) -> int:
        return int(time.time() * 1000) if now_ms is None else now_ms

    def search(self, query: str, limit: int = 20, project: str | None = None, since: str | None = None, sort: str = "relevance", now_ms: int | None = None) -> DataFrame:
        now = self._now(now_ms)
        docs = self.table("search_docs")
        low = G.instant_ms(since, now, self.zone) if since else None
        only = ([search.facet_predicate("project", project)] if project else []) + ([F.col("ts_ms") >= low] if low is not None else [])
        return search.search(docs, self.table("conversations"), query, now, limit, sort, self.zone, index=self.table("postings"), only=only, texts=lambda ids: self.of_conversations("search_docs", ids))

    def ask(self, text: str, literal: bool = False, **more) -> DataFrame:
        """Turns where the text is one conversation id or exchange reference (unless ``literal``), else a search."""
        words = text.split()
        if not literal and len(words) == 1 and re.fullmatch(r"rg_[0-9a-fA-F]{24}(:[^#]*)?(#e[1-9][0-9]*)?", words[0]):
            return self.turns(words[0])
        return self.search(text, **more)

    def document_count(self) -> int:
        return self.table("search_docs").count()

    def notifications(self) -> DataFrame:
        return S.distinct_notifications(self.table("turns"))

    def exchanges(self, query: str | None = None, failed: bool = False, interrupted: bool = False, min_duration: str | None = None, min_turns: int | None = None, project: str | None = None, since: str | None = None, limit: int = 20, now_ms: int | None = None) -> DataFrame:
        now = self._now(now_ms)
        e = self.table("exchanges")
        if query:
            e = search.exchanges_matching(self.table("search_docs"), e, query, now)
        return stats.filter_exchanges(e, self.table("conversations"), failed, interrupted, G.duration_ms(min_duration) if min_duration else None, min_turns, project, G.instant_ms(since, now, self.zone) if since else None, limit)

    def find(self, conversation: str, query: str, limit: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(turns that match everything, exchanges that hold every needle, turns of each needle)."""
        docs = self.table("search_docs", conversation)
        return search.find_strict(docs, conversation, query, self._now(None), limit), search.find_passages(docs, conversation, query), search.find_term_counts(docs, conversation, query)

    def turns(self, ref: str, turn: int | None = None, around: int | None = None, exchange: int | None = None, offset: int = 0, limit: int = 40) -> DataFrame:
        """Turns of a conversation id, a unique prefix of one, or an exchange reference id#eN."""
        cid, _, ordinal = ref.partition("#e")
        if ordinal:
            if not ordinal.isdigit() or ordinal == "0":
                raise G.QueryError(f"not an exchange: {ref}")
            exchange = int(ordinal) - 1
        found = search.resolve_prefix(self.table("conversations"), cid)
        if found is None:
            raise G.QueryError(f"no single conversation: {cid}")
        return search.turn_window(self.table("turns", found), found, turn, around, exchange, offset, limit)

    def git_ops(self, conversation: str | None = None, pr: int | None = None, branch: str | None = None, commit: str | None = None, mutating_only: bool = False) -> DataFrame:
        ops = self.table("git_ops")
        if conversation:
            ops = ops.where(F.col("conversation_id") == conversation)
        return gitops.filter_ops(ops, pr, branch, commit, mutating_only)

    def trajectory(self, query: str | None = None, pr: int | None = None, branch: str | None = None, commit: str | None = None, project: str | None = None, limit: int = 8, candidates: int = 40, now_ms: int | None = None) -> DataFrame:
        """Conversations that worked on a pull request, branch or commit: candidates by facets first, then by text.

        A text that looks like a hash or a branch is asked as one first.
        """
        now, text = self._now(now_ms), (query or "").strip()
        facet = lambda key, value: G.ParsedQuery(facets=[(key, value)])
        phrase = lambda words: G.ParsedQuery(phrases=[words.lower()])
        asks = [facet("git_pr", f"create-num:{pr}"), facet("git_pr_num", str(pr)), phrase(f"pull/{pr}"), phrase(f"pr {pr}")] if pr is not None else []
        asks += [facet("git_branch", branch), phrase(branch)] if branch else []
        asks += [facet("git_commit", shell.short_sha(commit)), G.parse_query(shell.short_sha(commit))] if commit else []
        if re.fullmatch("[0-9a-fA-F]{7,40}", text):
            asks.append(facet("git_commit", shell.short_sha(text)))
        elif "/" in text and " " not in text:
            asks.append(facet("git_branch", text))
        asks += [G.parse_query(text)] if text else []
        if not asks:
            raise G.QueryError("give a pull request, a branch, a commit or a text")
        docs = self.table("search_docs")
        if project:
            docs = docs.where(search.facet_predicate("project", project))
        order = [F.desc("score"), F.col("conversation_id"), F.col("turn_index")]
        found = gitops.ordered_union([search.scored(docs, a, now) for a in asks], order, candidates)
        return gitops.trajectory(found, self.table("git_ops"), self.table("conversations"), pr, branch, commit, limit)

    def conversations(self, project: str | None = None, limit: int = 20) -> DataFrame:
        return stats.recent(self.table("conversations"), limit, project)

    def stats(self, kind: str, since: str | None = None, by: str = "tokens", limit: int = 10, now_ms: int | None = None) -> DataFrame:
        """daily, weekly, monthly, heatmap, tools, commands, git, top or projects."""
        low = G.instant_ms(since, self._now(now_ms), self.zone) if since else None
        if kind in ("daily", "weekly", "monthly"):
            return stats.with_total(stats.usage(self.table("turns"), self.table("exchanges"), kind, self.zone, low))
        if kind == "heatmap":
            return stats.heatmap(stats.between(self.table("turns"), "ts_ms", low, None), self.zone)
        if kind in ("tools", "commands", "git"):
            return {"tools": stats.tools, "commands": stats.commands, "git": stats.git_activity}[kind](stats.between(self.table("tool_events"), "ts_ms", low, None))
        if kind == "top":
            return stats.top_exchanges(stats.between(self.table("exchanges"), "started_at", low, None), self.table("conversations"), by, limit)
        if kind == "projects":
            return stats.projects(self.table("conversations"))
        raise G.QueryError(f"no such report: {kind}")

    def doctor(self) -> DataFrame:
        return stats.inventory(self.discovered())
