"""Search over turn documents: predicates from a parsed query, BM25, grouping, the three tiers of find.

A document table has conversation_id, turn_index, exchange_ordinal, ts_ms, role, visible, text, tokens
(analyzed), facets, files, cwd, project, provider, model, origin, and optionally source_path.
Text predicates run on the analyzed column, which the table stores, so a search reads
that column, the filtered metadata, and the text of its results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.functions import grammar as G
from threadmill.functions import textsearch as X

CANDIDATES = 500


def needles(q: G.ParsedQuery) -> list[list[str]]:
    """Each term's and phrase's words; those without any word are left out."""
    return [w for w in (X.analyze_local(t) for t in q.highlights) if w]


def needle_count(words: list[str]) -> Column:
    return X.phrase_count(F.col("tokens"), words)


def _matches(column: Column, key: str, value: str, exact: bool, many: bool) -> Column:
    if value.startswith("/") and value.endswith("/") and len(value) > 2:
        test = lambda c: F.lower(c).rlike(f"^(?:{value[1:-1]})$")
    elif (pattern := G.glob_pattern(value)) is not None:
        test = lambda c: c.rlike(pattern)
    elif key in G.METADATA_KEYS and not exact:
        test = lambda c: F.contains(F.lower(c), F.lit(value.lower()))
    else:
        test = lambda c: c == value
    return F.coalesce(F.exists(column, test) if many else test(column), F.lit(False))


def facet_predicate(key: str, value: str, exact: bool = False) -> Column:
    """A facet's condition; metadata keys match substrings without case unless ``exact``."""
    if key == "subagent":
        return (F.col("origin") == "subagent") == F.lit(value in ("true", "1", "yes", "subagent"))
    if key == "is" and value == "subagent":
        return F.col("origin") == "subagent"
    column = {"provider": "provider", "agent": "provider", "origin": "origin", "model": "model", "project": "project", "cwd": "cwd", "role": "role", "source": "source_path"}.get(key)
    if column:
        return _matches(F.col(column), key, value, exact, False)
    if key == "file":
        return _matches(F.col("files"), key, value, exact, True)
    if value.startswith("/") and value.endswith("/") and len(value) > 2:
        return F.exists("facets", lambda f: F.lower(f).rlike(f"^{key}:(?:{value[1:-1]})$"))
    return _matches(F.col("facets"), "facets", f"{key}:{value}", True, True)


def predicate(q: G.ParsedQuery, now_ms: int, zone: str = "UTC", exact: bool = False, scope: str = "corpus", with_needles: bool = True) -> Column:
    """All clauses of a query, AND-ed (without its needles where an index has found them). Corpus scope adds visible turns of real work, unless the query names an origin."""
    low, high = G.date_range(q.dates, now_ms, zone)
    parts: list[Column] = [needle_count(w) > 0 if with_needles else F.lit(True) for w in needles(q)]
    parts += [facet_predicate(k, v, exact) for k, v in q.facets]
    parts += [F.col("text").rlike(r) for r in q.regexes]
    if low is not None:
        parts.append(F.col("ts_ms") >= low)
    if high is not None:
        parts.append(F.col("ts_ms") < high)
    if not parts:  # nothing to look for, or words of marks alone: no turn matches
        return F.lit(False)
    if q.highlights and not needles(q):
        return F.lit(False)
    if scope == "corpus":
        parts.append(F.col("visible"))
        if not q.names("origin"):
            parts.append(F.col("origin") != "auxiliary")
    return reduce(lambda a, b: a & b, parts)


def corpus_statistics(docs: DataFrame, words: list[list[str]]) -> DataFrame:
    """One row: n, average length, and the document count of each needle, over all documents."""
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("tokens")).alias("average"), *[F.count_if(needle_count(w) > 0).cast("double").alias(f"df{i}") for i, w in enumerate(words)])


def postings(docs: DataFrame) -> DataFrame:
    """The inverted index: term, conversation_id, turn_index, tf and positions of every term of every document (tokens)."""
    t = docs.select("conversation_id", "turn_index", F.posexplode("tokens").alias("position", "term"))
    return t.groupBy("term", "conversation_id", "turn_index").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def _needle_hits(index: DataFrame, words: list[str], into: str) -> DataFrame:
    """conversation_id, turn_index and how often the words stand there in order and side by side, from the words' postings alone."""
    doc = ["conversation_id", "turn_index"]
    hits = index.where(F.col("term") == words[0]).select(*doc, F.col("positions").alias("at"), F.col("tf").cast("bigint").alias(into))
    if len(words) == 1:
        return hits.drop("at")
    for k, w in enumerate(words[1:], 1):
        # each word narrows the starts that are left
        after = index.where(F.col("term") == w).select(*doc, F.transform("positions", lambda p: p - k).alias("next"))  # noqa: B023
        hits = hits.join(after, doc).withColumn("at", F.array_intersect("at", "next")).where(F.size("at") > 0).drop("next")
    return hits.select(*doc, F.size("at").cast("bigint").alias(into))


def _scored_by_index(docs: DataFrame, index: DataFrame, q: G.ParsedQuery, condition: Column, words: list[list[str]]) -> DataFrame:
    """As ``scored``: the terms' postings give matches and document counts, and lengths (one number column) the averages; no text is analyzed."""
    doc = ["conversation_id", "turn_index"]
    found = [_needle_hits(index, w, f"tf{i}") for i, w in enumerate(words)]
    size = docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("average"))
    fact = size.select(F.struct("n", "average").alias("s")).scalar()
    counts = [f.agg(F.count(F.lit(1)).cast("double")).scalar() for f in found]
    hits = reduce(lambda a, b: a.join(b, doc), found)
    score = reduce(lambda a, b: a + b, [X.bm25_part(F.col(f"tf{i}").cast("double"), F.col("length"), fact["average"], X.idf(fact["n"], counts[i])) for i in range(len(words))])
    return docs.where(condition).join(hits, doc).withColumn("score", score).drop(*[f"tf{i}" for i in range(len(words))])


def scored(docs: DataFrame, q: G.ParsedQuery, now_ms: int, zone: str = "UTC", exact: bool = False, scope: str = "corpus", index: DataFrame | None = None, only: list[Column] = ()) -> DataFrame:
    """Matching documents with their BM25 score; ``index`` are the documents' postings, ``only`` further conditions on what is found.

    Statistics are those of all ``docs``.
    """
    words = needles(q)
    more = reduce(lambda a, b: a & b, only, F.lit(True))
    if words and index is not None:
        return _scored_by_index(docs, index, q, predicate(q, now_ms, zone, exact, scope, with_needles=False) & more, words)
    hits = docs.where(predicate(q, now_ms, zone, exact, scope) & more)
    if not words:
        return hits.withColumn("score", F.lit(0.0))
    stats = corpus_statistics(docs, words)
    fact = stats.select(F.struct(*stats.columns).alias("s")).scalar()  # one row, planned as a subquery
    score = reduce(lambda a, b: a + b, [X.bm25_part(needle_count(w).cast("double"), F.size("tokens"), fact["average"], X.idf(fact["n"], fact[f"df{i}"])) for i, w in enumerate(words)])
    return hits.withColumn("score", score)


def search(docs: DataFrame, conversations: DataFrame, query: str, now_ms: int, limit: int = 20, sort: str = "relevance", zone: str = "UTC", candidates: int | None = None, half_life_days: float = X.HALF_LIFE_DAYS, exact: bool = False, index: DataFrame | None = None, only: list[Column] = (), texts: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """Conversations with matching turns: match_count, score, last_ts and the best turn, best first or newest first.

    ``candidates`` bounds the turns looked at, best first (the counts are then of those); by default all are.
    With ``texts`` (documents of given conversations) the page, ``limit`` rows, is computed first and only its conversations' texts are read.
    """
    hits = scored(docs, G.parse_query(query), now_ms, zone, exact, index=index, only=only)
    if candidates:
        hits = hits.orderBy(F.desc("score"), "conversation_id", "turn_index").limit(candidates)
    best = F.struct("score", (-F.col("turn_index")).alias("at"))
    g = hits.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("match_count"), F.max("score").alias("best_score"), F.max("ts_ms").alias("last_ts"), F.max_by("turn_index", best).alias("turn_index"), F.max_by("exchange_ordinal", best).alias("exchange_ordinal"))
    g = g.withColumn("score", X.recency(F.col("best_score"), F.col("last_ts"), now_ms, half_life_days))
    order = [F.desc("score"), F.col("conversation_id")] if sort == "relevance" else [F.desc_nulls_last("last_ts"), F.col("conversation_id")]
    page = g.orderBy(*order).limit(limit)
    if texts is not None:
        rows = page.collect()
        page = docs.sparkSession.createDataFrame(rows, page.schema)
        docs = texts([r["conversation_id"] for r in rows]) if rows else docs.limit(0)
        conversations = conversations.where(F.col("conversation_id").isin(*[r["conversation_id"] for r in rows]))
    named = page.join(conversations.select("conversation_id", "title"), "conversation_id", "left")
    found = docs.select("conversation_id", "turn_index", F.col("text").alias("best_text"))
    named = found.join(F.broadcast(named), ["conversation_id", "turn_index"])
    return named.withColumn("excerpt", X.excerpt(F.col("best_text"), G.parse_query(query).highlights)).drop("best_text").orderBy(*order)


def find_strict(docs: DataFrame, conversation_id: str, query: str, now_ms: int, limit: int = 20) -> DataFrame:
    """Turns of one conversation that match every clause, hidden ones too, with the total before the limit."""
    q = G.parse_query(query)
    hits = docs.where(F.col("conversation_id") == conversation_id).where(predicate(q, now_ms, scope="conversation"))
    return hits.withColumn("total_turn_hits", F.count(F.lit(1)).over(Window.partitionBy("conversation_id"))).orderBy("turn_index").limit(limit)


def find_passages(docs: DataFrame, conversation_id: str, query: str) -> DataFrame:
    """Exchanges of one conversation in which every needle occurs, in one turn or another; for queries of several needles."""
    words = needles(G.parse_query(query))
    d = docs.where(F.col("conversation_id") == conversation_id)
    if len(words) < 2:
        return d.select("conversation_id", "exchange_ordinal").limit(0)
    flags = [F.bool_or(needle_count(w) > 0).alias(f"has{i}") for i, w in enumerate(words)]
    g = d.groupBy("conversation_id", "exchange_ordinal").agg(*flags)
    return g.where(reduce(lambda a, b: a & b, [F.col(f"has{i}") for i in range(len(words))])).select("conversation_id", "exchange_ordinal").orderBy("exchange_ordinal")


def find_term_counts(docs: DataFrame, conversation_id: str, query: str) -> DataFrame:
    """Turns of one conversation with each needle, hidden ones too: one pass for all needles."""
    q = G.parse_query(query)
    words = [(t, X.analyze_local(t)) for t in q.highlights]
    words = [(t, w) for t, w in words if w]
    d = docs.where(F.col("conversation_id") == conversation_id)
    counts = d.agg(*[F.count_if(needle_count(w) > 0).alias(f"c{i}") for i, (_, w) in enumerate(words)])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"c{i}").alias("turns")) for i, (t, _) in enumerate(words)])
    return counts.select(F.explode(pairs).alias("p")).select("p.term", "p.turns")


def exchanges_matching(docs: DataFrame, exchanges: DataFrame, query: str, now_ms: int, best_only: bool = False) -> DataFrame:
    """Exchanges with a matching turn; ``best_only`` keeps the one of each conversation's best turn."""
    hits = scored(docs, G.parse_query(query), now_ms)
    if best_only:
        hits = hits.groupBy("conversation_id").agg(F.max_by("exchange_ordinal", F.struct("score", (-F.col("turn_index")).alias("at"))).alias("exchange_ordinal"))
    return exchanges.join(hits.select("conversation_id", "exchange_ordinal"), ["conversation_id", "exchange_ordinal"], "left_semi")


def find_substring(turns: DataFrame, conversation_id: str, needle: str) -> DataFrame:
    return turns.where((F.col("conversation_id") == conversation_id) & F.contains(F.lower("text"), F.lit(needle.lower()))).orderBy("turn_index")


def turn_window(turns: DataFrame, conversation_id: str, turn: int | None = None, around: int | None = None, exchange: int | None = None, offset: int = 0, limit: int = 40) -> DataFrame:
    """Turns of one conversation: one turn, a window around one, an exchange, or a page."""
    t = turns.where(F.col("conversation_id") == conversation_id)
    at = F.col("turn_index")
    if turn is not None:
        t = t.where(at == turn)
    elif around is not None:
        start = max(0, around - limit // 2)
        t = t.where(at.between(start, start + limit - 1))
    else:
        if exchange is not None:
            t = t.where(F.col("exchange_ordinal") == exchange)
        return t.orderBy("turn_index").offset(offset).limit(limit)
    return t.orderBy("turn_index")


def resolve_prefix(conversations: DataFrame, prefix: str) -> str | None:
    """The only conversation id that starts so, else None."""
    rows = conversations.where(F.col("conversation_id").startswith(prefix)).select("conversation_id").limit(2).collect()
    return rows[0][0] if len(rows) == 1 else None
