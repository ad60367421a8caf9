"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one per shard.

Distinct vectors are dealt to shards by hash: of ``LEAST_SHARD`` vectors while there are few, so that cores share the
building, and of up to ``MOST_SHARD`` as the table grows; vectors whose sizes differ by more than 2**``BAND`` don't share one, for
single precision couldn't tell the small ones apart.  A shard's graph grows by
batches: greedy searches from the entry points propose neighbours of each new vector, relaxed
distance pruning keeps a neighbour only if no kept one is ``alpha`` times nearer to it than the vector itself,
and reverse edges are added and pruned alike.  Largest inner product becomes least distance by one
more component that gives all stored vectors the same norm; queries have 0 there.

A graph is a file in the shared scratch folder and a small row that names it: graphs never move through a shuffle.  Queries are written
once; a task opens one graph, streams all queries past it in blocks, and gives ``k`` rows a query, so recall doesn't hang on
a choice of shards.  Scores are computed in double precision on the original vectors, whatever their type.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadmill.llm import support

LEAST_SHARD, MOST_SHARD = 8192, 1 << 18
#: Powers of two between the largest components of a shard's vectors.
BAND = 8
#: Queries that a task holds, and flags of visited vectors (queries x vectors) of one search call.
BLOCK, SEEN = 2048, 1 << 26
#: Components of the candidates' mutual distances that one pruning call holds.
PRUNED = 1 << 22
DEGREE, SLACK = 32, 44
BUILD_BEAM, SEARCH_BEAM, EXPAND = 64, 96, 4
ALPHA = 1.2
ENTRIES, SPREAD = 16, 16
#: Nearest vectors of its own batch that a new vector considers.
MATES = 32
#: Vectors named less often get up to so many edges more.
RARE, EXTRA = 8, 16
K = 20


def beam_search(x: np.ndarray, near: np.ndarray, q: np.ndarray, beam: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``beam`` best vectors found for each query, best first; -1 fills up.

    A search enters at the first ``ENTRIES`` vectors, which have the largest norms (few edges lead to those, and many queries want them),
    and at the next ``SPREAD``, which are random ones, so that a dense group far from the others is entered too.
    """
    b, n = len(q), len(x)
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    enter = np.arange(min(ENTRIES + SPREAD, n, beam))
    ids[:, enter], sims[:, enter], done[:, enter] = enter, q @ x[enter].T, False
    seen[:, enter] = True
    live = np.arange(b)
    expand = min(expand, beam)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-open_, expand - 1, axis=1)[:, :expand]
        good = np.take_along_axis(open_, pick, 1) > -np.inf
        keep = good.any(axis=1)
        live, pick, good = live[keep], pick[keep], good[keep]
        if not len(live):
            break
        done[live[:, None], pick] = True
        at = np.where(good, ids[live[:, None], pick], n)
        new = np.sort(near[at].reshape(len(live), -1), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[live[:, None], new]] = n
        row, col = np.nonzero(new < n)
        found = new[row, col]
        seen[live[row], found] = True
        s = np.full(new.shape, -np.inf, np.float32)
        s[row, col] = np.einsum("ij,ij->i", x[found], q[live[row]])
        all_s = np.concatenate([sims[live], s], axis=1)
        all_i = np.concatenate([ids[live], new], axis=1)
        all_d = np.concatenate([done[live], s == -np.inf], axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live], ids[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_d))
    ids[sims == -np.inf] = -1
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(x: np.ndarray, square: float, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours for each row of candidates (-1: none), nearest first; -1 fills up."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    v = x[np.maximum(cand, 0)]
    far = square - np.matmul(v, v.transpose(0, 2, 1))  # half of each squared distance
    own = square - sims
    alive = cand >= 0
    out = np.full((len(cand), degree), -1, np.int64)
    count = np.zeros(len(cand), np.int64)
    a2 = alpha * alpha
    for j in range(cand.shape[1]):
        r = np.flatnonzero(alive[:, j] & (count < degree))
        if not len(r):
            continue
        out[r, count[r]] = cand[r, j]
        count[r] += 1
        alive[r] &= a2 * far[r, j] > own[r]
    return out


def build_order(vectors: np.ndarray, random: np.ndarray) -> np.ndarray:
    """The vectors of the ``ENTRIES`` largest norms, then the others by ``random``: a graph that grows by norms builds its dense groups apart."""
    scaled = vectors / max(1e-300, np.abs(vectors).max()) if len(vectors) else vectors
    by_norm = np.lexsort((random, -(scaled**2).sum(axis=1)))
    rest = by_norm[ENTRIES:]
    return np.concatenate([by_norm[:ENTRIES], rest[np.argsort(random[rest], kind="stable")]])


def build(vectors: np.ndarray, degree: int = DEGREE, slack: int = SLACK, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(x, near): vectors with the norm component (float32), and each one's neighbours (n: none). The vectors are in the order of ``build_order``.

    They are scaled to norms of at most 1, which changes no order of inner products, so any finite component fits.
    """
    n = len(vectors)
    v = vectors / max(1e-300, np.abs(vectors).max()) if n else vectors
    v = v / max(1e-300, np.sqrt((v * v).sum(axis=1).max())) if n else v
    norm = (v * v).sum(axis=1)
    square = float(norm.max()) if n else 1.0
    x = np.concatenate([v, np.sqrt(np.maximum(0, square - norm))[:, None]], axis=1).astype(np.float32)
    near = np.full((n + 1, slack), n, np.int64)
    degrees = np.zeros(n, np.int64)
    a = 1
    while a < n:
        b = min(n, a + min(512, max(1, a), max(16, SEEN // max(1, a))))
        new = np.arange(a, b)
        cand, sims = beam_search(x[:a], np.minimum(near[: a + 1], a), x[new], min(beam, max(a, 1)))
        if b - a > 1:  # those of one batch don't find each other by searching; a dense group may be in one batch
            mates = x[new] @ x[new].T
            np.fill_diagonal(mates, -np.inf)
            pick = np.argpartition(-mates, min(MATES, b - a - 1) - 1, axis=1)[:, :MATES]
            pick = pick[:, : b - a - 1]
            cand, sims = np.concatenate([cand, a + pick], axis=1), np.concatenate([sims, np.take_along_axis(mates, pick, 1)], axis=1)
        out = robust_prune(x, square, cand, sims, degree, alpha)
        near[new, :degree] = np.where(out >= 0, out, n)
        degrees[new] = (out >= 0).sum(axis=1)
        r, c = np.nonzero(out >= 0)
        to, frm = out[r, c], new[r]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        first = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(to)))
        target = to[first]
        place = np.arange(len(to)) - np.repeat(first, size)
        fits = np.repeat(degrees[target] + size <= slack, size)
        near[to[fits], degrees[to[fits]] + place[fits]] = frm[fits]
        full = degrees[target] + size > slack
        degrees[target[~full]] += size[~full]
        over = target[full]
        # targets of like sizes together: all candidates of a target are pruned at once, however many they are
        ranked = np.argsort(size[full], kind="stable")
        k = 0
        while k < len(ranked):
            most = slack + int(size[full][ranked[min(len(ranked) - 1, k + 255)]])
            pick = ranked[k : k + max(1, min(256, PRUNED // most**2))]
            k += len(pick)
            t, sz, st = over[pick], size[full][pick], first[full][pick]
            wide = slack + int(sz.max())
            cand = np.full((len(t), wide), -1, np.int64)
            cand[:, :slack] = np.where(near[t] < n, near[t], -1)
            rr = np.repeat(np.arange(len(t)), sz)
            cc = np.arange(sz.sum()) - np.repeat(np.cumsum(sz) - sz, sz)
            cand[rr, slack + cc] = frm[np.repeat(st, sz) + cc]
            s = np.where(cand >= 0, np.matmul(x[np.maximum(cand, 0)], x[t][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
            kept = robust_prune(x, square, cand, s, degree, alpha)
            near[t] = n
            near[t, :degree] = np.where(kept >= 0, kept, n)
            degrees[t] = (kept >= 0).sum(axis=1)
        a = b
    return x, with_rare_edges(near)


def with_rare_edges(near: np.ndarray) -> np.ndarray:
    """``near`` with ``EXTRA`` more columns: vectors that fewer than ``RARE`` others name are named by their nearest neighbours too.

    A vector at the rim of a dense group, such as the one of its largest norm, is nobody's near neighbour; without an edge to it no search ends there.
    """
    n = len(near) - 1
    seen = np.bincount(near[:n].ravel(), minlength=n + 1)[:n]
    rare = np.flatnonzero(seen < RARE)
    to = near[rare, :EXTRA].ravel()
    who = np.repeat(rare, min(EXTRA, near.shape[1]))
    rank = np.tile(np.arange(min(EXTRA, near.shape[1])), len(rare))
    real = to < n
    to, who, rank = to[real], who[real], rank[real]
    order = np.lexsort((who, rank, seen[who], to))  # the least named first, then the nearest
    to, who = to[order], who[order]
    place = np.arange(len(to)) - np.searchsorted(to, to, "left")
    fits = place < EXTRA
    more = np.full((n + 1, EXTRA), n, near.dtype)
    more[to[fits], place[fits]] = who[fits]
    return np.concatenate([near, more], axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of rows with an id and a vector that is neither empty nor zero and has only finite components."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda c: c != 0)
    plain = F.transform(F.col("embedding").cast("array<double>"), lambda c: c + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some).select("vec_id", plain.alias("embedding"))


def distinct_vectors(rows: DataFrame, most_ids: int, salts: int = 64) -> DataFrame:
    """dim, key (two hashes), embedding and ids of each distinct vector: its ``most_ids`` smallest ids, enough for any query's answer.

    Ranks are taken within salted parts first, so a vector that a third of the rows share is spread.
    """
    r = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    slim = r.select("k1", "k2", "vec_id").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    part = Window.partitionBy("k1", "k2", "salt").orderBy("vec_id")
    whole = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = slim.withColumn("place", F.dense_rank().over(part)).where(F.col("place") <= most_ids).distinct()
    few = few.withColumn("place", F.dense_rank().over(whole)).where(F.col("place") <= most_ids)
    ids = few.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return r.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding")).join(ids, ["k1", "k2"]).withColumn("dim", F.size("embedding"))


def shard_size(n: int, cores: int) -> int:
    """Vectors of a shard: some shards for every core, within the bounds."""
    return min(MOST_SHARD, max(LEAST_SHARD, n // max(1, 4 * cores)))


def _save(path: str, **arrays: np.ndarray) -> None:
    """Under a temporary name and then moved, so a repeated task replaces its own file whole."""
    system, name = fs.FileSystem.from_uri(path)
    tmp = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(tmp) as out:
        held = io.BytesIO()
        np.savez(held, **arrays)
        out.write(held.getbuffer())
    system.move(tmp, name)


def _load(path: str) -> dict[str, np.ndarray]:
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as source, np.load(io.BytesIO(source.read())) as z:
        return dict(z)


def index(vectors: DataFrame, shard: int | None = None, most_ids: int = K + 1) -> DataFrame:
    """One row per shard: dim, band, shard, n and the path of its graph. Every usable row is indexed; an empty table has no shards."""
    spark = vectors.sparkSession
    largest = F.array_max(F.transform("embedding", F.abs))
    points = distinct_vectors(usable(vectors), most_ids).withColumn("band", F.floor((F.log2(largest) + BAND // 2) / BAND).cast("int"))
    points = support.materialise(points, "points")
    counts = points.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per vector length and band, of which there are 270 at most
    cores = spark.sparkContext.defaultParallelism
    sizes = [(r["dim"], r["band"], -(-r["n"] // (shard or shard_size(r["n"], cores)))) for r in counts]
    folder = support.scratch_path(spark, "graphs")
    sizes = F.broadcast(spark.createDataFrame(sizes, "dim int, band int, shards bigint"))
    dealt = points.join(sizes, ["dim", "band"]).withColumn("shard", F.pmod("k2", F.col("shards"))).select("dim", "band", "shard", "k1", "embedding", "ids")

    def task(table: pa.Table) -> pa.Table:
        dim, band, number = (table[c][0].as_py() for c in ("dim", "band", "shard"))
        vec = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        order = build_order(vec, table["k1"].to_numpy())
        vec, ids = vec[order], table["ids"].combine_chunks().take(pa.array(order))
        x, near = build(vec)
        with np.errstate(over="ignore"):
            exact = vec.astype(np.float32)
        own = exact if (exact.astype(np.float64) == vec).all() else vec  # as narrow as keeps every component
        path = f"{folder}/{dim}-{band}-{number}.npz"
        system, name = fs.FileSystem.from_uri(folder)
        system.create_dir(name, recursive=True)
        _save(path, x=x, near=near.astype(np.int32), own=own, many=np.diff(ids.offsets.to_numpy()), ids=ids.flatten().to_numpy().astype(np.int64))
        return pa.table({"dim": pa.array([dim], pa.int32()), "band": pa.array([band], pa.int32()), "shard": pa.array([number], pa.int64()), "n": pa.array([len(x)], pa.int64()), "path": [path]})

    return support.materialise(dealt.groupBy("dim", "band", "shard").applyInArrow(task, "dim int, band int, shard bigint, n bigint, path string"), "graphs")


def _hits(graph: dict[str, np.ndarray], qids: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the ``k`` best of one graph for each query, each id once."""
    x, near, own, many, ids = graph["x"], graph["near"], graph["own"], graph["many"], graph["ids"]
    first = np.concatenate([[0], np.cumsum(many)])
    size = np.abs(q).max(axis=1, keepdims=True)
    padded = np.concatenate([q / size, np.zeros((len(q), 1))], axis=1).astype(np.float32)
    found, _ = beam_search(x, near, padded, min(beam, len(x)))
    r, c = np.nonzero(found >= 0)
    at = found[r, c]
    with np.errstate(over="ignore", invalid="ignore"):
        score = (q[r] * own[at].astype(np.float64)).sum(axis=1)
    rows, sc = np.repeat(r, many[at]), np.repeat(score, many[at])
    vec = ids[np.repeat(first[at], many[at]) + np.arange(many[at].sum()) - np.repeat(np.cumsum(many[at]) - many[at], many[at])]
    other = vec != qids[rows]
    rows, sc, vec = rows[other], sc[other], vec[other]
    order = np.lexsort((-sc, vec, rows))  # an id of several vectors counts by its best
    rows, sc, vec = rows[order], sc[order], vec[order]
    once = np.append(True, (vec[1:] != vec[:-1]) | (rows[1:] != rows[:-1]))[: len(rows)]
    rows, sc, vec = rows[once], sc[once], vec[once]
    order = np.lexsort((vec, -sc, rows))
    rows, sc, vec = rows[order], sc[order], vec[order]
    top = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return qids[rows[top]], vec[top], sc[top]


def search(graphs: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for each row of ``queries`` (vec_id, embedding), its own id apart.

    Ties go to the smaller vec_id.  Queries that aren't usable have no rows.  An id that several rows share names one thing: it asks by the
    first of its vectors (by their hash), is listed once with the best of them, and never for itself.  Other columns are ignored, and
    empty tables give an empty result.
    """
    spark = graphs.sparkSession
    q = usable(queries).groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    asked = support.materialise(q.select("vec_id", "embedding", F.size("embedding").alias("dim")), "queries")
    folder = asked._threadmill_path

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, dim in zip(batch.column("path").to_pylist(), batch.column("dim").to_pylist(), strict=True):
                graph = _load(path)
                few = max(1, min(256, SEEN // max(1, len(graph["x"]))))
                system, name = fs.FileSystem.from_uri(folder)
                for part in ds.dataset(name, filesystem=system, format="parquet").to_batches(filter=ds.field("dim") == dim, batch_size=block):
                    qids = part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    q = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    for a in range(0, len(q), few):
                        hits = _hits(graph, qids[a : a + few], q[a : a + few], k, beam)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in hits], ["query_id", "vec_id", "score"])

    shards = max(1, graphs.count())
    hits = graphs.select("path", "dim").repartition(shards).mapInArrow(task, "query_id bigint, vec_id bigint, score double")
    # shards share an id only where several rows do; both steps go by query, so rows move once
    best = hits.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(index(vectors), vectors.where(F.col("vec_id") % 20 == 0))
