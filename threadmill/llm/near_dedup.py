"""Near-duplicate detection by a chosen-path set similarity join.

1. Sketch.  One pass over the texts: each document's set of word shingles, as the set's
   128-bit name, its size, and ``SIGNATURE`` minwise tokens.  Equal sets share a name, so
   copies collapse by a grouped minimum, however many there are.
2. Chosen path.  ``TREES`` trees branch the distinct sets, each by tokens of its own: a level sends
   each set of a node to the child named by its token's value, so sets of similarity s
   stay together with probability s.  A child of at most ``NODE`` sets is compared exhaustively
   by sketches; a larger one branches again, and after ``DEPTH`` levels its sets, which agree on
   all tokens chosen, are joined through one of them.  A pair is apart in every tree with
   probability (1 - s^d)^TREES at depth d: 3e-13 at depth one and 8e-5 in the deepest nodes for s = 0.80,
   below 1e-14 and 2e-6 for 0.85.
3. Confirmation.  The sketches' links only make clusters.  Within a cluster links are decided on
   the full sets: a set is compared with all others until the sets not yet compared lie in one
   component, which needs one comparison of each set for a cluster of near copies.  Pairs whose sketches
   agree in too few tokens aren't compared: fewer than one in a million linked pairs (``agree``).
   Clusters too large for one task are confirmed in rounds: a block of sets, doubling
   each round, is compared with the whole cluster by tasks that hold a part of each.

Copies never meet: whatever is joined to a set's name goes by ``support.hot_join``, and full sets come from one
document of each set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import shingles, support

TREES, DEPTH, NODE = 18, 4, 128
#: Minwise tokens of a set: each level of each tree has its own.
SIGNATURE = TREES * DEPTH
#: Sets and shingles of a cluster that one task confirms.
CLUSTER_SETS, CLUSTER_SHINGLES = 4096, 4_000_000
#: Bits a row, and at most, of the filter that tells which documents' sets are needed again; beyond it they are joined.
BLOOM_BITS_A_ROW, BLOOM_BITS = 16, 1 << 28

_rng = np.random.default_rng(8120917)
_FLIP = _rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**62, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def agree(percent: int) -> int:
    """How many tokens must agree between two sets whose similarity may reach ``percent``: fewer do in less than one of a million such pairs."""
    p, below = percent / 100, 0.0
    for k in range(SIGNATURE + 1):
        below += math.comb(SIGNATURE, k) * p**k * (1 - p) ** (SIGNATURE - k)
        if below >= 1e-6:
            return k
    return SIGNATURE


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (32 bits each) of non-empty sets, one row a set."""
    out = np.empty((len(sets), SIGNATURE), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k in range(SIGNATURE):
        v = (flat ^ _FLIP[k]) * _TIMES[k]
        v ^= v >> np.uint64(31)
        v *= np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = np.minimum.reduceat(v, starts) >> np.uint64(32)
    return out


def set_name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Links:
    """Union-find over local numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of ``others``: 100 * intersection >= percent * union with ``one``; all sets sorted and not empty."""
    flat = np.concatenate(others)
    sizes = np.array([len(s) for s in others])
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    common = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * common >= percent * (sizes + len(one) - common)


def confirm(sets: list[np.ndarray], sigs: np.ndarray, percent: int) -> list[int]:
    """The root of each set under links on full sets (exact; see the module's text)."""
    n = len(sets)
    links, pending, least = Links(n), set(range(n)), agree(percent)
    sizes = np.array([len(s) for s in sets])
    while pending:
        by_root: dict[int, list[int]] = {}
        for i in pending:
            by_root.setdefault(links.root(i), []).append(i)
        if len(by_root) == 1 and len(pending) < n:
            break
        group = min(by_root.values(), key=lambda g: (len(g), min(g)))
        p = min(group)
        pending.discard(p)
        near = (sigs == sigs[p]).sum(axis=1) >= least
        near &= (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p]))
        near[p] = False
        cand = [j for j in np.flatnonzero(near).tolist() if links.root(j) != links.root(p)]
        if cand:
            for j in np.array(cand)[linked(sets[p], [sets[j] for j in cand], percent)].tolist():
                links.join(p, j)
    return [links.root(i) for i in range(n)]


def sketch(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, text_hash, n_shingles, name (null where the set is empty) and sig of every row of ``docs`` (doc_id, text)."""
    support.bounded_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = shingles.text_bytes(batch.column(1))
            for a, b in shingles.slices(off):
                sets = shingles.shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full))
                names = [set_name(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array([next(sig).tobytes() if x else None for x in names], pa.binary())], ["doc_id", "text_hash", "n_shingles", "name", "sig"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(task, "doc_id bigint, text_hash bigint, n_shingles bigint, name binary, sig binary")


def tree_nodes(reps: DataFrame, trees: int = TREES, depth: int = DEPTH, node: int = NODE) -> tuple[DataFrame, DataFrame]:
    """(members, joined): (node, name) of nodes of 2 to ``node`` sets, and links (u, v) of those that stay larger at full depth."""
    spark = reps.sparkSession
    level = reps.select("name", "sig", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree")).withColumn("node", F.xxhash64("tree"))
    members, joined = None, None
    for d in range(depth):
        token = F.expr(f"substring(sig, (tree * {depth} + {d}) * 4 + 1, 4)")
        slim = support.materialise(level.select("tree", F.xxhash64("node", token).alias("node"), "name"), "nodes")
        sizes = support.materialise(slim.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("lead")).where("n > 1"), "node-sizes")
        kept = support.hot_join(slim, sizes, "node", "inner", sizes.select("node", "n")).select("tree", "node", "name", "n", "lead")
        small = kept.where(F.col("n") <= node).select("node", "name")
        members = small if members is None else members.union(small)
        large = kept.where(F.col("n") > node)
        if sizes.where(F.col("n") > node).isEmpty():
            break
        if d == depth - 1:
            joined = large.select(F.col("name").alias("u"), F.col("lead").alias("v"))
            break
        level = large.select("tree", "node", "name").join(reps.select("name", "sig"), "name")
    if joined is None:
        joined = spark.createDataFrame([], "u binary, v binary")
    return members, joined


def _compare_small(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Sketch links (u, v) within small nodes: each node's sets are linked to the least of their group."""
    least = agree(percent)
    nodes = members.join(reps.select("name", "sig", "n"), "name").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("name", "n", "sig"))).alias("sets"))

    def task(batches):
        for batch in batches:
            u: list[bytes] = []
            v: list[bytes] = []
            for sets in batch.column(0).to_pylist():
                sig = np.frombuffer(b"".join(s["sig"] for s in sets), np.uint32).reshape(len(sets), SIGNATURE)
                size = np.array([s["n"] for s in sets])
                links = Links(len(sets))
                for i in range(len(sets) - 1):
                    near = (sig[i + 1 :] == sig[i]).sum(axis=1) >= least
                    near &= 100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i])
                    for j in np.flatnonzero(near).tolist():
                        links.join(i, i + 1 + j)
                for i in range(len(sets)):
                    if (r := links.root(i)) != i:
                        u.append(sets[i]["name"])
                        v.append(sets[r]["name"])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return nodes.select("sets").mapInArrow(task, "u binary, v binary")


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Three bits of a Bloom filter for each key."""
    k = keys.astype(np.int64).view(np.uint64)
    other = shingles.mix(k ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    k = shingles.mix(k)
    return np.stack([(k + np.uint64(j) * other) % np.uint64(bits) for j in range(3)])


def _bloom(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of ``n`` 64-bit keys, ``BLOOM_BITS_A_ROW`` bits each; tasks fill parts, which are merged by their place."""
    bits = max(1 << 10, n * BLOOM_BITS_A_ROW) // 8 * 8

    def task(batches):
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(own, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        at = np.flatnonzero(own)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at], pa.int32())], ["at", "v"])

    table = keys.mapInArrow(task, "at int, v int").groupBy("at").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[table["at"].to_numpy()] = table["v"].to_numpy().astype(np.uint8)
    return out


def _row_key():
    """A hash of a row's doc_id and text; ``docs`` and the sketches have the same."""
    return F.xxhash64("doc_id", "text_hash")


def needed_sets(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(name, members) of the sets of the rows named by ``rows`` (key: a hash of doc_id and text), from a second pass over the texts.

    The filter lets some other rows through; their names match nothing later.  More rows than the filter holds are joined by hash.
    """
    spark = docs.sparkSession
    n = rows.count()
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).select("text", _row_key().alias("key"))
    if n * BLOOM_BITS_A_ROW > BLOOM_BITS:
        keyed, filt = keyed.join(rows, "key", "left_semi"), None
    else:
        filt = spark.sparkContext.broadcast(_bloom(rows.select("key"), n))

    def task(batches):
        for batch in batches:
            texts = batch.column(0)
            if filt is not None:
                at = _places(batch.column(1).to_numpy(), len(filt.value) * 8)
                hit = ((filt.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
                texts = texts.filter(pa.array(hit))
            data, off = shingles.text_bytes(texts)
            for a, b in shingles.slices(off):
                keep = [(set_name(s), s.tobytes()) for s in shingles.shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k) if len(s)]
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keep], pa.binary()), pa.array([x[1] for x in keep], pa.binary())], ["name", "members"])

    return keyed.mapInArrow(task, "name binary, members binary")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, cluster_sets: int = CLUSTER_SETS, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Rows with the same doc_id are one document's copies and keep their own sets.  A null text, or
    one without words, has an empty set and is linked with nothing: its component is its own doc_id.
    A null doc_id takes part like any other; where a component has no id at all, component_id is null
    and kept is true.  An empty table gives an empty result.
    """
    found, table = components_of(docs, percent, k, cluster_sets, cluster_shingles)
    own = support.hot_join(found.select("doc_id", "n_shingles", "name"), table.drop("root"), "name")
    comp = F.coalesce("component_id", "doc_id")
    return own.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def components_of(docs: DataFrame, percent: int = 85, k: int = 5, cluster_sets: int = CLUSTER_SETS, cluster_shingles: int = CLUSTER_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, (name, root, component_id) of every distinct set)."""
    found = support.materialise(sketch(docs, k), "sketches")
    one = found.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.min(_row_key()).alias("key"))
    reps = support.materialise(one, "sets")
    members, joined = tree_nodes(reps)
    edges = support.materialise(_compare_small(members, reps, percent).union(joined).distinct(), "sketch-links")
    clusters = support.components(edges).withColumnsRenamed({"node": "name", "component": "cluster"})
    clusters = support.materialise(clusters.join(reps.select("name", "n", "sig", "key"), "name"), "clusters")
    roots = confirmed(docs, clusters, percent, k, cluster_sets, cluster_shingles)
    named = reps.select("name", "first_id").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    named = support.materialise(named, "roots")
    low = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return found, support.materialise(support.hot_join(named, low, "root", "inner").select("name", "root", "component_id"), "set-components")


def keep_one(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """The rows of ``docs`` without near duplicates, all columns kept: of each component the row with the smallest doc_id
    (an id before none, then the smaller hash of the text).  Rows equal in doc_id and text stay once; texts without words all stay.
    """
    found, table = components_of(docs, percent, k)
    root = F.coalesce("root", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_hash")).cast("binary"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash")).alias("first")
    own = support.hot_join(found.select("doc_id", "text_hash", "name"), table, "name")
    chosen = own.select(root.alias("root"), first).groupBy("root").agg(F.min("first").alias("first"))
    keys = chosen.select(F.struct(F.col("first.doc_id").isNull().alias("is_null"), F.coalesce("first.doc_id", F.lit(0)).cast("bigint").alias("value")).alias("__id"), F.col("first.text_hash").alias("__text")).distinct()
    keyed = docs.withColumn("__id", support.never_null("doc_id", "bigint")).withColumn("__text", F.xxhash64("text"))
    # rows that repeat are made one before they move, and the join finds the rows where that left them
    return keyed.dropDuplicates(["__id", "__text"]).join(keys, ["__id", "__text"], "left_semi").select(*docs.columns)


def confirmed(docs: DataFrame, clusters: DataFrame, percent: int, k: int, cluster_sets: int, cluster_shingles: int) -> DataFrame:
    """(name, root) of the sets in ``clusters`` (name, cluster, n, sig, key) under links on full sets."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("weight"))
    fits = (F.col("sets") <= cluster_sets) & (F.col("weight") <= cluster_shingles)
    sizes = support.materialise(sizes.select("cluster", "sets", fits.alias("fits")), "cluster-sizes")
    # a cluster that is too large for one task is told before its sets move
    sized = support.materialise(support.hot_join(clusters, sizes, "cluster", "inner", sizes.select("cluster", F.col("sets").alias("n"))), "sized-sets")
    full = needed_sets(docs, sized.select("key").distinct(), k).groupBy("name").agg(F.first("members").alias("members")).join(sized.drop("key"), "name")
    full = support.materialise(full, "full-sets")

    def task(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(len(sets), SIGNATURE)
        names = table["name"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        roots = confirm([sets[i] for i in order], sig[order], percent)
        return pa.table({"name": pa.array([names[i] for i in order], pa.binary()), "root": pa.array([names[order[r]] for r in roots], pa.binary())})

    out = full.where("fits").select("cluster", "name", "sig", "members").groupBy("cluster").applyInArrow(task, "name binary, root binary")
    if not sizes.where("not fits").isEmpty():
        out = out.union(confirmed_in_rounds(full.where("not fits"), percent, part_sets=cluster_sets))
    return out


def confirmed_in_rounds(full: DataFrame, percent: int, first_block: int = 16, per_row: int = 16, part_sets: int = CLUSTER_SETS) -> DataFrame:
    """(name, root) for clusters of any size (cluster, sets, name, n, sig, members): each round compares a block of sets of each cluster
    with the whole cluster, and ends when the sets not yet compared lie in one component in every cluster.
    A cluster's sets are dealt to parts of about ``part_sets``, which all get the block: no task gathers a cluster.
    A joined row holds ``per_row`` sets of the block and one other, so memory doesn't grow with the cluster.
    """
    spark, least = full.sparkSession, agree(percent)
    parts = F.ceil(F.col("sets") / part_sets).cast("bigint")
    full = support.materialise(full.select("cluster", "name", "n", "sig", "members", parts.alias("parts"), F.pmod(F.xxhash64("name"), parts).alias("part")), "large-clusters")
    slim = support.materialise(full.select("cluster", "name"), "large-cluster-names")
    done = spark.createDataFrame([], "name binary")
    links = spark.createDataFrame([], "u binary, v binary")
    roots = support.materialise(slim.withColumn("root", F.col("name")), "large-roots")
    block = first_block
    while True:
        pending = support.materialise(roots.join(done, "name", "left_anti"), "pending")
        counts = support.materialise(pending.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("left")), "pending-counts")
        several = counts.groupBy("cluster").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1")
        open_ = support.materialise(several, "open-clusters")
        if open_.isEmpty():
            break
        # sets of small components first, so that what is left soon is one component
        ranked = support.hot_join(pending, support.hot_join(counts, open_, "cluster", "inner").drop("roots"), ["cluster", "root"], "inner")
        chosen = support.materialise(_lowest(ranked, block).join(full.select("name", "n", "sig", "members", "parts"), "name"), "block")
        packed = chosen.withColumn("row", F.floor((F.col("place") - 1) / per_row)).groupBy("cluster", "row").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("name", "sig", "members")).alias("block"))
        packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts", "row")

        def task(batches):
            for batch in batches:
                u: list[bytes] = []
                v: list[bytes] = []
                for row in batch.to_pylist():
                    sig = np.frombuffer(b"".join(x["sig"] for x in row["block"]), np.uint32).reshape(-1, SIGNATURE)
                    near = np.flatnonzero((sig == np.frombuffer(row["sig"], np.uint32)).sum(axis=1) >= least).tolist()
                    near = [row["block"][i] for i in near if row["block"][i]["name"] != row["name"]]
                    if near:
                        same = linked(np.frombuffer(row["members"], np.uint64), [np.frombuffer(x["members"], np.uint64) for x in near], percent)
                        v += [x["name"] for x, hit in zip(near, same.tolist(), strict=True) if hit]
                        u += [row["name"]] * int(same.sum())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

        more = full.join(packed, ["cluster", "part"]).select("name", "sig", "members", "block").mapInArrow(task, "u binary, v binary")
        links = support.materialise(links.union(more), "links")
        done = support.materialise(done.union(chosen.select("name")), "compared")
        comp = support.components(links).withColumnsRenamed({"node": "name", "component": "root"})
        roots = support.materialise(slim.join(comp, "name", "left").select("cluster", "name", F.coalesce("root", "name").alias("root")), "large-roots")
        block *= 2
    return roots.select("name", "root")


def _lowest(ranked: DataFrame, block: int, salts: int = 64) -> DataFrame:
    """The ``block`` sets of each cluster with the smallest components left; ranks within salted parts first, so no task ranks a whole cluster."""
    from pyspark.sql.window import Window

    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)))
    part = Window.partitionBy("cluster", "salt").orderBy("left", "name")
    whole = Window.partitionBy("cluster").orderBy("left", "name")
    few = salted.withColumn("place", F.row_number().over(part)).where(F.col("place") <= block)
    return few.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= block).select("cluster", "name", "place")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at similarity 0.85 on shingles of five words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
