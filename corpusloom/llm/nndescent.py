"""Approximate nearest neighbours by inner product: NN-descent builds a graph, greedy search walks it.

Equal vectors are one node. One more coordinate makes all nodes equally long, so the largest inner product is the nearest
node; queries have zero there, which leaves their products as they are. The graph starts from exact neighbours within
random-projection leaves. Each round of NN-descent joins every node's neighbours, forward and reverse, with each other:
neighbours of neighbours that beat a node's worst neighbour replace it. A search keeps a beam of the best nodes seen by
each query and expands all that are not yet expanded, until none is left.

At scale: nodes are dealt by hash into blocks, two for each core of the cluster, and more where one would receive more than
``BLOCK_BYTES`` of vectors. A block receives each vector that it needs once, whatever the number of its edges to it, and a
search sends only the vectors of the nodes that its frontier asks for. It ends when every node of a beam is expanded: a node
enters a beam only above its worst, so none comes back. What a block sends on is cut to what can still
matter: the best ``NEIGHBOURS`` per node, the best ``BEAM`` per query. Reverse lists are sampled where they are made, so a hub sends a
bounded number of edges per task, and again where they are used, so no list is longer than ``NEIGHBOURS`` + ``REVERSE``. Queries are distinct vectors; copies are expanded at the end.

Parameters: ``NEIGHBOURS`` in the graph, ``REVERSE`` sampled reverse neighbours, ``ROUNDS`` at most, ``BEAM`` nodes kept
per query. The graph holds every row; recall against brute force is part of the tests.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
id or of another dimension than most (of two dimensions that tie, the smaller stays); of rows that share an id, the least
vector counts, so repeated rows are one; copies of a query are candidates; equal scores go by id; with too few candidates
all are returned; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, materialize, scratch

NEIGHBOURS = 32
REVERSE = 32
ROUNDS = 4
SETTLED = 0.02  # share of new edges below which the graph is taken as it is
BEAM = 160
BLOCK_BYTES = 128 << 20  # of vectors that a block of the graph receives, about and at most
LEAF = 512
TREES = 2
EXTRA = 8  # nodes more than wanted that are scored again in double precision
EDGES = "u long, v long, score float, new boolean"


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float32).reshape(len(col), -1)


def _top(owner: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best rows of each owner."""
    order = np.lexsort((-score, owner))
    ranked = owner[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, int)
    rank = np.arange(len(ranked)) - np.repeat(first, np.diff(np.r_[first, len(ranked)]))
    return order[rank < k]


def _hash(*cols: np.ndarray) -> np.ndarray:
    h = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


# --- nodes ---------------------------------------------------------------------------------------------------------


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    e = F.col("embedding")
    rows = table.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    )
    big = float("inf")
    rows = rows.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("embedding", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("embedding") == (common[0]["n"] if common else 0))


def build_nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (vec_id, node, embedding) and nodes (node, vec): equal vectors share a node.

    Nodes are numbered in a written table of the distinct vectors, so no two vectors share a number; vectors are told
    apart by 128 bits of their components.
    """
    bits = F.unhex(F.md5(F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string"))).cast("binary")))
    named = materialize(vectors.select("vec_id", bits.alias("bits"), "embedding"), "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    longest = named.agg(F.max(square)).first()[0] or 0.0

    @F.pandas_udf("binary")
    def lift(rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), float)
        last = np.sqrt(np.maximum(0, longest - (x * x).sum(axis=1)))
        return pd.Series([r.tobytes() for r in np.column_stack([x, last]).astype(np.float32)])

    distinct = named.groupBy("bits").agg(F.any_value("embedding").alias("embedding"))
    distinct = materialize(distinct.select("bits", lift("embedding").alias("vec")), "distinct-vectors")
    numbered = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "numbered-vectors")
    members = materialize(named.join(numbered.select("bits", "node"), "bits").select("vec_id", "node", "embedding"), "members")
    nodes = materialize(numbered.select("node", "vec"), "nodes")
    forget(named, distinct, numbered)
    return members, nodes


# --- the graph -----------------------------------------------------------------------------------------------------


def _leaves(nodes: DataFrame, n: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """Rows (leaf, part, node, vec). A leaf is a sign pattern of random projections about their medians; parts split large leaves."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    sample = _matrix(nodes.orderBy("node").limit(2000).toPandas()["vec"])  # for medians only
    r = np.random.default_rng(seed)
    planes = r.normal(size=(trees, sample.shape[1], bits)).astype(np.float32)
    middles = np.median(np.einsum("nd,tdb->tnb", sample, planes), axis=1)

    @F.pandas_udf("array<long>")
    def codes(vec: pd.Series) -> pd.Series:
        x = _matrix(vec)
        got = np.stack([((x @ p > m) << np.arange(bits)).sum(axis=1) * trees + t for t, (p, m) in enumerate(zip(planes, middles, strict=True))], axis=1)
        return pd.Series(list(got.astype(np.int64)))

    dealt = nodes.select("node", "vec", F.explode(codes("vec")).alias("leaf"))
    sizes = materialize(dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).alias("parts")), "leaves")
    return dealt.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select("leaf", "part", "node", "vec")


def _leaf_neighbours(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(rows["vec"]), rows["node"].to_numpy()
        n = min(k, len(ids) - 1)
        if n < 1:
            return pd.DataFrame({"u": [], "v": [], "score": [], "new": []})
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        at = np.argpartition(-s, n - 1, axis=1)[:, :n]
        return pd.DataFrame({"u": np.repeat(ids, n), "v": ids[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel(), "new": True})

    return run


def _merge(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The k best edges of each node; an edge that was there before is not new."""
        u, v = rows["u"].to_numpy(), rows["v"].to_numpy()
        order = np.lexsort((rows["new"].to_numpy(), v, u))
        u, v = u[order], v[order]
        first = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
        rows = rows.iloc[order[first]]
        return rows.iloc[_top(rows["u"].to_numpy(), rows["score"].to_numpy(), k)]

    return run


def _block(col: str, blocks: int):
    return F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int").alias("block")


def merge_edges(edges: DataFrame, blocks: int, k: int) -> DataFrame:
    return edges.groupBy(_block("u", blocks)).applyInPandas(_merge(k), EDGES)


def neighbour_lists(edges: DataFrame, reverse: int, turn: int) -> DataFrame:
    """(owner, member, new): each node's neighbours, and a sample of the nodes that it is a neighbour of.

    A task sends on at most ``reverse`` of a node's reverse neighbours, new ones first; the receiver samples again.
    """

    def pick(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            yield pd.DataFrame({"owner": batch["u"], "member": batch["v"], "new": batch["new"], "back": False})
            held.append(batch[["u", "v", "new"]])
            if sum(map(len, held)) > 1_000_000:
                held = [few(pd.concat(held))]
        if held:
            got = few(pd.concat(held))
            yield pd.DataFrame({"owner": got["v"], "member": got["u"], "new": got["new"], "back": True})

    def few(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = rows["u"].to_numpy(), rows["v"].to_numpy()
        luck = (_hash(u, v, np.full(len(u), turn)) >> np.uint64(12)).astype(float) / 2**52
        return rows.iloc[_top(v, rows["new"].to_numpy() + luck, reverse)]

    return edges.mapInPandas(pick, "owner long, member long, new boolean, back boolean")


def _limit_reverse(owner: np.ndarray, member: np.ndarray, new: np.ndarray, back: np.ndarray, reverse: int) -> np.ndarray:
    """Indexes of the forward rows and of the sampled reverse rows."""
    at = np.flatnonzero(back)
    luck = (_hash(member[at], owner[at]) >> np.uint64(12)).astype(float) / 2**52
    return np.r_[np.flatnonzero(~back), at[_top(owner[at], new[at] + luck, reverse)]]


def _local_join(k: int, reverse: int):
    """Scores of pairs of neighbours that beat the worst neighbour of the first of the pair."""

    def run(lists: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"u": [], "v": [], "score": [], "new": []})
        if not len(lists) or not len(vectors):
            return none
        vectors = vectors.sort_values("node")
        ids, x, worst = vectors["node"].to_numpy(), _matrix(vectors["vec"]), vectors["worst"].to_numpy()
        owner, member, new = lists["owner"].to_numpy(), lists["member"].to_numpy(), lists["new"].to_numpy()
        keep = _limit_reverse(owner, member, new, lists["back"].to_numpy(), reverse)
        keep = keep[np.argsort(owner[keep], kind="stable")]
        owner, at, new = owner[keep], np.searchsorted(ids, member[keep]), new[keep]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[first, len(owner)])
        width = int(size.max())
        best_u, best_v, best_s = [], [], []
        for lo in range(0, len(first), 256):
            f, n = first[lo : lo + 256], size[lo : lo + 256]
            slot = np.arange(width)
            there = slot < n[:, None]
            row = np.where(there, f[:, None] + slot, 0)
            m, fresh = at[row], new[row] & there
            s = np.matmul(x[m], x[m].transpose(0, 2, 1))
            ok = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (m[:, :, None] != m[:, None, :])
            ok &= s > worst[m][:, :, None]
            g, i, j = np.nonzero(ok)
            best_u.append(m[g, i])
            best_v.append(m[g, j])
            best_s.append(s[g, i, j])
        u, v, s = map(np.concatenate, (best_u, best_v, best_s))
        _, once = np.unique(u.astype(np.int64) * len(ids) + v, return_index=True)
        once = once[_top(u[once], s[once], k)]
        return pd.DataFrame({"u": ids[u[once]], "v": ids[v[once]], "score": s[once], "new": True}) if len(once) else none

    return run


def descend(edges: DataFrame, nodes: DataFrame, blocks: int, turn: int, k: int = NEIGHBOURS, reverse: int = REVERSE) -> DataFrame:
    """One round: join neighbours of neighbours, keep the best. ``edges`` is a written table, which the result replaces."""
    lists = materialize(neighbour_lists(edges, reverse, turn).withColumn("block", _block("owner", blocks)), "lists")
    worst = edges.groupBy("u").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    worst = worst.select(F.col("u").alias("node"), F.when(F.col("n") >= k, F.col("low")).otherwise(float("-inf")).cast("float").alias("worst"))
    known = nodes.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")).cast("float")))
    asked = lists.select(F.col("block").alias("to"), F.col("member").alias("node")).distinct()
    vectors = asked.join(known, "node").select("to", "node", "vec", "worst")
    found = lists.groupBy("block").cogroup(vectors.groupBy("to")).applyInPandas(_local_join(k, reverse), EDGES)
    better = materialize(merge_edges(edges.withColumn("new", F.lit(False)).unionByName(found), blocks, k), "edges")
    forget(lists, edges)
    return better


def build_graph(nodes: DataFrame, rounds: int = ROUNDS, k: int = NEIGHBOURS, seed: int = 11) -> tuple[DataFrame, int]:
    """Edges (u, v, score, new) of every node, and the number of blocks."""
    n = nodes.count()
    blocks = 2 * nodes.sparkSession.sparkContext.defaultParallelism  # as many as run at once, more where memory asks for it
    if not n:
        return nodes.sparkSession.createDataFrame([], EDGES), blocks
    blocks = max(blocks, -(-n * (k + REVERSE) * len(nodes.first()["vec"]) // BLOCK_BYTES))
    start = _leaves(nodes, n, TREES, LEAF, seed).groupBy("leaf", "part").applyInPandas(_leaf_neighbours(k), EDGES)
    edges = materialize(merge_edges(start, blocks, k), "edges")
    for turn in range(rounds):
        edges = descend(edges, nodes, blocks, turn, k)
        fresh = edges.filter("new").count()
        if fresh < SETTLED * n * k:
            break
    return edges, blocks


# --- search --------------------------------------------------------------------------------------------------------


def _adjacent(reverse: int):
    """(owner, near): each node's neighbours and its sampled reverse neighbours, once each."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        owner, member = lists["owner"].to_numpy(), lists["member"].to_numpy()
        keep = _limit_reverse(owner, member, lists["new"].to_numpy(), lists["back"].to_numpy(), reverse)
        order = keep[np.lexsort((member[keep], owner[keep]))]
        owner, member = owner[order], member[order]
        once = np.r_[True, (owner[1:] != owner[:-1]) | (member[1:] != member[:-1])]
        owner, member = owner[once], member[once]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return pd.DataFrame({"owner": owner[first], "near": np.split(member, first[1:])})

    return run


def _score_pairs(beam: int):
    def run(pairs: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """Best ``beam`` of each query among this block's nodes, if better than the query's worst."""
        none = pd.DataFrame({"q": [], "node": [], "score": []})
        if not len(pairs) or not len(vectors):
            return none
        vectors = vectors.sort_values("id")
        is_query = vectors["query"].to_numpy()
        q, v = vectors[is_query], vectors[~is_query]
        if not len(q) or not len(v):
            return none
        qx, vx, worst = _matrix(q["vec"]), _matrix(v["vec"]), q["worst"].to_numpy()
        q_ids, v_ids = q["id"].to_numpy(), v["id"].to_numpy()
        i, j = np.searchsorted(q_ids, pairs["q"].to_numpy()), np.searchsorted(v_ids, pairs["node"].to_numpy())
        once = np.unique(i * len(v_ids) + j)
        i, j = once // len(v_ids), once % len(v_ids)
        s = np.concatenate([np.einsum("nd,nd->n", qx[i[k : k + 65536]], vx[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
        ok = np.flatnonzero(s > worst[i])
        ok = ok[_top(i[ok], s[ok], beam)]
        return pd.DataFrame({"q": q_ids[i[ok]], "node": v_ids[j[ok]], "score": s[ok]}) if len(ok) else none

    return run


def _merge_beam(beam: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, node, score = rows["q"].to_numpy(), rows["node"].to_numpy(), rows["score"].to_numpy()
        order = np.lexsort((~rows["expanded"].to_numpy(), node, q))
        first = np.r_[True, (q[order][1:] != q[order][:-1]) | (node[order][1:] != node[order][:-1])] if len(q) else np.zeros(0, bool)
        at = order[first]
        return rows.iloc[at[_top(q[at], score[at], beam)]]

    return run


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, blocks: int, beam: int = BEAM, entries: DataFrame | None = None) -> DataFrame:
    """(q, node, score): the beam of each query (q, vec) after greedy search.

    ``entries`` (q, node) are the nodes where a query starts; by default each starts at 16 nodes of least id.
    """
    state_of = "q long, node long, score float, expanded boolean"
    lists = neighbour_lists(edges, REVERSE, -1)
    adjacency = materialize(lists.groupBy(_block("owner", blocks)).applyInPandas(_adjacent(REVERSE), "owner long, near array<long>"), "adjacency")
    queries = materialize(queries.select("q", "vec"), "queries")
    if entries is None:
        some = nodes.select("node").orderBy("node").limit(16)
        entries = queries.select("q", F.explode(F.array(*[F.lit(r[0]) for r in some.collect()]))).toDF("q", "node")
    q_blocks = max(1, -(-queries.count() // 1024))

    def scored(pairs: DataFrame, worst: DataFrame | None) -> DataFrame:
        asked = pairs.select(F.col("block").alias("to"), "q").distinct().join(queries, "q")
        low = F.lit(float("-inf")).cast("float")
        asked = asked.withColumn("worst", low) if worst is None else asked.join(worst, "q", "left").withColumn("worst", F.coalesce("worst", low))
        asked = asked.select("to", F.col("q").alias("id"), "vec", F.lit(True).alias("query"), "worst")
        # Only the vectors of nodes that the frontier asks for are sent.
        sent = pairs.select("node").distinct().join(nodes, "node")
        sent = sent.select(_block("node", blocks).alias("to"), F.col("node").alias("id"), "vec", F.lit(False).alias("query"), F.lit(0.0).cast("float").alias("worst"))
        both = sent.unionByName(asked)
        return pairs.groupBy("block").cogroup(both.groupBy("to")).applyInPandas(_score_pairs(beam), "q long, node long, score float")

    def merged(rows: DataFrame) -> DataFrame:
        by = F.pmod(F.xxhash64("q"), F.lit(q_blocks)).cast("int").alias("q_block")
        return materialize(rows.groupBy(by).applyInPandas(_merge_beam(beam), state_of), "beam")

    def placed(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.withColumn("block", _block("node", blocks)), "pairs")

    pairs = placed(entries.select("q", "node"))
    state = merged(scored(pairs, None).withColumn("expanded", F.lit(False)))
    while True:
        forget(pairs)
        frontier = state.filter("NOT expanded").select("q", "node")
        if frontier.isEmpty():
            break
        pairs = placed(frontier.join(adjacency, F.col("node") == F.col("owner")).select("q", F.explode("near").alias("node")))
        worst = state.groupBy("q").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
        worst = worst.filter(F.col("n") >= beam).select("q", F.col("low").alias("worst"))
        found = scored(pairs, worst).withColumn("expanded", F.lit(False))
        old, state = state, merged(state.withColumn("expanded", F.lit(True)).unionByName(found))
        forget(old, collect=False)
    return state.select("q", "node", "score")


def nearest(table: DataFrame, wanted: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest other rows of each row whose vec_id is divisible by ``every``."""
    with scratch() as keep:
        members, nodes = build_nodes(valid_vectors(table))
        edges, blocks = build_graph(nodes)
        asked = members.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "node", "embedding")
        starts = asked.select("node").distinct()

        @F.pandas_udf("binary")
        def flat(rows: pd.Series) -> pd.Series:
            x = np.array(rows.tolist(), float)
            return pd.Series([r.tobytes() for r in np.column_stack([x, np.zeros(len(x))]).astype(np.float32)])

        vec_of = asked.groupBy("node").agg(F.any_value("embedding").alias("embedding"))
        queries = vec_of.select(F.col("node").alias("q"), flat("embedding").alias("vec"))
        entries = starts.select(F.col("node").alias("q"), "node")  # a query is a node of the graph and starts at itself
        beams = search(queries, nodes, edges, blocks, entries=entries)
        best = beams.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "node"))).filter(F.col("nth") <= wanted + EXTRA)

        originals = members.groupBy("node").agg(F.any_value("embedding").alias("there"))
        few = members.select("node", "vec_id").withColumn("nth", F.row_number().over(W.partitionBy("node").orderBy("vec_id")))
        few = few.filter(F.col("nth") <= wanted + 1).select("node", "vec_id")
        product = F.aggregate(F.zip_with("here", "there", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        exact = (
            best.select("q", "node")
            .join(vec_of.select(F.col("node").alias("q"), F.col("embedding").alias("here")), "q")
            .join(originals, "node")
            .select("q", "node", product.alias("score"))
            .join(few, "node")
        )
        order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        exact = materialize(exact.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= wanted + 1).select("q", "vec_id", "score"), "nearest")
        lists = exact.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
        own = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(lists, "q")
        others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, wanted)
        found = own.select("query_id", F.posexplode(others)).select(
            "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.minus")).alias("score")
        )
        found = materialize(found, "found")
        keep(found)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the 20 nearest rows of every twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
