"""Embedding near-duplicates by NN-descent.

A forest of random hyperplanes gives each vector first neighbours; joins of neighbours with neighbours of
neighbours (both ways) then refine the lists of ``NEIGHBOURS`` best. Edges near the threshold are computed again in
double precision and kept from the threshold on. Where a list is saturated - all of its neighbours are above the
threshold - it is too short for what it should hold; it is enlarged to its whole component of links, whose members
are compared in blocks. As such lists may hold none of the links that leave the component, saturated vectors are also
compared with all saturated vectors of other components in their leaves. The recall is audited: for a bounded number of vectors, chosen by hash, links are found by
comparing them with all rows. Each vector that has links counts alike, and vectors outside the largest components are
sampled for themselves, until ``LINKED`` with links are among them or ``MOST_AUDITED`` are compared. Below ``TARGET`` more
trees are grown and the descent goes on; after ``MOST_ROUNDS`` all vectors of different components are compared in blocks.

Equal vectors are one node from the start, with their number: copies are not expanded. Vectors that are null, zero,
or hold null or non-finite components link with nothing; so do vectors of different lengths with each other. A null
vec_id counts as a vector for the others' links but is no component's name. Repeated rows are copies of each other. Of neighbours
that are equally near those of the least hash stay in a list; ties at the threshold are links. An empty table gives no rows. vec_id may be
of any type that has an order; further columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import written

THRESHOLD = 0.9
NEIGHBOURS = 12
TREES, STEPS = 10, 2
LEAF = 256
BLOCK = 512
AUDITED, TARGET, MOST_ROUNDS = 256, 0.97, 8
#: Audited outside the largest components: up to so many vectors (and bytes of them), until so many have links.
MOST_AUDITED, AUDITED_BYTES, LINKED = 1 << 14, 16 << 20, 64
#: A component is one of the largest if it holds more than one in so many vectors.
LARGE = 64
#: The graph is made in half precision, which is off by less than this.
SLACK = 5e-3
_EDGES = "a long, b long, s float"


def nodes_of(table: DataFrame) -> DataFrame:
    """g (hash of the vector), x (its components as doubles), copies: the different valid vectors."""
    x = F.col("embedding").cast("array<double>")
    valid = F.col("embedding").isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")),
    ) & F.exists(x, lambda v: v != 0)
    return table.where(valid).select(node_id().alias("g"), x.alias("x")).groupBy("g").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("copies"))


def node_id() -> Column:
    return F.xxhash64(F.col("embedding").cast("array<double>"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of b parted by the length of their vectors."""
    n = np.diff(b.column("x").offsets.to_numpy())
    kinds = np.unique(n)
    for k in kinds:
        yield b if len(kinds) == 1 else b.take(pa.array(np.flatnonzero(n == k)))


def units(nodes: DataFrame) -> DataFrame:
    """g, dim, u: the vectors at length 1, in half precision, as bytes: what the graph's joins carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _by_length(batch):
                u = unit(matrix(b.column("x"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [b.column("g"), pa.array(np.full(len(u), u.shape[1]), pa.int32()), pa.array([r.tobytes() for r in u], pa.binary())],
                    ["g", "dim", "u"],
                )

    return nodes.select("g", "x").mapInArrow(run, "g long, dim int, u binary")


def codes(u: DataFrame, n: int, first: int, trees: int) -> DataFrame:
    """code, g: the leaf of each vector in each tree."""
    bits = int(min(20, max(1, np.ceil(np.log2(max(2, n / 128))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                x = np.frombuffer(b"".join(part.column("u").to_pylist()), np.float16).reshape(len(part), d).astype(np.float32)
                for t in range(first, first + trees):
                    planes = np.random.default_rng([t, int(d)]).standard_normal((d, bits)).astype(np.float32)
                    code = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(code + (t << 20) + (int(d) << 32)), part.column("g")], ["code", "g"])

    return u.mapInArrow(run, "code long, g long")


def leaves(coded: DataFrame, u: DataFrame) -> DataFrame:
    """key, g, u: the vectors of each leaf; leaf sizes are bounded by dealing crowded ones out by hash."""
    # without the vectors, which join once the leaves are known
    size = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    dealt = coded.join(size, "code").select(F.xxhash64("code", F.pmod(F.xxhash64("g", "code"), F.ceil(F.col("n") / LEAF))).alias("key"), "g")
    return dealt.join(u.select("g", "u"), "g")


def _grouped(members: DataFrame, floor: bool) -> DataFrame:
    """Edges both ways from lists (key; g, u, w): of each list's vectors, every one's best; with floor only those above w, the
    similarity that either's list ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, o, s = [], [], []
            for rows in b.column("m").to_pylist():
                if len(rows) < 2 or len({len(r["u"]) for r in rows}) > 1:
                    continue
                g = np.array([r["g"] for r in rows], np.int64)
                g, first = np.unique(g, return_index=True)
                x = np.frombuffer(b"".join(rows[i]["u"] for i in first), np.float16).reshape(len(g), -1).astype(np.float32)
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                if floor:
                    w = np.array([rows[i]["w"] for i in first], np.float32)
                    sim[sim <= np.minimum(w[:, None], w[None, :])] = -2
                k = min(NEIGHBOURS, len(g) - 1)
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(len(g)), k)
                j = best.ravel()
                ok = sim[i, j] > -2
                a.append(g[i[ok]])
                o.append(g[j[ok]])
                s.append(sim[i, j][ok])
            if a:
                a, o, s = map(np.concatenate, (a, o, s))
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, o]), pa.array(np.r_[o, a]), pa.array(np.r_[s, s])], ["a", "b", "s"])

    lists = members.groupBy("key").agg(F.collect_list(F.struct("g", "u", "w")).alias("m"))  # of bounded length
    return lists.select("m").mapInArrow(run, _EDGES)


def best(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return edges.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("r", rank).where(F.col("r") <= k).drop("r")


def refined(graph: DataFrame, u: DataFrame) -> DataFrame:
    """One step of the descent: the neighbours of each node, both ways, meet at it."""
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    around = graph.unionByName(back.withColumn("r", rank).where(F.col("r") <= NEIGHBOURS).drop("r")).select(F.col("a").alias("key"), F.col("b").alias("g"))
    around = around.unionByName(u.select(F.col("g").alias("key"), "g")).distinct()
    worst = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("s")).alias("w"))
    known = u.join(worst, u["g"] == worst["a"], "left").select("g", "u", F.coalesce("w", F.lit(-1.0).cast("float")).alias("w"))
    return best(graph.unionByName(_grouped(around.join(known, "g"), True)))


def exact(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose cosine in double precision is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = b.column("xa").to_pylist(), b.column("xb").to_pylist()
            same = [len(v) == len(w) for v, w in zip(p, q, strict=True)]
            cos = np.array([float(unit(np.array([v]))[0] @ unit(np.array([w]))[0]) if ok else -2 for v, w, ok in zip(p, q, same, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(cos >= threshold, pa.bool_()))

    x = nodes.select("g", "x")
    both = pairs.join(x.toDF("a", "xa"), "a").join(x.toDF("b", "xb"), "b")
    return both.mapInArrow(run, "a long, b long")


def enlarged(member: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """g, links: of each node of the components given (node, component), how many vectors of its component it is linked with, copies
    counted. Components are compared in pairs of blocks; no pair of vectors is emitted."""
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    rows = member.join(nodes, F.col("node") == F.col("g")).join(size, "component").withColumn("of", F.ceil(F.col("n") / BLOCK)).withColumn("i", F.pmod(F.xxhash64("g"), F.col("of")))
    tiles = rows.select("component", "g", "x", "copies", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("j"))
    tiles = tiles.select(
        "component", F.greatest("i", "j").alias("hi"), F.least("i", "j").alias("lo"), (F.col("i") >= F.col("j")).alias("upper"),
        "g", "x", "copies",
    )

    def run(t: pa.Table) -> pa.Table:
        g, x, m, upper = t["g"].to_numpy(), unit(matrix(t["x"].combine_chunks())), t["copies"].to_numpy(), t["upper"].to_numpy()
        own = t["hi"][0].as_py() == t["lo"][0].as_py()
        p = np.flatnonzero(upper)
        q = p if own else np.flatnonzero(~upper)
        near = x[p] @ x[q].T >= threshold
        if own:
            np.fill_diagonal(near, False)
            return pa.table({"g": g, "links": near @ m})
        return pa.table({"g": np.r_[g[p], g[q]], "links": np.r_[near @ m[q], near.T @ m[p]]})

    return tiles.groupBy("component", "hi", "lo").applyInArrow(run, "g long, links long").groupBy("g").agg(F.sum("links").alias("links"))


def bridges(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links a, b between different components c of the vectors (g, x) that share a key (rows: key, c, g, x). A key's vectors are all
    compared, in pairs of blocks; each pair of blocks returns no more links than join its components."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
    cut = rows.join(size.select("key", F.ceil(F.col("n") / block).alias("of")), "key").withColumn("i", F.pmod(F.xxhash64("g"), F.col("of")))
    tiles = cut.select("key", "c", "g", "x", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("j"))
    tiles = tiles.select(
        "key", F.greatest("i", "j").alias("hi"), F.least("i", "j").alias("lo"), (F.col("i") >= F.col("j")).alias("upper"), "c",
        "g", "x",
    )

    def run(t: pa.Table) -> pa.Table:
        own = t["hi"][0].as_py() == t["lo"][0].as_py()
        pairs = []
        for b in _by_length(pa.RecordBatch.from_arrays([t[k].combine_chunks() for k in ("c", "g", "x", "upper")], ["c", "g", "x", "upper"])):
            g, x, upper = b.column("g").to_numpy(), unit(matrix(b.column("x"))), b.column("upper").to_numpy(zero_copy_only=False)
            top = np.unique(b.column("c").to_numpy(), return_inverse=True)[1]
            p = np.flatnonzero(upper)
            q = p if own else np.flatnonzero(~upper)
            for k in range(0, len(p), BLOCK):
                r = p[k : k + BLOCK]
                i, j = np.nonzero((x[r] @ x[q].T >= threshold) & (top[r][:, None] != top[q][None, :]))
                i, j = r[i], q[j]
                _, first = np.unique(np.minimum(top[i], top[j]) * len(g) + np.maximum(top[i], top[j]), return_index=True)
                for v, w in zip(i[first].tolist(), j[first].tolist(), strict=True):
                    if top[v] != top[w]:
                        pairs.append((g[v], g[w]))
                        top[top == top[w]] = top[v]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": found.min(1), "b": found.max(1)})

    return tiles.groupBy("key", "hi", "lo").applyInArrow(run, "a long, b long").distinct()


def named(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """c, g, x: the vectors with their component; one without links is its own."""
    return nodes.join(member, F.col("g") == F.col("node"), "left").select(F.coalesce("component", "g").alias("c"), "g", "x")


def _recalled(picked: list, rows: DataFrame, threshold: float) -> np.ndarray:
    """The share of its links that each of the picked vectors has in its own component, of those that have links."""
    picked = list({r["g"]: r for r in picked}.values())
    ask = {}
    for d in {len(r["x"]) for r in picked}:
        of = [r for r in picked if len(r["x"]) == d]
        ask[d] = np.array([r["g"] for r in of], np.int64), np.array([r["c"] for r in of], np.int64), unit(np.array([r["x"] for r in of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _by_length(batch):
                x = matrix(b.column("x"))
                if x.shape[1] in ask:
                    g, c, q = ask[x.shape[1]]
                    links, hits = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
                    for k in range(0, len(x), BLOCK):
                        near = (unit(x[k : k + BLOCK]) @ q.T >= threshold) & (b.column("g").to_numpy()[k : k + BLOCK, None] != g)
                        links += near.sum(0)
                        hits += (near & (b.column("c").to_numpy()[k : k + BLOCK, None] == c)).sum(0)
                    at = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(links[at]), pa.array(hits[at])], ["g", "links", "hits"])

    sums = rows.mapInArrow(run, "g long, links long, hits long").groupBy("g").agg(F.sum("links").alias("links"), F.sum("hits").alias("hits")).collect()  # one of each picked
    return np.array([r["hits"] / r["links"] for r in sums])


def audit(member: DataFrame, nodes: DataFrame, n: int, threshold: float) -> float:
    """Recall of a vector's links, as the mean over vectors that have any; the lesser one of vectors of all kinds and of those outside the
    largest components. Vectors are chosen by hash and compared with all rows. The enlarged lists hold every link within a component,
    so a link counts as found if its ends are in one component of ``member``."""
    large = [r["component"] for r in member.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > n / LARGE).collect()]  # below LARGE
    rows = written(named(nodes, member), "vectors-named")
    apart = rows.where(~F.col("c").isin(large))
    m = apart.count()
    chosen = lambda of, k, total: of.where(F.pmod(F.xxhash64("g"), F.lit(1 << 30)) < int(min(1.0, k / max(1, total)) * (1 << 30))).collect()
    recall = [_recalled(chosen(rows, AUDITED, n), rows, threshold)]
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 1
    most = max(AUDITED, min(MOST_AUDITED, AUDITED_BYTES // (8 * longest)))
    k = AUDITED
    while m:
        recall[1:] = [_recalled(chosen(apart, k, m), rows, threshold)]
        if len(recall[1]) >= LINKED or k >= min(m, most):
            break
        k = min(8 * k, most)
    return min((float(r.mean()) for r in recall if len(r)), default=1.0)


def link(table: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, steps: int = STEPS) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept: a row for each row of ``table``."""
    nodes = written(nodes_of(table), "vectors")
    n = nodes.count()
    u = written(units(nodes), "vectors-unit")
    graph = bridged = None
    for round_ in range(MOST_ROUNDS):
        coded = written(codes(u, n, round_ * trees, trees), "leaf-codes")
        members = leaves(coded, u).withColumn("w", F.lit(-1.0).cast("float"))
        grown = _grouped(members, False)
        graph = written(best(grown if graph is None else graph.unionByName(grown)), "graph")
        for _ in range(steps):
            graph = written(refined(graph, u), "graph")
        near = graph.where(F.col("s") >= threshold - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = written(exact(near, nodes, threshold), "vector-links")
        member = written(components(links), "vector-components")
        # a list that ends above the threshold may lack links that leave the component
        full = graph.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.min("s").alias("w")).where((F.col("k") >= NEIGHBOURS) & (F.col("w") >= threshold - SLACK))
        crowded = written(named(nodes, member).join(full.select(F.col("a").alias("g")), "g", "left_semi"), "vectors-crowded")
        across = written(bridges(coded.withColumnRenamed("code", "key").join(crowded, "g"), threshold), "vector-links")
        if not across.isEmpty():
            bridged = across if bridged is None else bridged.unionByName(across)
        if bridged is not None:
            links = links.unionByName(bridged)
            member = written(components(links), "vector-components")
        if audit(member, nodes, n, threshold) >= TARGET:
            break
    else:
        rest = bridges(named(nodes, member).withColumn("key", F.lit(0)), threshold, 8 * BLOCK)
        member = written(components(written(links.unionByName(rest), "vector-links")), "vector-components")
    more = enlarged(member, nodes, threshold)
    facts = nodes.select("g", "copies").join(more, "g", "left").join(member, F.col("g") == F.col("node"), "left").select(
        "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "g").alias("c"),
    )
    facts = written(facts, "vector-facts")
    # a vector that is not valid is no node
    rows = written(
        table.select("vec_id", F.when(F.col("embedding").isNotNull(), node_id()).alias("_g")).join(facts, F.col("_g") == F.col("g"), "left"),
        "vector-rows",
    )
    least = rows.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("vec_id").alias("component_id"))
    done = rows.join(least, "c", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
