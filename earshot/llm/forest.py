"""Near-duplicates among embeddings by a forest of random-projection trees.

Every tree splits the vectors of a label again and again at the median of a random projection; vectors within SPILL of
the median go to both sides. The splits are found in a bounded sample, and each vector goes down all of them in one
pass; nodes that are still large, as where labels are too many for the sample, are split on in rounds at their own
medians. Vectors of a leaf are compared, links verified by their cosine, and linked vectors united.
A pair is counted in the first of the leaves that both are in, so that counts need no list of pairs. Equal vectors are
one class with a count, and leaves that no projection divides are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import discard, saved
from earshot.llm.components import components, local_roots

COSINE = 0.98
TREES, LEAF_ROWS, SPILL = 4, 512, 0.02
#: Directions tried for a node before it is a leaf of any size, and the most of its rows that may go to one side.
TRIES, LARGEST_SIDE = 3, 0.7
BLOCK_ROWS = 1024
#: Vectors sampled for the trees, and of a node at least.
SAMPLE, SAMPLE_NODE = 60_000, 32
KEY = ["label", "dim", "tree", "node", "tries"]


def usable(v: Column) -> Column:
    """Whether a vector can link: not null or empty, finite, no null component, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def direction(tree: int, node: int, tries: int, dim: int) -> np.ndarray:
    x = np.random.default_rng([tree, tries, node & 0xFFFFFFFF, node >> 32, dim]).normal(size=dim)
    return x / np.linalg.norm(x)


def projected(rows: DataFrame) -> DataFrame:
    """rows with p: the projection of the unit vector on its node's random direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [tuple(k) for k in zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "tries", "dim")))]
            known = {k: direction(*k) for k in set(keys)}
            found = [float(known[k] @ unit(v)) for k, v in zip(keys, batch.column("vec").to_numpy(zero_copy_only=False))]
            yield batch.append_column("p", pa.array(found, pa.float64()))

    return rows.mapInArrow(run, rows.withColumn("p", F.lit(0.0)).schema)


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max()  # no overflow
    return v / np.sqrt(v @ v)


#: A split: the tries that its direction took, and the projection at which it parts; None for the latter in a leaf that
#: no direction divides.
Splits = dict[tuple[int, int], tuple[int, float | None]]


def sampled_splits(rows: np.ndarray, share: float, trees: int, leaf_rows: int) -> Splits:
    """The splits of each (tree, node) for the unit vectors of a label's sample, which is `share` of all."""
    out: Splits = {}
    open_nodes = [(tree, 1, np.arange(len(rows))) for tree in range(trees)]
    while open_nodes:
        tree, node, mine = open_nodes.pop()
        if len(mine) / share <= leaf_rows or len(mine) < SAMPLE_NODE:
            continue
        for tries in range(TRIES):
            p = rows[mine] @ direction(tree, node, tries, rows.shape[1])
            low, mid, high = np.quantile(p, [1 - LARGEST_SIDE, 0.5, LARGEST_SIDE])
            if low < mid - SPILL and high > mid + SPILL:
                out[tree, node] = tries, float(mid)
                open_nodes += [(tree, 2 * node, mine[p <= mid + SPILL]), (tree, 2 * node + 1, mine[p >= mid - SPILL])]
                break
        else:
            out[tree, node] = TRIES, None
    return out


def forest(classes: DataFrame, trees: int, leaf_rows: int) -> dict[tuple, Splits]:
    """Splits by (label, dim), from a sample of at most about SAMPLE vectors."""
    total = classes.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sample = classes if share == 1 else classes.filter(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    groups: dict[tuple, list] = {}
    for r in sample.select("label", "dim", "vec").collect():
        groups.setdefault((r["label"], r["dim"]), []).append(unit(np.array(r["vec"])))
    return {k: found for k, v in groups.items() if (found := sampled_splits(np.stack(v), share, trees, leaf_rows))}


def descended(classes: DataFrame, splits: dict[tuple, Splits], trees: int) -> DataFrame:
    """Each class in every node of every tree at which its way down the splits ends: KEY, cid, n, vec."""
    held = classes.sparkSession.sparkContext.broadcast(splits)

    def ends(rows: np.ndarray, known: Splits) -> Iterator[tuple[int, int, int, np.ndarray]]:
        at = [(tree, 1, np.arange(len(rows))) for tree in range(trees)]
        while at:
            tree, node, mine = at.pop()
            if not len(mine):
                continue
            tries, mid = known.get((tree, node), (0, None))
            if mid is None:
                yield tree, node, tries, mine
                continue
            p = rows[mine] @ direction(tree, node, tries, rows.shape[1])
            at += [(tree, 2 * node, mine[p <= mid + SPILL]), (tree, 2 * node + 1, mine[p >= mid - SPILL])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            for key in dict.fromkeys(keys):
                mine = np.array([i for i, k in enumerate(keys) if k == key])
                vectors = np.stack([unit(v) for v in batch.column("vec").take(pa.array(mine)).to_numpy(zero_copy_only=False)])
                found = list(ends(vectors, held.value.get(key, {})))
                which = np.concatenate([mine[f[3]] for f in found])
                spread = lambda j, kind: pa.array(np.concatenate([np.full(len(f[3]), f[j]) for f in found]), kind)
                rows = batch.take(pa.array(which))
                named = {"tree": spread(0, pa.int32()), "node": spread(1, pa.int64()), "tries": spread(2, pa.int32())}
                yield pa.RecordBatch.from_arrays([named.get(c) if c in named else rows.column(c) for c in (*KEY, "cid", "n", "vec")], names=[*KEY, "cid", "n", "vec"])

    plain = classes.select("label", "dim", "cid", "n", "vec")
    empty = plain.withColumns({"tree": F.lit(0), "node": F.lit(1).cast("long"), "tries": F.lit(0)}).select(*KEY, "cid", "n", "vec")
    return plain.mapInArrow(run, empty.schema)


def leaves_of(classes: DataFrame, trees: int, leaf_rows: int) -> DataFrame:
    """Each class in every leaf of every tree that it falls into: KEY, cid, n, vec."""
    state = saved(descended(classes, forest(classes, trees, leaf_rows // 2), trees))
    done: list[DataFrame] = []
    while True:
        nodes = state.groupBy(*KEY).count().withColumn("open", (F.col("count") > leaf_rows) & (F.col("tries") < TRIES)).drop("count")
        marked = saved(state.join(nodes, KEY))
        discard(state)
        done.append(marked.filter("NOT open").drop("open"))
        if marked.filter("open").isEmpty():
            break
        lines = saved(projected(marked.filter("open").drop("open")))
        low, high = 1 - LARGEST_SIDE, LARGEST_SIDE
        at = lines.groupBy(*KEY).agg(F.percentile_approx("p", [low, 0.5, high], 1000).alias("q"))
        splits = at.select(*KEY, F.col("q")[1].alias("mid"), ((F.col("q")[0] < F.col("q")[1] - SPILL) & (F.col("q")[2] > F.col("q")[1] + SPILL)).alias("apart"))
        sides = F.array_compact(F.array(F.when(F.col("p") <= F.col("mid") + SPILL, F.col("node") * 2), F.when(F.col("p") >= F.col("mid") - SPILL, F.col("node") * 2 + 1)))
        moved = lines.join(splits, KEY).withColumn("next", F.explode(F.when(F.col("apart"), sides).otherwise(F.array("node"))))
        new = moved.select("label", "dim", "tree", F.col("next").alias("node"), F.when(F.col("apart"), 0).otherwise(F.col("tries") + 1).alias("tries"), "cid", "n", "vec")
        state = saved(new)
        discard(lines)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def compare(rows: pa.Table, leaf: int, same_block: bool, cosine: float) -> pa.Table:
    """Per class of the group: cid, links (its rows' other vectors, counted here first), root (a cid it links to)."""
    vec = np.stack([unit(v) for v in rows.column("vec").to_numpy()])
    cid, n = rows.column("cid").to_numpy(), rows.column("n").to_numpy()
    block = rows.column("b").to_numpy()
    near = vec @ vec.T >= cosine
    np.fill_diagonal(near, False)
    if not same_block:
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(near)
    links = np.zeros(len(cid), np.int64)
    root = np.arange(len(cid))
    if len(i):
        homes = rows.column("homes").to_pylist()
        earlier = {h: k for k, h in enumerate(sorted({h for x in homes for h in x if h < leaf}))}
        if earlier:
            member = np.zeros((len(cid), len(earlier)), np.float32)
            for r, x in enumerate(homes):
                member[r, [earlier[h] for h in x if h < leaf]] = 1
            first = near & (member @ member.T == 0)
        else:
            first = near
        links = first @ n
        root = local_roots(len(cid), i, j)
    keep = (links > 0) | (root != np.arange(len(cid)))
    return pa.table({"cid": cid[keep], "links": links[keep], "root": cid[root[keep]]})


def links_of(leaves: DataFrame, cosine: float) -> DataFrame:
    """cid, links, root of compare() over all leaves."""
    named = leaves.withColumn("leaf", F.xxhash64(*KEY)).drop(*KEY)
    sizes = named.groupBy("leaf").count().filter("count > 1").select("leaf", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    homes = named.groupBy("cid").agg(F.sort_array(F.collect_list("leaf")).alias("homes"))
    rows = named.join(sizes, "leaf").join(homes, "cid").withColumn("b", F.pmod(F.xxhash64("cid", "leaf"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"b1": F.least("b", "o"), "b2": F.greatest("b", "o")})

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        leaf, b1, b2 = (k.as_py() for k in key)
        return compare(rows, leaf, b1 == b2, cosine)

    return rows.select("leaf", "b1", "b2", "b", "cid", "n", "vec", "homes").groupBy("leaf", "b1", "b2").applyInArrow(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding, label).

    Vectors link where labels are equal and not null and their cosine, in double precision, is at least `cosine`; a
    null, zero or empty vector, one with null or non-finite components, and one of another length link with nothing.
    component_id is the smallest vec_id that links reach. Links are looked for in leaves of the forest: what it finds
    is verified; pairs that no leaf of any tree holds are missed (see the README for recall). Equal vectors always link.
    A row with a null vec_id has no part in links and is its own component, null. An empty table gives an empty table.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vec"))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vec"))
    linkable = rows.filter(good).withColumn("h", F.xxhash64("vec"))
    classes = saved(linkable.groupBy("label", "h", "vec").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")).withColumn("dim", F.size("vec")))
    found = saved(links_of(leaves_of(classes.drop("h"), trees, leaf_rows), cosine))
    comps = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    degrees = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = classes.join(degrees, "cid", "left").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    told = told.select("label", "h", "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    linked = linkable.join(told, ["label", "h", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
