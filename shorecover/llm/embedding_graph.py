"""Near duplicates among embeddings by a flat proximity graph.

Equal vectors are one node. Nodes are dealt to overlapping shards around pivots; each shard links
every node to a robust-pruned choice of its nearest ones and names its medoid; the lists of a node
from all its shards are united. Regions, wider and overlapping as well, then search: every node goes
best-first from the medoids and from its own list, and as long as something unexpanded lies within
the range, that is expanded too. What is met is verified in double precision. A sample searched in
full measures the recall, and too low a figure widens the overlap and runs again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import cut


@dataclass(frozen=True)
class Settings:
    """similarity: the least cosine of a link. shard, region: nodes of a build shard and of a search region, about; larger ones are cut into blocks.

    overlap, margin: a node belongs to its nearest pivot and to at most overlap - 1 others whose
    cosine is within the margin of it. degree, pool, alpha: neighbours kept of the pool of nearest
    ones, and how much nearer to a kept one another must be to go. expansions: nodes that each
    search expands at least. audit, recall: nodes searched in full, and the recall below which
    the overlap is widened, at most `widened` times.
    """

    similarity: float = 0.95
    shard: int = 512
    region: int = 4096
    overlap: int = 3
    margin: float = 0.1
    degree: int = 16
    pool: int = 48
    alpha: float = 1.2
    expansions: int = 16
    audit: int = 1000
    recall: float = 0.98
    widened: int = 2


#: Pivots are chosen among at most twice as many sampled nodes; at 64 dimensions of 8 bytes 16 MB reach the driver.
MOST_PIVOTS = 16_384
#: Pivots lie further apart than this cosine, so that a dense group has one of its own.
APART = 0.8
#: Queries searched together, and neighbours of a node in a search.
TOGETHER, MOST_NEAR = 256, 64
#: Similarities of the search are in 32 bits; what is within this of the limit is verified in 64.
SLACK = 1e-4


def usable(v: Column) -> Column:
    """Vectors that can link: not null, no null or non-finite component, not zero."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))


def nodes(vectors: DataFrame) -> DataFrame:
    """id, v, m of the distinct usable vectors of (id, v): the smallest id and the number of rows; shorter vectors are filled with zeros."""
    rows = vectors.where(F.col("id").isNotNull() & usable(F.col("v")))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    v = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    return rows.groupBy(v.alias("v")).agg(F.min("id").alias("id"), F.count("*").alias("m"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component goes first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def pivots(found: DataFrame, k: int) -> np.ndarray:
    """At most k unit vectors, no two nearer than APART, from a sample of the nodes in the order of a hash of their ids (at most 2 k, see MOST_PIVOTS)."""
    k = max(1, min(k, MOST_PIVOTS))
    sample = found.orderBy(F.xxhash64("id"), "id").limit(2 * k).select("v").toArrow()["v"]
    if not len(sample):
        return np.zeros((0, 0), np.float32)
    units = _unit(_matrix(sample)).astype(np.float32)
    kept = np.zeros((k, units.shape[1]), np.float32)
    n = 0
    for u in units:
        if n < k and (not n or (kept[:n] @ u).max() < APART):
            kept[n] = u
            n += 1
    return kept[:n]


def _places(units: np.ndarray, around: np.ndarray, how: Settings) -> list[np.ndarray]:
    """The pivots of each row, ascending."""
    near = units.astype(np.float32) @ around.T
    k = min(how.overlap, len(around))
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    close = np.take_along_axis(near, best, 1)
    return [np.sort(b[c >= c.max() - how.margin]) for b, c in zip(best, close, strict=True)]


def dealt(rows: DataFrame, around: np.ndarray, how: Settings) -> DataFrame:
    """rows (id, v and others) once for each of their places: with place, and places, all of them."""
    kept = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _places(_unit(_matrix(batch["v"])), around, how)
                lists = pa.array([f.tolist() for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*kept, "places"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(work, f"{kinds}, places array<int>").withColumn("place", F.explode("places"))


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """rows with blocks: how many blocks of about `size` their place needs; a row a place is joined."""
    counts = rows.groupBy("place").agg(F.greatest(F.lit(1), F.round(F.count("*") / size)).cast("int").alias("blocks"))
    return rows.join(counts, "place")


def pruned(units: np.ndarray, how: Settings, seed: int) -> np.ndarray:
    """[node, slot]: the robust-pruned neighbours of each node of a shard, and two drawn ones; empty slots hold the node itself.

    The nearest of the pool is kept and what lies alpha times nearer to it than to the node goes, and so on.
    """
    n = len(units)
    own = np.arange(n)
    sims = units @ units.T
    sims[own, own] = -np.inf
    pool = np.argpartition(-sims, min(how.pool, n) - 1, axis=1)[:, : min(how.pool, n)]
    pool = np.take_along_axis(pool, np.argsort(-np.take_along_axis(sims, pool, 1), axis=1), 1)
    away = 2 - 2 * np.take_along_axis(sims, pool, 1)  # squared; infinite for the node itself
    alive = np.isfinite(away)
    near = np.tile(own[:, None], (1, how.degree + 2))
    for slot in range(min(how.degree, pool.shape[1])):
        first = alive.argmax(1)
        some = alive[own, first]
        chosen = np.where(some, pool[own, first], own)
        near[:, slot] = chosen
        between = np.maximum(0, 2 - 2 * np.where(pool == chosen[:, None], 1, sims[chosen[:, None], pool]))
        alive &= how.alpha**2 * between > away
        alive[own, first] = False
    near[:, how.degree :] = np.random.default_rng(seed).integers(0, n, (n, 2))
    return near


def build(found: DataFrame, how: Settings, k: int) -> DataFrame:
    """id, near (neighbours, each once), medoid (whether it is one of a shard's) over all shards of a node."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        units, ids = _unit(_matrix(table["v"])).astype(np.float32), table["id"].to_numpy()
        near = pruned(units, how, key[0].as_py())
        medoid = np.arange(len(ids)) == (units @ units.sum(0)).argmax()
        lists = [np.unique(ids[row[row != i]]) for i, row in enumerate(near)]
        return pa.table({"id": table["id"], "near": pa.array(lists, pa.list_(pa.int64())), "medoid": pa.array(medoid)})

    members = _blocked(dealt(found.select("id", "v"), pivots(found, k), how), how.shard)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    lists = members.select("place", block.alias("block"), "id", "v").groupBy("place", "block").applyInArrow(work, "id long, near array<long>, medoid boolean")
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))


def expand(units: np.ndarray, near: np.ndarray, entries: np.ndarray, asked: np.ndarray, reach: float, least: int) -> np.ndarray:
    """[query, node] similarities of what each query (a row of units) meets, -inf elsewhere.

    Best-first: the nearest node met and not expanded is, at least `least` times, and beyond that while it lies within `reach`.
    """
    q = len(asked)
    met = np.full((q, len(units)), -np.inf, np.float32)
    waiting = met.copy()

    def meet(at: np.ndarray, row: np.ndarray) -> None:
        sims = np.einsum("ij,ij->i", units[asked[at]], units[row])
        met[at, row] = waiting[at, row] = sims

    start = np.concatenate((np.tile(entries, (q, 1)), asked[:, None]), 1)
    meet(np.repeat(np.arange(q), start.shape[1]), start.ravel())
    going, step = np.arange(q), 0
    while len(going):
        best = waiting[going].argmax(1)
        value = waiting[going, best]
        go = (value >= reach) if step >= least else np.isfinite(value)
        going, best = going[go], best[go]
        waiting[going, best] = -np.inf
        around = near[best]
        at, slot = np.nonzero(np.isneginf(met[going[:, None], around]))
        meet(going[at], around[at, slot])
        step += 1
    return met


def _within(units: np.ndarray, how: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, neighbours) of pruned lists made in a tile alone: the tile's own overlapping shards, of at most 2 how.shard nodes."""
    around = units[:: max(1, how.shard // 2)]
    k = min(2, len(around))
    place = np.argpartition(-(units @ around.T), k - 1, axis=1)[:, :k]
    found = []
    for p in range(len(around)):
        rows = np.flatnonzero((place == p).any(1))
        for part in np.array_split(rows, -(-len(rows) // (2 * how.shard)) or 1):
            if len(part):
                near = pruned(units[part], how, p)
                found.append((np.repeat(part, near.shape[1]), part[near.ravel()]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a[a != b], b[a != b]


def _slots(ids: np.ndarray, lists: pa.ChunkedArray, units: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """[node, slot] of the neighbours that lie here, both ways, the nearest MOST_NEAR; empty slots hold the node itself."""
    lists = lists.combine_chunks()
    a = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    to = lists.flatten().to_numpy()
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, to, sorter=order), len(ids) - 1)
    here = ids[order[at]] == to
    a, b = a[here], order[at[here]]
    if more:
        a, b = np.concatenate((a, more[0])), np.concatenate((b, more[1]))
    pairs = np.unique(np.concatenate((a * len(ids) + b, b * len(ids) + a)))
    a, b = pairs // len(ids), pairs % len(ids)
    sims = np.einsum("ij,ij->i", units[a], units[b])
    by = np.lexsort((-sims, a))
    a, b = a[by], b[by]
    slot = np.arange(len(a)) - np.searchsorted(a, a)
    kept = slot < MOST_NEAR
    out = np.tile(np.arange(len(ids))[:, None], (1, max(1, int(slot[kept].max(initial=0)) + 1)))
    out[a[kept], slot[kept]] = b[kept]
    return out


def _links(table: pa.Table, how: Settings, cut_up: bool) -> np.ndarray:
    """[node, node]: verified links met from either side. cut_up: part of a region, whose lists lead out of it, so that it gets lists of its own beside them."""
    v = _unit(_matrix(table["v"]))
    units = v.astype(np.float32)
    ids = table["id"].to_numpy()
    near = _slots(ids, table["near"], units, _within(units, how) if cut_up else None)
    medoids = np.flatnonzero(table["medoid"].to_numpy(zero_copy_only=False))
    entries = medoids[:: max(1, -(-len(medoids) // 64))] if len(medoids) else np.zeros(1, int)
    linked = np.zeros((len(v), len(v)), bool)
    for at in range(0, len(v), TOGETHER):
        asked = np.arange(at, min(at + TOGETHER, len(v)))
        met = expand(units, near, entries, asked, how.similarity - 0.02, how.expansions)
        a, b = np.nonzero(met >= how.similarity - SLACK)
        for part in range(0, len(a), 1 << 16):
            i, j = asked[a[part : part + (1 << 16)]], b[part : part + (1 << 16)]
            linked[i, j] = np.einsum("ij,ij->i", v[i], v[j]) >= how.similarity
    linked |= linked.T
    np.fill_diagonal(linked, False)
    return linked


def _here(rows: np.ndarray, all_places: np.ndarray, place: int) -> np.ndarray:
    """[row, node]: pairs of which this is the first place that both have, so that one place counts them."""
    shared = np.zeros((len(rows), len(all_places)), bool)
    for a in rows.T:
        for b in all_places.T:
            shared |= (a[:, None] == b) & (a >= 0)[:, None] & (a < place)[:, None]
    return ~shared


def search(found: DataFrame, lists: DataFrame, how: Settings, k: int) -> DataFrame:
    """id, n (rows of other nodes linked with it), root (the smallest id linked with it here) of each node in each region that has links of it."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # so the first of a component is the smallest id
        place, i, j = (x.as_py() for x in key)
        linked = _links(table, how, table["blocks"][0].as_py() > 1)
        places = table["places"].to_pylist()
        width = max(map(len, places))
        places = np.array([p + [-1] * (width - len(p)) for p in places])
        block, m, ids = table["block"].to_numpy(), table["m"].to_numpy(), table["id"].to_numpy()
        for at in range(0, len(ids), TOGETHER):
            part = slice(at, at + TOGETHER)
            linked[part] &= _here(places[part], places, place)
            if i != j:  # links within a block are those of its own tile
                linked[part] &= block[part][:, None] != block
        root, last = np.arange(len(ids)), None
        while last is None or (root != last).any():
            last = root.copy()
            for at in range(0, len(ids), TOGETHER):
                part = slice(at, at + TOGETHER)
                root[part] = np.minimum(root[part], np.where(linked[part], root, len(ids)).min(1))
        n = np.concatenate([linked[at : at + TOGETHER] @ m for at in range(0, len(ids), TOGETHER)])
        some = np.flatnonzero(n)
        return pa.table({"id": ids[some], "n": pa.array(n[some], pa.int64()), "root": ids[root[some]]})

    rows = _blocked(cut(dealt(found.join(lists, "id"), pivots(found, k), how)), how.region)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "place"), F.col("blocks")).cast("int"))
    # a region of several blocks is searched in tiles of two; each row goes to the tiles of its block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = rows.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    tiles = tiles.select("place", "i", "j", "block", "blocks", "id", "v", "m", "near", "medoid", "places")
    return tiles.groupBy("place", "i", "j").applyInArrow(work, "id long, n long, root long")


def measured(found: DataFrame, links: DataFrame, how: Settings) -> float:
    """The mean share of the links found, over those of how.audit nodes (the first by a hash of the id) that have any, each compared with all nodes; 1 where none has."""
    sample = found.orderBy(F.xxhash64("id"), "id").limit(how.audit).select("id", "v").toArrow()
    if not sample.num_rows:
        return 1.0
    units, ids = _unit(_matrix(sample["v"])), sample["id"].to_numpy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = units @ _unit(_matrix(batch["v"])).T >= how.similarity
                near &= ids[:, None] != batch["id"].to_numpy()
                total += near @ batch["m"].to_numpy()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], ["id", "every"])

    every = found.select("id", "v", "m").mapInArrow(work, "id long, every long").groupBy("id").agg(F.sum("every").alias("every"))
    share = every.join(links.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("every"))).first()[0]
    return 1.0 if share is None else share


@dataclass
class Found:
    rows: DataFrame
    #: Of the last run, on the audited sample.
    recall: float


def near_duplicates(embeddings: DataFrame, how: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> Found:  # noqa: B008
    """vec_id, n_links, component_id, kept of every row, and the measured recall.

    A vector that is null, zero, or holds a null or non-finite component, and a row without an
    id, link with nothing: no links, its own component, kept. Equal vectors link with each other
    without a pair of them being made; repeated rows count as vectors of their own. Shorter
    vectors are filled with zeros. Other columns are left out; an empty table gives an empty one.
    Tasks hold a region or two blocks of one, some 8000 nodes.
    """
    # 0.0 and -0.0 are one value
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c + F.lit(0.0))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), x.alias("v"))
    found = cut(nodes(rows))
    n = found.count()
    regions, shards = -(-how.overlap * n // how.region), -(-how.overlap * n // how.shard)
    for _ in range(how.widened + 1):
        links = cut(search(found, build(found, how, shards), how, regions)) if n else None
        recall = measured(found, links, how) if n else 1.0
        if recall >= how.recall:
            break
        how = replace(how, overlap=2 * how.overlap, margin=2 * how.margin)
    if not n:
        empty = rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        return Found(empty, recall)
    roots = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_node = found.join(links.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    of_node = of_node.select("v", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component"))
    width = F.lit(found.select(F.size("v")).first()[0])
    # what can't link gets no key, so it meets no node
    key = F.when(F.col("id").isNotNull() & usable(F.col("v")), F.concat("v", F.array_repeat(F.lit(0.0), width - F.size("v"))))
    every = rows.select("id", key.alias("key")).join(of_node, F.col("key") == F.col("v"), "left")
    component = F.coalesce("component", "id")
    out = every.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    return Found(out, recall)
