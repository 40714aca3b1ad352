"""Embedding near-duplicates: robust-pruned graphs of overlapping cluster shards, their adjacency
lists united, range-expanding greedy search from medoids, an audit of recall by shard, block against
block where it falls short."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, write_table
from .components import connected_components

THRESHOLD = 0.93
SHARD_ROWS = 3000          # larger shards are split again
ROWS_PER_CENTRE = 400
MOST_CENTRES = 64          # of one split
OVERLAP = 3                # nearest centres whose shards a vector joins
MARGIN = 0.35              # but none whose cosine is this much below the nearest one's
SHRINK = 0.9               # a shard that keeps more of its parent than this is dealt by hash
TIE_DIGITS = 12            # cosines equal to so many digits tie
TASK_ROWS = 20_000         # rows of a shard that one task assigns to its centres
POOL = 32                  # nearest candidates of a node before pruning
RANDOM = 8                 # and random ones, for long edges
DEGREE = 16
ALPHA = 1.2
BEAM = 24
AUDIT_QUERIES = 200
AUDIT_PER_SHARD = 8        # besides, of each shard of a split label
AUDIT_RECALL = 0.95
EXACT_ROWS = 8000          # rows of a block that is compared with every block of its label
TILE = 1 << 21             # products held at once


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if n else np.empty(0)
    return flat.astype(np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def medoid(unit: np.ndarray) -> int:
    return int(np.argmax(unit @ unit.mean(0)))


def build_graph(unit: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Adjacency lists: the nearest and some random nodes of each, robustly pruned (a candidate goes when
    a kept one is ALPHA times nearer to it than the node is), edges made mutual, and every part that the
    medoid doesn't reach hung to it."""
    n = len(unit)
    if n < 2:
        return [np.empty(0, np.int64) for _ in range(n)]
    rng = np.random.default_rng(seed)
    kept: list[list[int]] = [[] for _ in range(n)]
    near = min(POOL, n - 1)
    for a in range(0, n, 512):
        b = min(n, a + 512)
        sims = unit[a:b] @ unit.T
        sims[np.arange(b - a), np.arange(a, b)] = -2
        top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        pool = np.concatenate([top, rng.integers(0, n, (b - a, min(RANDOM, n)))], axis=1)
        s = np.take_along_axis(sims, pool, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        pool, s = np.take_along_axis(pool, order, axis=1), np.take_along_axis(s, order, axis=1)
        v = unit[pool]
        dist = 1 - v @ v.transpose(0, 2, 1)
        alive, count = s > -2, np.zeros(b - a, int)
        for r in range(pool.shape[1]):
            take = alive[:, r] & (count < DEGREE)
            count += take
            for i in np.flatnonzero(take):
                kept[a + i].append(int(pool[i, r]))
            alive &= ~(take[:, None] & (ALPHA * dist[:, r, :] <= (1 - s) + 1e-12) & (np.arange(pool.shape[1]) > r))
    sets = [set(x) for x in kept]
    for i, x in enumerate(kept):
        for j in x:
            sets[j].add(i)
    start = medoid(unit)
    seen, todo = {start}, [start]
    for i in [-1, *range(n)]:
        if i >= 0 and i not in seen:
            sets[start].add(i)
            sets[i].add(start)
            seen.add(i)
            todo.append(i)
        while todo:
            for j in sets[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
    return [np.fromiter(sorted(x), np.int64, len(x)) for x in sets]


def _near_among(own: np.ndarray, unit: np.ndarray, asked: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the (query, node) places marked in ``asked`` whose cosine is >= threshold: products of whole
    tiles where many places of a tile are marked, single ones elsewhere."""
    near = np.zeros_like(asked)
    step = max(1, TILE // unit.shape[1])
    for k in range(0, asked.shape[1], 256):
        part = asked[:, k:k + 256]
        count = np.count_nonzero(part)
        if count * 16 > part.size:
            near[:, k:k + 256] = part & (own @ unit[k:k + 256].T >= threshold)
        elif count:
            r, c = np.nonzero(part)
            for h in range(0, count, step):
                p, to = r[h:h + step], c[h:h + step] + k
                near[p, to] = np.einsum("ij,ij->i", own[p], unit[to]) >= threshold
    return near


def range_search(unit: np.ndarray, adjacency: list[np.ndarray], threshold: float,
                 queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) found with cosine >= threshold: all ``queries`` (nodes) walk in lockstep.  A greedy
    beam walks from the medoid to the query's surroundings; then each hit's neighbours are looked at
    until no hit is new."""
    n = len(unit)
    if n < 2 or not len(queries):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = max(1, max(map(len, adjacency)))
    links = np.full((n, width), -1, np.int64)
    for i, x in enumerate(adjacency):
        links[i, :len(x)] = x
    edge_to = np.concatenate(adjacency)
    order = np.argsort(edge_to, kind="stable")
    edge_from, edge_to = np.repeat(np.arange(n), [len(x) for x in adjacency])[order], edge_to[order]
    found_i, found_j = [], []
    start = medoid(unit)
    block = max(1, min((1 << 24) // n, (1 << 17) // width))
    for a in range(0, len(queries), block):
        q = queries[a:a + block]
        m = len(q)
        rows = np.arange(m)
        seen = np.zeros((m, n), bool)
        hit = np.zeros((m, n), bool)
        done = np.zeros((m, n), bool)                  # hits whose neighbours were looked at
        beam = np.full((m, BEAM), -1, np.int64)
        score = np.full((m, BEAM), -3.0)
        open_ = np.zeros((m, BEAM), bool)
        beam[:, 0], score[:, 0], open_[:, 0] = start, unit[q] @ unit[start], True
        seen[:, start] = True
        hit[rows, start] = score[:, 0] >= threshold
        while True:
            act = np.flatnonzero(open_.any(1))
            if not len(act):
                break
            pick = np.argmax(np.where(open_[act], score[act], -9), axis=1)
            open_[act, pick] = False
            node = beam[act, pick]
            done[act, node] = True
            nb = links[node]
            fresh = (nb >= 0) & ~seen[act[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            who, to = act[r], nb[r, c]
            s = np.einsum("ij,ij->i", unit[q[who]], unit[to])
            seen[who, to] = True
            hit[who, to] |= s >= threshold
            more = np.full(nb.shape, -3.0)
            more[r, c] = s
            both_n = np.concatenate([beam[act], nb], axis=1)
            both_s = np.concatenate([score[act], more], axis=1)
            both_o = np.concatenate([open_[act], more > -3], axis=1)
            top = np.argpartition(-both_s, BEAM - 1, axis=1)[:, :BEAM]
            beam[act], score[act], open_[act] = (np.take_along_axis(x, top, axis=1) for x in (both_n, both_s, both_o))
        new = hit & ~done
        while new.any():
            # All queries at once: a node's row of bits says which queries hit it anew, and a node is looked at by
            # those that hit a node with an edge to it.
            bits = np.packbits(new.T, axis=1)
            live = new.any(0)[edge_from]
            ends, first = np.unique(edge_to[live], return_index=True)
            if not len(ends):
                break
            looked = np.zeros((n, bits.shape[1]), np.uint8)
            looked[ends] = np.bitwise_or.reduceat(bits[edge_from[live]], first, axis=0)
            fresh = np.unpackbits(looked, axis=1, count=m).T.astype(bool) & ~seen
            seen |= fresh
            new = _near_among(unit[q], unit, fresh, threshold)
            hit |= new
        who, node = np.nonzero(hit)
        who = q[who]
        keep = who != node
        found_i.append(np.minimum(who, node)[keep])
        found_j.append(np.maximum(who, node)[keep])
    both = np.unique(np.concatenate(found_i) * n + np.concatenate(found_j))
    return both // n, both % n


def _drawn(cids: np.ndarray, centres: int, level: int) -> np.ndarray:
    """A number per vector and centre, fixed by the vector's class id."""
    with np.errstate(over="ignore"):
        z = cids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9) * np.arange(
            1 + level * centres, 1 + (level + 1) * centres, dtype=np.uint64)[None, :]
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(29))


def shards_of(classes: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(cid, shard, vec) -> memberships (cid, shard, vec, home): shards above ``SHARD_ROWS`` are split among
    centres (their members of smallest hash), each vector joining its nearest centres, until none is
    above; ``home`` marks the one shard of a vector that is nearest at each split.  A task holds one shard's centres and streams rows; hot shards are spread over tasks.

    Splitting ends on any data.  Centres whose cosines tie are taken in an order drawn by the vector's hash,
    so equal directions spread over all of them; and a shard that kept more than ``SHRINK`` of its parent is
    dealt to its centres by hash.  Links that this cuts show in the audit, whose exact way finds them."""
    rows, level = classes.withColumns({"home": F.lit(True), "above": F.lit(None).cast("long")}), 0
    done: list[DataFrame] = []
    while True:
        sizes = (rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("above").alias("was")).where(F.col("n") > SHARD_ROWS)
                 .withColumn("stuck", F.coalesce(F.col("n") > F.col("was") * SHRINK, F.lit(False))).drop("was"))
        sizes = cut(sizes.withColumn("salts", F.ceil(F.col("n") / TASK_ROWS).cast("int"))
                    .withColumn("k", F.least(F.lit(MOST_CENTRES), F.ceil(F.col("n") / ROWS_PER_CENTRE) + 2 * overlap).cast("int")))
        if sizes.isEmpty():
            done.append(rows.drop("above"))
            break
        done.append(rows.join(sizes.select("shard"), "shard", "left_anti").drop("above"))
        large = rows.drop("above").join(sizes, "shard")
        rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("cid", F.lit(level)), "cid"))
        centres = (large.withColumn("rank", rank).where(F.col("rank") <= MOST_CENTRES).where("rank <= k")
                   .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                   .select("shard", "salt", F.col("rank").cast("long").alias("cid"), "vec", "home", "n", "stuck", F.lit(0).alias("row")))
        dealt = (large.withColumn("salt", F.pmod(F.xxhash64("cid"), "salts").cast("int"))
                 .select("shard", "salt", "cid", "vec", "home", "n", "stuck", F.lit(1).alias("row")).unionByName(centres)
                 .repartition("shard", "salt").sortWithinPartitions("shard", "salt", "row"))

        def assign(batches):
            at, near = None, []
            for b in batches:
                pdf = b.select(["shard", "salt", "row", "home", "n", "stuck"]).to_pandas()
                home = pdf["home"].to_numpy()
                cids = b.column("cid").to_numpy()
                vecs = b.column("vec")
                run = pdf["shard"].ne(pdf["shard"].shift()) | pdf["salt"].ne(pdf["salt"].shift()) | pdf["row"].ne(pdf["row"].shift())
                edges = [*np.flatnonzero(run.to_numpy()).tolist(), len(pdf)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    key = (pdf["shard"].iat[lo], pdf["salt"].iat[lo])
                    part = vecs.slice(lo, hi - lo)
                    x = _unit(np.asarray(part.flatten()).astype(np.float64).reshape(hi - lo, -1))
                    if key != at:
                        at, near = key, []
                    if pdf["row"].iat[lo] == 0:
                        near.append(x)
                        continue
                    sims = x @ np.concatenate(near).T
                    k = 1 if pdf["stuck"].iat[lo] else min(overlap, sims.shape[1])
                    order = np.zeros(sims.shape) if pdf["stuck"].iat[lo] else -np.round(sims, TIE_DIGITS)
                    top = np.lexsort((_drawn(cids[lo:hi], sims.shape[1], level), order), axis=1)[:, :k]
                    best = np.take_along_axis(sims, top, axis=1)
                    r, c = np.nonzero(best >= best[:, :1] - MARGIN)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cids[lo:hi][r]), pa.array(np.full(len(r), key[0], np.int64)), pa.array(top[r, c]),
                         part.take(pa.array(r)), pa.array(home[lo:hi][r] & (c == 0)), pa.array(pdf["n"].to_numpy()[lo:hi][r])],
                        names=["cid", "shard", "centre", "vec", "home", "above"])

        split = dealt.mapInArrow(assign, "cid long, shard long, centre long, vec array<float>, home boolean, above long")
        rows = write_table(split.select("cid", F.xxhash64("shard", "centre", F.lit(level)).alias("shard"), "vec", "home", "above"),
                           f"shards{level}")
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _adjacency(t: pa.Table) -> pa.Table:
    t = t.sort_by("cid")
    cids = t["cid"].to_numpy()
    lists = build_graph(_unit(_matrix(t["vec"], len(cids))))
    return pa.table({"cid": cids, "near": pa.array([cids[x] for x in lists], pa.list_(pa.int64()))})


def _links(threshold: float):
    def fn(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        cids, n, shard = t["cid"].to_numpy(), t.num_rows, t["shard"][0].as_py()
        x = _matrix(t["vec"], n)
        where = {c: i for i, c in enumerate(cids.tolist())}
        lists = [np.fromiter((where[c] for c in near if c in where), np.int64) for near in t["near"].to_pylist()]
        home = t["home_shard"].to_numpy()
        i, j = range_search(_unit(x), lists, threshold - 1e-9, np.flatnonzero(home == shard))
        sure = np.zeros(len(i), bool)
        step = max(1, TILE // n)
        for k in range(0, n, step):          # pairs come sorted by i
            lo, hi = np.searchsorted(i, [k, min(n, k + step)])
            u, v = i[lo:hi], j[lo:hi]
            if len(u) * 16 > step * n:
                sure[lo:hi] = _near(x[k:k + step], x, threshold)[u - k, v]
            else:
                sure[lo:hi] = _cosines(x, u, x, v) >= threshold
        i, j = i[sure], j[sure]
        # Only a pair of vectors that are each a member of the other's home shard can be found twice, so
        # it goes out as a row; any other is counted here, in the one shard that can find it.
        own = t["shards"].to_pylist()
        wide = max(map(len, own))
        table = np.array([[*x, *[x[0]] * (wide - len(x))] for x in own], np.int64)
        far = np.where(home[i] == shard, j, i)
        twice = (home[i] != home[j]) & (table[i + j - far] == home[far][:, None]).any(1)
        pair_i, pair_j = i[twice], j[twice]
        i, j = i[~twice], j[~twice]
        sizes = t["size"].to_numpy()
        links = np.bincount(i, sizes[j], n) + np.bincount(j, sizes[i], n)
        lab = np.arange(n)
        while len(i):
            then = lab.copy()
            np.minimum.at(then, i, lab[j])
            np.minimum.at(then, j, lab[i])
            then = then[then]
            if (then == lab).all():
                break
            lab = then
        keep = (links > 0) | (lab != np.arange(n))
        one = pa.table({"cid": cids[keep], "links": links[keep].astype(np.int64), "low": cids[lab[keep]]})
        none = pa.nulls(one.num_rows, pa.int64())
        one = one.append_column("other", none).append_column("other_links", none)
        two = pa.table({"cid": cids[pair_i], "links": sizes[pair_j].astype(np.int64), "low": cids[pair_i],
                        "other": cids[pair_j], "other_links": sizes[pair_i].astype(np.int64)})
        return pa.concat_tables([one, two])
    return fn


def classes_of(vectors: DataFrame) -> DataFrame:
    """Rows with cid, the class of equal vectors of a label (null where a vector links with nothing)."""
    e = F.col("embedding")
    sound = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    ok = sound & F.col("label").isNotNull() & F.exists(e, lambda v: v != 0)
    return vectors.select("vec_id", "label", F.transform(e, lambda v: F.when(v == 0, 0.0).otherwise(v).cast("float")).alias("vec"),
                          ok.alias("ok")).select(
        "vec_id", "label", "vec", F.when(F.coalesce("ok", F.lit(False)), F.xxhash64("label", "vec")).alias("cid"))


def _searched(full: DataFrame, threshold: float) -> DataFrame:
    """Members with near, shards, home_shard and size -> (cid, links, low).  A pair that two shards
    found counts once, and one that either found is never lost."""
    rows = write_table(full.groupBy("shard").applyInArrow(
        _links(threshold), "cid long, links long, low long, other long, other_links long"), "links")
    pairs = cut(rows.where("other is not null").dropDuplicates(["cid", "other"]))
    return (rows.where("other is null").select("cid", "links", "low").unionByName(pairs.select("cid", "links", "low"))
            .unionByName(pairs.select(F.col("other").alias("cid"), F.col("other_links").alias("links"), F.col("cid").alias("low"))))


def _linked(classes: DataFrame, overlap: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(cid, vec, size, shard) -> (cid, links, low): links found per shard, and spanning edges; and
    (cid, home_shard)."""
    members = write_table(shards_of(classes.select("cid", "shard", "vec"), overlap), "members")
    near = members.select("cid", "shard", "vec").groupBy("shard").applyInArrow(_adjacency, "cid long, near array<long>")
    # Uniting the lists of a node's shards: as many lists as it has shards.
    near = near.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    own = members.groupBy("cid").agg(F.collect_set("shard").alias("shards"),
                                     F.max(F.when(F.col("home"), F.col("shard"))).alias("home_shard"))
    full = members.drop("home").join(near.join(own, "cid"), "cid").join(classes.select("cid", "size"), "cid")
    return _searched(full, threshold), members.where("home").select("cid", F.col("shard").alias("home_shard"))


def _cosines(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine of ``x[i]`` and ``y[j]``, pair by pair."""
    out = np.empty(len(i))
    step = max(1, TILE // x.shape[1])
    for k in range(0, len(i), step):
        a, b = x[i[k:k + step]], y[j[k:k + step]]
        norm = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        out[k:k + step] = np.einsum("ij,ij->i", a, b) / norm
    return out


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of ``x`` by rows of ``y``: cosine >= threshold.  Products of unit vectors decide all but
    those next to the threshold, which are worked out as the search's verification does."""
    sims = _unit(x) @ _unit(y).T
    near = sims >= threshold
    i, j = np.nonzero(np.abs(sims - threshold) < 1e-9)
    near[i, j] = _cosines(x, i, y, j) >= threshold
    return near


def _merge(lab: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``lab`` (each node's smallest known relative) after the edges u-v."""
    while True:
        low, high = np.minimum(lab[u], lab[v]), np.maximum(lab[u], lab[v])
        if (low == high).all():
            return lab
        np.minimum.at(lab, high, low)
        while not (lab[lab] == lab).all():
            lab = lab[lab]


def _block_links(threshold: float):
    def fn(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        cids, n = t["cid"].to_numpy(), t.num_rows
        x, sizes, block = _matrix(t["vec"], n), t["size"].to_numpy().astype(np.float64), t["block"].to_numpy()
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        links, lab = np.zeros(n), np.arange(n)
        step = max(1, TILE // max(1, len(b)))
        for k in range(0, len(a), step):
            r = a[k:k + step]
            near = _near(x[r], x[b], threshold) & (r[:, None] != b[None, :])
            links[r] += near @ sizes[b]
            if lo != hi:
                links[b] += sizes[r] @ near
            # Of the edges between parts, one a row and one a column join them, until none is left.
            while True:
                apart = near & (lab[r][:, None] != lab[b][None, :])
                p, q = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
                if not len(p):
                    break
                lab = _merge(lab, np.r_[r[p], r[apart[:, q].argmax(0)]], np.r_[b[apart[p].argmax(1)], b[q]])
        keep = links > 0
        return pa.table({"cid": cids[keep], "links": links[keep].astype(np.int64), "low": cids[lab[keep]]})
    return fn


def exact_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, vec, size, shard) -> (cid, links, low) of all links: within each label, every block of about
    ``EXACT_ROWS`` classes against every other and itself, a task a pair of blocks.  A task returns counts
    and spanning edges, no pairs."""
    sizes = classes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / EXACT_ROWS).cast("int").alias("blocks"))
    rows = (classes.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("cid", F.lit("block")), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.select("shard", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                       "block", "cid", "vec", "size")
    return cut(rows.groupBy("shard", "lo", "hi").applyInArrow(_block_links(threshold), "cid long, links long, low long"))


def weak_labels(classes: DataFrame, homes: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(shard): the split labels in which, for the vectors at home in some shard, less than ``AUDIT_RECALL``
    of the links were found.  Asks ``AUDIT_PER_SHARD`` classes of every shard (smallest hash), so a small lossy
    region shows however many links lie elsewhere; brute force over the label in salted tasks."""
    split = (classes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS)
             .select("shard", F.ceil(F.col("n") / TASK_ROWS).cast("int").alias("salts")))
    rows = classes.join(split, "shard")
    rank = F.row_number().over(Window.partitionBy("home_shard").orderBy(F.xxhash64("cid", F.lit("audit")), "cid"))
    asked = cut(rows.join(homes, "cid").withColumn("rank", rank).where(F.col("rank") <= AUDIT_PER_SHARD)
                .select("shard", "salts", "home_shard", "cid", "vec"))
    dealt = (asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .select("shard", "salt", "cid", "vec", F.lit(0).cast("long").alias("size"), F.lit(True).alias("asked"))
             .unionByName(rows.select("shard", F.pmod(F.xxhash64("cid"), "salts").cast("int").alias("salt"), "cid", "vec", "size",
                                      F.lit(False).alias("asked"))))

    def count(t: pa.Table) -> pa.Table:
        cids, x, sizes = t["cid"].to_numpy(), _matrix(t["vec"], t.num_rows), t["size"].to_numpy().astype(np.float64)
        q = t["asked"].to_numpy()
        a, b = np.flatnonzero(q), np.flatnonzero(~q)
        true = np.zeros(len(a))
        step = max(1, TILE // max(1, len(b)))
        for k in range(0, len(a), step):
            r = a[k:k + step]
            true[k:k + step] = (_near(x[r], x[b], threshold) & (cids[r][:, None] != cids[b][None, :])) @ sizes[b]
        return pa.table({"cid": cids[a], "true": true.astype(np.int64)})

    true = dealt.groupBy("shard", "salt").applyInArrow(count, "cid long, true long").groupBy("cid").agg(F.sum("true").alias("true"))
    got = found.groupBy("cid").agg(F.sum("links").alias("got"))
    return (asked.select("shard", "home_shard", "cid").join(true, "cid").join(got, "cid", "left")
            .groupBy("shard", "home_shard").agg(F.sum("true").alias("true"), F.sum(F.coalesce("got", F.lit(0))).alias("got"))
            .where(F.col("got") < F.col("true") * AUDIT_RECALL).select("shard").distinct())


def audit(classes: DataFrame, found: DataFrame, threshold: float = THRESHOLD, queries: int = AUDIT_QUERIES) -> float:
    """Share of the links of ``queries`` classes (smallest hash) that were found; a brute-force count
    against all classes, in blocks, gives all of them.  The driver holds the queries only."""
    asked = (classes.join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
             .orderBy(F.xxhash64("cid", F.lit("audit")), "cid").limit(queries)
             .select("cid", "shard", "vec", F.coalesce("links", F.lit(0)).alias("links")).collect())
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for s in {r["shard"] for r in asked}:
        own = [r for r in asked if r["shard"] == s]
        sets[s] = (np.array([r["cid"] for r in own]), np.array([r["vec"] for r in own], np.float64))

    def count(batches):
        for pdf in batches:
            total = 0
            for s, part in pdf.groupby("shard"):
                if s in sets:
                    ids, x = sets[s]
                    y = np.stack(part["vec"].to_list()).astype(np.float64)
                    near = (_unit(x) @ _unit(y).T >= threshold) & (ids[:, None] != part["cid"].to_numpy()[None, :])
                    total += int((near * part["size"].to_numpy()[None, :]).sum())
            yield pd.DataFrame({"n": [total]})

    true = classes.select("cid", "shard", "vec", "size").mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0
    return sum(r["links"] for r in asked) / true if true else 1.0


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, embedding, label) -> one row per row: vec_id, n_links, component_id, kept, audited_recall.

    Vectors compare within a label (and a length) only.  Equal vectors form one class that is searched
    once, whatever its size.  Classes are put into overlapping cluster shards; each shard builds a
    robust-pruned graph; a node's adjacency lists are united over its shards; then each shard searches
    that graph from its medoid for the vectors at home in it, verifies hits in double precision, and returns
    counts and spanning edges; a pair that two shards can find is a row, counted once from either side (at most
    ``SHARD_ROWS`` a vector).  Labels that were split and in which the audit of some shard
    finds less than ``AUDIT_RECALL`` of the links are compared block against block, and so is the whole table
    if the audit over all of it still stays below.

    Null, zero or non-finite vectors and null labels link with nothing (their component is their own
    vec_id); a null vec_id takes part but is never a component's smallest id; rows that repeat are
    equal vectors; an empty table gives no rows.
    """
    rows = cut(classes_of(vectors))
    classes = cut(rows.where("cid is not null").groupBy("cid").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("size"),
        F.min("vec_id").alias("low_id")).withColumn("shard", F.xxhash64("label", F.size("vec"))))
    found, homes = _linked(classes, OVERLAP, threshold)
    weak = cut(weak_labels(classes, homes, found, threshold))
    if not weak.isEmpty():
        again = classes.join(weak, "shard", "left_semi")
        found = cut(found.join(again, "cid", "left_anti").unionByName(exact_links(again, threshold)))
    recall = audit(classes, found, threshold)
    if recall < AUDIT_RECALL:
        found = exact_links(classes, threshold)
        recall = audit(classes, found, threshold)
    comp = connected_components(found.select(F.col("cid").alias("u"), F.col("low").alias("v")))
    per = (classes.select("cid", "size", "low_id")
           .join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
           .join(comp.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    low = per.groupBy("root").agg(F.min("low_id").alias("component"))
    per = per.join(low, "root").select("cid", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), "component")
    out = rows.select("vec_id", "cid").join(per, "cid", "left")
    comp_id = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.col("vec_id").eqNullSafe(comp_id).alias("kept"), F.lit(float(recall)).alias("audited_recall"))
