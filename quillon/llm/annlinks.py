"""Operator 2: near-duplicate vectors, by a robust-pruned flat graph and range-expanding greedy search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Shelf
from quillon.llm.components import components
from quillon.llm.topk import usable

THRESHOLD = 0.93
# Rows that one shard aims at, and the rows of the sample that centres are drawn from.
SHARD_ROWS = 2048
SAMPLE_ROWS = 20_000
# Shards that a vector is in: those of its nearest centres.
OVERLAP = 2
# Graph: candidates looked at per vertex, edges kept, and the pruning slack.
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.2
# Search: width of the beam, and the share of audited links that a search must find before a wider beam is tried.
BEAM, AUDIT_ROWS, RECALL = 16, 64, 0.999
# Vertices, about, whose links are counted against all rows of their labels.
AUDIT = 512


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision, scaled to length one."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Of every vertex's candidates (nearest first, -1 for none), those that no kept one is much closer to; -1 fills up.

    A candidate goes when alpha times its distance to a kept one is at most its distance to the vertex, so that long edges stay and
    greedy search gets across. All vertices are pruned together, candidate by candidate.
    """
    n, c = near.shape
    out = np.full((n, degree), -1, np.int64)
    for s in range(0, n, 512):
        cand = near[s : s + 512]
        v = x[np.maximum(cand, 0)]
        among = np.sqrt(np.maximum(0.0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
        own = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("bid,bd->bi", v, x[s : s + 512])))
        alive, count = cand >= 0, np.zeros(len(cand), np.int64)
        for i in range(c):
            take = alive[:, i] & (count < degree)
            rows = np.flatnonzero(take)
            out[s + rows, count[rows]] = cand[rows, i]
            count[rows] += 1
            gone = alpha * among[rows, i] <= own[rows]
            gone[:, : i + 1] = False
            alive[rows] &= ~gone
    return out


def dots(x: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Inner products of rows a[i] and b[i] of x; only ``step`` pairs of rows are laid out at once."""
    out = np.empty(len(a))
    for s in range(0, len(a), step):
        out[s : s + step] = np.einsum("ij,ij->i", x[a[s : s + step]], x[b[s : s + step]])
    return out


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of every row, nearest first (-1 fills up), block by block."""
    n = len(x)
    k = min(k, n - 1)
    out = np.full((n, max(k, 1)), -1, np.int64)
    if k <= 0:
        return out
    for s in range(0, n, 512):
        sim = x[s : s + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        part = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sim, part, axis=1), axis=1, kind="stable")
        out[s : s + 512] = np.take_along_axis(part, order, axis=1)
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Adjacency of one shard: pruned nearest candidates, with the reverse edges pruned in."""
    near = nearest(x, CANDIDATES)
    out = robust_prune(x, near)
    src, col = np.nonzero(out >= 0)
    dst = out[src, col]
    # Reverse edges, nearest sources first, join the vertex's own edges and are pruned again.
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    both = np.unique(a * len(x) + b)
    a, b = both // len(x), both % len(x)
    d = dots(x, a, b)
    order = np.lexsort((-d, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < CANDIDATES
    wide = np.full((len(x), CANDIDATES), -1, np.int64)
    wide[a[keep], rank[keep]] = b[keep]
    return robust_prune(x, wide)


def range_search(x: np.ndarray, adjacency: np.ndarray, entry: np.ndarray, queries: np.ndarray, threshold: float, beam: int):
    """For queries (rows of x): pairs (query, vertex) with cosine at the threshold or above, by greedy search.

    Every search starts from the shard's medoids and its own vertex, expands the best ``beam`` vertices met so far, and all that
    lie in range, until none is left unexpanded. All queries of a block go on together; a round touches what it meets and what is
    still open, and the best of each query are carried over.
    """
    n, found_q, found_v = len(x), [], []
    block = max(1, (1 << 23) // max(1, n * 8))
    for s in range(0, len(queries), block):
        q = queries[s : s + block]
        seen, best = np.zeros((len(q), n), bool), np.full((len(q), beam), -np.inf)
        new = np.zeros((len(q), n), bool)
        new[:, entry] = True
        new[np.arange(len(q)), q] = True
        row, col = np.nonzero(new)
        open_row, open_col, open_sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        while len(row):
            seen[row, col] = True
            sim = dots(x, q[row], col)
            hit = (sim >= threshold) & (col != q[row])
            found_q.append(q[row[hit]])
            found_v.append(col[hit])
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            wide = np.full((len(q), beam + int(rank.max()) + 1), -np.inf)
            wide[:, :beam] = best
            wide[row, beam + rank] = sim
            best = np.partition(wide, wide.shape[1] - beam, axis=1)[:, wide.shape[1] - beam :]
            least = np.minimum(np.maximum(best[:, 0], -2), threshold)
            open_row, open_col, open_sim = (np.concatenate(z) for z in ((open_row, row), (open_col, col), (open_sim, sim)))
            front = open_sim >= least[open_row]
            r, c = open_row[front], open_col[front]
            open_row, open_col, open_sim = open_row[~front], open_col[~front], open_sim[~front]
            nxt = adjacency[c]
            r, c = np.repeat(r, nxt.shape[1]), nxt.ravel()
            some = c >= 0
            new[:] = False
            new[r[some], c[some]] = True
            new &= ~seen
            row, col = np.nonzero(new)
    return np.concatenate([np.zeros(0, np.int64), *found_q]), np.concatenate([np.zeros(0, np.int64), *found_v])


def medoids(x: np.ndarray, k: int = 4) -> np.ndarray:
    """The row nearest to the mean, and the rows nearest to the means of up to k - 1 parts around far-apart rows."""
    centre = int((x @ x.mean(axis=0)).argmax())
    picked, sim = [centre], x @ x[centre]
    while len(picked) < min(k, len(x)):
        far = int(sim.argmin())
        if far in picked:
            break
        picked.append(far)
        sim = np.maximum(sim, x @ x[far])
    part = (x @ x[picked].T).argmax(axis=1)
    return np.unique([centre] + [int(np.flatnonzero(part == p)[(x[part == p] @ x[part == p].mean(axis=0)).argmax()]) for p in range(len(picked))])


def links_of(x: np.ndarray, adjacency: np.ndarray, audit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of a part in range of each other, by searches from every row; the rows ``audit`` are checked against all.

    While the audit is short the beam is doubled. Once the lists of a wider beam name as many rows as there are, a search is no less
    work than comparing all rows block by block, and that is done instead: it misses nothing.
    """
    n, entry, beam = len(x), medoids(x), BEAM
    want = x[audit] @ x.T >= threshold
    want[np.arange(len(audit)), audit] = False
    while True:
        fq, fv = range_search(x, adjacency, entry, np.arange(n), threshold, beam)
        if np.bincount(fq, minlength=n)[audit].sum() >= RECALL * want.sum():
            return fq, fv
        if 2 * beam * DEGREE >= n:
            fq, fv = in_range(x, x, threshold)
            return fq[fq != fv], fv[fq != fv]
        beam *= 2


def _centres(vectors: DataFrame, shard_rows: int) -> dict[tuple[int, int], np.ndarray]:
    """Centres per (label, width) of more than one shard, refined on a bounded sample."""
    sizes = vectors.groupBy("label", "width").agg(F.count("*").alias("n"))
    sample = vectors.withColumn("h", F.xxhash64("id")).orderBy("h").limit(SAMPLE_ROWS).select("label", "width", "v").toArrow()
    rows = sizes.filter(F.col("n") > shard_rows).collect()
    out = {}
    labels, widths = sample.column("label").to_numpy(), sample.column("width").to_numpy()
    for r in rows:
        mine = np.flatnonzero((labels == r["label"]) & (widths == r["width"]))
        want = min(-(-OVERLAP * r["n"] // shard_rows), max(1, len(mine) // 4))
        if want < 2:
            continue
        x = unit_rows(sample.column("v").combine_chunks().take(pa.array(mine)))
        c = x[np.linspace(0, len(x) - 1, want).astype(int)]
        for _ in range(8):
            near = (x @ c.T).argmax(axis=1)
            for j in range(len(c)):
                if (near == j).any():
                    m = x[near == j].mean(axis=0)
                    c[j] = m / max(np.linalg.norm(m), 1e-12)
        out[(r["label"], r["width"])] = c
    return out


def reach(x: np.ndarray, c: np.ndarray, threshold: float, step: int = 512):
    """(home, row, shard): each unit row's nearest centre, and the other centres whose nearest rows can be in range of it.

    A row u whose nearest centre is s lies on the side of s of the plane between s and the centre h of x. If u is within
    the angle acos(threshold) of x, the sine of x's own angle to that plane is sin(acos(threshold)) at most, or x is on the side of s, too.
    """
    limit = (1 - threshold * threshold) ** 0.5 if threshold > 0 else 2.0
    home, row, shard = np.zeros(len(x), np.int64), [], []
    for i in range(0, len(x), step):
        sim = x[i : i + step] @ c.T
        home[i : i + step] = h = np.argsort(-sim, axis=1, kind="stable")[:, 0]
        apart = np.sqrt(np.maximum(0.0, (c[h] ** 2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * c[h] @ c.T))
        near = sim[np.arange(len(h)), h][:, None] - sim <= limit * apart + 1e-6
        near[np.arange(len(h)), h] = False
        r, s = np.nonzero(near)
        row.append(i + r)
        shard.append(s)
    return home, np.concatenate([np.zeros(0, np.int64), *row]), np.concatenate([np.zeros(0, np.int64), *shard])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", column: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audit_links, audit_found.

    Vectors link when labels are equal and not null and their cosine, in double precision, reaches the threshold. Equal vectors of a
    label are one vertex from the start. Vertices are dealt to overlapping shards around centres (fitted on a bounded sample);
    each shard builds a robust-pruned graph. The shards' adjacency lists are united per vertex; every shard then searches, for each
    of its vertices, through the united lists of its members. Over-full shards are cut into parts by hash. All other parts where a
    vertex can have links are compared with it block by block: parts of its own shards, and every shard that the plane between its
    nearest centre and the shard's does not rule out (see ``reach``). No pair is lost between shards; on vectors without clusters
    little is ruled out, and the work is that of all pairs of a label. A pair counts in the shard of the found vertex's nearest
    centre only. Only counts and a spanning forest of the links leave a task, so a tight group of thousands gives thousands of rows.
    Searches of some vertices are checked against all of the part; a part whose recall is short is searched with
    a beam twice as wide, and in the end against all of it (see ``links_of``). audit_links is the number of links that about AUDIT hashed vertices have among
    all rows of their labels, and audit_found what the search counted for them (0 for vertices that are not audited).
    Vectors that are null, zero or hold null or non-finite components, and null labels or ids, link with nothing;
    vectors of different widths do not link. Rows that repeat an id are one vertex each by their vector; component_id is the
    smallest id of the component.
    """
    spark = vectors.sparkSession
    shelf = Shelf(spark)
    value = F.transform(F.col(column), lambda x: x.cast("double"))
    able = usable(F.col(column)) & F.exists(F.col(column), lambda x: x != 0) & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(able, F.col(label)).alias("label"), F.when(able, value).alias("v"))
    rows = rows.withColumn("name", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    rows = shelf.put(rows.withColumn("check", F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v"), 256))), "rows")
    same = rows.filter("name is not null").groupBy(F.col("name").alias("id"), "check").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    points = shelf.put(same.select("id", "first", "weight", F.xxhash64("label").alias("label"), F.size("v").alias("width"), "v"), "points")
    centres = spark.sparkContext.broadcast(_centres(points, shard_rows))

    def deal(batches):
        for t in batches:
            labels, widths = t.column("label").to_numpy(), t.column("width").to_numpy()
            shards = np.full((t.num_rows, OVERLAP), -1, np.int64)
            shards[:, 0] = 0
            row, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for (la, w), c in centres.value.items():
                mine = np.flatnonzero((labels == la) & (widths == w))
                if len(mine):
                    x = unit_rows(t.column("v").take(pa.array(mine)))
                    k = min(OVERLAP, len(c))
                    for i in range(0, len(x), 512):
                        shards[mine[i : i + 512][:, None], np.arange(k)] = np.argsort(-(x[i : i + 512] @ c.T), axis=1, kind="stable")[:, :k]
                    _, r, s = reach(x, c, threshold)
                    row.append(mine[r])
                    other.append(s)
            row, other = np.concatenate(row), np.concatenate(other)
            more = (shards[row] != other[:, None]).all(axis=1)
            row, other = row[more], other[more]
            order = np.argsort(row, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1, dtype=np.int32) * OVERLAP), pa.array(shards.ravel()))
            others = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(t.num_rows + 1)).astype(np.int32)), pa.array(other[order]))
            yield pa.RecordBatch.from_arrays([*t.columns, lists, others], names=[*t.schema.names, "shards", "others"])

    dealt = points.select("id", "weight", "label", "width", "v").mapInArrow(deal, "id long, weight long, label long, width int, v array<double>, shards array<long>, others array<long>")
    dealt = shelf.put(dealt, "dealt")
    members = dealt.drop("others").select("*", F.explode(F.filter("shards", lambda x: x >= 0)).alias("shard"))
    sizes = members.groupBy(F.col("label").alias("l_"), F.col("width").alias("w_"), F.col("shard").alias("s_")).agg(F.ceil(F.count("*") / (4 * shard_rows)).cast("int").alias("parts"))
    sizes = shelf.put(sizes, "sizes")
    placed = members.join(sizes, (F.col("label") == F.col("l_")) & (F.col("width") == F.col("w_")) & (F.col("shard") == F.col("s_"))).drop("l_", "w_", "s_")
    placed = shelf.put(placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "placed")
    by = ["label", "width", "shard", "part"]

    def edges(key_, t):
        x, ids = unit_rows(t.column("v").combine_chunks()), t.column("id").to_numpy()
        adjacency = build(x)
        lists = [ids[a[a >= 0]] for a in adjacency]
        return pa.table({"id": pa.array(ids), "to": pa.array(lists, pa.list_(pa.int64()))})

    graph = placed.select(*by, "id", "v").groupBy(*by).applyInArrow(edges, "id long, to array<long>")
    graph = shelf.put(graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")), "graph")
    held = placed.join(graph.withColumnRenamed("id", "g_id"), F.col("id") == F.col("g_id")).select(*by, "id", "weight", "v", "shards", "to")

    def search(key_, t):
        shard = key_[2].as_py()
        ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
        x = unit_rows(t.column("v").combine_chunks())
        order = np.argsort(ids)
        to = t.column("to").combine_chunks()
        src, dst = np.repeat(np.arange(len(ids)), np.diff(np.asarray(to.offsets))), to.flatten().to_numpy()
        p = np.minimum(np.searchsorted(ids[order], dst), len(ids) - 1)
        here = ids[order][p] == dst
        src, dst = src[here], order[p[here]]
        rank = np.arange(len(src)) - np.searchsorted(src, src)
        adjacency = np.full((len(ids), max(1, int(rank.max(initial=0)) + 1)), -1, np.int64)
        adjacency[src, rank] = dst
        audit = np.argsort((ids * np.int64(2654435761)) % 1_000_003, kind="stable")[:AUDIT_ROWS]
        fq, fv = links_of(x, adjacency, audit, threshold)
        # A pair counts, once for each side that asks, in the shard of the found vertex's nearest centre.
        home = t.column("home").to_numpy()
        mine = home[fv] == shard
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, fq[mine], weight[fv[mine]])
        a, b = spanning(fq, fv, len(ids))
        return pa.table({"id": pa.array(np.concatenate([ids, ids[a]])), "other": pa.array(np.concatenate([ids, ids[b]])), "links": pa.array(np.concatenate([links, np.zeros(len(a), np.int64)]))})

    held = held.withColumn("home", F.element_at("shards", 1))
    found = held.groupBy(*by).applyInArrow(search, "id long, other long, links long")

    # What no search has seen: vertices against the home members of other parts and shards, in salted groups of bounded size.
    whole = dealt.select("id", "label", "width", "shards", F.array_union(F.filter("shards", lambda x: x >= 0), "others").alias("ask"))
    asks = whole.select("id", "label", "width", "shards", F.explode("ask").alias("shard"))
    asks = asks.join(sizes, (F.col("label") == F.col("l_")) & (F.col("width") == F.col("w_")) & (F.col("shard") == F.col("s_"))).drop("l_", "w_", "s_")
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = asks.filter(~(F.array_contains("shards", F.col("shard")) & (F.col("part") == F.pmod(F.xxhash64("id"), F.col("parts")))))
    asks = shelf.put(asks.select("id", *by), "asks")
    salts = asks.groupBy(*[F.col(c).alias(f"{c}_") for c in by]).agg(F.ceil(F.count("*") / (4 * shard_rows)).cast("int").alias("salts"))
    salts = shelf.put(salts, "salts")
    same_part = [F.col(c) == F.col(f"{c}_") for c in by]
    left = asks.join(salts, same_part).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.col("salts")).cast("int")).select("id", *by, "salt")
    left = left.join(dealt.select(F.col("id").alias("d_"), "v"), F.col("id") == F.col("d_")).drop("d_")
    right = placed.filter(F.element_at("shards", 1) == F.col("shard")).join(salts, same_part)
    right = right.select("id", "weight", "v", *by, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def cross(key_, q, t):
        qids, ids = q.column("id").to_numpy(), t.column("id").to_numpy()
        if not len(qids) or not len(ids):
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "other", "links")})
        links, label = linked(unit_rows(q.column("v").combine_chunks()), unit_rows(t.column("v").combine_chunks()), t.column("weight").to_numpy(), threshold)
        both = np.concatenate([qids, ids])
        a = np.flatnonzero(label != np.arange(len(both)))
        b = label[a]
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(np.concatenate([qids[some], both[a]])), "other": pa.array(np.concatenate([qids[some], both[b]])), "links": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]))})

    # Groups are small in bytes and heavy in work: a stated count keeps them from being merged into few tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.repartition(tasks, *by, "salt") for side in (left, right))
    over = left.groupBy(*by, "salt").cogroup(right.groupBy(*by, "salt")).applyInArrow(cross, "id long, other long, links long")
    found = shelf.put(found.union(over), "found")
    shelf.drop(dealt, sizes, placed, graph, asks, salts)
    roots = shelf.put(components(found.filter("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), shelf), "roots")
    totals = found.groupBy(F.col("id").alias("t_id")).agg(F.sum("links").alias("others"))
    audited = audit_links(points, threshold)
    known = points.select("id", "first", "weight").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    smallest = known.groupBy(F.col("root").alias("r_")).agg(F.min("first").alias("component"))
    known = known.join(smallest, known["root"] == smallest["r_"]).join(totals, known["id"] == totals["t_id"], "left").join(audited, known["id"] == audited["a_id"], "left")
    links = F.col("weight") - 1 + F.coalesce("others", F.lit(0))
    known = shelf.put(known.select("id", "component", links.alias("links"), "audit_links", F.when(F.col("audit_links").isNotNull(), links).alias("audit_found")), "known")
    out = rows.select("vec_id", "name").join(known, F.col("name") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id").cast("long")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("audit_links", F.lit(0)).alias("audit_links"), F.coalesce("audit_found", F.lit(0)).alias("audit_found"),
    )


def in_range(q: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) with cosine at the threshold or above, block by block."""
    pairs = [np.nonzero(q[s : s + 512] @ x.T >= threshold) for s in range(0, len(q), 512)]
    return np.concatenate([np.zeros(0, np.int64), *[i * 512 + p[0] for i, p in enumerate(pairs)]]), np.concatenate([np.zeros(0, np.int64), *[p[1] for p in pairs]])


def audit_links(points: DataFrame, threshold: float) -> DataFrame:
    """(a_id, audit_links): the links of about AUDIT vertices, chosen by hash, among all rows of their labels."""
    share = max(1, points.count() // AUDIT)
    chosen = points.filter(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(share)) == 0).orderBy("id").limit(4 * AUDIT).select("id", "label", "width", "v").toArrow()
    groups = {}
    if chosen.num_rows:
        labels, widths = chosen.column("label").to_numpy(), chosen.column("width").to_numpy()
        for la, w in set(zip(labels.tolist(), widths.tolist())):
            mine = np.flatnonzero((labels == la) & (widths == w))
            groups[la, w] = (chosen.column("id").to_numpy()[mine], unit_rows(chosen.column("v").combine_chunks().take(pa.array(mine))))
    asked = points.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        for t in batches:
            labels, widths = t.column("label").to_numpy(), t.column("width").to_numpy()
            for (la, w), (ids, q) in asked.value.items():
                mine = np.flatnonzero((labels == la) & (widths == w))
                if len(mine):
                    near = q @ unit_rows(t.column("v").take(pa.array(mine))).T >= threshold
                    own = ids[:, None] == t.column("id").to_numpy()[mine]
                    weight = t.column("weight").to_numpy()[mine]
                    links = np.where(own, weight - 1, near * weight).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["a_id", "links"])

    return points.select("id", "weight", "label", "width", "v").mapInArrow(run, "a_id long, links long").groupBy("a_id").agg(F.sum("links").alias("audit_links"))


def linked(q: np.ndarray, x: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The weight of the rows of x in range of each row of q, and the smallest row of each one's component (rows of q, then of x); pairs are not stored."""
    n, links, label = len(q), np.zeros(len(q), np.int64), np.arange(len(q) + len(x))
    for s in range(0, n, 512):
        near = q[s : s + 512] @ x.T >= threshold
        r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if len(r):
            near = near[np.ix_(r, c)]
            links[s + r] = np.rint(near.astype(np.float64) @ weight[c]).astype(np.int64)
            # A first partner of each side joins most of them; what lies apart then is joined pair by pair.
            a, b = np.concatenate([r, r[near.argmax(axis=0)]]), np.concatenate([c[near.argmax(axis=1)], c])
            label = joined(label, s + a, n + b)
            i, j = np.nonzero(near & (label[s + r][:, None] != label[n + c]))
            label = joined(label, s + r[i], n + c[j])
    return links, label


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest row of each component) after the pairs are joined, too."""
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star from each vertex of a component to its smallest: at most n edges that connect what the pairs connect."""
    label = joined(np.arange(n), a, b)
    away = np.flatnonzero(label != np.arange(n))
    return away, label[away]
