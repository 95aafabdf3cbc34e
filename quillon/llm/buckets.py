"""Components of similar items out of banded sketches, without ever listing the pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Shelf
from quillon.llm.components import components

# Members of a bucket that one task compares with as many others.
BLOCK = 2048
# Sets of at most so many members are cut to 16 bits a member.
SHORT = 2000
# Rows of small buckets that are handed to Python together, about.
BIN = 512
# How many partners an item is offered in each round: all of a bucket's come in turn, best first.
FIRST_WINDOW, GROWTH = 16, 8

Compare = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def sketch_matrix(column: pa.Array, dtype) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1)


def _screen(pairs: DataFrame, items: DataFrame, compare: Compare, dtype, threshold: float, cut: float) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose sketches make a similarity of ``cut`` or more most likely."""
    a = items.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = items.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                est = compare(sketch_matrix(t.column("sa"), dtype), sketch_matrix(t.column("sb"), dtype), t.column("na").to_numpy(), t.column("nb").to_numpy())
                yield t.select(["a", "b"]).filter(pa.array(est >= cut))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _offering(*settings):
    """A function for groups of whole buckets (or blocks of buckets); many small ones share a group."""

    def run(queries, members):
        a, b = [], []
        if queries.num_rows and members.num_rows:
            qk, ck = (np.rec.fromarrays([t.column(x).to_numpy() for x in ("key", "qblock", "cblock")], names="key,qblock,cblock") for t in (queries, members))
            keys, inverse = np.unique(np.concatenate([qk, ck]), return_inverse=True)
            qo, co = np.argsort(inverse[: len(qk)], kind="stable"), np.argsort(inverse[len(qk) :], kind="stable")
            q, c = _columns(queries, settings[1], qo), _columns(members, settings[1], co)
            qcut, ccut = (np.searchsorted(x, np.arange(len(keys) + 1)) for x in (inverse[: len(qk)][qo], inverse[len(qk) :][co]))
            for i in range(len(keys)):
                if qcut[i] < qcut[i + 1] and ccut[i] < ccut[i + 1]:
                    x, y = _offers([v[qcut[i] : qcut[i + 1]] for v in q], [v[ccut[i] : ccut[i + 1]] for v in c], *settings)
                    a += x
                    b += y
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _columns(t: pa.Table, dtype, order: np.ndarray) -> list[np.ndarray]:
    short = np.empty(t.num_rows, object)
    short[:] = t.column("short").to_pylist()
    return [*(t.column(x).to_numpy()[order] for x in ("id", "root", "n")), sketch_matrix(t.column("sketch"), dtype)[order], short[order]]


def shorten(members: np.ndarray) -> bytes:
    """A set's 64-bit members cut to 16 bits, or to 32 if there are many: enough to bound its intersections from above."""
    return members.astype(np.uint16 if len(members) <= SHORT else np.uint32).tobytes()


def _open(short: bytes, n: int) -> np.ndarray:
    return np.frombuffer(short, np.uint16 if n <= SHORT else np.uint32)


def able_to_reach(x: bytes, nx: int, ys: list[bytes], ny: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of the set x and each set y can reach the threshold. Cut members coincide at least as often as whole ones, so no pair that does is refused."""
    mine, others = _open(x, nx), [_open(y, n) for y, n in zip(ys, ny)]
    if nx > SHORT and (ny > SHORT).all():
        hits = np.isin(np.concatenate(others), mine)
    else:
        there = np.zeros(1 << 16, bool)
        there[mine.astype(np.uint16)] = True
        hits = there[np.concatenate([y.astype(np.uint16) for y in others])]
    cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(y) for y in others])])
    common = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(hits)])[cuts])
    common = np.minimum(common, np.minimum(nx, ny))
    return 100 * common >= round(100 * threshold) * (nx + ny - common)


def _offers(queries, members, compare: Compare, dtype, threshold: float, cut: float, least_equal: float, low: int, high: int) -> tuple[list, list]:
    """Partners number ``low`` to ``high`` of every query by estimated similarity, if in another component; a partner None tells that more follow."""
    (qi, qr, qn, qs, qx), (ci, cr, cn, cs, cx) = queries, members
    a, b = [], []
    if not (cr != cr[0]).any() and not (qr != cr[0]).any():
        return a, b
    step = max(1, (1 << 22) // max(1, cs.size))
    for s in range(0, len(qi), step):
        part = slice(s, s + step)
        able = (qi[part, None] != ci) & (np.minimum(qn[part, None], cn) >= threshold * np.maximum(qn[part, None], cn))
        able &= np.count_nonzero(qs[part, None, :] == cs[None, :, :], axis=2) >= least_equal * cs.shape[1]
        x, y = np.nonzero(able)
        if not len(x):
            continue
        x += s
        est = compare(qs[x], cs[y], qn[x], cn[y])
        fine = est >= cut
        x, y, est = x[fine], y[fine], est[fine]
        if not len(x):
            continue
        edge = np.flatnonzero(np.diff(x, prepend=-1))
        fine = np.concatenate([able_to_reach(qx[x[i]], int(qn[x[i]]), list(cx[y[i:j]]), cn[y[i:j]], threshold) for i, j in zip(edge, np.append(edge[1:], len(x)))])
        x, y, est = x[fine], y[fine], est[fine]
        order = np.lexsort((ci[y], -est, x))
        x, y = x[order], y[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        other = qr[x] != cr[y]
        now = other & (rank >= low) & (rank < high)
        a += qi[x[now]].tolist()
        b += ci[y[now]].tolist()
        later = np.unique(x[other & (rank >= high)])
        a += qi[later].tolist()
        b += [None] * len(later)
    return a, b


def link(items: DataFrame, banded: DataFrame, shelf: Shelf, compare: Compare, dtype, verify: Callable[[DataFrame], DataFrame], load: Callable[[DataFrame], DataFrame], threshold: float, cut: float, least_equal: float) -> DataFrame:
    """(node, root) of all items that similar items link, root being the smallest id of the component.

    ``items``: id (unique), n (set size), sketch (binary); ``banded``: id, bands (array of keys). Items that share a band key share a
    bucket. First, every member of a bucket meets its smallest member, the hub; pairs that survive the sketch are verified
    exactly (``verify`` takes and returns rows a, b). Whole groups of copies fall into one component by this. Then buckets of
    one hub are taken together. As long as such a group holds several components, its members outside the main one are compared with all
    of it, in blocks: by size, by the share of equal places (``least_equal``), by the estimate (``cut``), and by an upper bound of the
    similarity from shortened sets (``load`` gives id, short for rows id). What passes is offered for verification if it
    would join two components, 16 partners first, then 8 times as many each round, until none is left. So every pair of a bucket that
    the sketch lets pass is verified, refused by the bound or already in one component, and the pairs listed are about the links.
    """
    keyed = banded.select(F.explode("bands").alias("key"), "id")
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("total")).filter("total > 1")
    met = keyed.join(hubs.withColumnRenamed("key", "hub_key"), F.col("key") == F.col("hub_key")).filter("id <> hub").select("hub", "id").distinct()
    met = shelf.put(met, "met")
    star = shelf.put(_screen(met.select(F.col("hub").alias("a"), F.col("id").alias("b")), items, compare, dtype, threshold, cut), "star")
    links = shelf.put(verify(star), "links")
    tested = [star]
    roots = shelf.put(components(links, shelf), "roots")
    sizes = met.groupBy(F.col("hub").alias("key")).agg((F.count("*") + 1).alias("total")).filter("total > 2")
    members = met.select(F.col("hub").alias("key"), "id").union(met.select(F.col("hub").alias("key"), F.col("hub").alias("id")).distinct())
    members = shelf.put(members.join(sizes.withColumnRenamed("key", "size_key"), F.col("key") == F.col("size_key")).select("key", "id", "total"), "members")
    main, short, low, high = None, None, 0, FIRST_WINDOW
    while True:
        known = roots.select(F.col("node").alias("n_"), "root")
        placed = members.join(known, members["id"] == known["n_"], "left").select("key", "id", "total", F.coalesce("root", "id").alias("root"))
        if main is None:
            # The main component of a bucket is the one of this member from now on: a member outside it now was outside it in every round before.
            sizes = placed.groupBy("key", "root").agg(F.count("*").alias("c"), F.max("total").alias("total"))
            main = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts"), F.sum("c").alias("total")).filter("parts > 1").select(F.col("key").alias("main_key"), "main", F.col("total").alias("size"))
            main = shelf.put(main, "main")
            if main.isEmpty():
                break
        here = main.join(known, main["main"] == known["n_"], "left").select("main_key", F.coalesce("root", "main").alias("main_root"), "size")
        open_ = placed.join(here, placed["key"] == here["main_key"]).select("key", "id", "root", "size", (F.col("root") != F.col("main_root")).alias("outside"))
        open_ = shelf.put(open_, "open")
        if short is None:
            short = shelf.put(load(open_.select("id").distinct()).select(F.col("id").alias("short_id"), "short"), "short")
        outside = open_.filter("outside").groupBy(F.col("key").alias("out_key")).agg(F.count("*").alias("outsiders"))
        rows = open_.join(outside, open_["key"] == outside["out_key"]).join(items.select(F.col("id").alias("item"), "n", "sketch"), F.col("id") == F.col("item"))
        rows = rows.join(short, F.col("id") == F.col("short_id"))
        cb, qb = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.col("outsiders") / BLOCK).cast("int")
        h = F.xxhash64("id")
        q = rows.filter("outside").select("key", F.pmod(h, qb).cast("int").alias("qblock"), F.explode(F.sequence(F.lit(0), cb - 1)).alias("cblock"), "id", "root", "n", "sketch", "short")
        c = rows.select("key", F.explode(F.sequence(F.lit(0), qb - 1)).alias("qblock"), F.pmod(h, cb).cast("int").alias("cblock"), "id", "root", "n", "sketch", "short")
        n = open_.count() // BIN + 1
        parts = min(n, max(shelf.spark.sparkContext.defaultParallelism, int(shelf.spark.conf.get("spark.sql.shuffle.partitions"))))
        c = c.select(*[F.col(x).alias(x) for x in c.columns])  # attributes of its own, though the source is one
        q, c = (t.withColumn("bin", F.pmod(F.xxhash64("key", "qblock", "cblock"), F.lit(n))).repartition(parts, "bin") for t in (q, c))
        offers = q.groupBy("bin").cogroup(c.groupBy("bin")).applyInArrow(_offering(compare, dtype, threshold, cut, least_equal, low, high), "a long, b long")
        offers = shelf.put(offers, "offers")
        fresh = offers.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for done in tested:
            fresh = fresh.join(done, ["a", "b"], "left_anti")
        fresh = shelf.put(fresh, "fresh")
        more = not offers.filter("b is null").isEmpty()
        found = not fresh.isEmpty()
        if found:
            new = shelf.put(verify(fresh), "links")
            found = not new.isEmpty()
            if found:
                links = links.union(new)
                shelf.drop(roots)
                roots = shelf.put(components(links, shelf), "roots")
        shelf.drop(open_, offers)
        tested.append(fresh)
        if not more:
            break
        low, high = high, high * GROWTH
    shelf.drop(members, met)
    return roots
