"""Prefix trie of conversations by block digests: whole blocks of turns are grouped first, turns only where blocks diverge."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Shelf
from quillon.runtime import ship

# Turns of a block.
BLOCK = 4
# Turns of one conversation that one task numbers or adds up; longer conversations are cut and totals carried over.
STRETCH = 4096
# Copies of a turn laid out by one row.
COPIES = 1024
# Members of a digest's piece: ids that share all but this many low bits.
PIECE_BITS = 9
# Tasks over which the rows that look up one key are dealt.
SALTS = 32
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
LANES = ("1", "2")


def _keyed(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """Join on pairs of differently named columns; the right names are dropped."""
    out = left.join(right, [F.col(a) == F.col(b) for a, b in keys.items()], how)
    return out if how in ("left_semi", "left_anti") else out.drop(*keys.values())


def _lookup(rows: DataFrame, key: list[str], table: DataFrame, names: list[str], spread_by: str) -> DataFrame:
    """Left join of ``rows`` with a table of unique keys (columns ``names`` are its key), rows of one key dealt over SALTS tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    wanted = salted.select(*key, "salt").distinct()
    found = _keyed(wanted, table, dict(zip(key, names)))
    found = found.select(*[F.col(k).alias(f"w_{k}") for k in key], F.col("salt").alias("w_salt"), *[c for c in found.columns if c not in (*key, "salt")])
    return _keyed(salted, found, {**{k: f"w_{k}" for k in key}, "salt": "w_salt"}, "left").drop("salt")


def number_turns(conversations: DataFrame, shelf: Shelf) -> DataFrame:
    """(conv_id, total, start, m, h1, h2, size): the turns of every conversation in order, m equal ones in a row at positions start, start + 1...

    Order is by turn, null first; turns with equal marks stand in the order of their digests (120 bits of SHA-256 of role and
    text, nulls being empty). ``size`` is the text's number of code points. Rows whose conv_id is null or no whole number are
    left out. Only digests are shuffled. Equal rows are counted first; a long conversation is numbered in stretches of its marks (of its
    digests, where the mark is null), so it is never in one task unless most of it has one mark.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.expr("try_cast(conv_id AS long)").alias("conv_id"), F.col("turn"), F.length(text).cast("long").alias("size"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("d"),
    ).filter("conv_id is not null")
    h1, h2 = (F.conv(F.substring("d", at, 15), 16, 10).cast("long") for at in (1, 16))
    rows = rows.select("conv_id", "turn", h1.alias("h1"), h2.alias("h2"), "size")
    marked = F.col("turn").isNotNull()
    part = F.when(marked, F.floor(F.col("turn") / STRETCH).cast("long")).otherwise(F.shiftright("h1", 50))
    rows = rows.withColumn("marked", marked).withColumn("part", part)
    counted = shelf.put(rows.groupBy("conv_id", "marked", "part", "turn", "h1", "h2", "size").agg(F.count(F.lit(1)).alias("m")), "counted")
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("marked", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("conv_id", "marked", "part").agg(F.sum("m").alias("here"))
    parts = parts.select(F.col("conv_id").alias("p_conv"), F.col("marked").alias("p_marked"), F.col("part").alias("p_part"), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"), F.sum("here").over(whole).alias("total"))
    inside = Window.partitionBy("conv_id", "marked", "part").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("inner", F.coalesce(F.sum("m").over(inside), F.lit(0)))
    placed = _keyed(placed, parts, {"conv_id": "p_conv", "marked": "p_marked", "part": "p_part"})
    out = shelf.put(placed.select("conv_id", "total", (F.col("inner") + F.col("offset") + 1).alias("start"), "m", "h1", "h2", "size"), "placed")
    shelf.drop(counted)
    return out


def _laid_out(placed: DataFrame, first: Column) -> DataFrame:
    """A row (at) for each position from ``first`` on, copies laid out in slices."""
    last = F.col("start") + F.col("m") - 1
    rows = placed.withColumn("low", F.greatest("start", first)).withColumn("high", last).filter("low <= high")
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(high - low) div {COPIES}"))))
    low = F.col("low") + F.col("slice") * COPIES
    return rows.withColumn("at", F.explode(F.sequence(low, F.least(low + (COPIES - 1), F.col("high")))))


def with_shared_heads(placed: DataFrame, shelf: Shelf, family: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of their family's first: (conv_id, total) and (conv_id, total, at, h1, h2, size).

    Conversation c gets the first h turns of conversation c - c % family (all if it has fewer, none if it is absent), then its own after
    its first h; h is crc32 of c as decimal text modulo ``most`` + 1. Conversations without turns left stay in the first table, with total 0.
    """
    totals = placed.groupBy("conv_id").agg(F.max("total").alias("own"))
    plan = totals.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    bases = totals.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("b_conv"), F.col("own").alias("b_own"))
    plan = _keyed(plan, bases, {"base": "b_conv"}, "left").withColumn("k", F.least("h", F.coalesce("b_own", F.lit(0))))
    plan = shelf.put(plan.select("conv_id", "h", "k", "base", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "plan")
    # A family's first has at most 2 family - 1 members, and no more than ``most`` of its turns are taken: no key is large here.
    heads = _laid_out(placed.filter((F.col("conv_id") % family == 0) & (F.col("start") <= most)).withColumn("m", F.least("m", F.lit(most))), F.lit(1))
    heads = heads.select(F.col("conv_id").alias("h_conv"), "at", "h1", "h2", "size")
    taken = plan.filter("k > 0").join(heads, (F.col("base") == F.col("h_conv")) & (F.col("at") <= F.col("k"))).select("conv_id", "total", "at", "h1", "h2", "size")
    # h comes from the id, and k joins by stretches of the conversation, so that a long one is dealt over many tasks.
    own = placed.drop("total").withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).filter("start + m - 1 > h")
    own = own.withColumn("stretch", F.expr(f"start div {STRETCH}"))
    keys = _keyed(own.select("conv_id", "stretch").distinct(), plan.select(F.col("conv_id").alias("p_conv"), "k", "total"), {"conv_id": "p_conv"})
    keys = keys.select(F.col("conv_id").alias("s_conv"), F.col("stretch").alias("s_stretch"), "k", "total")
    own = _laid_out(_keyed(own, keys, {"conv_id": "s_conv", "stretch": "s_stretch"}), F.col("h") + 1)
    own = own.select("conv_id", "total", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "h1", "h2", "size")
    return plan.select("conv_id", "total"), taken.union(own)


def as_they_are(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns without any change, as :func:`prefix_trie` takes them."""
    turns = _laid_out(placed, F.lit(1)).select("conv_id", "total", "at", "h1", "h2", "size")
    return placed.groupBy("conv_id").agg(F.max("total").alias("total")), turns


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """A row per block of a conversation: digests of all turns before it (p) and up to its end (c), and its turns.

    The digest of a sequence is the XOR of hashes of (position, turn) in two lanes of 64 bits, so blocks and stretches are combined in any order.
    """
    salted = [F.xxhash64(F.lit(int(i)), F.col("at"), F.col("h1"), F.col("h2")).alias(f"x{i}") for i in LANES]
    rows = turns.select("conv_id", "total", "at", *salted, "size", F.expr(f"(at - 1) div {block}").alias("block"), F.expr(f"(at - 1) div {block * STRETCH}").alias("stretch"))
    turn = F.struct("at", "x1", "x2", "size")
    own = [F.expr(f"bit_xor(x{i})").alias(f"o{i}") for i in LANES]
    rows = rows.repartition("conv_id", "stretch").groupBy("conv_id", "stretch", "block", "total").agg(*own, F.array_sort(F.collect_list(turn)).alias("turns"))
    before = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.expr(f"bit_xor(o{i})").over(before), F.lit(0)).alias(f"r{i}") for i in LANES])
    whole = rows.filter(F.col("total") > block * STRETCH).groupBy("conv_id", "stretch").agg(*[F.expr(f"bit_xor(o{i})").alias(f"o{i}") for i in LANES])
    carried = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col("conv_id").alias("w_conv"), F.col("stretch").alias("w_stretch"), *[F.expr(f"bit_xor(o{i})").over(carried).alias(f"w{i}") for i in LANES])
    rows = _keyed(rows, whole, {"conv_id": "w_conv", "stretch": "w_stretch"}, "left")
    p = [F.col(f"r{i}").bitwiseXOR(F.coalesce(F.col(f"w{i}"), F.lit(0))) for i in LANES]
    return rows.select("conv_id", "total", "block", *[x.alias(f"p{i}") for x, i in zip(p, LANES)], *[x.bitwiseXOR(F.col(f"o{i}")).alias(f"c{i}") for x, i in zip(p, LANES)], "turns")


def _turn_nodes(distinct: DataFrame) -> DataFrame:
    """Nodes (depth, d, parent's digest q, n_convs, conv_id, size). A block without siblings gives its turns at once; siblings are refined by turn."""
    edge = ["block", "p1", "p2"]
    alone = distinct.groupBy(*edge).agg(F.count(F.lit(1)).alias("kids"), F.min(F.struct("c1", "c2")).alias("kid")).filter("kids = 1")
    alone = alone.select(*[F.col(c).alias(f"a_{c}") for c in edge], F.col("kid.c1").alias("a_c1"), F.col("kid.c2").alias("a_c2"), F.lit(True).alias("alone"))
    marked = _keyed(distinct, alone, {c: f"a_{c}" for c in (*edge, "c1", "c2")}, "left")
    lanes = [F.expr(f"aggregate(slice(turns, 1, i + 1), p{i}, (x, t) -> x ^ t.x{i})").alias(f"d{i}") for i in LANES]
    rows = marked.select("*", F.posexplode("turns").alias("i", "t")).select("alone", "conv_id", "n_convs", F.col("t.at").alias("depth"), F.col("t.size").alias("size"), *[F.col(f"t.x{i}").alias(f"x{i}") for i in LANES], *lanes)
    rows = rows.select("alone", "depth", "d1", "d2", *[F.col(f"d{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in LANES], "size", "n_convs", "conv_id")
    keys = ["depth", "d1", "d2", "q1", "q2", "size"]
    merged = rows.filter("alone is null").groupBy(*keys).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return merged.union(rows.filter("alone").select(*keys, "n_convs", "conv_id"))


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids in order, comma-joined: ids are joined in short pieces first, and a task reads the pieces one after the other."""
    pieces = ends.groupBy("depth", "d1", "d2", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("depth", "d1", "d2", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches):
        key, state, out = None, None, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("depth", "d1", "d2", "ids")]
            for *k, ids in zip(*columns):
                if k == key:
                    state.update(b",")
                elif key is not None:
                    out.append((*key, state.hexdigest()))
                if k != key:
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield made(out)
            out = []
        if key is not None:
            yield made([(*key, state.hexdigest())])

    def made(rows):
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["depth", "d1", "d2", "sha"])

    return pieces.repartition("depth", "d1", "d2").sortWithinPartitions("depth", "d1", "d2", "piece").mapInArrow(run, "depth long, d1 long, d2 long, sha string")


def _subtrees(chains: DataFrame, shelf: Shelf) -> DataFrame:
    """Sums of leaves and saved over every chain and all chains that hang from it, by pointer doubling: rounds are the logarithm of the nesting."""
    state = shelf.put(chains.select("chain", F.col("above").alias("jump"), "leaves", "saved"), "chains")
    while not state.filter("jump is not null").isEmpty():
        open_ = state.filter("jump is not null")
        add = open_.groupBy(F.col("jump").alias("j_chain")).agg(F.sum("leaves").alias("j_leaves"), F.sum("saved").alias("j_saved"))
        far = _lookup(open_.select("chain", "jump"), ["jump"], state.select(F.col("chain").alias("t_chain"), F.col("jump").alias("t_jump")), ["t_chain"], "chain")
        far = far.select(F.col("chain").alias("f_chain"), F.col("t_jump").alias("far"))
        new = _keyed(_keyed(state, add, {"chain": "j_chain"}, "left"), far, {"chain": "f_chain"}, "left")
        new = new.select("chain", F.col("far").alias("jump"), *[(F.col(c) + F.coalesce(F.col(f"j_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")])
        old, state = state, shelf.put(new, "chains")
        shelf.drop(old)
    return state.drop("jump")


def prefix_trie(convs: DataFrame, turns: DataFrame, shelf: Shelf, block: int = BLOCK) -> DataFrame:
    """One row per distinct sequence of first turns, from the root (no turn) down.

    ``convs``: conv_id (unique), total; ``turns``: conv_id, total, at (1 to total), h1, h2 (the turn's digest), size. Returns conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of the subtree, itself included), saved_tokens
    ((n_convs - 1) times size, summed over the subtree) and ends_sha256 (of the ids of the members that end there, ascending, comma-joined).
    Without conversations there is no root.

    Conversations are grouped by the digest of their turns up to each block's end; a block that no sibling diverges from gives all its turns as they
    are, and only blocks with siblings are grouped by turn. The nodes whose smallest member is c form one chain of the tree, so subtree sums
    are taken over chains first, then along each chain. Groups are counted and joined by unique keys; no node's members meet in one task.
    """
    ship(shelf.spark)
    blocks = shelf.put(_blocks(turns, block), "blocks")
    distinct = blocks.groupBy("block", "p1", "p2", "c1", "c2").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    distinct = shelf.put(distinct, "distinct")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(*[zero.alias(c) for c in ("depth", "d1", "d2")], *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")], zero.alias("size"), "n_convs", "conv_id")
    nodes = shelf.put(_turn_nodes(distinct).union(root), "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("k_depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("kids"))
    full = _keyed(nodes, kids, {"depth": "k_depth", "d1": "k1", "d2": "k2"}, "left")
    full = full.select(*nodes.columns, F.coalesce("kids", zero).alias("n_children"), F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saving"))
    full = shelf.put(full, "full")
    shelf.drop(distinct, nodes)
    tops = full.groupBy(F.col("conv_id").alias("chain")).agg(F.min("depth").alias("top"), F.min_by(F.struct("q1", "q2"), "depth").alias("q"), F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    tops = tops.select("chain", (F.col("top") - 1).alias("at"), F.col("q.q1").alias("q1"), F.col("q.q2").alias("q2"), "leaves", "saved")
    owners = full.select(F.col("depth").alias("o_depth"), F.col("d1").alias("o1"), F.col("d2").alias("o2"), F.col("conv_id").alias("above"))
    tops = shelf.put(_lookup(tops, ["at", "q1", "q2"], owners, ["o_depth", "o1", "o2"], "chain"), "tops")
    sums = _subtrees(tops, shelf)
    hung = _keyed(tops.filter("above is not null").select("chain", "above", "at"), sums.select(F.col("chain").alias("s_chain"), "leaves", "saved"), {"chain": "s_chain"})
    hung = hung.groupBy(F.col("above").alias("g_conv"), F.col("at").alias("g_depth")).agg(F.sum("leaves").alias("g_leaves"), F.sum("saved").alias("g_saved"))
    heads = tops.select(F.col("chain").alias("t_conv"), (F.col("at") + 1).alias("t_depth"), "above", F.lit(True).alias("head"))
    rows = _keyed(_keyed(full, hung, {"conv_id": "g_conv", "depth": "g_depth"}, "left"), heads, {"conv_id": "t_conv", "depth": "t_depth"}, "left")
    rows = rows.select(
        "conv_id", "depth", F.when(F.col("head"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "d1", "d2",
        (F.col("leaf") + F.coalesce("g_leaves", zero)).alias("leaves"), (F.col("saving") + F.coalesce("g_saved", zero)).alias("saved"), F.expr(f"depth div {STRETCH}").alias("stretch"),
    ).repartition("conv_id", "stretch")
    below = Window.partitionBy("conv_id", "stretch").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    names = ("leaves", "saved")
    over = rows.groupBy("conv_id", "stretch").agg(*[F.sum(c).alias(c) for c in names])
    over = over.select(F.col("conv_id").alias("v_conv"), F.col("stretch").alias("v_stretch"), *[F.sum(c).over(later).alias(f"v_{c}") for c in names]).filter("v_leaves is not null")
    rows = _keyed(rows.select("*", *[F.sum(c).over(below).alias(f"b_{c}") for c in names]), over, {"conv_id": "v_conv", "stretch": "v_stretch"}, "left")
    last = blocks.filter(F.expr(f"block = (total - 1) div {block}")).select(F.col("total").alias("depth"), F.col("c1").alias("d1"), F.col("c2").alias("d2"), "conv_id")
    ends = last.union(convs.filter("total = 0").select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), "conv_id"))
    digests = _digests(ends).select(F.col("depth").alias("e_depth"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "sha")
    rows = _keyed(rows, digests, {"depth": "e_depth", "d1": "e1", "d2": "e2"}, "left")
    sums = {"n_leaves": "leaves", "saved_tokens": "saved"}
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *[(F.col(f"b_{c}") + F.coalesce(F.col(f"v_{c}"), zero)).alias(name) for name, c in sums.items()],
        F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
