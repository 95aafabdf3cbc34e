"""Ranked lexical search without an index: an automaton of all query terms runs over the documents' bytes and counts them."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import SLICE_BYTES, Shelf, slices, text_buffer
from quillon.runtime import ship

# Terms: runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Byte for byte: letters lower-cased, every byte that ends a term a blank (no byte of a longer UTF-8 character is ASCII).
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
# (item, term) rows that one automaton is built for and one broadcast holds; more items take further scans.
POSTINGS = 200_000
# Scores that are held at once, and groups in which candidates of an item meet before they meet as a whole.
CELLS = 1 << 21
GROUPS = 64


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def _automaton(terms: list[bytes]):
    """All terms between blanks. Text and terms are given as one character a byte."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        a.add_word(f" {t.decode('latin-1')} ", i)
    if terms:
        a.make_automaton()
    return a


def _scan_slice(automaton, n_terms: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms per text, and (text * n_terms + term, count) of the automaton's terms."""
    n = len(offsets) - 1
    raw = data[offsets[0] : offsets[-1]].tobytes()
    cuts = (offsets - offsets[0]).tolist()
    joined = b" ".join([b"", *(raw[i:j] for i, j in zip(cuts, cuts[1:])), b""]).translate(FOLD)
    starts = np.array(cuts[:-1], np.int64) + np.arange(1, n + 1)
    bytes_ = np.frombuffer(joined, np.uint8)
    begins = np.flatnonzero((bytes_[1:] != 32) & (bytes_[:-1] == 32)) + 1
    sizes = np.diff(np.append(np.searchsorted(begins, starts), len(begins)))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    text, at = joined.decode("latin-1"), 0
    while n_terms and at < len(joined) - 1:
        # A blank ends one piece and begins the next, so no term is cut.
        end = joined.find(b" ", min(at + SLICE_BYTES, len(joined) - 1))
        hits = np.fromiter(itertools.chain.from_iterable(automaton.iter(text, at, end + 1)), np.int64).reshape(-1, 2)
        key, count = np.unique((np.searchsorted(starts, hits[:, 0] - 1, side="right") - 1) * n_terms + hits[:, 1], return_counts=True)
        keys.append(key)
        counts.append(count)
        at = end
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return sizes, key, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)


def count_terms(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with at least one term: its number of terms, and which of ``terms`` it holds how often."""
    shared, n_terms = docs.sparkSession.sparkContext.broadcast(terms), len(terms)
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        automaton = _automaton(shared.value)
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for low, high in slices(offsets):
                sizes, key, count = _scan_slice(automaton, n_terms, data, offsets[low : high + 1])
                text, term = np.divmod(key, max(n_terms, 1))
                cuts = np.searchsorted(text, np.arange(high - low + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (term, count)]
                rows = pa.RecordBatch.from_arrays([b.column("doc_id").slice(low, high - low), pa.array(sizes.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(sizes > 0))

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("tfs", ints)])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _best(rows: pa.Table, n_items: int, k: int) -> tuple[pa.Table, np.ndarray]:
    """The k best rows of each item, and the score that a further row must reach."""
    rows = rows.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    item = rows.column("item").to_numpy()
    place = np.arange(len(item)) - np.searchsorted(item, item)
    rows = rows.filter(pa.array(place < k))
    floor = np.ones(n_items, np.int64)
    full = place == k - 1
    floor[item[full]] = rows.column("score").to_numpy()[np.flatnonzero(place[place < k] == k - 1)]
    return rows, floor


def _rank(hits: DataFrame, postings: pa.Table, items: pa.Array, weight: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """Each task's k best documents per item: (item_id, doc_id, score). ``postings``: term, item, gain (weight times repeats), by term."""
    spark = hits.sparkSession
    shared = spark.sparkContext.broadcast((postings, items, weight))
    id_type, n_items = hits.schema["doc_id"].dataType, len(items)

    def run(batches):
        postings, items, weight = shared.value
        term, item = postings.column("term").to_numpy(), postings.column("item").to_numpy()
        gain = weight[term] * postings.column("repeats").to_numpy()
        first = np.searchsorted(term, np.arange(len(weight) + 1))
        best, floor = None, np.ones(n_items, np.int64)
        step = max(1, CELLS // n_items)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                m = 25 + 75 * part.column("n").to_numpy() * n_docs // n_words
                lists = part.column("terms")
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                t, tf = lists.flatten().to_numpy(), part.column("tfs").flatten().to_numpy().astype(np.int64)
                x = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                many = first[t + 1] - first[t]
                each = np.repeat(np.arange(len(t)), many)
                where = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + first[t[each]]
                scores = np.zeros(part.num_rows * n_items, np.int64)
                np.add.at(scores, doc[each] * n_items + item[where], gain[where] * x[each])
                scores = scores.reshape(-1, n_items)
                least = floor
                if len(scores) > k:
                    least = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                d, i = np.nonzero(scores >= least)
                new = pa.table({"item": pa.array(i), "score": pa.array(scores[d, i]), "doc_id": pa.chunked_array([part.column("doc_id").take(pa.array(d))])})
                best, floor = _best(new if best is None else pa.concat_tables([best, new]), n_items, k)
        if best is not None:
            best = best.combine_chunks()
            yield from pa.table({"item_id": pa.chunked_array([items.take(best.column("item").combine_chunks())]), "doc_id": best.column("doc_id"), "score": best.column("score")}).to_batches()

    schema = T.StructType([T.StructField("item_id", T.LongType() if pa.types.is_int64(items.type) else T.StringType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return hits.mapInArrow(run, schema)


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, postings_bound: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents, equal scores by ascending doc_id (null last).

    ``docs``: doc_id, text; ``items``: item_id (whole number or text), text; further columns are ignored. Every row of ``docs`` is a document, also where an
    id repeats; items that share an id are one item with the terms of all. Null texts have no terms. Documents without terms count nowhere; items
    without a document above score 0 give no row. With N documents that have terms, L terms in all and df documents holding a term, a
    document of n terms, tf of them this one, adds floor(1000 ln((2N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 8 m)) for each
    time the term stands in the item; m is 25 + 75 n N div L. All in 64-bit integers.

    Items are taken in blocks of about ``postings_bound`` (item, term) rows, or one item if it has more, so automaton and broadcast are bounded. A scan counts a block's terms in
    all documents and stores the counts; frequencies and scores come from these. A task keeps k rows per item, and no
    item's candidates meet in one task before k are left of each of GROUPS groups.
    """
    spark = docs.sparkSession
    ship(spark)
    shelf = Shelf(spark)
    whole = isinstance(items.schema["item_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    wanted = items.select(F.col("item_id").cast("long" if whole else "string").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term"))
    wanted = shelf.put(wanted.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats")), "postings")
    blocks = max(1, math.ceil(wanted.count() / postings_bound))
    out, totals = [], None
    for block in range(blocks):
        mine = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        terms = mine.column("term").unique()
        ids = mine.column("item_id").unique()
        number = lambda c, of: np.array([of[x] for x in mine.column(c).to_pylist()], np.int64)
        term = number("term", {t: i for i, t in enumerate(terms.to_pylist())})
        item = number("item_id", {t: i for i, t in enumerate(ids.to_pylist())})
        hits = shelf.put(count_terms(docs, [t.encode() for t in terms.to_pylist()]), "hits")
        if totals is None:
            totals = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_words = totals
        if not len(term) or not n_docs:
            continue
        seen = hits.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = np.zeros(len(terms), np.int64)
        df[seen.column("t").to_numpy()] = seen.column("df").to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        order = np.argsort(term, kind="stable")
        postings = pa.table({"term": term[order], "item": item[order], "repeats": mine.column("repeats").to_numpy()[order]})
        ranked = _rank(hits, postings, ids, weight, n_docs, n_words, k).withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
        found = _first(_first(ranked, ["item_id", "group"], k).drop("rank"), ["item_id"], k)
        out.append(shelf.put(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "found"))
        shelf.drop(hits)
    shelf.drop(wanted)
    if not out:
        return items.select("item_id", F.lit(1).alias("rank")).limit(0).join(docs.select("doc_id", F.lit(0).cast("long").alias("score")).limit(0))
    while len(out) > 1:
        out = [a.union(out[i + 1]) if i + 1 < len(out) else a for i, a in list(enumerate(out))[::2]]
    return out[0]
