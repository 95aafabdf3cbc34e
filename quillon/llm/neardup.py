"""Operator 10: near-duplicate documents by SetSketch registers on word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import setsketch
from quillon.llm.buckets import link, shorten, sketch_matrix
from quillon.llm.common import Shelf, fresh, slices, text_buffer
from quillon.llm.shingles import distinct, jaccard, mix, shingles, words

THRESHOLD = 0.75
# Bands miss a pair at the threshold with this chance; the estimate must reach CUT, five deviations below the threshold.
MISS = 3e-5
CUT = 0.55
LEAST_EQUAL = 0.4
SALT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array):
    """For slices of the texts: (first row, sorted distinct shingle hashes, where each text's begin)."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        hashes, _, _, starts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, *distinct(*shingles(hashes, starts))


def set_keys(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: the sum of its members' hashes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ SALT), dtype=np.uint64)])
    return mix((sums[begin[1:]] - sums[begin[:-1]]) ^ np.diff(begin).astype(np.uint64)).view(np.int64)


def sketch_documents(docs: DataFrame, m: int) -> DataFrame:
    """doc_id, text_hash, n (distinct shingles), name (of the set; null if empty), sketch (registers, two bytes each)."""

    def run(batches):
        for batch in batches:
            n, names, sketches = [], [], []
            for _, values, begin in shingle_sets(batch.column(1)):
                n.append(np.diff(begin))
                names.append(set_keys(values, begin))
                sketches.append(setsketch.registers(values, begin, m))
            size = np.concatenate([np.zeros(0, np.int64), *n])
            regs = np.concatenate([np.zeros((0, m), np.uint16), *sketches])
            name = pa.array(np.concatenate([np.zeros(0, np.int64), *names]), mask=size == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), name, pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "text_hash", "n", "name", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, n long, name long, sketch binary")


def banded(items: DataFrame, rows: int) -> DataFrame:
    """(id, bands): the keys of the bands of ``rows`` registers each."""

    def run(batches):
        for batch in batches:
            keys = setsketch.bands(sketch_matrix(batch.column(1), np.uint16), rows).view(np.int64) if batch.num_rows else np.zeros((0, 1), np.int64)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], names=["id", "bands"])

    return items.select("id", "sketch").mapInArrow(run, "id long, bands array<long>")


def texts_of(ids: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the asked classes, from the document that stands for each; a repeated doc_id gives several rows."""
    asked = ids.join(items.select(F.col("id").alias("item"), "doc"), F.col("id") == F.col("item")).select("id", "doc")
    return docs.select(F.col("doc_id").cast("long").alias("d"), "text").join(asked, F.col("d") == F.col("doc")).select("id", "text")


def short_sets(ids: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, short): the shortened shingle sets of the asked classes."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                wanted, got, short = batch.column(0).to_numpy(), [], []
                for first, values, begin in shingle_sets(batch.column(1)):
                    names = set_keys(values, begin)
                    for j in np.flatnonzero(names == wanted[first : first + len(names)]):
                        got.append(names[j])
                        short.append(shorten(values[begin[j] : begin[j + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(short, pa.binary())], names=["id", "short"])

    return texts_of(ids, items, docs).mapInArrow(run, "id long, short binary").dropDuplicates(["id"])


def verify_documents(pairs: DataFrame, items: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. Only texts that are in a pair are moved."""
    texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), items, docs)
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                left, right = (list(zip(batch.column(i).to_pylist(), batch.column(t).to_pylist())) for i, t in (("a", "ta"), ("b", "tb")))
                texts = list(dict.fromkeys(left + right))
                sets: dict = {}
                for first, values, begin in shingle_sets(pa.array([t for _, t in texts], pa.string())):
                    names = set_keys(values, begin)
                    for j in range(len(begin) - 1):
                        if names[j] == texts[first + j][0]:  # else the text of another row with this doc_id
                            sets[texts[first + j]] = values[begin[j] : begin[j + 1]]
                keep = []
                for x, y in zip(left, right):
                    common, union = jaccard(sets[x], sets[y]) if x in sets and y in sets else (0, 1)
                    keep.append(100 * common >= round(100 * threshold) * union)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    A document's set is its distinct five-word shingles (A-Z in lower case), or its whole word sequence if shorter. Documents
    with equal sets are one class from the start; classes are sketched, banded, estimated and verified on their full
    sets, and linked ones form components, named by their smallest doc_id. kept marks rows whose doc_id is the name.
    Null or wordless texts have an empty set and link with nothing; so do rows with a null doc_id, whose
    component_id is null and who are kept. Rows that repeat a doc_id are each judged by their own text.
    """
    shelf = Shelf(docs.sparkSession)
    bands, rows = setsketch.tune(threshold, MISS, 128)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketched = shelf.put(sketch_documents(hashed, bands * rows), "sketched")
    usable = sketched.filter("name is not null and doc_id is not null")
    first = usable.groupBy(F.col("name").alias("id")).agg(F.min(F.struct("doc_id", "n", "sketch")).alias("first"))
    items = shelf.put(first.select("id", "first.n", "first.sketch", F.col("first.doc_id").alias("doc")), "items")
    roots = link(items, banded(items, rows), shelf, setsketch.compare, np.uint16, lambda pairs: verify_documents(pairs, items, docs, threshold), lambda ids: short_sets(ids, items, docs), threshold, CUT, LEAST_EQUAL)
    rooted = items.select("id", "doc").join(roots, items["id"] == roots["node"], "left").select("id", "doc", F.coalesce("root", "id").alias("root"))
    names = rooted.groupBy(F.col("root").alias("class")).agg(F.min("doc").alias("component"))
    known = shelf.put(rooted.join(names, rooted["root"] == names["class"]).select(F.col("id").alias("set_id"), "component"), "classes")
    out = sketched.join(known, (F.col("name") == F.col("set_id")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay when one of every group of near-duplicates does; a row repeated whole stays once."""
    kept_id, kept_hash, own = fresh(docs.columns, "kept_id", "kept_hash", "__hash")
    kept = near_duplicates(docs, threshold).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).distinct()
    rows = docs.withColumn(own, F.xxhash64("text")).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_hash)))
    return rows.dropDuplicates(["doc_id", own]).select(*docs.columns)
