"""Operator 4: substring deduplication by paragraph MinHash banding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import setsketch
from quillon.llm.buckets import link, shorten, sketch_matrix
from quillon.llm.common import Shelf, slices, text_buffer
from quillon.llm.neardup import set_keys
from quillon.llm.shingles import distinct, jaccard, mix, powers, shingles, words

THRESHOLD = 0.75
# A pair at the threshold is missed by all bands with this chance at most.
MISS = 3e-4
# Paragraphs of fewer words are left alone.
LEAST_WORDS = 20
# Runs of this many words that stand elsewhere word for word are cut, also across line ends.
PASSAGE = 50
# Anchors are runs of this many words; every run of PASSAGE words holds one that depends on nothing but the run.
ANCHOR = 25
# A hot anchor or passage is dealt over this many keys.
SALTS = 8
# Names found about HOT_PLACES times or more, told from the places in one of HOT_SHARE hash ranges, are looked up in tasks: at most
# HOT_NAMES of them, the commonest, whatever the size of the table. All other names are joined; both ways give the same rows.
HOT_PLACES, HOT_SHARE, HOT_NAMES = 512, 16, 4096
# Estimates below this are not verified.
CUT = 0.5
STEP = 1 << 15


def tune(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows per band for high recall at the threshold, the most selective that 48 minima allow."""
    return setsketch.tune(threshold, miss, 48)


def minima(values: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """Plain MinHash: the last 16 bits of the least of m hashes over each (non-empty) set."""
    out = np.full((len(begin) - 1, m), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(values), STEP):
        e = min(len(values), s + STEP)
        a, b = np.searchsorted(begin, s, side="right") - 1, np.searchsorted(begin, e, side="left")
        rows = np.arange(a, b)
        rows = rows[begin[rows + 1] > np.maximum(begin[rows], s)]
        cuts = np.maximum(begin[rows], s) - s
        part = values[s:e]
        for i in range(m):
            h = ((part * setsketch.MULTIPLIERS[i] + setsketch.INCREMENTS[i]) >> np.uint64(32)).astype(np.uint32)
            out[rows, i] = np.minimum(out[rows, i], np.minimum.reduceat(h, cuts))
    return (mix(out.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((len(low), low.shape[1] // rows), np.uint64)
    for b in range(out.shape[1]):
        acc = np.full(len(low), np.uint64(b + 1))
        for k in range(rows):
            acc = mix((acc ^ low[:, b * rows + k].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
        out[:, b] = acc
    return out


def compare(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The share of equal minima."""
    return (a == b).mean(axis=1)


def paragraphs(data: np.ndarray, offsets: np.ndarray):
    """Paragraphs are lines: the text and first byte of each, the word hashes, and where each paragraph's begin."""
    edges = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    hashes, first_byte, _, _ = words(data, offsets)
    return np.searchsorted(offsets, edges[:-1], side="right") - 1, hashes, np.searchsorted(first_byte, edges)


def occurrences(docs: DataFrame, m: int) -> DataFrame:
    """(doc_id, text_hash, pos, name, n, sketch): every paragraph of LEAST_WORDS words or more, with the name, size and minima of its shingle set."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in slices(offsets):
                owner, hashes, starts = paragraphs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keep = np.flatnonzero(np.diff(starts) >= LEAST_WORDS)
                if not len(keep):
                    continue
                pos = (np.arange(len(owner)) - np.searchsorted(owner, owner))[keep]
                count = np.diff(starts)[keep]
                begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
                at = np.arange(begin[-1]) + np.repeat(starts[keep] - begin[:-1], count)
                values, begin = distinct(*shingles(hashes[at], begin))
                row = pa.array(a + owner[keep])
                sketch = pa.array([r.tobytes() for r in minima(values, begin, m)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(pos.astype(np.int32)), pa.array(set_keys(values, begin)), pa.array(np.diff(begin)), sketch],
                    names=["doc_id", "text_hash", "pos", "name", "n", "sketch"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInArrow(run, "doc_id long, text_hash long, pos int, name long, n long, sketch binary")


def banded(items: DataFrame, per_band: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys = band_keys(sketch_matrix(batch.column(1), np.uint16), per_band).view(np.int64) if batch.num_rows else np.zeros((0, 1), np.int64)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], names=["id", "bands"])

    return items.select("id", "sketch").mapInArrow(run, "id long, bands array<long>")


def extract(docs: DataFrame, wanted: DataFrame, what, schema: str) -> DataFrame:
    """Run ``what(ids, paragraph texts)`` over the paragraphs ``wanted`` (id, doc_id, text_hash, pos); each id comes from one place."""
    groups = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "id")).alias("want")).select(F.col("doc_id").alias("d_"), F.col("text_hash").alias("h_"), "want")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = source.join(groups, source["doc_id"].eqNullSafe(groups["d_"]) & (source["text_hash"] == groups["h_"])).select("text", "want")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, texts = [], []
                for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    lines = text.split("\n")
                    for w in want:
                        ids.append(w["id"])
                        texts.append(lines[w["pos"]])
                if ids:
                    yield from what(ids, texts)

    return rows.mapInArrow(run, schema)


def text_sets(texts: list[str]):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    for a, b in slices(offsets):
        hashes, _, _, starts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, *distinct(*shingles(hashes, starts))


def repeated(docs: DataFrame, shelf: Shelf, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, pos, first_doc, first_pos): every paragraph that repeats an earlier one, of its own or another document.

    Paragraphs with equal shingle sets are one class; classes are banded, verified by exact Jaccard similarity and
    linked to components. The occurrence with the smallest (doc_id, text_hash, pos) of a component stays, all others are listed.
    """
    bands, per_band = tune(threshold)
    all_places = shelf.put(occurrences(docs, bands * per_band), "places")
    place = F.struct("doc_id", "text_hash", "pos")
    grouped = all_places.groupBy(F.col("name").alias("id")).agg(F.min(place).alias("first"), F.count("*").alias("rows"), F.min(F.struct("n", "sketch")).alias("s"))
    items = shelf.put(grouped.select("id", "first", "rows", "s.n", "s.sketch"), "items")
    places = all_places.select("doc_id", "text_hash", "pos", "name")
    at = items.select("id", "first.doc_id", "first.text_hash", "first.pos")

    def load(ids: DataFrame) -> DataFrame:
        def pack(ids, texts):
            for a, values, begin in text_sets(texts):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + len(begin) - 1], pa.int64()), pa.array([shorten(values[begin[j] : begin[j + 1]]) for j in range(len(begin) - 1)], pa.binary())], names=["id", "short"])

        return extract(docs, at.join(ids.select(F.col("id").alias("p")), F.col("id") == F.col("p")).drop("p"), pack, "id long, short binary").dropDuplicates(["id"])

    def verify(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("p")).union(pairs.select(F.col("b").alias("p"))).distinct()
        wanted = at.join(asked, at["id"] == asked["p"]).select("id", "doc_id", "text_hash", "pos")

        def pack(ids, texts):
            for a, values, begin in text_sets(texts):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + len(begin) - 1], pa.int64()), pa.array([values[begin[j] : begin[j + 1]].tobytes() for j in range(len(begin) - 1)], pa.binary())], names=["id", "members"])

        sets = extract(docs, wanted, pack, "id long, members binary")
        both = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")

        def run(batches):
            for t in batches:
                keep = []
                for x, y in zip(t.column("ma").to_pylist(), t.column("mb").to_pylist()):
                    common, union = jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                    keep.append(100 * common >= round(100 * threshold) * union)
                yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return both.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")

    roots = link(items.select("id", "n", "sketch"), banded(items, per_band), shelf, compare, np.uint16, verify, load, threshold, CUT, CUT)
    rooted = items.join(roots, items["id"] == roots["node"], "left").select("id", "first", "rows", F.coalesce("root", "id").alias("root"))
    groups = rooted.groupBy(F.col("root").alias("group")).agg(F.min("first").alias("kept"), F.sum("rows").alias("all")).filter("all > 1")
    again = shelf.put(rooted.join(groups, rooted["root"] == groups["group"]).select(F.col("id").alias("set_id"), "kept"), "again")
    hits = places.join(again, places["name"] == again["set_id"]).filter(~place.eqNullSafe(F.col("kept")))
    return hits.distinct().select("doc_id", "text_hash", "pos", F.col("kept.doc_id").alias("first_doc"), F.col("kept.pos").alias("first_pos"))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, whatever text it is in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(max(2, len(hashes) + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * down[:n] + np.uint64(k))


def anchors(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, name) of the anchors: in each run of PASSAGE words of a text the ANCHOR-run with the least hash, of equal ones the last."""
    names = runs(hashes, ANCHOR)
    span = PASSAGE - ANCHOR + 1
    n = len(hashes) - PASSAGE + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lesser(a, b):
        return np.where(names[b] <= names[a], b, a)

    best, width = np.arange(len(names)), 1
    while 2 * width <= span:
        best, width = lesser(best[:-width], best[width:]), 2 * width
    best = lesser(best[:n], best[span - width : span - width + n])
    inside = np.arange(n) + PASSAGE <= np.repeat(starts[1:], np.diff(starts))[:n]
    at = np.unique(best[inside])
    return at, names[at].view(np.int64)


def keyed(docs: DataFrame, at: int) -> DataFrame:
    """The columns as c0, c1, ... (no name of the input can clash) with d_ and h_: the id of a row as a long and the hash of its text."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return named.select("*", F.col(f"c{docs.columns.index('doc_id')}").cast("long").alias("d_"), F.xxhash64(f"c{at}").alias("h_"))


def hot_names(found: DataFrame) -> list[int]:
    """The commonest names, at most HOT_NAMES. Which names are listed changes how they are looked up, not what is found."""
    some = found.filter(F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(HOT_SHARE)) == 0).groupBy("name").agg(F.count("*").alias("n"))
    return [r["name"] for r in some.filter(F.col("n") >= HOT_PLACES // HOT_SHARE).orderBy(F.desc("n"), "name").limit(HOT_NAMES).collect()]


def repeats(found: DataFrame, apart: int) -> DataFrame:
    """Of (doc_id, text_hash, start, name) the rows with a name that stands at another place, the first place of each name, and later.

    later: whether the row stands elsewhere than the first; a place of the first's own text counts from ``apart`` words behind it.
    Names are counted before they are joined. The first places of the commonest names go to all tasks, so that their many rows are not
    shuffled; the others are joined by salted keys, so that no name meets in one task.
    """
    place = F.struct("doc_id", "text_hash", "start")

    def firsts(rows):
        return rows.groupBy(F.col("name").alias("group")).agg(F.min(place).alias("kept"), F.max(place).alias("last")).filter("kept != last")

    hot = hot_names(found)
    common = F.col("name").isin(hot)
    rest = found.filter(~common) if hot else found
    groups = firsts(rest).select("group", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))
    both = rest.join(groups, (F.col("name") == F.col("group")) & (dealt == F.col("salt"))).select("doc_id", "text_hash", "start", "name", "kept")
    if hot:
        first = {r["group"]: r["kept"].asDict() for r in firsts(found.filter(common)).collect()}

        def look_up(batches):
            for batch in batches:
                kept = [first.get(x) for x in batch.column(3).to_pylist()]
                kind = pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32())])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, kind)], names=["doc_id", "text_hash", "start", "name", "kept"])

        known = found.filter(common).select("doc_id", "text_hash", "start", "name").mapInArrow(look_up, "doc_id long, text_hash long, start int, name long, kept struct<doc_id:long,text_hash:long,start:int>")
        both = both.union(known.filter("kept is not null"))
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    return both.withColumn("later", ~same | (F.col("start") >= F.col("kept.start") + apart))


def dropped_lines(raw: np.ndarray, drop: set[int]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which bytes stay when the lines ``drop`` go with their line ends, and (line, first, past-the-last byte) of each."""
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    stay = np.ones(len(raw), bool)
    some = [k for k in sorted(drop) if k < len(ends)]
    for k in some:
        stay[begins[k] : ends[k] + 1] = False
    left = len(ends) - 1
    while left in drop:
        left -= 1
    if 0 <= left < len(ends) - 1:
        stay[ends[left]] = False
    return stay, [(k, int(begins[k]), int(ends[k])) for k in some]


def repeated_passages(rows: DataFrame, at: int, cuts: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc_id, text_hash, start, first_doc): every run of PASSAGE words in what the paragraph step leaves that stands before, by (doc_id, text_hash, word).

    Anchors that occur at two places or more name the texts to look at, and the runs of PASSAGE words around them are compared
    by name. As each such run holds an anchor which is the same in all its copies, none is missed. Rows repeated whole give the same
    places again, which change neither first nor later; a place can be listed as often as its row stands there.
    """

    def mark(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in slices(offsets):
                hashes, _, _, starts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                where, names = anchors(hashes, starts)
                text = np.searchsorted(starts, where, side="right") - 1
                row = pa.array(a + text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array((where - starts[text]).astype(np.int32)), pa.array(names)], names=["doc_id", "text_hash", "start", "name"])

    kind = "doc_id long, text_hash long, start int, name long"
    marked = shelf.put(rows.select("d_", "h_", f"c{at}").mapInArrow(mark, kind), "anchors")
    seen = repeats(marked, 0).select("doc_id", "text_hash", F.lit(None).cast("int").alias("line"), "start")
    lines = cuts.select("doc_id", "text_hash", F.explode("lines.at").alias("line"), F.lit(None).cast("int").alias("start"))
    todo = seen.union(lines).groupBy(F.col("doc_id").alias("e_"), F.col("text_hash").alias("g_")).agg(F.collect_set("start").alias("starts"), F.collect_set("line").alias("lines")).filter("size(starts) > 0")
    texts = rows.join(todo, F.col("d_").eqNullSafe(F.col("e_")) & (F.col("h_") == F.col("g_"))).select("d_", "h_", f"c{at}", "starts", "lines")

    def spell(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(2)[i].as_py().encode(), np.uint8)
                hashes, first, _, _ = words(raw, np.array([0, len(raw)]))
                drop = set(batch.column(4)[i].as_py())
                where = np.zeros(max(0, len(hashes) - PASSAGE + 1) + 1, np.int64)
                marks = np.array(batch.column(3)[i].as_py(), np.int64)
                np.add.at(where, np.clip(marks - (PASSAGE - ANCHOR), 0, len(where) - 1), 1)
                np.add.at(where, np.clip(marks + 1, 0, len(where) - 1), -1)
                near = np.flatnonzero(np.cumsum(where)[:-1] > 0)
                if drop:
                    stay, _ = dropped_lines(raw, drop)
                    gone = np.concatenate([np.zeros(1, np.int64), np.cumsum(~stay[first])])
                    near = near[gone[near + PASSAGE] == gone[near]]
                names = runs(hashes, PASSAGE)[near].view(np.int64)
                for s in range(0, len(near), STEP):
                    k = len(near[s : s + STEP])
                    ids = batch.column(0).slice(i, 1).take(pa.array(np.zeros(k, np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(i, 1).take(pa.array(np.zeros(k, np.int64))), pa.array(near[s : s + STEP].astype(np.int32)), pa.array(names[s : s + STEP])], names=["doc_id", "text_hash", "start", "name"])

    spelled = shelf.put(texts.mapInArrow(spell, kind), "runs")
    shelf.drop(marked)
    return repeats(spelled, PASSAGE).filter("later").select("doc_id", "text_hash", "start", F.col("kept.doc_id").alias("first_doc"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, inner: bool = True) -> DataFrame:
    """The input's columns, with repeated paragraphs and passages cut out of ``text``, and n_removed, removed, repeats_of.

    A paragraph is a line of LEAST_WORDS words or more. One that repeats another (Jaccard similarity of five-word
    shingle sets of ``threshold`` or more, over links) is removed everywhere but at the smallest (doc_id, text_hash, position).
    With ``inner``, runs of PASSAGE words or more that stand word for word elsewhere in what is left are cut as well, everywhere but at
    the smallest (doc_id, text_hash, word); line ends and short lines are text like any other, and a run goes in full. A word of the
    kept place is itself cut only where a still earlier place keeps it. Shorter repeats stay, and a text that repeats itself
    with a period of less than PASSAGE words keeps its first PASSAGE words. removed has (start, stop, first_doc) per cut
    piece, in characters of the input's text; repeats_of lists the documents that keep them. doc_id must be a whole number. A null text
    stays null; rows repeated whole are one place and are cut alike; a null doc_id comes before all others. Input columns of the
    three names are replaced.
    """
    shelf = Shelf(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("n_removed", "removed", "repeats_of")]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index("text")
    rows = keyed(docs, at)
    hits = repeated(docs.select("doc_id", "text"), shelf, threshold)
    cuts = hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(F.col("pos").alias("at"), "first_doc")).alias("lines"))
    cuts = shelf.put(cuts, "cuts")
    shelf.drop(*[t for t, _ in list(shelf.paths.values()) if t is not cuts])
    none = F.lit(None).cast("array<struct<at:int,first_doc:bigint>>")
    todo = cuts.select("doc_id", "text_hash", "lines", none.alias("more"))
    if inner:
        more = repeated_passages(rows, at, cuts, shelf).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(F.col("start").alias("at"), "first_doc")).alias("more"))
        more = shelf.put(more.select("doc_id", "text_hash", none.alias("lines"), "more"), "passages")
        shelf.drop(*[t for t, _ in list(shelf.paths.values()) if t is not cuts and t is not more])
        todo = todo.union(more).groupBy("doc_id", "text_hash").agg(F.first("lines", ignorenulls=True).alias("lines"), F.first("more", ignorenulls=True).alias("more"))
    todo = todo.select(F.col("doc_id").alias("e_"), F.col("text_hash").alias("g_"), "lines", "more")
    rows = rows.join(todo, F.col("d_").eqNullSafe(F.col("e_")) & (F.col("h_") == F.col("g_")), "left").select(*[f"c{i}" for i in range(len(columns))], "lines", "more")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def cut(text: str, lines, more) -> tuple[str, list[dict]]:
        """What stays of a text, and the pieces that go."""
        data = text.encode()
        raw = np.frombuffer(data, np.uint8)
        firsts = {c["at"]: c["first_doc"] for c in lines or []}
        stay, gone = dropped_lines(raw, set(firsts))
        spans = [(a, b, firsts[k]) for k, a, b in gone]
        if more:
            _, first, last, _ = words(raw, np.array([0, len(raw)]))
            pieces: list[list] = []
            for w, d in sorted({(c["at"], c["first_doc"]) for c in more}, key=lambda x: x[0]):
                if pieces and w <= pieces[-1][1]:
                    if pieces[-1][2] == d:
                        pieces[-1][1] = w + PASSAGE
                        continue
                    reach = max(pieces[-1][1], w + PASSAGE)
                    pieces[-1][1] = w
                    pieces.append([w, reach, d])
                else:
                    pieces.append([w, w + PASSAGE, d])
            for j, (a, b, d) in enumerate(pieces):
                e = int(first[b] if j + 1 < len(pieces) and pieces[j + 1][0] == b else last[b - 1])
                spans.append((int(first[a]), e, d))
                stay[first[a] : e] = False
        removed, place, done = [], 0, 0
        for a, b, d in sorted(spans, key=lambda x: x[:2]):
            done += len(data[place:a].decode())
            n = len(data[a:b].decode())
            removed.append({"start": done, "stop": done + n, "first_doc": d})
            done, place = done + n, b
        return raw[stay].tobytes().decode(), removed

    def run(batches):
        for batch in batches:
            texts, removed = batch.column(at).to_pylist(), []
            for i, (lines, more) in enumerate(zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist())):
                gone = []
                if texts[i] is not None and (lines or more):
                    texts[i], gone = cut(texts[i], lines, more)
                removed.append(gone)
            arrays = list(batch.columns[:-2])
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("first_doc", pa.int64())]))
            arrays += [pa.array([len(r) for r in removed], pa.int32()), pa.array(removed, kind), pa.array([sorted({x["first_doc"] for x in r if x["first_doc"] is not None}) for r in removed], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_removed", "removed", "repeats_of"])

    return rows.mapInArrow(run, f"{fields}, n_removed int, removed array<struct<start:int,stop:int,first_doc:long>>, repeats_of array<long>")
