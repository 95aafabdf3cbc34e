"""Vector, page and scoring operators against brute force on small fixtures."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import annlinks, buckets, components, lm, topk, warc
from quillon.llm.common import Shelf, remainder

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

VECTORS = "vec_id long, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    x[100:180] = x[100] + 0.08 * rng.standard_normal((80, 8))
    x[200:230] = x[200]
    rows = [(i, [float(v) for v in r], int(i % 2 if not 100 <= i < 230 else 1), "x") for i, r in enumerate(x)]
    rows += [(300, None, 1, "x"), (301, [float("nan")] * 8, 1, "x"), (302, [0.0] * 8, 1, "x"), (303, rows[200][1], None, "x"), (304, [None] * 8, 1, "x"), (305, [1.0, 2.0], 1, "x"), (306, [], 1, "x"), (307, [float("inf")] + [0.0] * 7, 1, "x")]
    return spark.createDataFrame(rows, VECTORS).repartition(4)


def able(v, zero=False):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


@pytest.mark.parametrize("shard_rows", [2048, 40])
def test_near_vectors_find_their_links(spark, vectors, shard_rows):
    rows = sorted(vectors.collect(), key=lambda r: r["vec_id"])
    got = {r["vec_id"]: r for r in annlinks.near_vectors(vectors, shard_rows=shard_rows).collect()}
    links = {r["vec_id"]: set() for r in rows}
    for a in rows:
        for b in rows:
            if a["vec_id"] != b["vec_id"] and a["label"] is not None and a["label"] == b["label"] and able(a["embedding"]) and able(b["embedding"]) and len(a["embedding"]) == len(b["embedding"]):
                u, v = np.array(a["embedding"], float), np.array(b["embedding"], float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                    links[a["vec_id"]].add(b["vec_id"])
    total = sum(map(len, links.values()))
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and found <= total and found >= (total if shard_rows == 2048 else 0.9 * total)
    if shard_rows == 2048:
        for i, mine in links.items():
            assert got[i]["n_links"] == len(mine)
            seen, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (min(seen) == i)


@pytest.mark.parametrize("shard_rows", [40, 5])
def test_near_vectors_lose_no_link_between_shards(spark, shard_rows):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 16))
    x[300:] = x[:300] / np.linalg.norm(x[:300], axis=1, keepdims=True) + 0.34 * rng.standard_normal((300, 16)) / 4  # near the threshold
    x[590:] = x[0] * np.arange(1, 11)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in annlinks.near_vectors(df, shard_rows=shard_rows).collect()}
    assert 150 < near.sum() < 1000 and [got[i]["n_links"] for i in range(600)] == near.sum(axis=1).tolist()
    assert all(r["audit_links"] == r["audit_found"] == near[i].sum() for i, r in got.items())  # few rows: all are audited


@pytest.mark.parametrize("sizes", [(8192, 1024, 128), (40, 3, 8)])
def test_topk_is_exact(spark, vectors, sizes):
    shard, group, block = sizes
    rows = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in vectors.collect() if able(r["embedding"], zero=True)]
    got = topk.search(vectors, F.col("vec_id") % 50 == 0, shard_rows=shard, query_rows=group, block=block).collect()
    want = []
    for q, x in rows:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("sizes", [(8192, 1024, 128), (40, 3, 8)])
def test_topk_counts_rows_that_repeat_an_id_once(spark, sizes):
    shard, group, block = sizes
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.standard_normal(6)]) for i in range(150)]
    rows += [(i, [4 * v for v in rows[0][1]]) for i in (7, 8)] + [(7, [(5 + 0.1 * n) * v for v in rows[0][1]]) for n in range(30)] + [(9, [9 * v for v in rows[0][1]])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = topk.search(df, F.col("vec_id") == 0, shard_rows=shard, query_rows=group, block=block).collect()
    best, whole = {}, [(i, [math.floor(256 * v) for v in x]) for i, x in rows]
    for i, y in whole:
        if i:
            best[i] = max(best.get(i, -(2**63)), sum(a * b for a, b in zip(whole[0][1], y)))
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert sorted(map(tuple, got)) == [(0, n + 1, i, s) for n, (i, s) in enumerate(want)]


def test_topk_without_rows_and_with_huge_numbers(spark, vectors):
    assert topk.search(vectors.limit(0), F.lit(True)).count() == 0 and topk.search(vectors, F.lit(False)).count() == 0
    big = spark.createDataFrame([(0, [1e12, -1e12]), (1, [1e12, 1e12]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.search(big, F.lit(True)).collect()}
    assert got[(0, 2)] == math.floor(256e12) * 768 - math.floor(256e12) * 256 and len(got) == 6


def test_components_agree_for_rounds_and_one_step(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5001), (5001, 5000), (7, 7)]
    links = spark.createDataFrame(chain, "a long, b long").repartition(6)
    shelf = Shelf(spark)
    want = {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {5000: 5000, 5001: 5000}
    for local in (10**6, 0):
        assert {r["node"]: r["root"] for r in components.components(links, shelf, local_links=local).collect()} == want


def test_bucket_offers_reach_every_partner_in_turn():
    n = 60
    members = [np.arange(n), np.arange(n), np.full(n, 100), np.zeros((n, 8), np.uint16), np.array([buckets.shorten(np.arange(100, dtype=np.uint64))] * n, object)]
    seen, low, high = set(), 0, 4
    while True:
        a, b = buckets._offers(members, members, lambda x, y, *_: np.ones(len(x)), np.uint16, 0.75, 0.5, 0.5, low, high)
        seen |= {(x, y) for x, y in zip(a, b) if y is not None}
        if None not in b:
            break
        low, high = high, high * 4
    assert seen == {(x, y) for x in range(n) for y in range(n) if x != y}


def test_bound_refuses_no_pair_that_reaches_the_threshold():
    rng = np.random.default_rng(3)
    for size in (40, 1990, 2600, 30_000):
        x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        ys = [np.unique(np.concatenate([x[: int(len(x) * share)], rng.integers(0, 2**63, len(x) - int(len(x) * share), dtype=np.uint64)])) for share in (0.3, 0.84, 0.87, 1.0)]
        got = buckets.able_to_reach(buckets.shorten(x), len(x), [buckets.shorten(y) for y in ys], np.array([len(y) for y in ys]), 0.75)
        for y, g in zip(ys, got):
            common = len(np.intersect1d(x, y))
            assert g or 100 * common < 75 * (len(x) + len(y) - common)
        assert not got[0] or size == 2600


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 300_000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (1, "u1", None), (2, "u2\nx", ""), (4, "u4", big), (6, "u6", "one"), (6, "u6", "one"), (None, "u", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    index = warc.archive_pages(pages, roll_bytes=1000)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows) and index.select("archive", "offset").distinct().count() == len(rows)
    for r in got:
        html = [h for p, _, h in rows if p == r["page_id"] and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r["payload_digest"]]
        assert html and r["payload_bytes"] == len((html[0] or "").encode())
        first = min((p for p, _, h in rows if (h or "") == (html[0] or "") and p is not None), default=None)
        revisit = first is not None and r["page_id"] != first
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
        assert bytes(r["payload"]) == (b"" if revisit else (html[0] or "").encode())
    assert warc.read_records(warc.archive_pages(pages.limit(0))).count() == 0
    assert warc.read_records(warc.archive_pages(pages, least_bytes=10)).filter("record_type = 'revisit'").count() == 0


def test_inflate_reads_one_and_many_members():
    import gzip
    import io

    a = warc.record(1, "u", b"payload", warc.digest(b"payload"))
    for raw in (gzip.compress(a + a), gzip.compress(a) + gzip.compress(a)):
        assert list(warc.split_records(warc.inflate(io.BytesIO(raw), 7))) == [a, a]
    with pytest.raises(ValueError):
        list(warc.split_records(iter([a[:-9]])))


def test_lm_counts_and_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["the", "The", "river", "stone", f"w{i}", "zz"], int(rng.integers(0, 60))))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "never " * 30), (503, "y" * 3000), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    got = lm.score(df, remainder("doc_id", 5) == 1).collect()
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + [None]) for i, t in rows]
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(w for i, ws in split if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in split)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    nobody = lm.score(df, F.lit(True)).collect()
    assert {r["train_tokens"] for r in nobody} == {0} and {r["n_known"] for r in nobody} == {0}


def test_windows_score_each_token_once():
    flat = np.arange(1000, 1107)
    begin = np.array([0, 1, 60, 107])
    inputs, targets, text = lm.cut_windows(flat, begin, 7)
    for t in range(3):
        mine = targets[text == t]
        assert mine[mine >= 0].tolist() == flat[begin[t] : begin[t + 1]].tolist()
    first = inputs[text == 1][0]
    assert first[lm.CONTEXT - 1 :][:3].tolist() == [-1, 7, 1001][:3] and (first[: lm.CONTEXT] == -1).all()
    second = inputs[text == 1][1]
    assert second[: lm.CONTEXT].tolist() == flat[1 + lm.SCORED - lm.CONTEXT - 1 : 1 + lm.SCORED - 1].tolist()


def test_lm_trains_on_every_window_of_every_training_text(spark, monkeypatch):
    late = " ".join(["late"] * 50)
    rows = [(0, " ".join(f"w{i}" for i in range(400)) + " " + late, True), (1, "same words", True), (2, "same words", True), (3, None, True), (4, "held out " * 99, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    sub = lm.Subwords(lm.default_tokenizer())
    want = Counter(x for _, t, train in rows if train for x in [*(i for w in (t or "").split() for i in sub.encode(w)), sub.end])
    windows = lm.training_windows(df, lm.default_tokenizer()).cache()
    got = Counter(x for r in windows.collect() for x in r["tokens"][lm.CONTEXT + 1 :] if x >= 0)
    assert got == want and {r["id"]: r["count"] for r in lm.count_subwords(windows, sub.size).collect()} == want
    assert lm.start_sample(windows, 3).num_rows == 3
    trained, whole = [], lm.Attention.train
    monkeypatch.setattr(lm.Attention, "train", lambda self, i, t, *a, **b: trained.append(len(i)) or whole(self, i, t, *a, **b))
    still, moved = lm.train_model(windows, sub.size, rounds=0), lm.train_model(windows, sub.size)
    assert trained[0] == windows.count() and not np.allclose(still.flat(), moved.flat())  # rounds are run on few windows, too


def test_lm_scores_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["old", "grey", "river", "stone", "bridge", "falls", "over"], int(rng.integers(1, 90))))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({(r["doc_id"]): r["score"] for r in lm.score(d, remainder("doc_id", 5) == 1).collect()} for d in (df.coalesce(1), df.orderBy("text").repartition(7)))
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) / max(1, abs(one[i])) for i in one) < 1e-5


def test_lm_starts_at_the_unigram_of_subwords():
    counts = np.random.default_rng(3).integers(0, 60, 3000).astype(float)
    m = lm.Attention(counts)
    m.weights = {k: (np.zeros_like(w) if k not in ("bclass", "btoken") else w) for k, w in m.weights.items()}
    ids = np.arange(3000)
    lp = m.log_probs(np.zeros((3000, lm.WIDTH), np.float32), m.token[ids]) / np.log(10) + m.rest[ids]
    assert abs((10.0**lp).sum() - 1) < 1e-4 and np.allclose(lp, np.log10((counts + 0.5) / (counts + 0.5).sum()), atol=1e-4)


def test_gradients_and_masking():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 1500).astype(float)
    m = lm.Attention(counts)
    x = m.tokens(rng.integers(0, 1500, (3, lm.WINDOW)))
    x[0, :5] = -1
    t = m.tokens(rng.integers(0, 1500, (3, lm.SCORED)))
    t[1, -4:] = -1
    m.weights = {k: w.astype(np.float64) for k, w in m.weights.items()}
    loss, g = m.gradients(x, t)
    for name in m.NAMES:
        i = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        keep, step = m.weights[name][i], 1e-4
        m.weights[name][i] = keep + step
        up = m.gradients(x, t)[0]
        m.weights[name][i] = keep - step
        down = m.gradients(x, t)[0]
        m.weights[name][i] = keep
        assert abs((up - down) / (2 * step) - g[name][i]) < 1e-3 * max(1e-3, abs(g[name][i])) + 1e-6, name
    h, _ = m.hidden(x)
    y = x.copy()
    y[:, -1] = 3
    assert np.allclose(m.hidden(y)[0][:, :-1], h[:, :-1])  # a later token changes nothing before it
    some = t.ravel() >= 0
    lp = m.log_probs(h.reshape(-1, lm.WIDTH)[some], t.ravel()[some])
    assert abs(-lp.mean() - loss) < 1e-6


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    ids = np.tile(np.arange(40), 60)
    flat, begin = ids, np.arange(0, len(ids) + 1, 80)
    inputs, targets, _ = lm.cut_windows(flat, begin, 41)
    counts = np.bincount(targets[targets >= 0], minlength=42).astype(float)
    m = lm.Attention(counts)
    before = m.gradients(m.tokens(inputs), m.tokens(targets))[0]
    order = rng.permutation(len(inputs))
    assert m.train(m.tokens(inputs[order]), m.tokens(targets[order]), 30, 0.02, batch=32) < before / 3


def test_a_short_part_is_compared_whole_before_its_beam_is_wider_than_that(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=8)[None, :] + 0.05 * rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    beams, search = [], annlinks.range_search
    monkeypatch.setattr(annlinks, "range_search", lambda *a: beams.append(a[-1]) or search(*a))
    fq, fv = annlinks.links_of(x, np.full((600, 1), -1, np.int64), np.arange(64), 0.93)
    want = x @ x.T >= 0.93
    np.fill_diagonal(want, False)
    assert want.sum() > 100_000 and len(fq) == want.sum() and want[fq, fv].all()
    assert max(beams) * annlinks.DEGREE < 600


def test_shuffle_files_go_when_a_table_is_stored(spark):
    import glob
    import os
    import time

    def there():
        return set(glob.glob(f"{folder}/blockmgr-*/*/shuffle_*.data"))

    jvm = spark.sparkContext._jvm
    folder = os.path.dirname(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = there()
    shelf = Shelf(spark)
    stored = shelf.put(spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not there() - before:
            break
        time.sleep(0.2)
    assert not there() - before
    assert stored.count() == 7
    shelf.drop(stored)


def test_windows_go_when_the_model_is_trained_and_travel_as_its_tokens(spark, monkeypatch):
    import os
    from types import SimpleNamespace

    import pyarrow as pa

    made, folder = [], Shelf.folder
    monkeypatch.setattr(Shelf, "folder", lambda self, name: made.append(folder(self, name)) or made[-1])
    df = spark.createDataFrame([(i, "old stone bridge " * i) for i in range(1, 9)], "doc_id long, text string")
    out = lm.score(df, remainder("doc_id", 5) == 1)
    assert [os.path.isdir(p.removeprefix("file:")) for p in made if "/windows-" in p] == [False]
    assert out.count() == 8
    model = lm.Attention(np.arange(3000.0))
    ids = np.random.default_rng(1).integers(-1, 3000, (5, lm.WINDOW + 1)).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(ids.tolist(), pa.list_(pa.int32()))], names=["h", "tokens"])
    (packed,) = lm.narrow(SimpleNamespace(value=model))(iter([batch]))
    assert np.array_equal(np.frombuffer(b"".join(packed.column(1).to_pylist()), np.int16).reshape(5, -1), model.tokens(ids))
