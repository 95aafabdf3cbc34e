"""Document operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import language, mixing, neardup, pieces, quality, setsketch, substring
from quillon.llm.common import remainder

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, copy string, name string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def shingle_set(text):
    w = tokens(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = prose(rng, 80, vocabulary).split()
    out = [None, "", "   \n\t ", "One two THREE", "one two three", "a b c d e", "x" * 5000, "wörd " * 40]
    out += [prose(rng, rng.randint(6, 60), vocabulary) for _ in range(40)]
    for _ in range(120):  # a tight group of near copies, some near the threshold
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [" ".join(base)] * 60
    out.append(prose(rng, 30_000, vocabulary))
    passage = prose(rng, 60, vocabulary)
    out += [f"{prose(rng, 30, vocabulary)}\n{passage}\n{prose(rng, 25, vocabulary)}\n" for _ in range(8)]
    out += [f"{passage}\n\n{passage}"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["big", "big", "small", None][i % 4], len(t or ""), "x", "x", "x", "x") for i, t in enumerate(texts)]
    rows += [rows[12], (rows[13][0], *rows[14][1:]), (None, *rows[15][1:]), (None, None, *rows[15][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def roots(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def test_near_duplicates_match_brute_force(spark, docs):
    rows = [r for r in docs.collect()]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in neardup.near_duplicates(docs).collect())
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    sets = [shingle_set(r["text"]) for r in rows]
    able = [i for i, r in enumerate(rows) if r["doc_id"] is not None]
    root = roots(len(rows), [(i, j) for i in able for j in able if i < j and linked(sets[i], sets[j])])
    want = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, len(sets[i]), -1 if r["doc_id"] is None else rows[root[i]]["doc_id"] or 0, True if r["doc_id"] is None else r["doc_id"] == rows[root[i]]["doc_id"])
        for i, r in enumerate(rows)
    )
    assert [(a, b, c, (d if d != -1 else -1), e) for a, b, c, d, e in want] == [(a, b, c, (0 if d == -1 and not a else d), e) for a, b, c, d, e in got]


def test_keep_one_keeps_one_row_of_each_group(spark, docs):
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    out = [r["doc_id"] for r in kept.collect()]
    group = {r["component_id"] for r in neardup.near_duplicates(docs).collect() if r["component_id"] is not None}
    assert set(out) - {None} == group and len([x for x in out if x is not None]) - len(group) in (0, 1)  # one doc_id stands for two texts


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert neardup.near_duplicates(none).count() == 0 and neardup.keep_one(none).count() == 0
    assert substring.deduplicate(none).count() == 0 and mixing.mix(none).count() == 0 and pieces.encode(none, ["doc_id"]).count() == 0
    model = language.learn(none, F.lit(True))
    assert [r["lang_pred"] for r in language.identify(docs.limit(3), model, ["doc_id"]).collect()] == ["und"] * 3
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = quality.learn(none, labels, F.lit(True))
    assert {0 <= r["score"] <= 1 for r in quality.score(docs, rules, ["doc_id"]).collect()} == {True}


def test_substring_removals_match_brute_force(spark, docs):
    rows = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect() if r["text"]})
    got = {(r["doc_id"], r["n_removed"], r["text"]) for r in substring.deduplicate(docs, inner=False).collect()}
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    paras = [((d, i, hashes[(i if d else None, t)], p), shingle_set(x)) for d, i, t in rows for p, x in enumerate(t.split("\n")) if len(tokens(x)) >= substring.LEAST_WORDS]
    paras.sort()
    root = roots(len(paras), [(i, j) for i in range(len(paras)) for j in range(i + 1, len(paras)) if linked(paras[i][1], paras[j][1])])
    cut = {paras[i][0] for i in range(len(paras)) if root[i] != i}
    for d, i, t in rows:
        h = hashes[(i if d else None, t)]
        lines = t.split("\n")
        left = [x for p, x in enumerate(lines) if (d, i, h, p) not in cut]
        assert (i if d else None, len(lines) - len(left), "\n".join(left)) in got
    assert substring.deduplicate(docs).filter("text is null").count() == docs.filter("text is null").count()


def test_removed_spans_point_at_the_passages(spark, docs):
    before = {(r["doc_id"], r["h"]): r["text"] for r in docs.withColumn("h", F.xxhash64("text")).collect()}
    lines = {x for t in before.values() if t for x in t.split("\n")}
    seen = 0
    for r in substring.deduplicate(docs.withColumn("h", F.xxhash64("text")), inner=False).filter("n_removed > 0").collect():
        for s in r["removed"]:
            assert before[(r["doc_id"], r["h"])][s["start"] : s["stop"]] in lines
            seen += 1
    assert seen > 8


def test_bands_are_tuned_for_recall():
    for miss in (1e-2, 1e-4):
        b, r = setsketch.tune(0.75, miss, 200)
        assert (1 - 0.75**r) ** b <= miss and b * r <= 200


def test_mixing_repeats_by_source_and_is_repeatable(spark, docs):
    many = docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i")).withColumn("doc_id", F.xxhash64("doc_id", "i", "text"))
    weights = {"big": 3.0, None: 1.0}
    out = mixing.mix(many, weights, rows=20_000, seed=5).cache()
    share = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(share) == {"big", None} and abs(share["big"] / 15_000 - 1) < 0.05 and abs(share[None] / 5_000 - 1) < 0.05
    again = mixing.mix(many.repartition(3), weights, rows=20_000, seed=5)
    assert out.select("doc_id", "copy", "shuffle_key").exceptAll(again.select("doc_id", "copy", "shuffle_key")).count() == 0
    repeats = out.groupBy("doc_id", "source").agg(F.max("copy") + 1, F.count("*")).collect()
    assert all(r[2] >= r[3] or r[3] % r[2] == 0 for r in repeats)


def test_poisson_counts_have_the_wanted_mean_and_variance(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'s' as source")
    counts = [r["n"] for r in df.join(mixing.mix(df, rows=50_000).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").fillna(0).collect()]
    mean = sum(counts) / len(counts)
    var = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert abs(mean - 2.5) < 0.05 and abs(var - 2.5) < 0.12


def test_rules_learn_junk_and_score_all_rows(spark, docs):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        good = i % 3 > 0
        w = [rng.choice(["the", "river", "stone", "under", "light", "walks"]) + ("" if good else "###") for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w), int(good)))
    made = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.learn(made.drop("quality"), made.select("doc_id", "quality"), remainder("doc_id", 4) != 2)
    assert model.rules and all(r.terms for r in model.rules)
    scored = quality.score(made, model, ["doc_id", "quality"]).withColumn("held", remainder("doc_id", 4) == 2).filter("held").collect()
    assert sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in scored) / len(scored) > 0.97
    odd = quality.score(docs, model, ["doc_id", "score"])
    assert odd.columns == ["doc_id", "score"] and odd.count() == docs.count() and odd.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.accept(docs, model, 0.0).columns == docs.columns and quality.accept(docs, model, 0.0).count() == docs.count()


def test_statistics_of_known_texts(spark):
    df = spark.createDataFrame([(1, "Aé 1!\nb b B"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.with_statistics(df, "doc_id").collect()}
    assert got[1]["chars"] == 11 and got[1]["words"] == 5 and got[1]["words_per_line"] == 2.5 and got[1]["repeats"] == 0.4 and got[1]["distinct"] == 0.6
    assert got[1]["upper"] == 2 / 11 and got[1]["digits"] == 1 / 11 and got[1]["letters"] == 5 / 11
    assert all(got[i][c] == 0 for i in (2, 3) for c in ("chars", "words", "upper", "distinct"))


def test_languages_are_told_apart_on_held_out_rows(spark):
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "er"], "cc": ["que", "eau", "oi", "ç"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(rng.randint(8, 80))), k) for i in range(300) for k in [list(parts)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "kaloka", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("held_out", remainder("doc_id", 5) == 0)
    model = language.learn(df, ~F.col("held_out"))
    got = {r["doc_id"]: r for r in language.identify(df, model, ["doc_id", "held_out", "score"]).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) / len(held) > 0.97
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.reject(language.identify(df, model, ["doc_id"])).filter("lang_pred = 'und'").count() == 0


def test_pieces_round_trip_and_are_distinct(spark, docs):
    odd = docs.union(docs.limit(1).withColumn("text", F.lit(" lead  two▁mark\n\té😀  ")).withColumn("doc_id", F.lit(9999)))
    out = pieces.encode(odd, ["doc_id", "text", "score"], k=3)
    rows = out.collect()
    assert "score" in out.columns and all(r["round_trip"] for r in rows) and {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["text"]), set()).add(tuple(r["ids"]))
        assert r["n_pieces"] == len(r["ids"]) and 0 <= r["inclusion"] <= 1
    assert all(len(v) == 3 for (_, t), v in by.items() if t and sum(c.isalpha() for c in t) > 4) and all(len(v) == 1 for (_, t), v in by.items() if not t)
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(out.filter("sample = 0"), ["doc_id"]).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in odd.collect()}


def test_samples_follow_the_lattice_and_take_every_segmentation():
    import numpy as np

    p = pieces.Pieces(pieces.default_model())
    cps = pieces.code_points(" cab de")
    starts = np.flatnonzero(cps == 32)
    lat = pieces.Lattices(p, cps, starts)
    unit = lat.unit
    every = pieces.sample(lat, np.array([0, 2]), np.array([5], np.uint64), 1000)[0]
    assert len({tuple(e) for e, *_ in every}) == len(every) and abs(sum(np.exp(lp) for _, lp, _, _ in every) - 1) < 1e-5 and all(x[3] == 1.0 for x in every)
    lat.unit = np.tile(unit, 4000)
    drawn = pieces.sample(lat, np.arange(4001) * 2, pieces.mix(np.arange(1, 4001, dtype=np.uint64)), 2)
    first = [d[0][1] for d in drawn]
    assert all(d[0][2] >= d[1][2] for d in drawn)
    for lp in {round(e[1], 4) for e in every}:
        expected = np.exp(lp) * sum(round(e[1], 4) == lp for e in every)
        assert abs(sum(round(x, 4) == lp for x in first) / 4000 - expected) < 0.03


def test_passages_inside_lines_are_cut_once_found_before(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdéfgh") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    shared = [prose(rng, 55, vocabulary) for _ in range(40)]
    rows, clean = [], {}
    for i in range(80):
        rows.append((i, f"{prose(rng, 40, vocabulary)} {shared[i % 40]} {prose(rng, 45, vocabulary)}\nshort line\n{prose(rng, 30, vocabulary)}"))
    for i in range(100, 140):
        clean[i] = f"{prose(rng, 120, vocabulary)}\n{prose(rng, 60, vocabulary)}"
        rows.append((i, clean[i]))
    out = {r["doc_id"]: r for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    before = dict(rows)
    assert all(out[i]["text"] == before[i] and out[i]["n_removed"] == 0 for i in [*range(40), *clean])
    caught = [i for i in range(40, 80) if shared[i - 40] not in out[i]["text"]]
    assert len(caught) >= 38
    for i in caught:
        assert out[i]["repeats_of"] == [i - 40] and all(before[i][s["start"] : s["stop"]] in shared[i - 40] for s in out[i]["removed"])
        left = before[i]
        for s in reversed(out[i]["removed"]):
            left = left[: s["start"]] + left[s["stop"] :]
        assert left == out[i]["text"]


def test_inner_passages_match_brute_force(spark):
    """All lines are shorter than a paragraph: passages run over line ends, repeat themselves, and are up to 49 words where nothing may go."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 60, 90, 200, 400)]

    def wrap(tokens):
        out, left = [], 0
        for t in tokens:
            left = left - 1 if left else rng.randint(3, 14)
            out.append(t + ("\n" if not left else rng.choice([" ", "  ", "\t"])))
        return "".join(out)

    rows = []
    for i in range(60):
        body = []
        for _ in range(rng.randint(1, 3)):
            passage = rng.choice(passages)
            lo = rng.choice([0, 0, rng.randint(0, len(passage) // 2)])
            body += [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] + passage[lo:]
        rows.append((i, wrap(body + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))])))
    rows += [(70, "tick tock\n" * 300), (71, "tick tock\n" * 80), (72, None), (73, ""), (74, " \n\n "), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as d_", "'y' as c0", "1 as starts", "2 as e_").repartition(5)
    out = substring.deduplicate(df)
    assert out.columns == [*df.columns, "n_removed", "removed", "repeats_of"]
    got = {r["doc_id"]: r for r in out.collect()}
    first, texts = {}, dict(rows)
    for i in sorted(texts):
        w = (texts[i] or "").split()
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), (i, s))
    for i, text in texts.items():
        w = (text or "").split()
        gone = set()
        for s in range(len(w) - 49):
            d, at = first[tuple(w[s : s + 50])]
            if d != i or s >= at + 50:
                gone.update(range(s, s + 50))
        assert (got[i]["text"] or "").split() == [x for j, x in enumerate(w) if j not in gone], i
        assert (got[i]["text"] is None) == (text is None) and (got[i]["n_removed"] > 0) == bool(gone)
        left = text
        for s in reversed(got[i]["removed"]):
            left = left[: s["start"]] + left[s["stop"] :]
        assert left == got[i]["text"]


def test_columns_with_clashing_names_come_back(spark, docs):
    names = ["__u", "__n", "__salt", "__cdf", "__src", "__id", "__hash", "d1", "kept_id", "kept_hash", "__seed", "__text", "lines", "more", "h_"]
    wide = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    model = language.learn(wide, F.lit(True))
    outs = [mixing.mix(wide), neardup.keep_one(wide), substring.deduplicate(wide), pieces.encode(wide, ["doc_id", *names]), language.identify(wide, model, ["doc_id", *names])]
    for out in outs:
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {tuple(f"own {n}" for n in names)}


def test_anchors_are_deleted_before_runs_are_compared(spark, monkeypatch):
    import os

    from quillon.llm import common, substring

    made, there = [], []
    folder, repeats = common.Shelf.folder, substring.repeats
    monkeypatch.setattr(common.Shelf, "folder", lambda self, name: made.append(folder(self, name)) or made[-1])
    monkeypatch.setattr(substring, "repeats", lambda found, apart: there.append([os.path.isdir(p.removeprefix("file:")) for p in made if "/anchors-" in p]) or repeats(found, apart))
    text = " ".join(f"w{i}" for i in range(60))
    got = substring.deduplicate(spark.createDataFrame([(1, "a " + text), (2, text + " b")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert there == [[True], [False]]
    assert [r["n_removed"] for r in got] == [0, 1]


def test_a_slice_of_pieces_takes_little_memory():
    import tracemalloc

    import numpy as np

    p = pieces.Pieces(pieces.default_model())
    rng = np.random.default_rng(2)
    letters = rng.integers(97, 123, pieces.SLICE_CHARS).astype(np.uint32)
    letters[rng.random(len(letters)) < 0.15] = pieces.SPACE
    letters[0] = pieces.SPACE
    tracemalloc.start()
    lat = pieces.Lattices(p, letters, np.flatnonzero(letters == pieces.SPACE))
    pieces.sample(lat, np.array([0, len(lat.unit)]), np.array([5], np.uint64), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_common_names_are_looked_up_and_not_joined(spark, monkeypatch):
    places = [(d, d * 7, s, d % 3 if s < 9 else 100 * d + s % 40) for d in range(1, 40) for s in range(60)]
    places += [(None, 5, 0, 1), (1, 7, 90, 10_000), (2, 14, 90, -3), (2, 14, 91, -3)]
    found = spark.createDataFrame(places, "doc_id long, text_hash long, start int, name long")

    def rows(apart):
        return sorted((str(r["doc_id"]), r["text_hash"], r["start"], r["name"], str(r["kept"]["doc_id"]), r["kept"]["start"], r["later"]) for r in substring.repeats(found, apart).collect())

    want = [rows(0), rows(4)]
    assert want[0] and not substring.hot_names(found)
    monkeypatch.setattr(substring, "HOT_PLACES", 48)
    assert set(substring.hot_names(found)) == {0, 1, 2}
    assert [rows(0), rows(4)] == want
    joined = substring.repeats(found, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in joined and "NOT name" in joined
