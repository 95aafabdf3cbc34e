"""Licence scans against brute force over all blocks, with nulls, repeats, long texts, ties and clashing columns."""

import math
import random
import re

import pytest

from quillon.llm import licenses

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, words string, text_hash string, label string, rank string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(text, templates, threshold):
    w = words(text)
    starts, base, labels, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    for label, t in templates:
        own, step = set(words(t)), licenses.step_of(len(words(t)))
        for k in range(0, len(w), step):
            held = len(own & set(w[k : k + 2 * step]))
            if own and held >= threshold * len(own) - 1e-9:
                labels.add(label)
                best = max(best, held / len(own))
    join = lambda s: ",".join(sorted(s))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), join(base), join(base | labels), 1.0 if starts else best


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in words(t)}) + [f"w{i}" for i in range(300)]
    out = [None, "", "  \n?", "MIT License", "mit\nLICENSE. Apache-License, mit license", "license", "mit", "GNU general public license general public license", "Ünder the MIT license ünder"]
    for _, t in licenses.TEMPLATES:
        w = words(t)
        for drop in (0, 1, 2, len(w) // 5, len(w) // 5 + 1, len(w) // 4):
            kept = [x for i, x in enumerate(w) if i not in set(rng.sample(range(len(w)), drop))]
            filler = [rng.choice(vocabulary[-300:]) for _ in range(rng.randint(0, 70))]
            out.append(" ".join([*filler, *kept, *filler[:9]]))
            rng.shuffle(kept)
            out.append(" ".join([*filler[: len(filler) // 2], *kept, *filler]))
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    out += [" ".join(rng.choice(vocabulary[:60]) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    out += ["released under the mit license " * 20_000, "x" * 200_000]
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_scan_matches_brute_force(spark, texts, threshold):
    rows = [(i, t, "x", "x", "x", "x") for i, t in enumerate(texts)]
    rows += [rows[4], (3, *rows[20][1:]), (None, *rows[21][1:]), (None, *rows[22][1:]), (None, *rows[21][1:])]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(5), threshold=threshold)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = [(r[0], *brute(r[1], licenses.TEMPLATES, threshold)) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_blocks_are_found_where_they_stand(spark, texts):
    rows = spark.createDataFrame([("a", "x " * 40 + licenses.TEMPLATES[6][1])], "doc_id string, text string")
    rows = rows.select("doc_id", licenses.words_of(rows["text"]).alias("words"), licenses.F.xxhash64("text").alias("text_hash"))
    hits = licenses.matching_blocks(rows).collect()
    assert sorted((r["label"], r["first_word"], r["end_word"], r["containment"]) for r in hits) == [("cc-by-nc", 32, 48, 1.0), ("cc-by-nc", 40, 56, 1.0)]


def test_empty_table_and_no_templates(spark, texts):
    docs = spark.createDataFrame([(1, "mit license", "x", "x", "x", "x")], SCHEMA)
    assert licenses.scan(docs.limit(0)).count() == 0
    assert [r["labels"] for r in licenses.scan(docs, templates=[]).collect()] == ["mit"]


def test_no_python_in_the_plan(spark, texts):
    docs = spark.createDataFrame([(1, "mit license", "x", "x", "x", "x")], SCHEMA)
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
