"""Ranked lexical search against brute force, with nulls, ties, repeated ids, long texts, clashing columns and several blocks of items."""

import math
import random
import re

import pytest

from quillon.llm import lexscan

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, item_id string, score string, rank string, n string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, k=10):
    lists = [(r[0], terms(r[1])) for r in docs]
    lists = [(d, t) for d, t in lists if t]
    total, words = len(lists), sum(len(t) for _, t in lists)
    df = {}
    for _, t in lists:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for i, text, *_ in items:
        wanted.setdefault(i, []).extend(terms(text))
    out = []
    for i, query in wanted.items():
        scored = []
        for d, t in lists:
            m = 25 + 75 * len(t) * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in query if x in t)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "THE", "naïve", "日本語", "Ünder", "a_b", "it's", "x1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "x", "x", "x", "x") for i in range(150)]
    docs += [(200 + i, docs[3][1], "x", "x", "x", "x") for i in range(40)]  # copies tie
    docs += [(300, None, "x", "x", "x", "x"), (301, "", "x", "x", "x", "x"), (302, "?! _ \n", "x", "x", "x", "x"), (None, "the w1 w2", "x", "x", "x", "x"), (7, "w5 w5 w6", "x", "x", "x", "x"), docs[9]]
    docs += [(303, "the  w1\tw1,w1" * 30_000, "x", "x", "x", "x"), (304, "x" * 900_000, "x", "x", "x", "x")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "absent"), (93, "w1 w1 W1 the"), (3, "w9 naïve"), (None, "w2 日本語"), (94, "w1" * 3)]
    return docs, items


@pytest.mark.parametrize("bound", [lexscan.POSTINGS, 100])
def test_search_matches_brute_force(spark, tables, bound, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(lexscan, "CELLS", 500)
    got = lexscan.search(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(items, "item_id long, text string").repartition(3), postings_bound=bound)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_text_ids(spark, tables):
    docs, items = [(f"d{i}", *r[1:]) for i, r in enumerate(tables[0][:60])], [(f"i{r[0]}", r[1]) for r in tables[1][:9]]
    got = lexscan.search(spark.createDataFrame(docs, DOCS.replace("doc_id long", "doc_id string")), spark.createDataFrame(items, "item_id string, text string"), k=3)
    keyed = {d[0]: n for n, d in enumerate(sorted(docs))}
    want = brute([(keyed[d[0]], d[1]) for d in docs], items, 3)
    assert sorted(((r[0], r[1], keyed[r[2]], r[3]) for r in got.collect()), key=repr) == want


def test_empty_tables(spark, tables):
    docs, items = spark.createDataFrame(tables[0], DOCS), spark.createDataFrame(tables[1], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id = 301"), items)):
        got = lexscan.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
