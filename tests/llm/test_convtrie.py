"""The conversation trie against a brute-force one, with null, equal and repeated turns, absent families and long conversations."""

import hashlib
import random
import zlib

import pytest

from quillon.llm import convtrie
from quillon.llm.common import Shelf

COLUMNS = "conv_id long, turn long, role string, text string, total string, at string, d1 string, salt string"


def brute(rows, heads=True):
    rows = [r for r in rows if r[0] is not None]
    own = {}
    for c, t, role, text, *_ in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]
        own.setdefault(c, []).append((t is not None, t or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = (own.get(base, [])[:h] if heads else []) + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids.setdefault(p, 0)
        leaves[p] = leaves.get(p, 0) + (kids[p] == 0)
        saved[p] = saved.get(p, 0) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            q = p[:-1]
            kids[q] = kids.get(q, 0) + 1
            leaves[q] = leaves.get(q, 0) + leaves[p]
            saved[q] = saved.get(q, 0) + saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def trie(spark, rows, heads=True, block=convtrie.BLOCK):
    shelf = Shelf(spark)
    placed = convtrie.number_turns(spark.createDataFrame(rows, COLUMNS).repartition(5), shelf)
    convs, turns = convtrie.with_shared_heads(placed, shelf) if heads else convtrie.as_they_are(placed)
    return sorted((tuple(r) for r in convtrie.prefix_trie(convs, turns, shelf, block).collect()), key=lambda x: (x[1], x[0]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for c in [*range(0, 130), *range(205, 240), *range(-120, -90), 10**12 + 7, 900]:
        for t in range(rng.randint(1, 9)):
            out.append((c, t * 3 - 4, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "wörd 😀", "x" * 40]), "x", "x", "x", "x"))
    out += [(5, None, "user", w, "x", "x", "x", "x") for w in ("b", "a", "a", None, "b", "b")]  # null marks and equal turns
    out += [(7, 2, "user", w, "x", "x", "x", "x") for w in ("tie", "eit", "tie")]
    out += [(300, t, "user", "same" if t % 7 else str(t), "x", "x", "x", "x") for t in range(60)] + [(301, t, "user", "same" if t % 7 else str(t), "x", "x", "x", "x") for t in range(50)]
    out += [(None, 1, "user", "nobody", "x", "x", "x", "x"), (400, 0, "user", "long " * 20_000, "x", "x", "x", "x")]
    return out + out[40:60]


@pytest.mark.parametrize("heads, block", [(True, 4), (True, 1), (False, 3), (False, 64)])
def test_trie_matches_brute_force(spark, rows, heads, block):
    assert trie(spark, rows, heads, block) == brute(rows, heads)


def test_long_conversations_are_cut_and_joined_again(spark, rows, monkeypatch):
    monkeypatch.setattr(convtrie, "STRETCH", 3)
    monkeypatch.setattr(convtrie, "COPIES", 2)
    more = rows + [(302, 5, "user", "copy", "x", "x", "x", "x")] * 23
    assert trie(spark, more, True, 2) == brute(more, True)


def test_empty_table_has_no_root(spark):
    assert trie(spark, []) == []
