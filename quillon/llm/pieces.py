"""Operator 7: SentencePiece encoding and decoding, with segmentations sampled without replacement."""

from __future__ import annotations

import heapq
import importlib.util
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh
from quillon.llm.shingles import mix, powers

SPACE, MARK, NEWLINE, NONE = 32, 0x2581, 10, 0x110000
SLICE_CHARS = 250_000
STEPS = mix(np.arange(1, 4097, dtype=np.uint64))
SCHEMA = "sample int, ids array<int>, n_pieces int, log_prob double, score double, inclusion double, round_trip boolean"


def default_model() -> str:
    """The public piece model of this machine, where one is installed."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, "piece_bpe_32k.model")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def poly(cps: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial hash: the run [i, j) hashes to (sums[j] - sums[i]) * INVERSE^i."""
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(mix(cps.astype(np.uint64) + np.uint64(1)) * powers(max(2, len(cps)))[0][: len(cps)], out=sums[1:])
    return sums


class Pieces:
    """The vocabulary of a SentencePiece model, with a weight per piece.

    A BPE model ranks its pieces and has no probabilities: a piece's log weight here is -log(rank + 10), and a byte's
    is that of the last rank. A model of another type keeps its own scores. Pieces that no text reaches are left out.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.vocab_size()
        self.names = [m.id_to_piece(i) for i in range(n)]
        scores = np.array([m.get_score(i) for i in range(n)])
        text = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        scored = [i for i in text if scores[i] > -1e8]
        normal = scored + [i for i in text if scores[i] <= -1e8 and len(self.names[i]) == 1]
        low = min(scores[scored], default=0)
        ranked = low < -100
        weight = np.full(n, -np.log(n + 10.0) if ranked else low - 1.0)
        weight[scored] = -np.log(10.0 - scores[scored]) if ranked else scores[scored]
        self.weight = weight
        self.byte = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if (self.byte == m.unk_id()).any():
            raise ValueError("the model has no byte pieces, so that it cannot give back every text")
        self.bytes = [b""] * n
        for i in normal:
            self.bytes[i] = self.names[i].replace("▁", " ").encode()
        for b in range(256):
            self.bytes[self.byte[b]] = bytes([b])
        by: dict[int, list] = {}
        for i in normal:
            cps = code_points(self.names[i])
            by.setdefault(len(cps), []).append((int(poly(cps)[-1]), i))
        self.table = {k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)], np.int32), self._filter([h for h, _ in v])) for k, v in sorted(by.items())}

    @staticmethod
    def _filter(hashes: list[int]) -> np.ndarray:
        """Which of 2^20 hash ranges hold a piece: most runs of characters are told apart without a search."""
        out = np.zeros(1 << 20, bool)
        out[[h >> 44 for h in hashes]] = True
        return out

    def decode(self, ids) -> str:
        """The text of a piece sequence; the space that encoding put in front is taken off, ids that are no text add nothing."""
        raw = b"".join([self.bytes[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class Lattices:
    """The lattices of all distinct units of some texts. A unit starts at a space or a line end: no piece crosses it.

    Row i of the tables stands for character i of the distinct units end to end, column j for the piece of j + 1 characters
    that begins there (or the character as bytes). logp is the edge's share of the weight of all segmentations from there to the
    unit's end, so following edges by it draws a segmentation of the unit by its weight. An edge's code is row * width + column.
    """

    def __init__(self, pieces: Pieces, cps: np.ndarray, starts: np.ndarray):
        ends = np.append(starts[1:], len(cps))
        sums = poly(cps)
        down = powers(max(2, len(cps) + 1))[1]
        names = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        _, where, self.unit = np.unique(names, return_index=True, return_inverse=True)
        a, size = starts[where], (ends - starts)[where]
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        self.first, self.last = begin[:-1], begin[1:]
        c = cps[np.arange(begin[-1]) + np.repeat(a - begin[:-1], size)].astype(np.uint32)
        literal = c == MARK
        c[c == SPACE] = MARK
        c[literal] = NONE
        left = np.repeat(begin[1:], size) - np.arange(len(c))
        sums, found = poly(c), []
        for k, (hashes, ids, filled) in pieces.table.items():
            i = np.flatnonzero(left >= k)
            h = (sums[i + k] - sums[i]) * down[i]
            some = np.flatnonzero(filled[(h >> np.uint64(44)).astype(np.int64)])
            i, h = i[some], h[some]
            p = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[p] == h
            if hit.any():
                found.append((k, i[hit], ids[p[hit]]))
        # As wide as the longest piece that occurs.
        self.width = max([k for k, _, _ in found], default=1)
        self.ids = np.full((len(c), self.width), -1, np.int32)
        self.logp = np.full((len(c), self.width), -np.inf, np.float32)
        for k, i, p in found:
            self.ids[i, k - 1] = p
            self.logp[i, k - 1] = pieces.weight[p]
        # Characters without a piece: their ids are -2, -3, ... into ``raw``.
        rest = np.flatnonzero(self.ids[:, 0] < 0)
        self.raw = [pieces.byte[list(chr(MARK if c[i] == NONE else c[i]).encode("utf-8", "replace"))] for i in rest]
        self.ids[rest, 0] = -2 - np.arange(len(rest))
        self.logp[rest, 0] = [pieces.weight[pieces.byte[0]] * len(r) for r in self.raw]
        self._solve(left)

    def _solve(self, left: np.ndarray) -> None:
        total = np.zeros(len(left) + self.width + 1, np.float64)  # log weight from a row to its unit's end
        order = np.argsort(left, kind="stable")
        levels = np.flatnonzero(np.diff(left[order], prepend=0))
        for s, e in zip(levels, np.append(levels[1:], len(order))):
            some = order[s:e]
            k = min(self.width, int(left[some[0]]))
            after = total[some[:, None] + np.arange(1, k + 1)]
            if k == left[some[0]]:
                after[:, k - 1] = 0.0  # the unit ends there
            value = self.logp[some, :k] + after
            high = value.max(axis=1, keepdims=True)
            all_ = high[:, 0] + np.log(np.exp(value - high).sum(axis=1))
            total[some] = all_
            self.logp[some, :k] = value - all_[:, None]
        self.cum = np.cumsum(np.exp(self.logp), axis=1, dtype=np.float32)
        self.lone = np.count_nonzero(np.isfinite(self.logp), axis=1) == 1  # rows with one edge

    def follow(self, seed: np.ndarray, cur: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a segmentation of the rest [cur, end) of each unit; the edges' codes in order, and which unit each is of."""
        at = np.arange(len(cur))
        codes, owners, step = [], [], 0
        while True:
            alive = cur < end
            if not alive.all():
                at, cur, end = at[alive], cur[alive], end[alive]
            if not len(at):
                break
            u = ((mix(seed[at] + STEPS[step % len(STEPS)] + np.uint64(step)) >> np.uint64(40)) * 2.0**-24).astype(np.float32)
            cum = self.cum[cur]
            j = np.minimum((cum <= (u * cum[:, -1])[:, None]).sum(axis=1), self.width - 1)
            codes.append(cur * self.width + j)
            owners.append(at)
            cur = cur + j + 1
            step += 1
        if not codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(codes)[order], owner[order]

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many each edge gives."""
        ids = self.ids.ravel()[codes]
        count = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, count
        which = -2 - ids[odd]
        count[odd] = np.array([len(r) for r in self.raw])[which]
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        out = np.repeat(ids, count)
        for j in range(4):
            more = odd[count[odd] > j]
            out[begin[more] + j] = [self.raw[-2 - ids[o]][j] for o in more]
        return out, count


def unit_uniform(seed: np.ndarray) -> np.ndarray:
    return (mix(seed) >> np.uint64(11)) * 2.0**-53


def exponential(seed: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.minimum(unit_uniform(seed), 1 - 2.0**-53))


def truncated(loc: np.ndarray, limit: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Gumbel values with locations ``loc``, given that they stay below ``limit``; minus infinity where nothing is left."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = loc - np.log(np.exp(np.minimum(loc - limit, 700.0)) + e)
    return np.where(np.isneginf(loc), -np.inf, np.minimum(out, limit))


def best_steps(values: np.ndarray, begin: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` largest values of each document (begin has where each one's begin; none is empty), document by document."""
    left, found = values.copy(), []
    size = np.diff(begin)
    for _ in range(min(most, int(size.max(initial=0)))):
        high = np.maximum.reduceat(left, begin[:-1])
        at = np.flatnonzero(left == np.repeat(high, size))
        at = at[left[at] > -np.inf]
        doc = np.searchsorted(begin, at, side="right") - 1
        at = at[np.flatnonzero(np.diff(doc, prepend=-1))]  # of equal values the first
        if not len(at):
            break
        found.append(at)
        left[at] = -np.inf
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def sample(lat: Lattices, unit_at: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, k distinct segmentations by Gumbel top-k: (edges, log probability, perturbed log probability, inclusion).

    Text i has the units unit_at[i] to unit_at[i + 1] of ``lat.unit``. A segmentation's perturbed log probability is its log probability plus Gumbel noise; the k largest are a sample
    without replacement. The search is best first over sets of segmentations: a set has the Gumbel value of its
    total probability, the best one is followed down to a segmentation, and what each step leaves aside becomes a
    new set, whose value is drawn below its parent's. inclusion is the chance to be among the k, given the best
    value outside: 1 - exp(-exp(log_prob - value)). Paths of all texts are followed together.
    """
    n = len(seeds)
    out: list[list] = [[] for _ in range(n)]
    paths: list[list] = [[] for _ in range(n)]
    queues: list[list] = [[] for _ in range(n)]
    flat = lat.logp.ravel()

    def add(docs, codes, owners, doc_of, values, turn, skip):
        """New paths of ``docs``; codes and owners (unit numbers in the text) are the steps after the branch, doc_of their place in docs."""
        logp = flat[codes].astype(np.float64)
        begin = np.searchsorted(doc_of, np.arange(len(docs) + 1))
        runs = np.concatenate([np.zeros(1), np.cumsum(logp)])
        base = np.array([paths[d][p][2][s] if p >= 0 else 0.0 for d, p, s, _ in docs])
        before = base[doc_of] + runs[:-1] - runs[begin[doc_of]]
        with np.errstate(divide="ignore"):
            aside = np.log(np.maximum(-np.expm1(np.minimum(logp, 0.0)), 0.0))
            close = np.flatnonzero(logp > -1e-3)  # there, add up the sisters instead, if there are any
            alone = lat.lone[codes[close] // lat.width]
            aside[close[alone]] = -np.inf
            sure = close[~alone]
            sisters = np.exp(lat.logp[codes[sure] // lat.width].astype(np.float64))
            sisters[np.arange(len(sure)), codes[sure] % lat.width] = 0.0
            aside[sure] = np.log(sisters.sum(axis=1))
        loc = before + aside
        if skip:
            loc[begin[:-1]] = -np.inf  # the parent keeps what the branching step leaves aside
        e = exponential(seeds[np.array([d[0] for d in docs])][doc_of] ^ mix((np.arange(len(codes)) - begin[doc_of] + turn * 1_000_003 + 7).astype(np.uint64)))
        gumbel = truncated(loc, values[doc_of], e)
        # As many as can still be followed, and the best one outside.
        for j in best_steps(gumbel, begin, k - turn).tolist():
            i = doc_of[j]
            d, p, s, _ = docs[i]
            heapq.heappush(queues[d], (-gumbel[j], len(paths[d]), s + int(j - begin[i]), (int(codes[j]),)))
        for i, (d, p, s, _) in enumerate(docs):
            mine, own = codes[begin[i] : begin[i + 1]], owners[begin[i] : begin[i + 1]]
            prefix = base[i] + runs[begin[i] : begin[i + 1] + 1] - runs[begin[i]]
            if p >= 0:
                parent = paths[d][p]
                mine, own = np.concatenate([parent[0][:s], mine]), np.concatenate([parent[1][:s], own])
                prefix = np.concatenate([parent[2][:s], prefix])
            paths[d].append((mine, own, prefix))
            out[d].append((mine, float(prefix[-1]), float(values[i])))

    def seeds_of(doc, unit, turn):
        return mix(seeds[doc] ^ mix(unit.astype(np.uint64) * np.uint64(64) + np.uint64(turn)))

    full = np.flatnonzero(np.diff(unit_at))
    doc = np.repeat(full, np.diff(unit_at)[full])
    unit_no = np.arange(len(doc)) - unit_at[doc]
    codes, at = lat.follow(seeds_of(doc, unit_no, 0), lat.first[lat.unit], lat.last[lat.unit])
    start = [(int(d), -1, 0, None) for d in full]
    place = np.zeros(n, np.int64)
    place[full] = np.arange(len(full))
    if len(full):
        add(start, codes, unit_no[at], place[doc[at]], -np.log(exponential(seeds[full] ^ np.uint64(0xABCDEF))), 0, False)
    for turn in range(1, k):
        docs, cur, end, doc, unit_no, heads, values = [], [], [], [], [], [], []
        for d in full:
            if not queues[d]:
                continue
            value, p, s, used = heapq.heappop(queues[d])
            value = -value
            own, prefix = paths[d][p][1], paths[d][p][2]
            row = used[0] // lat.width
            edges = lat.logp[row].astype(float)
            prob = np.exp(edges)
            prob[[c % lat.width for c in used]] = 0.0
            share = np.cumsum(prob)
            if share[-1] <= 0:
                continue
            r = float(unit_uniform(seeds[d : d + 1] ^ np.uint64(turn * 7_919 + 3))[0])
            j = min(int(np.searchsorted(share, r * share[-1], side="right")), int(np.flatnonzero(prob)[-1]))
            used += (row * lat.width + j,)
            prob[j] = 0.0
            others = prob.sum()
            if others > 0:
                rest = truncated(np.array([prefix[s] + np.log(others)]), np.array([value]), exponential(seeds[d : d + 1] ^ np.uint64(turn * 104_729 + 5)))
                heapq.heappush(queues[d], (-float(rest[0]), p, s, used))
            u, a, b = int(own[s]), unit_at[d], unit_at[d + 1]
            units = lat.unit[a + u : b]
            c = lat.first[units].copy()
            c[0] = row + j + 1
            cur.append(c)
            end.append(lat.last[units])
            doc.append(np.full(len(units), len(docs)))
            unit_no.append(np.arange(u, u + len(units)))
            heads.append(row * lat.width + j)
            values.append(value)
            docs.append((int(d), p, s, None))
        if not docs:
            break
        doc, unit_no = np.concatenate(doc), np.concatenate(unit_no)
        ids = np.array([d[0] for d in docs])
        codes, at = lat.follow(seeds_of(ids[doc], unit_no, turn), np.concatenate(cur), np.concatenate(end))
        # The branching edge goes in front of each text's tail.
        doc_of = doc[at]
        where = np.searchsorted(doc_of, np.arange(len(docs)))
        own = np.insert(unit_no[at], where, unit_no[np.searchsorted(doc, np.arange(len(docs)))])
        add(docs, np.insert(codes, where, heads), own, np.insert(doc_of, where, np.arange(len(docs))), np.array(values), turn, True)
    result = []
    for d in range(n):
        outside = -queues[d][0][0] if queues[d] else -np.inf
        with np.errstate(over="ignore"):
            result.append([(c, lp, v, 1.0 if np.isneginf(outside) else float(-np.expm1(-np.exp(min(lp - outside, 700.0))))) for c, lp, v in out[d]])
    return result


def encode(docs: DataFrame, columns: list[str], k: int = 2, seed: int = 1, model_file: str | None = None, key: str = "doc_id") -> DataFrame:
    """``columns`` and, per sample (from 0, best perturbed first): ids, n_pieces, log_prob, score, inclusion, round_trip.

    Every whole text is segmented by ``k`` distinct draws, seeded by ``seed`` and the row's key, whatever rows are
    beside it; a text with fewer segmentations gives them all, with inclusion 1. As in SentencePiece, a space goes
    in front of the text and characters without a piece become bytes. round_trip tells that decoding the ids gave the text.
    A null or empty text has one sample without pieces. Rows with equal keys and texts have equal samples; a null key is a
    key like any other. Input columns with the names of results are replaced.
    """
    path = model_file or default_model()
    results = {c.split()[0] for c in SCHEMA.split(", ")}
    columns = [c for c in columns if c not in results]
    seeds, whole_text = fresh(columns, "__seed", "__text")
    kept = docs.select(*columns, F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias(seeds), F.col("text").alias(whole_text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2])

    def run(batches):
        pieces = Pieces(path)
        for whole in batches:
            lengths = np.array(pc.fill_null(pc.utf8_length(whole.column(whole_text)), 0))
            at, sums = 0, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths + 1)])
            while at < whole.num_rows:
                end = max(at + 1, int(np.searchsorted(sums, sums[at] + SLICE_CHARS, side="right")) - 1)
                yield from encode_slice(pieces, whole.slice(at, min(end, whole.num_rows) - at))
                at = end

    def encode_slice(pieces, batch):
        texts = [t or "" for t in batch.column(whole_text).to_pylist()]
        cps = code_points("".join([" " + t if t else "" for t in texts]))
        doc_at = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) + 1 if t else 0 for t in texts])])
        drawn = batch.column(seeds).to_numpy().view(np.uint64)
        nothing = [(np.zeros(0, np.int64), 0.0, 0.0, 1.0)]
        found = [nothing] * len(texts)
        if len(cps):
            new = (cps == SPACE) | (cps == NEWLINE)
            new[1:] |= cps[:-1] == NEWLINE
            new[doc_at[:-1][np.diff(doc_at) > 0]] = True
            starts = np.flatnonzero(new)
            lat = Lattices(pieces, cps, starts)
            found = [f or nothing for f in sample(lat, np.searchsorted(starts, doc_at), drawn, k)]
        rows = [(i, j, *x) for i, f in enumerate(found) for j, x in enumerate(f)]
        for s in range(0, len(rows), 1000):
            some = rows[s : s + 1000]
            codes = np.concatenate([r[2] for r in some])
            edges = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(r[2]) for r in some])])
            ids, count = lat.expand(codes) if len(codes) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])[edges].astype(np.int32)
            spelled = [pieces.decode(ids[a:b].tolist()) == texts[r[0]] for r, a, b in zip(some, offsets[:-1], offsets[1:])]
            cols = [pa.array([r[1] for r in some], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(np.diff(offsets))]
            cols += [pa.array([r[m] for r in some], pa.float64()) for m in (3, 4, 5)] + [pa.array(spelled)]
            taken = batch.select(columns).take(pa.array([r[0] for r in some])).columns if columns else []
            yield pa.RecordBatch.from_arrays([*taken, *cols], names=[*columns, *(c.split()[0] for c in SCHEMA.split(", "))])

    return kept.mapInArrow(run, f"{fields}, {SCHEMA}" if fields else SCHEMA)


def decode(encoded: DataFrame, columns: list[str], model_file: str | None = None) -> DataFrame:
    """``columns`` and text: what the piece ids of ``ids`` spell; null ids give a null text, ids that are no text add nothing."""
    path = model_file or default_model()
    columns = [c for c in columns if c != "text"]
    kept = encoded.select(*columns, "ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches):
        pieces = Pieces(path)
        n = len(pieces.bytes)
        for batch in batches:
            texts = [None if ids is None else pieces.decode([i for i in ids if i is not None and 0 <= i < n]) for ids in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*columns, "text"])

    return kept.mapInArrow(run, f"{fields}, text string" if fields else "text string")
