"""Operator 9: language-model scoring with a causal self-attention model on subword ids, trained in numpy."""

from __future__ import annotations

import base64
import importlib.util
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Shelf, local_rows, row_numbers, slices, text_buffer, tidy
from quillon.llm.shingles import mix, words

# A window is CONTEXT inputs that are only looked at and SCORED inputs whose next token is scored.
CONTEXT, SCORED = 8, 24
WINDOW = CONTEXT + SCORED
WIDTH, KNOWN, CLASS = 16, 1024, 32
# Words counted this often or more are sent to all tasks; the threshold is raised until at most this many are.
FREQUENT = 200_000
# Windows of the start model (all windows of all training texts refine it afterwards).
START_WINDOWS = 8192
# Windows that one bucket of a training round holds, on average.
BUCKET = 1 << 17
# Windows laid out at once.
STEP = 8192
CACHE = 400_000


def default_tokenizer() -> str:
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(spec.origin) if spec else "/opt/tokenizers", "byte_bpe_50k.tiktoken")


class Subwords:
    """Ids of words under a public byte-level BPE; each word is encoded by itself, with a space in front."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, word: str) -> list[int]:
        # A word is one piece of text for the encoder; very long ones go in parts, since its merges take quadratic time.
        if len(word) <= 64:
            return self.encoding.encode_ordinary(" " + word)
        return list(chain.from_iterable(self.encoding.encode_ordinary((" " if i == 0 else "") + word[i : i + 64]) for i in range(0, len(word), 64)))


class WordIds:
    """Subword ids of the words of a slice of texts; distinct words are encoded once and remembered while there is room."""

    def __init__(self, subwords: Subwords):
        self.subwords, self.seen = subwords, {}

    def __call__(self, data: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray):
        """(distinct hashes, which of them each word is, flat ids, where each distinct word's begin)."""
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen, out, raw, encode = self.seen, [], data.tobytes().translate(LOWER), self.subwords.encode
        for h, i, j in zip(distinct.tolist(), first[where].tolist(), last[where].tolist()):
            ids = seen.get(h)
            if ids is None:
                ids = seen[h] = encode(raw[i:j].decode("utf-8", "replace"))
            out.append(ids)
        begin = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in out], dtype=np.int64)])
        return distinct, which, np.fromiter(chain.from_iterable(out), np.int32, int(begin[-1])), begin


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def sequences(ids: np.ndarray, begin: np.ndarray, which: np.ndarray, starts: np.ndarray, end: int):
    """Subword ids of texts, each with ``end`` behind it, and where each text's begin."""
    count = np.diff(begin)[which]
    runs = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    flat = ids[np.arange(runs[-1]) + np.repeat(begin[which] - runs[:-1], count)]
    at = runs[starts]
    return np.insert(flat, at[1:], end), at + np.arange(len(starts))


def cut_windows(flat: np.ndarray, begin: np.ndarray, end: int, which: np.ndarray | None = None):
    """Windows of every text: (inputs, targets, text of each window); -1 stands for no token.

    Window w of a text scores its tokens from w * SCORED on, so every token once; the inputs are the tokens before
    each, the CONTEXT before those, and ``end`` in front of the text.
    """
    size = np.diff(begin)
    per = -(-size // SCORED)
    text = np.repeat(np.arange(len(size)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    if which is not None:
        text, number = text[which], number[which]
    pos = number[:, None] * SCORED + np.arange(-CONTEXT, SCORED) - 1  # position of the input in the text, -1 is the start
    at = begin[text][:, None] + pos
    inputs = np.where(pos >= 0, flat[np.clip(at, 0, max(len(flat) - 1, 0))], np.where(pos == -1, end, -1))
    inputs[pos >= size[text][:, None]] = -1
    tpos = pos[:, CONTEXT:] + 1
    targets = np.where(tpos < size[text][:, None], flat[np.clip(at[:, CONTEXT:] + 1, 0, max(len(flat) - 1, 0))], -1)
    return inputs, targets, text


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w for a stack of matrices x, as one product."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of x^T y over a stack of matrices, as one product."""
    return x.reshape(-1, x.shape[-1]).T @ y.reshape(-1, y.shape[-1])


def row_sums(e: np.ndarray) -> np.ndarray:
    return times(e, np.ones((e.shape[-1], 1), e.dtype))


def exp_rows(z: np.ndarray) -> np.ndarray:
    """exp(z), with each row's maximum taken off first where numbers are large; a row's shares are the same either way."""
    if z.size and max(z.max(), -z.min()) > 30:
        z = z - z.max(axis=-1, keepdims=True)
    return np.exp(z)


class Attention:
    """One layer of causal self-attention with a residual, and a softmax in two steps: the class of the next token, then the token.

    The KNOWN commonest subwords are tokens of their own, CLASS to a class; all others are one token with a class of
    its own, told apart by their counts.
    """

    NAMES = ["embed", "place", "query", "key", "value", "out", "wclass", "bclass", "wtoken", "btoken"]

    def __init__(self, counts: np.ndarray, seed: int = 3):
        order = np.argsort(-counts, kind="stable")[:KNOWN]
        share = np.full(KNOWN, 0.5)
        share[: len(order)] += counts[order]
        self.token = np.full(len(counts), KNOWN, np.int64)
        self.token[order] = np.arange(len(order))
        rest = counts + 0.5
        rest[order] = 0.0
        self.rest = np.log10(np.maximum(rest, 1e-300) / max(rest.sum(), 1e-300))
        self.rest[order] = 0.0
        self.classes = KNOWN // CLASS
        share = share.reshape(self.classes, CLASS)
        of_class = np.append(share.sum(axis=1), max(rest.sum(), 0.5))  # the biases start at the counts: a model without weights is the unigram
        rng = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        d = WIDTH
        self.weights = {
            "embed": draw(KNOWN + 1, d, scale=0.3), "place": draw(WINDOW, d, scale=0.1), "query": draw(d, d, scale=d**-0.5), "key": draw(d, d, scale=d**-0.5),
            "value": draw(d, d, scale=d**-0.5), "out": draw(d, d, scale=d**-0.5), "wclass": draw(d, self.classes + 1, scale=0.1), "bclass": np.log(of_class / of_class.sum()).astype(np.float32),
            "wtoken": draw(self.classes, CLASS, d, scale=0.1), "btoken": np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
        }
        causal = np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]
        self.mask = np.where(causal, 0.0, -1e9).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[n].ravel() for n in self.NAMES])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            w = self.weights[n]
            self.weights[n] = np.asarray(values[at : at + w.size], np.float32).reshape(w.shape)
            at += w.size

    def hidden(self, tokens: np.ndarray):
        """tokens (windows, WINDOW), -1 for none: the hidden state at each scored input, and what training needs."""
        w = self.weights
        x = w["embed"][np.maximum(tokens, 0)] + w["place"]
        late = x[:, CONTEXT:]
        q, k, v = times(late, w["query"]), times(x, w["key"]), times(x, w["value"])
        a = (q * np.float32(WIDTH**-0.5)) @ k.transpose(0, 2, 1)
        large = a.size and max(a.max(), -a.min()) > 30
        a += self.mask
        some = np.flatnonzero((tokens < 0).any(axis=1))
        a[some] += np.where(tokens[some] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
        if large:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= row_sums(a)
        mixed = a @ v
        return late + times(mixed, w["out"]), (x, q, k, v, a, mixed)

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target token (rows of h)."""
        w = self.weights
        logits = h @ w["wclass"] + w["bclass"]
        cls = target // CLASS
        shares = exp_rows(logits)
        out = np.log(np.maximum(shares[np.arange(len(h)), cls] / row_sums(shares)[:, 0], 1e-30))
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(self.classes + 1))
        h, own, part = h[order], (target - cls * CLASS)[order], np.zeros(len(h), h.dtype)
        for c in np.flatnonzero(np.diff(cut)):
            rows = slice(cut[c], cut[c + 1])
            z = h[rows] @ w["wtoken"][c].T + w["btoken"][c]
            e = exp_rows(z)
            part[rows] = np.log(np.maximum(e[np.arange(len(z)), own[rows]] / row_sums(e)[:, 0], 1e-30))
        out[order] += part
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch of windows of tokens, and its gradients."""
        w, d = self.weights, WIDTH
        h, (x, q, k, v, a, mixed) = self.hidden(inputs)
        flat, t = h.reshape(-1, d), targets.ravel()
        some = np.argsort(t, kind="stable")[np.count_nonzero(t < 0) :]  # by token, so that a class is a slice
        hs, t, n = flat[some], t[some], max(1, len(some))
        cls = t // CLASS
        z = hs @ w["wclass"] + w["bclass"]
        p = exp_rows(z)
        p /= row_sums(p)
        loss = -np.log(np.maximum(p[np.arange(len(t)), cls], 1e-12)).sum()
        p[np.arange(len(t)), cls] -= 1
        p /= n
        g = {"wclass": hs.T @ p, "bclass": p.sum(axis=0), "wtoken": np.zeros_like(w["wtoken"]), "btoken": np.zeros_like(w["btoken"])}
        dh = p @ w["wclass"].T
        cut = np.searchsorted(cls, np.arange(self.classes + 1))
        for c in np.flatnonzero(np.diff(cut)):
            rows = slice(cut[c], cut[c + 1])
            z = hs[rows] @ w["wtoken"][c].T + w["btoken"][c]
            e = exp_rows(z)
            e /= row_sums(e)
            own = (np.arange(len(z)), t[rows] - c * CLASS)
            loss -= np.log(np.maximum(e[own], 1e-12)).sum()
            e[own] -= 1
            e /= n
            g["wtoken"][c], g["btoken"][c] = e.T @ hs[rows], e.sum(axis=0)
            dh[rows] += e @ w["wtoken"][c]
        back = np.zeros_like(flat)
        back[some] = dh
        back = back.reshape(h.shape)
        g["out"] = outer(mixed, back)
        dm = times(back, w["out"].T)
        da = dm @ v.transpose(0, 2, 1)
        da -= row_sums(a * da)
        da *= a
        ds = da * np.float32(d**-0.5)
        dq, dk, dv = ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dm
        late = x[:, CONTEXT:]
        g["query"], g["key"], g["value"] = outer(late, dq), outer(x, dk), outer(x, dv)
        dx = times(dk, w["key"].T) + times(dv, w["value"].T)
        dx[:, CONTEXT:] += back + times(dq, w["query"].T)
        g["place"] = dx.sum(axis=0)
        used = inputs >= 0
        cells = inputs[used][:, None] * d + np.arange(d)
        g["embed"] = np.bincount(cells.ravel(), dx[used].ravel(), w["embed"].size).reshape(w["embed"].shape).astype(dx.dtype)
        return float(loss / n), g

    def train(self, inputs: np.ndarray, targets: np.ndarray, epochs: int, rate: float, batch: int = 128, seed: int = 1) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m = {n: np.zeros_like(x) for n, x in self.weights.items()}
        s = {n: np.zeros_like(x) for n, x in self.weights.items()}
        step, loss = 0, 0.0
        total = epochs * -(-len(inputs) // batch)
        for _ in range(epochs):
            order, losses = rng.permutation(len(inputs)), []
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                value, g = self.gradients(inputs[rows], targets[rows])
                losses.append(value)
                step += 1
                lr = rate * (1 - step / (total + 1))
                for name, grad in g.items():
                    m[name] += 0.1 * (grad - m[name])
                    s[name] += 0.01 * (grad * grad - s[name])
                    self.weights[name] = (self.weights[name] - lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss

    def tokens(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < 0, -1, self.token[np.maximum(ids, 0)])

    def score_windows(self, inputs: np.ndarray, targets: np.ndarray, step: int = 512) -> np.ndarray:
        """log10 probability of the scored tokens of each window; subword ids in, all windows in batches."""
        out = np.zeros(len(inputs))
        for s in range(0, len(inputs), step):
            t = targets[s : s + step]
            h, _ = self.hidden(self.tokens(inputs[s : s + step]))
            some = t.ravel() >= 0
            ids = t.ravel()[some]
            lp = np.zeros(t.size)
            lp[some] = self.log_probs(h.reshape(-1, WIDTH)[some], self.token[ids]) / np.log(10) + self.rest[ids]
            out[s : s + step] = lp.reshape(t.shape).sum(axis=1)
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, trained, total): occurrences of every word, by 64-bit hash, in training rows and in all; a task adds up each batch first."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            train = batch.column(1).to_numpy(zero_copy_only=False)
            parts, weights = [], []
            for a, b in slices(offsets):
                hashes, _, _, starts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                parts.append(hashes)
                weights.append(np.repeat(train[a:b], np.diff(starts)))
            if parts:
                distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
                trained = np.bincount(which, np.concatenate(weights), len(distinct)).astype(np.int64)
                total = np.bincount(which, minlength=len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(trained), pa.array(total)], names=["word", "trained", "total"])

    counted = docs.select("text", "train").mapInArrow(run, "word long, trained long, total long")
    return counted.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total"))


def training_windows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every window of every training text: (h, tokens), tokens being the WINDOW inputs and the last target; copies of a text count each.

    h is a number drawn for the window from its document's id and text and its place there, in the range of a long, so that it
    does not depend on how rows lie in files. Rows repeated whole (id and text) are numbered within their batch, so that many of
    them do not meet in one bucket; only with such rows the layout can still change weights a little.
    """

    def run(batches):
        subwords = Subwords(tokenizer)
        ids_of = WordIds(subwords)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            keys = batch.column(1).to_numpy().view(np.uint64)
            order = np.argsort(keys, kind="stable")
            again = np.zeros(len(keys), np.uint64)
            again[order] = np.arange(len(keys)) - np.searchsorted(keys[order], keys[order])
            numbers = keys ^ mix(again)
            for a, b in slices(offsets):
                part, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, first, last, starts = words(part, o)
                _, which, ids, id_at = ids_of(part, hashes, first, last)
                flat, begin = sequences(ids, id_at, which, starts, subwords.end)
                per = -(-np.diff(begin) // SCORED)
                total, first_of = int(per.sum()), np.cumsum(per) - per
                drawn = np.repeat(mix(numbers[a:b] + np.uint64(1)), per)
                drawn = mix(drawn + (np.arange(total) - np.repeat(first_of, per)).astype(np.uint64)).view(np.int64)
                for s in range(0, total, STEP):
                    inputs, targets, _ = cut_windows(flat, begin, subwords.end, np.arange(s, min(total, s + STEP)))
                    tokens = np.concatenate([inputs, targets[:, -1:]], axis=1).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * (WINDOW + 1)), pa.array(tokens.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(drawn[s : s + STEP]), lists], names=["h", "tokens"])

    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("key")
    return docs.filter("train").select("text", key).mapInArrow(run, "h long, tokens array<int>")


def _matrices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of windows: a target is the input after it, and the last target stands for itself."""
    tokens = column.flatten().to_numpy().reshape(-1, WINDOW + 1).astype(np.int64)
    return tokens[:, :WINDOW], tokens[:, CONTEXT + 1 :]


def count_subwords(windows: DataFrame, vocabulary: int) -> DataFrame:
    """(id, count): how often each subword is a target, over all windows; a task adds its own up first."""

    def run(batches):
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            _, targets = _matrices(batch.column(0))
            counts += np.bincount(targets[targets >= 0], minlength=vocabulary)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["id", "count"])

    return windows.select("tokens").mapInArrow(run, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))


def start_sample(windows: DataFrame, rows: int = START_WINDOWS, n: int | None = None) -> pa.Table:
    """The ``rows`` of the ``n`` windows with the smallest h; only about twice as many are put in order, however many there are."""
    n = windows.count() if n is None else n
    some = windows
    if n > 2 * rows:
        some = windows.filter(F.col("h") < int(-(2**63) + 2**64 * (2 * rows / n)))
    return some.orderBy("h", "tokens").limit(rows).select("tokens").toArrow()


def narrow(bc):
    """Windows of subword ids to windows of the model's tokens, two bytes each: lists of ids take about four times as much in a shuffle."""

    def run(batches):
        for batch in batches:
            ids = batch.column(1).flatten().to_numpy()
            tokens = bc.value.tokens(ids).astype(np.int16).reshape(-1, WINDOW + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in tokens], pa.binary())], names=["h", "tokens"])

    return run


def bucket_round(bc, rate: float):
    """What a round does with a bucket: its windows in the order of h, and the weights afterwards times their number."""

    def run(group: pa.Table) -> pa.Table:
        own = Attention.__new__(Attention)
        own.__dict__.update(bc.value.__dict__)
        own.weights = dict(bc.value.weights)
        packed = b"".join(group.sort_by("h").column("tokens").to_pylist())
        tokens = np.frombuffer(packed, np.int16).reshape(-1, WINDOW + 1).astype(np.int64)
        own.train(tokens[:, :WINDOW], tokens[:, CONTEXT + 1 :], 1, rate, batch=256)
        w = own.flat().astype(np.float64) * group.num_rows
        return pa.table([pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w), pa.array(np.full(len(w), group.num_rows))], names=["at", "sum", "n"])

    return run


def train_model(windows: DataFrame, vocabulary: int, rounds: int = 1, bucket: int = BUCKET) -> Attention:
    """Fit on all windows: a start model on a bounded sample, then ``rounds`` of training in tasks and averaging.

    The start model, and nothing else, sees START_WINDOWS windows at most. A round, which is run whatever the size, deals all
    windows to buckets of about ``bucket`` windows by their drawn numbers; a task takes the model through the windows of a bucket in the
    order of these numbers, and the buckets' weights are averaged by their window counts. Neither buckets nor order depend on
    how rows lie in files. Subwords are counted over all windows, thus over all training text.
    """
    spark = windows.sparkSession
    counts, n = np.zeros(vocabulary), windows.count()
    for r in local_rows(count_subwords(windows, vocabulary), vocabulary):
        counts[r["id"]] = r["count"]
    model = Attention(counts)
    start = start_sample(windows, n=n)
    if start.num_rows:
        inputs, targets = _matrices(start.column(0).combine_chunks())
        model.train(model.tokens(inputs), model.tokens(targets), epochs=6, rate=0.01)
    buckets = -(-n // bucket)
    for r in range(rounds if start.num_rows else 0):
        bc = spark.sparkContext.broadcast(model)

        # Twice as many partitions as buckets: few tasks get more than two.
        dealt = windows.select("h", "tokens").mapInArrow(narrow(bc), "h long, tokens binary").withColumn("bucket", F.pmod("h", F.lit(buckets))).repartition(2 * buckets, "bucket")
        parts = dealt.groupBy("bucket").applyInArrow(bucket_round(bc, 0.003 / (r + 1)), "at int, sum double, n long")
        with tidy(spark):
            mean = parts.groupBy("at").agg((F.sum("sum") / F.sum("n")).alias("mean")).orderBy("at").toArrow()
        model.load(mean.column("mean").to_numpy())
        bc.unpersist()
    return model


def score(docs: DataFrame, held_out: Column, tokenizer: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z in lower case, and one end per text (a null text is empty). Counts come from every training
    row. base_score is the smoothed unigram log10 probability; score is the attention model's, the sum over the text's
    subword ids and its end. Words are counted by a 64-bit hash. The commonest words travel to all tasks in a table
    of at most FREQUENT rows; what a text has of all other words is joined with the counts, so no count is left out and no
    joined word is a hot key. Rows that repeat a doc_id are scored each; without training rows base_score follows from zero counts.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    shelf = Shelf(spark)
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).withColumn("train", ~F.col("held_out"))
    counts = shelf.put(count_words(docs), "counts")
    sums = counts.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")).first()
    ends = docs.filter("train").count()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    steps = {r["p"]: r["rows"] for r in counts.groupBy(F.floor(F.log2("total")).cast("int").alias("p")).agg(F.count("*").alias("rows")).collect()}
    least = 0
    while sum(x for p, x in steps.items() if p >= least) > FREQUENT:
        least += 1
    common = counts.filter(F.floor(F.log2("total")) >= least).orderBy("word").select("word", "trained").toArrow()
    table = (common.column("word").to_numpy().view(np.uint64), common.column("trained").to_numpy())
    order = np.argsort(table[0])
    table = (table[0][order], table[1][order])
    subwords = Subwords(tokenizer)
    windows = shelf.put(training_windows(docs, tokenizer), "windows")
    model = train_model(windows, subwords.size)
    shelf.drop(windows)
    bc = spark.sparkContext.broadcast((model, table))
    end_log = float(np.log10(ends + 0.5))

    def run(batches):
        model, (known, trained) = bc.value
        logs = np.log10(trained + 0.5)
        subwords = Subwords(tokenizer)
        ids_of = WordIds(subwords)
        for numbers, batch in row_numbers(batches):
            data, offsets = text_buffer(batch.column("text"))
            for a, b in slices(offsets):
                part, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, first, last, starts = words(part, o)
                distinct, which, ids, id_at = ids_of(part, hashes, first, last)
                place = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
                hit = known[place] == distinct if len(known) else np.zeros(len(distinct), bool)
                log = np.where(hit, logs[place], 0.0) if len(known) else np.zeros(len(distinct))
                seen = hit & (trained[place] > 0) if len(known) else hit

                def total(x):
                    return np.diff(np.concatenate([np.zeros(1), np.cumsum(x[which])])[starts])

                rare = ~hit[which]
                rare_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(rare)])[starts].astype(np.int32)
                flat, seq = sequences(ids, id_at, which, starts, subwords.end)
                inputs, targets, text = cut_windows(flat, seq, subwords.end)
                lp = np.bincount(text, model.score_windows(inputs, targets), b - a)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(numbers[a:b]), pa.array(np.diff(starts) + 1), pa.array(np.round(total(seen.astype(float))).astype(np.int64) + (ends > 0)),
                     pa.array(total(log) + end_log), pa.array(lp), pa.ListArray.from_arrays(pa.array(rare_at), pa.array(hashes[rare].view(np.int64)))],
                    names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "score", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, base double, score double, rare array<long>")
    scored = shelf.put(scored, "scored")
    rare = scored.select("row", F.explode("rare").alias("w")).join(counts, F.col("w") == F.col("word"), "left").select("row", F.coalesce("trained", F.lit(0)).alias("c"))
    rare = rare.groupBy(F.col("row").alias("rare_row")).agg(F.sum(F.log10(F.col("c") + 0.5)).alias("rare_log"), F.count(F.when(F.col("c") > 0, 1)).alias("rare_known"))
    out = scored.join(rare, scored["row"] == rare["rare_row"], "left")
    base = F.col("base") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
