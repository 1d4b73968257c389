"""LM scoring: a gated recurrent language model with a class-factored output softmax, in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.common import byte_words, fold, raw, slices, texts
from photolake.session import stored, table

#: Size of the network: state, word vectors, words, classes and groups of classes. Word 0 stands for all others, word 1 ends a text.
HIDDEN, EMBED, NETWORK_WORDS, CLASSES, GROUPS = 16, 16, 20_480, 128, 12
UNKNOWN, END = 0, 1
#: Every training text is used once: in one of so many rounds, after each of which the workers' weights are averaged.
ROUNDS = 3
#: Training goes through windows of so many words; a worker has so many lanes at most and aims at so many updates.
WINDOW, LANES, UPDATES = 16, 2048, 64
#: Words that a worker lays on its lanes at once, and those it takes in a round on average.
CHUNK, WORKER = 1 << 21, 4_000_000
#: Weights travel in so many pieces, so that sums of them are spread.
PIECES = 64
#: Scores of so many words and classes are worked out at once, to stay in the processor's cache.
BLOCK = 1 << 17
#: Counts of at most so many of the commonest words travel with each task; the others are joined.
COMMON = 200_000


def word_counts(docs: DataFrame) -> DataFrame:
    """``(w, c)``: how often each word stands in all ``docs``; the empty word ends each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "c"])

        for batch in slices(batches, "text", 1 << 20):
            for text in raw(batch.column("text")):
                seen.update(byte_words(text))
            seen[b""] += batch.num_rows
            if len(seen) > 200_000:
                yield out()
                seen = Counter()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the commonest words, the network's number of each, and what all words add up to."""

    index: dict[bytes, int]
    c: np.ndarray
    number: np.ndarray
    n: int
    v: int

    def rest(self) -> tuple[int, int]:
        """Tokens and words that share the network's word 0."""
        own = self.number != UNKNOWN
        return self.n - int(self.c[own].sum()), self.v - int(own.sum())

    def frequencies(self) -> np.ndarray:
        """Smoothed shares of the network's words."""
        p = np.full(int(self.number.max(initial=END)) + 1, 0.1)
        own = self.number != UNKNOWN
        p[self.number[own]] += self.c[own]
        p[UNKNOWN] += self.rest()[0]
        return p / p.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words above the count that at most ``COMMON`` reach, found by a histogram of counts."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2(F.col("c")) * 8)
    bins = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    total, least = 0, None
    for s, k in bins:
        total += k
        if total > COMMON:
            break
        least = s
    found = counts.where(step >= least).collect() if least is not None else []
    rows = sorted(((r.c, bytes(r.w)) for r in found if r.w), key=lambda r: (-r[0], r[1]))
    ends = next((r.c for r in found if not r.w), None)
    rows = ([(ends, b"")] if ends is not None else []) + rows
    number = np.zeros(len(rows), dtype=np.int32)
    top = NETWORK_WORDS - 2 + (ends is not None)
    first = END if ends is not None else END + 1
    number[:top] = np.arange(first, first + len(number[:top]))
    return Vocabulary({w: i for i, (_, w) in enumerate(rows)}, np.array([c for c, _ in rows], dtype=np.int64), number, n, v)


# --- the network ------------------------------------------------------------------------


@dataclass
class Network:
    """Weights of the network as views of ``flat``; class c has the words from edges[c] to edges[c + 1], group g the classes from groups[g] on."""

    edges: np.ndarray
    flat: np.ndarray

    def __post_init__(self) -> None:
        v, at = int(self.edges[-1]), 0
        self.class_of = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        self.groups = _groups(len(self.edges) - 1)
        self.group_of = np.repeat(np.arange(len(self.groups) - 1), np.diff(self.groups))
        for key, shape in _shapes(self.edges).items():
            n = int(np.prod(shape))
            setattr(self, key, self.flat[at : at + n].reshape(shape))
            at += n
        assert at == len(self.flat) and v == len(self.class_of)


def _groups(n: int) -> np.ndarray:
    """Where groups of ``n`` classes begin (one more at the end)."""
    return np.arange(min(GROUPS, n) + 1) * n // min(GROUPS, n)


def _shapes(edges: np.ndarray) -> dict[str, tuple[int, ...]]:
    """Word vectors; their and the state's part in gates and candidate, with a bias; scores of groups, of classes within their group and of words within their class, the bias last."""
    v, c = int(edges[-1]), len(edges) - 1
    return {"emb": (v, EMBED), "p": (EMBED, 3 * HIDDEN), "b": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN), "gw": (len(_groups(c)) - 1, HIDDEN + 1), "cw": (c, HIDDEN + 1), "ww": (v, HIDDEN + 1)}


def classes(p: np.ndarray) -> np.ndarray:
    """Where classes of words begin (one more at the end): about equal sums of the square roots of the words' shares.

    Common words are in small classes and rare ones in large ones. A word costs the scores
    of all groups, of its group's classes and of its class's words: some 80, not 20,480.
    """
    roots = np.cumsum(np.sqrt(p))
    inner = np.searchsorted(roots, roots[-1] * np.arange(1, CLASSES) / CLASSES)
    return np.unique(np.concatenate([[0, len(p)], inner[(inner > 0) & (inner < len(p))]]))


def start(vocabulary: Vocabulary, seed: int = 11) -> Network:
    """Weights whose output is the words' frequencies, with a small random recurrent part."""
    p = vocabulary.frequencies()
    edges = classes(p)
    rng = np.random.default_rng(seed)
    net = Network(edges, np.zeros(sum(int(np.prod(x)) for x in _shapes(edges).values()), np.float32))
    for key, size in (("emb", 0.3), ("p", 0.3), ("u", 0.2), ("gw", 0.02), ("cw", 0.02), ("ww", 0.02)):
        getattr(net, key)[:] = rng.normal(0, size, getattr(net, key).shape)
    of_class = np.add.reduceat(p, edges[:-1])
    of_group = np.add.reduceat(of_class, net.groups[:-1])
    net.gw[:, -1] = np.log(of_group)
    net.cw[:, -1] = np.log(of_class / of_group[net.group_of])
    net.ww[:, -1] = np.log(p / of_class[net.class_of])
    return net


def _choice(h: np.ndarray, w: np.ndarray, pick: np.ndarray, into: np.ndarray | None, out: np.ndarray, back: np.ndarray | None) -> None:
    """Adds the log softmax of ``h @ w.T`` at ``pick`` to ``out``; with ``into`` adds the gradients of the weights and, to ``back``, of ``h``."""
    step, ones, columns = max(64, BLOCK // len(w)), np.ones(len(w), h.dtype), np.ascontiguousarray(w.T)
    for a in range(0, len(pick), step):
        part, mine = h[a : a + step], pick[a : a + step]
        at = np.arange(len(mine))
        z = part @ columns
        own = z[at, mine]
        e = np.exp(z, out=z)
        s = e @ ones
        if not np.isfinite(s).all() or not s.all():
            z = part @ columns
            z -= z.max(axis=1, keepdims=True)
            own = z[at, mine]
            e = np.exp(z, out=z)
            s = e @ ones
        out[a : a + step] += own - np.log(s)
        if into is not None:
            # the softmax's division is done on the smaller factors
            e[at, mine] -= s
            s = s[:, None]
            into += e.T @ (part / s)
            more = e @ w
            more /= s
            back[a : a + step] += more


def log_likelihood(net: Network, h: np.ndarray, target: np.ndarray, grad: Network | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target after state ``h``: its group's, its class's within the group, and its own within the class.

    With ``grad``, also adds the gradients of the negative sum to it and returns that of ``h``.
    """
    cls = net.class_of[target]
    order = np.argsort(cls, kind="stable")
    wide = np.ones((len(h), HIDDEN + 1), h.dtype)
    wide[:, :HIDDEN] = h[order]
    cls, target = cls[order], target[order]
    group = net.group_of[cls]
    with np.errstate(over="ignore"):
        got, back = np.zeros(len(h), h.dtype), None if grad is None else np.zeros_like(wide)
        _choice(wide, net.gw, group, None if grad is None else grad.gw, got, back)
        # rows are in order of classes, and so of groups
        for edges, of, pick, name in ((net.groups, group, cls, "cw"), (net.edges, cls, target, "ww")):
            bounds = np.searchsorted(of, np.arange(len(edges)))
            weights, into = getattr(net, name), None if grad is None else getattr(grad, name)
            for c in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = edges[c], edges[c + 1]
                if b - a > 1:
                    mine = slice(bounds[c], bounds[c + 1])
                    _choice(wide[mine], weights[a:b], pick[mine] - a, None if into is None else into[a:b], got[mine], None if into is None else back[mine])
    out = np.empty(len(got))
    out[order] = got
    if back is None:
        return out, None
    unsorted = np.empty((len(h), HIDDEN), h.dtype)
    unsorted[order] = back[:, :HIDDEN]
    return out, unsorted


#: Gates and candidate are 1 / (1 + exp(s)) and 2 / (1 + exp(s)) - 1 of sums s that are scaled by these.
_SCALE = np.repeat(np.array([-1, -1, -2], np.float32), HIDDEN)


def _step(inputs: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gates (keep, reset), candidate and the state's part in it, from scaled sums; ``u`` is overwritten.

    A column is a text, so that the rows of a gate lie together.
    """
    H = HIDDEN
    zr, un = u[: 2 * H], u[2 * H :]
    zr += inputs[: 2 * H]
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    new = zr[H:] * un
    new += inputs[2 * H :]
    np.exp(new, out=new)
    new += 1
    np.divide(2, new, out=new)
    new -= 1
    return zr, new, un


class Trainer:
    """Truncated backpropagation with per-weight step sizes (Adagrad), over any number of chunks of texts."""

    def __init__(self, net: Network, rate: float) -> None:
        self.net, self.rate = Network(net.edges, net.flat.copy()), rate
        self.grad = Network(net.edges, np.zeros_like(net.flat))
        self.sums = np.full_like(net.flat, 1e-8)
        self.tokens = 0
        self.first = self.net.emb.size

    def __call__(self, tokens: list[np.ndarray]) -> None:
        """Goes once over texts (word numbers with an end).

        They are laid end to end on lanes; the state passes from window to window and is
        cleared where a text begins, gradients stop at the window's start.
        """
        net, H = self.net, HIDDEN
        y = np.concatenate(tokens)
        self.tokens += len(y)
        lanes = int(np.clip(len(y) // (UPDATES * WINDOW), 8, LANES))
        steps = -(-len(y) // lanes)
        steps += -steps % WINDOW
        begins = np.zeros(len(y), dtype=bool)
        begins[np.cumsum([0, *map(len, tokens[:-1])])] = True
        x = np.concatenate([[END], y[:-1]])
        x[begins] = END
        real = np.ones(len(y), bool)
        x, y, begins, real = (np.concatenate([v, np.zeros(steps * lanes - len(v), v.dtype)]).reshape(lanes, steps).T.copy() for v in (x, y, begins, real))
        h = np.zeros((H, lanes), dtype=np.float32)
        for k in range(0, steps, WINDOW):
            span = slice(k, k + WINDOW)
            ok = real[span].ravel()
            if not ok.any():
                continue
            words = x[span].ravel()
            vectors = net.emb[words].reshape(WINDOW, lanes, EMBED)
            inputs = (net.p * _SCALE).T @ vectors.transpose(0, 2, 1)
            inputs += (net.b * _SCALE)[:, None]
            scaled = np.ascontiguousarray((net.u * _SCALE).T)
            stays = [not begins[t].any() for t in range(k, k + WINDOW)]
            befores, states = np.empty((WINDOW, H, lanes), np.float32), np.empty((WINDOW, H, lanes), np.float32)
            saved = []
            for t in range(WINDOW):
                befores[t] = h
                if not stays[t]:
                    befores[t][:, begins[k + t]] = 0
                zr, new, un = _step(inputs[t], scaled @ befores[t])
                saved.append((zr, new, un))
                h = states[t]
                np.subtract(befores[t], new, out=h)
                h *= zr[:H]
                h += new
            seen = states.transpose(0, 2, 1).reshape(-1, H)
            if ok.all():
                back = log_likelihood(net, seen, y[span].ravel(), self.grad)[1]
            else:
                back = np.zeros_like(seen)
                back[ok] = log_likelihood(net, seen[ok], y[span].ravel()[ok], self.grad)[1]
            back = np.ascontiguousarray(back.reshape(WINDOW, lanes, H).transpose(0, 2, 1))
            da, du = np.empty((WINDOW, 3 * H, lanes), np.float32), np.empty((WINDOW, 3 * H, lanes), np.float32)
            later = np.zeros_like(h)
            for t in range(WINDOW - 1, -1, -1):
                zr, new, un = saved[t]
                one, two = da[t], du[t]
                d = later
                d += back[t]
                z, r = zr[:H], zr[H:]
                slope = 1 - zr
                slope *= zr
                keep = d * z
                dn = d - keep
                dn *= 1 - new * new
                np.multiply(d, befores[t] - new, out=one[:H])
                un *= -0.5
                np.multiply(dn, un, out=one[H : 2 * H])
                one[: 2 * H] *= slope
                one[2 * H :] = dn
                two[: 2 * H] = one[: 2 * H]
                np.multiply(dn, r, out=two[2 * H :])
                later = net.u @ two
                later += keep
                if not stays[t]:
                    later[:, begins[k + t]] = 0
            g = self.grad
            g.u += (befores @ du.transpose(0, 2, 1)).sum(axis=0)
            g.p += (da @ vectors).sum(axis=0).T
            g.b += da.sum(axis=(0, 2))
            order = np.argsort(words, kind="stable")
            heads = np.flatnonzero(np.diff(words[order], prepend=-1))
            of_words = (net.p @ da).transpose(0, 2, 1).reshape(-1, EMBED)
            self._update(words[order[heads]], np.add.reduceat(of_words[order], heads, axis=0), float(ok.sum()))

    def _update(self, rows: np.ndarray, of_rows: np.ndarray, n: float) -> None:
        """One update: the window's word vectors, then all other weights."""
        of_rows /= n
        sums = self.sums[: self.first].reshape(-1, EMBED)
        seen = sums[rows] + of_rows * of_rows
        sums[rows] = seen
        self.net.emb[rows] -= self.rate * of_rows / np.sqrt(seen)
        g, s = self.grad.flat[self.first :], self.sums[self.first :]
        g /= n
        s += g * g
        g *= self.rate
        g /= np.sqrt(s)
        self.net.flat[self.first :] -= g
        g[:] = 0


def train(net: Network, tokens: list[np.ndarray], rate: float) -> Network:
    """The network after one pass over texts."""
    trainer = Trainer(net, rate)
    trainer(tokens)
    return trainer.net


def log_probabilities(net: Network, tokens: np.ndarray, lengths: np.ndarray, window: int = 1 << 16) -> np.ndarray:
    """Natural log probability of each whole text, its end included.

    All texts advance together, longest first; the state of each is carried from one
    window of outputs to the next, to the text's end.
    """
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    if not len(n):
        return np.zeros(0)
    longest = int(n[0])
    active = len(n) - np.searchsorted(n[::-1], np.arange(longest), side="right")
    first = np.concatenate([[0], np.cumsum(active)])
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    source = np.repeat(begin[order], n) + step
    place = first[step] + owner
    y = np.empty(len(tokens), dtype=np.int32)
    y[place] = tokens[source]
    x = np.empty(len(tokens), dtype=np.int32)
    x[place] = np.where(step == 0, END, tokens[source - 1])
    lane = np.empty(len(tokens), dtype=np.int32)
    lane[place] = owner
    h = np.zeros((HIDDEN, len(n)), dtype=np.float32)
    sums = np.zeros(len(n))
    p, b, u = (net.p * _SCALE).T, (net.b * _SCALE)[:, None], np.ascontiguousarray((net.u * _SCALE).T)
    t = 0
    while t < longest:
        stop = max(t + 1, int(np.searchsorted(first, first[t] + window, side="right")) - 1)
        a = p @ net.emb[x[first[t] : first[stop]]].T
        a += b
        out = np.empty((HIDDEN, a.shape[1]), dtype=np.float32)
        for s in range(t, stop):
            k, at = int(active[s]), int(first[s] - first[t])
            hs = h[:, :k]
            zr, new, _ = _step(a[:, at : at + k], u @ hs)
            hs -= new
            hs *= zr[:HIDDEN]
            hs += new
            out[:, at : at + k] = hs
        got, _ = log_likelihood(net, np.ascontiguousarray(out.T), y[first[t] : first[stop]])
        sums += np.bincount(lane[first[t] : first[stop]], weights=got, minlength=len(n))
        t = stop
    result = np.empty(len(n))
    result[order] = sums
    return result


def _numbers(texts_: list[bytes], index: dict[bytes, int], number: np.ndarray) -> list[np.ndarray]:
    """The network's numbers of each text's words and its end."""
    lists = [byte_words(t) for t in texts_]
    flat = np.fromiter(map(index.get, chain.from_iterable(lists), repeat(-1)), np.int64, sum(map(len, lists)))
    flat = np.where(flat >= 0, number[flat] if len(number) else 0, UNKNOWN).astype(np.int32)
    edges = np.cumsum([0, *map(len, lists)])
    return [np.append(flat[a:b], np.int32(END)) for a, b in zip(edges[:-1], edges[1:])]


def fit(docs: DataFrame, vocabulary: Vocabulary) -> Network:
    """The network, trained on every text of ``docs`` (doc_id, text).

    Hashes of a row put it in one of three rounds, with one of the round's workers, and at
    a place there; there are as many workers as give each about ``WORKER`` tokens. So what
    a worker learns hangs on the rows and not on how files or partitions part them. From
    the weights of the round before it goes over its texts in chunks of a bounded size;
    the results are averaged by their tokens in pieces, so no task and not the driver
    holds more than a few sets of weights, however many workers there are.
    """
    net = start(vocabulary)
    if not vocabulary.n:
        return net
    sc = docs.sparkSession.sparkContext
    keep = {w: i for w, i in vocabulary.index.items() if vocabulary.number[i] != UNKNOWN}
    words = sc.broadcast((keep, vocabulary.number))
    kinds = "piece int, n long, w binary"
    workers = max(1, -(-vocabulary.n // (ROUNDS * WORKER)))
    key = F.xxhash64("doc_id", "text")
    rounds = docs.select("text", F.pmod(key, F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64(key), F.lit(workers)).cast("int").alias("worker"), key.alias("key"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for piece, n, w in zip(*(c.to_pylist() for c in batch.columns)):
                had = found.setdefault(piece, [0, 0.0])
                had[0] += n
                had[1] = had[1] + np.frombuffer(w, "<f4").astype(np.float64) * n
        for piece, (n, w) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([n], pa.int64()), pa.array([(w / n).astype("<f4").tobytes()], pa.binary())], names=["piece", "n", "w"])

    for k in range(ROUNDS):
        now, rate = sc.broadcast((net.edges, net.flat)), 0.1 / (1 + k)

        def work(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            index, number = words.value
            trainer, worker, held, size = None, None, [], 0

            def done() -> pa.RecordBatch:
                if held:
                    trainer(held)
                parts = np.array_split(trainer.net.flat, PIECES)
                return pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([trainer.tokens] * PIECES, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["piece", "n", "w"])

            for batch in slices(batches, "text", 1 << 20):
                # a partition may have several workers, one behind the other
                for own, text in zip(batch.column("worker").to_pylist(), _numbers(raw(batch.column("text")), index, number)):
                    if own != worker:
                        if trainer:
                            yield done()
                        trainer, worker, held, size = Trainer(Network(*now.value), rate), own, [], 0
                    held.append(text)
                    size += len(text)
                    if size >= CHUNK:
                        trainer(held)
                        held, size = [], 0
            if trainer:
                yield done()

        mine = rounds.where(F.col("round") == k).repartitionById(workers, "worker").sortWithinPartitions("worker", "key").select("worker", "text")
        got = mine.mapInArrow(work, kinds).repartition(16, "piece").mapInArrow(add, kinds).collect()
        if got:
            net = Network(net.edges, np.concatenate([np.frombuffer(r.w, "<f4") for r in sorted(got, key=lambda r: r.piece)]).copy())
    return net


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, net: Network) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    ``docs`` has doc_id, held_out and text. ``base_score`` is the smoothed word counts'
    log10 probability. ``score`` is the network's: a word outside its 20,478 is word 0 and
    then shares that word's probability by smoothed counts, so that all words add up to
    one. Counts of the words outside the commonest are joined by word. An empty text has
    its end alone; repeated rows are scored each. With no training text all counts are 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, net.edges, net.flat))
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_all = np.log10(vocabulary.n + 0.1 * (vocabulary.v + 1))
    rest_n, rest_v = vocabulary.rest()
    n_rest = np.log10(rest_n + 0.1 * (rest_v + 1))
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "w", "n"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, *weights = shared.value
        net, logs = Network(*weights), np.log10(vocab.c + 0.1)
        uid = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 4 << 20):
            lists = [byte_words(t) + [b""] for t in raw(batch.column("text"))]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            flat_words = [x for ws in lists for x in ws]
            del lists
            at = np.fromiter(map(vocab.index.get, flat_words, repeat(-1)), np.int64, len(flat_words))
            common = at >= 0
            number = np.where(common, vocab.number[at] if len(vocab.number) else 0, UNKNOWN).astype(np.int32)
            number[starts[1:] - 1] = END
            value = np.where(common, logs[at] if len(logs) else 0.0, 0.0)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            sums = np.bincount(owner, weights=value, minlength=len(lengths))
            other = np.bincount(owner, weights=value * (number == UNKNOWN), minlength=len(lengths))
            n_other = np.bincount(owner[number == UNKNOWN], minlength=len(lengths))
            base = sums - lengths * n_all
            total = log_probabilities(net, number, lengths) / np.log(10) + other - n_other * n_rest
            ids = uid + np.arange(len(lengths))
            uid += len(lengths)
            rare = np.flatnonzero(~common)
            pairs = Counter(zip(owner[rare].tolist(), (flat_words[i] for i in rare.tolist())))
            del flat_words
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids), batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), pa.array(np.bincount(owner[common], minlength=len(lengths))),
                    pa.array(base), pa.array(total), pa.array([b" %d" % i for i in ids.tolist()], pa.binary()), pa.array(np.zeros(len(ids), np.int64)),
                ],
                names=names,
            )
            if pairs:
                k = len(pairs)
                none = [pa.nulls(k, batch.schema.field("doc_id").type), pa.nulls(k, pa.bool_()), *(pa.nulls(k, pa.int64()) for _ in range(2)), *(pa.nulls(k, pa.float64()) for _ in range(2))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[[d for d, _ in pairs]]), *none, pa.array([x for _, x in pairs], pa.binary()), pa.array(list(pairs.values()), pa.int64())], names=names)

    rows = docs.select("doc_id", "held_out", "text").mapInArrow(apply, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, w binary, n long")
    seen = rows.join(counts, "w", "left").select(*names[:7], F.col("n").alias("times"), F.coalesce("c", F.lit(0)).alias("c"))
    part = F.sum(F.col("times") * F.log10(F.col("c") + F.lit(0.1)))
    # words of a rare row are unknown to the network as well, so both scores have the same part
    return seen.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.max("base") + part).alias("base_score"),
        (F.max("score") + part).alias("score"),
    ).drop("uid")


def score_documents(docs: DataFrame) -> DataFrame:
    """Learns from the folds other than 0 of 10 and scores every whole text; see ``score``."""
    docs = texts(docs, (fold("doc_id", 10) == 0).alias("held_out"))
    learn = docs.where("NOT held_out").select("doc_id", "text")
    counts = stored(word_counts(learn), "lm-counts")
    words = vocabulary(counts)
    return score(docs, counts, words, fit(learn, words))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by word counts and by the recurrent network."""
    return score_documents(table(spark, sf_dir, "documents"))
