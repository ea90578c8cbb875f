"""Scoring documents with a gated recurrent language model, trained here in numpy.

The model predicts each word from a recurrent state.  Its output is factored by
classes: a softmax over classes, then one over the words of the class.  The most
frequent words are its vocabulary; all other words form classes by how they end,
in which a word has its share of the training counts.  Documents lie end to end
in parallel streams; the state is carried from window to window within a
document and begins anew with each, so a score is that of the complete document.

Counts cover all training documents, and words are told apart by their bytes.
Each text is read as word numbers once.  Training documents are dealt by a hash
into buckets of about equal size and sorted in them, so that results don't depend
on how the input lies in files.  Training begins with a pilot on a bounded sample,
gives every bucket the pilot's weights, runs truncated backpropagation over all
documents of the bucket, and averages what the buckets arrive at, weighed by words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldloom.llm import scratch
from fieldloom.llm.textbatch import NOT_SPACE, lower_ascii, pieces, runs, text_values

#: Words with their counts that every task gets, at most (a hundred bytes each in a task); rarer ones are joined in.
TABLE_WORDS = 1 << 18
#: Words of the model; their classes; sizes of state, streams and windows.
CLASSES, CLASS_WORDS = 32, 64
STATE, STREAMS, WINDOW = 24, 512, 32
#: Words of a bucket, about, and words that a task gathers before it scores them.
BUCKET_WORDS, BUFFER_WORDS = 3_000_000, 2_000_000
#: Bytes of text that are read as words at once.
READ_BYTES = 6 << 20
#: Words of the pilot sample at most; a smaller sample is gone through again, up to so many times.
PILOT_WORDS, PILOT_ROUNDS = 1_000_000, 8
#: Documents of the pilot sample at most, and the words that it takes of each.
PILOT_DOCUMENTS, PILOT_EACH = 50_000, 4096
#: Steps that a bucket is divided into at least, by taking fewer streams.
MIN_STEPS = 128
PILOT_RATE, RATE = 1e-2, 4e-3
SEED = 5
#: How many weights are added up by one task.
ADDED_BY_ONE = 64
#: Rows of a softmax that are worked on at once, so that they stay in the cache, and the least log-probability.
LAYER_ROWS, LEAST = 1024, np.float32(np.log(1e-30))
_BINS_PER_OCTAVE = 32
#: The token that ends each document; words aren't empty.
END = b""
#: A word's group is its last sign, and for letters whether others than ASCII stand in the word; the end is in group 0.
GROUPS = 61
_ENDINGS = np.full(256, 59, np.uint8)
_ENDINGS[97:123] = np.arange(26)
_ENDINGS[48:58] = 52
for _sign, _group in ((".", 53), (",", 53), ("*", 54), ("%", 55), ("$", 56), ("&", 57), ("#", 58)):
    _ENDINGS[ord(_sign)] = _group
_ENDINGS[128:] = 60


@dataclass(frozen=True)
class WordTable:
    """The most frequent training tokens with counts in falling order; totals of all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    groups: np.ndarray
    total: int
    distinct: int
    group_totals: np.ndarray
    group_distinct: np.ndarray

    def rest(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """By group, the counts and the number of the training tokens that aren't among the first ``words`` of the table."""
        of = self.groups[:words]
        return self.group_totals - np.bincount(of, self.counts[:words], 64), self.group_distinct - np.bincount(of, minlength=64)


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts: the distinct ones as bytes with their groups, the number of each token's, and how many each text has."""

    distinct: pa.Array
    groups: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words with A-Z as a-z, and an end after each text."""
    lowered = lower_ascii(data)
    inside = NOT_SPACE[lowered]
    starts, ends, n = runs(inside, offsets)
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = np.ascontiguousarray(lowered[inside])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
    distinct = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_binary())])
    numbers = np.insert(np.asarray(coded.indices).astype(np.int32, copy=False), np.cumsum(n), len(distinct) - 1)
    return Tokens(distinct, groups_of(distinct), numbers, n + 1)


def groups_of(words: pa.Array) -> np.ndarray:
    """The group of each token."""
    values, at = text_values(words)
    filled = at[1:] > at[:-1]
    last = np.full(len(words), 97, np.uint8)  # the end is in group 0
    last[filled] = values[at[1:][filled] - 1]
    groups = _ENDINGS[last]
    beyond = np.concatenate([[0], np.cumsum(values >= 128, dtype=np.int64)])
    return np.where((groups < 26) & (beyond[at[1:]] > beyond[at[:-1]]), groups + 26, groups).astype(np.uint8)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id's text is divisible by 10; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _token_counts(training: DataFrame) -> DataFrame:
    """(w, g, c) of every training token: its bytes, group and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def merged() -> tuple[pa.Array, np.ndarray]:
            coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
            return coded.dictionary, np.bincount(np.asarray(coded.indices), np.concatenate([c for _, c in held]), len(coded.dictionary)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            words, counts = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(groups_of(words), pa.int32()), pa.array(counts)], ["w", "g", "c"])

        for whole in batches:
            for batch in pieces(whole, "text", READ_BYTES):
                tokens = tokens_of(*text_values(batch.column(0)))
                held.append((tokens.distinct, np.bincount(tokens.numbers, minlength=len(tokens.distinct))))
                if sum(len(w) for w, _ in held) > 1_000_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 500_000:
                        yield rows()
        if held:
            yield rows()

    return training.select("text").mapInArrow(run, "w binary, g int, c long").groupBy("w", "g").agg(F.sum("c").alias("c"))


def count_tokens(training: DataFrame, table_words: int = TABLE_WORDS) -> tuple[DataFrame, WordTable]:
    """All training tokens with their counts, as a written table; and its most frequent ones.

    The table is cut where whole bins of counts (32 to a doubling) fit; what is
    brought to the driver are the bins and at most ``table_words`` rows.
    """
    counts = scratch.written(_token_counts(training), "counts")
    bin_of = F.floor(_BINS_PER_OCTAVE * F.log2("c"))
    bins = counts.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("n")).collect()
    least, room = None, table_words
    for b in sorted(bins, key=lambda b: -b.bin):
        if b.types > room:
            break
        least, room = b.bin, room - b.types
    rows = counts.where(bin_of >= least).collect() if least is not None else []
    rows = sorted(rows, key=lambda r: (-r.c, r.w))  # of equal counts the smaller bytes come first
    group_totals, group_distinct = np.zeros(64, np.int64), np.zeros(64, np.int64)
    for r in counts.groupBy("g").agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("n")).collect():
        group_totals[r.g], group_distinct[r.g] = r.n, r.types
    words, numbers, groups = [bytes(r.w) for r in rows], np.array([r.c for r in rows], np.int64), np.array([r.g for r in rows], np.int64)
    return counts, WordTable(words, numbers, groups, sum(b.n for b in bins), sum(b.types for b in bins), group_totals, group_distinct)


class Gru:
    """A gated recurrent network with input rows by word and class-factored output.

    Word numbers: 0 to CLASSES * CLASS_WORDS - 1 are words, class by class; the
    next are the groups of other words, each a class; the last begins a document.
    """

    def __init__(self, classes: int = CLASSES, class_words: int = CLASS_WORDS, state: int = STATE, weights: dict[str, np.ndarray] | None = None, groups: int = GROUPS):
        self.classes, self.class_words, self.state, self.groups = classes, class_words, state, groups
        self.words = classes * class_words
        self.first = self.words + groups
        self.w = weights

    def begin(self, counts: np.ndarray, other: np.ndarray, seed: int = SEED) -> None:
        """Random weights, and output biases that give the words' shares of the counts."""
        rng, h = np.random.default_rng(seed), self.state
        f = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        by_class = np.maximum(counts.astype(np.float64), 0.1).reshape(self.classes, self.class_words)
        shares = np.append(by_class.sum(1), np.maximum(other, 0.1))
        self.w = {
            "x": f(self.first + 1, 3 * h), "u": f(h, 3 * h) / np.float32(2),
            "wc": f(h, self.classes + self.groups) / np.float32(4), "bc": np.log(shares / shares.sum()).astype(np.float32),
            "ww": f(self.classes, h, self.class_words) / np.float32(4), "bw": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        }

    def run(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, save: bool = False) -> tuple[np.ndarray, list]:
        """States after each of the T steps of (T, B) words; ``keep`` is 0 where a document begins.  ``h`` has B rows at least; active rows are overwritten."""
        n, steps = self.state, len(x)
        # the two gates and the candidate are planes of their own, so that each is one stretch of memory; the gates are negated for exp
        gates, u = (np.ascontiguousarray(w.reshape(-1, 3, n).transpose(1, 0, 2)) for w in (self.w["x"], self.w["u"]))
        for w in (gates, u):
            np.negative(w[:2], out=w[:2])
        gates = np.take(gates, x, axis=1)
        states, saved = np.empty((steps, x.shape[1], n), np.float32), []
        now, keeps = h[: x.shape[1]].copy(), keep.all(axis=1)
        for t in range(steps):
            before = now if keeps[t] else now * keep[t][:, None]
            hg = np.matmul(before, u)
            zr = hg[:2]
            zr += gates[:2, t]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            cand = zr[1] * hg[2]
            cand += gates[2, t]
            np.tanh(cand, out=cand)
            now = states[t]
            np.subtract(before, cand, out=now)
            now *= zr[0]
            now += cand
            if save:
                saved.append((before, hg, cand))
        h[: x.shape[1]] = now
        return states, saved

    @staticmethod
    def _layer(states: np.ndarray, weights: np.ndarray, y: np.ndarray, grad: np.ndarray | None = None, back: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probabilities of the places ``y`` in softmaxes; states end in a column of ones, weights in the biases' row.  With ``grad``, adds to it and to ``back``.

        Rows are taken so few at once that they stay in the cache.  Exponentials aren't
        divided by their sums; what they are multiplied with is.
        """
        found, ones = np.empty(len(y), np.float32), np.ones(weights.shape[1], np.float32)
        transposed = np.ascontiguousarray(weights[:-1].T) if grad is not None else None
        for a in range(0, len(y), LAYER_ROWS):
            s, at = states[a : a + LAYER_ROWS], y[a : a + LAYER_ROWS]
            rows = np.arange(len(at))
            out = s @ weights
            own = out[rows, at]
            with np.errstate(over="ignore", invalid="ignore"):
                np.exp(out, out=out)
                sums = out @ ones
            if not (np.isfinite(sums).all() and sums.all()):  # beyond what exp can hold
                out = s @ weights
                most = out.max(1)
                own = own - most
                out -= most[:, None]
                np.exp(out, out=out)
                sums = out @ ones
            found[a : a + LAYER_ROWS] = own - np.log(sums)
            if grad is not None:
                out[rows, at] -= sums
                parts = (1 / sums)[:, None]
                grad += (s * parts).T @ out
                moved = out @ transposed
                moved *= parts
                back[a : a + LAYER_ROWS] += moved
        return np.maximum(found, LEAST, out=found)

    def outputs(self, states: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the targets given (N, H) states; with ``grads``, adds to them and returns the states' gradients."""
        n = self.state
        of = np.where(target < self.words, target // self.class_words, target - self.words + self.classes).astype(np.uint16)
        order = np.argsort(of, kind="stable")  # by class, so that each class is one stretch
        target, of = target[order], of[order]
        ended = np.empty((len(target), n + 1), np.float32)
        ended[:, :n] = states[order]
        ended[:, n] = 1
        back = np.zeros((len(target), n), np.float32) if grads is not None else None

        def layer(w: str, b: str, k: tuple, a: int, e: int, y: np.ndarray) -> np.ndarray:
            weights = np.concatenate([self.w[w][k], self.w[b][k][None]])
            if grads is None:
                return self._layer(ended[a:e], weights, y)
            grad = np.zeros_like(weights)
            found = self._layer(ended[a:e], weights, y, grad, back[a:e])
            grads[w][k] += grad[:n]
            grads[b][k] += grad[n]
            return found

        found = layer("wc", "bc", (), 0, len(target), of)
        edges = np.searchsorted(of, np.arange(self.classes + 1)).tolist()
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                found[a:b] += layer("ww", "bw", (k,), a, b, target[a:b] - k * self.class_words)
        out = np.empty_like(found)
        out[order] = found
        if back is not None:
            spread = np.empty_like(back)
            spread[order] = back
            back = spread
        return out, back

    def backward(self, x: np.ndarray, keep: np.ndarray, saved: list, back: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Backpropagation through the steps of one window."""
        n, (steps, width) = self.state, x.shape
        # planes as in run; the candidate's has one gradient for the word's row and one for the state's product
        gx, gh, befores = np.empty((steps, width, n), np.float32), np.empty((3, steps, width, n), np.float32), np.empty((steps, width, n), np.float32)
        ut, dh, keeps = np.ascontiguousarray(self.w["u"].reshape(n, 3, n).transpose(1, 2, 0)), np.zeros((width, n), np.float32), keep.all(axis=1)
        for t in range(steps - 1, -1, -1):
            before, hg, cand = saved[t]
            z, r = hg[0], hg[1]
            dh += back[t]
            dz = dh * z
            da, slope = gx[t], cand * cand
            np.subtract(1, slope, out=slope)
            np.subtract(dh, dz, out=da)  # dh (1 - z)
            da *= slope
            g = gh[0, t]
            np.subtract(before, cand, out=g)
            g *= dz
            np.subtract(1, z, out=slope)
            g *= slope
            g, dr = gh[1, t], gh[2, t]
            np.multiply(da, r, out=dr)
            np.multiply(dr, hg[2], out=g)
            np.subtract(1, r, out=slope)
            g *= slope
            befores[t] = before
            moved = np.matmul(gh[:, t], ut)
            dh = dz
            for m in moved:
                dh += m
            if not keeps[t]:
                dh *= keep[t][:, None]
        flat = x.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        given, befores = ordered[first], befores.reshape(-1, n).T
        for k, (word, product) in enumerate(((gh[0], gh[0]), (gh[1], gh[1]), (gx, gh[2]))):
            grads["u"][:, k * n : (k + 1) * n] += befores @ product.reshape(-1, n)
            grads["x"][given, k * n : (k + 1) * n] += np.add.reduceat(word.reshape(-1, n)[order], first, axis=0)


def streams_of(sizes: np.ndarray, most: int = STREAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where documents of the given sizes go: (stream, offset) of each, and the streams' lengths in falling order.

    Documents go longest first to the emptiest stream, of which there are no
    more than fill to the length of the longest document.
    """
    width = int(max(1, min(most, len(sizes), sizes.sum() // max(1, sizes.max()) + 1)))
    heap, stream, offset = [(0, s) for s in range(width)], np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for d in np.argsort(-sizes, kind="stable").tolist():
        length, s = heapq.heappop(heap)
        stream[d], offset[d] = s, length
        heapq.heappush(heap, (length + int(sizes[d]), s))
    lengths = np.zeros(width, np.int64)
    for length, s in heap:
        lengths[s] = length
    rank = np.argsort(-lengths, kind="stable")
    new = np.empty(width, np.int64)
    new[rank] = np.arange(width)
    return new[stream], offset, lengths[rank]


def _windows(model: Gru, words: np.ndarray, sizes: np.ndarray, window: int = WINDOW, places: bool = False, most: int = STREAMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(inputs, keeps, targets, places of the targets if asked for) of each window; every token is a target once.  Only streams that still have tokens take part."""
    stream, offset, lengths = streams_of(sizes, most)
    starts = np.cumsum(sizes) - sizes
    width = len(lengths)
    flat = np.repeat((offset - starts) * width + stream, sizes)
    flat += np.arange(len(words)) * width
    target = np.zeros((int(lengths[0]), width), np.uint16)
    target.ravel()[flat] = words
    place = None
    if places:
        place = np.zeros(target.shape, np.int32)
        place.ravel()[flat] = np.arange(len(words), dtype=np.int32)
    del flat
    begins = np.zeros(target.shape, bool)
    begins[offset, stream] = True
    cuts = sorted({0, *lengths.tolist()})
    for a, b in zip(cuts, cuts[1:]):
        active = int(np.searchsorted(-lengths, -a, side="left"))
        for t in range(a, b, window):
            e = min(t + window, b)
            given = np.empty((e - t, active), np.int32)
            given[1:] = target[t : e - 1, :active]
            given[0] = target[t - 1, :active] if t else 0
            given[begins[t:e, :active]] = model.first
            yield given, 1 - begins[t:e, :active].astype(np.float32), target[t:e, :active].astype(np.int32), place[t:e, :active] if places else None


def log_probabilities(model: Gru, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The natural log-probability of each token of documents that lie one after the other."""
    out = np.empty(len(words))
    if not len(words):
        return out
    h = np.zeros((STREAMS, model.state), np.float32)
    for given, keep, target, place in _windows(model, words, sizes, places=True):
        states, _ = model.run(given, keep, h)
        out[place.ravel()] = model.outputs(states.reshape(-1, model.state), target.ravel())[0]
    return out


class Trainer:
    """Adam steps, one for each window."""

    def __init__(self, model: Gru, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.w.items()}

    def learn(self, words: np.ndarray, sizes: np.ndarray) -> None:
        if not len(words):
            return
        model, h = self.model, np.zeros((STREAMS, self.model.state), np.float32)
        most = min(STREAMS, max(8, len(words) // (WINDOW * MIN_STEPS)))
        for given, keep, target, _ in _windows(model, words, sizes, most=most):
            states, saved = model.run(given, keep, h, save=True)
            grads = {k: np.zeros_like(v) for k, v in model.w.items()}
            _, back = model.outputs(states.reshape(-1, model.state), target.ravel(), grads)
            model.backward(given, keep, saved, back.reshape(states.shape), grads)
            self._update(grads, target.size)

    def _update(self, grads: dict[str, np.ndarray], n: int) -> None:
        self.step += 1
        size = np.float32(self.rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step) * min(1.0, n / (8 * WINDOW)))
        for k, g in grads.items():
            g /= np.float32(n)
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            v *= np.float32(0.99)
            v += np.float32(0.01) * g
            self.model.w[k] -= size * m / (np.sqrt(v) + np.float32(1e-6))


def _shape(model: Gru) -> list[tuple[str, tuple[int, ...]]]:
    h, c, k = model.state, model.classes, model.class_words
    return [("x", (model.first + 1, 3 * h)), ("u", (h, 3 * h)), ("wc", (h, c + model.groups)), ("bc", (c + model.groups,)), ("ww", (c, h, k)), ("bw", (c, k))]


def to_bytes(model: Gru) -> bytes:
    return b"".join(model.w[k].astype("<f4").tobytes() for k, _ in _shape(model))


def from_bytes(model: Gru, data: bytes) -> Gru:
    flat, at, w = np.frombuffer(data, "<f4"), 0, {}
    for k, shape in _shape(model):
        size = int(np.prod(shape))
        w[k] = flat[at : at + size].reshape(shape).copy()
        at += size
    return Gru(model.classes, model.class_words, model.state, w, model.groups)


_ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, part double, rare array<struct<w: binary, n: int>>, numbers binary"


def encoded(docs: DataFrame, table: WordTable, model_words: int) -> DataFrame:
    """What the table tells of each document (doc_id, held_out, text), and its word numbers (16 bits each) for the model.

    Numbers from 0 are the table's first words, in classes of like frequency; all
    others have those of their groups after ``model_words``.  ``rare`` has the
    tokens that the table doesn't have, with their counts; ``base`` and ``part``
    leave out those counts, but not the divisors they are put over.  ``part`` is
    what tokens outside the model have in their groups.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        listed_words = pa.array(table.words, pa.large_binary())
        share = np.append(np.log10(table.counts + 0.1), 0.0)
        whole = np.log10(table.total + 0.1 * (table.distinct + 1))
        totals, distinct = table.rest(model_words)
        rest = np.log10(totals + 0.1 * (distinct + 1))
        row = TaskContext.get().partitionId() << 40
        for whole_batch in batches:
            for batch in pieces(whole_batch, "text", READ_BYTES):
                at = batch.schema.get_field_index
                tokens = tokens_of(*text_values(batch.column(at("text"))))
                places = np.asarray(pc.fill_null(pc.index_in(tokens.distinct, value_set=listed_words), -1)).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(tokens.sizes)])
                summed = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[tokens.numbers], dtype=np.float64)])[edges])  # noqa: E731, B023
                own = share[places]  # of a place of -1 the last, which is 0
                inside = (places >= 0) & (places < model_words)
                part = np.where(inside, 0.0, own - rest[tokens.groups])
                numbers = np.where(inside, places, model_words + tokens.groups.astype(np.int64)).astype("<u2")[tokens.numbers].tobytes()
                cuts = (2 * edges).tolist()
                where = np.flatnonzero((places < 0)[tokens.numbers])
                of = np.searchsorted(edges, where, side="right") - 1
                keys, times = np.unique(of * len(places) + tokens.numbers[where], return_counts=True)
                ends = np.concatenate([[0], np.cumsum(np.bincount(keys // len(places), minlength=len(tokens.sizes)))])
                listed = pa.StructArray.from_arrays([tokens.distinct.take(pa.array(keys % len(places))).cast(pa.binary()), pa.array(times, pa.int32())], ["w", "n"])
                n = batch.num_rows
                columns = [pa.array(row + np.arange(n), pa.int64()), batch.column(at("doc_id")), batch.column(at("held_out")), pa.array(tokens.sizes, pa.int64()), pa.array(summed((places >= 0).astype(np.float64)).astype(np.int64)), pa.array(summed(own - whole)), pa.array(summed(part)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed), pa.array([numbers[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())]
                row += n
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "part", "rare", "numbers"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _ENCODED)


def _numbers(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all rows, and how many each has."""
    data, offsets = text_values(rows)
    return np.frombuffer(data.tobytes(), "<u2"), np.diff(offsets) // 2


def _trained(rows: DataFrame, model: Gru, rate: float, most: int | None = None) -> DataFrame:
    """(bucket, n, weights) of each bucket of a table (bucket, numbers) in which buckets lie together: its words and the weights.

    With ``most``, a bucket ends at so many words, and a small one is gone through more than once.
    """
    plain = Gru(model.classes, model.class_words, model.state, groups=model.groups)
    shared = rows.sparkSession.sparkContext.broadcast((plain, to_bytes(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, data = shared.value
        now, seen, held, trainer = None, 0, [], None

        def learn(limit: int | None = None) -> None:
            """Learns what is held, or the first documents of it that reach the limit."""
            words, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            if limit:
                cut = int(np.searchsorted(np.cumsum(sizes), limit)) + 1
                at = int(sizes[:cut].sum())
                held.append((words[at:], sizes[cut:]))
                words, sizes = words[:at], sizes[:cut]
            for _ in range(max(1, min(PILOT_ROUNDS, most // len(words))) if most and len(words) else 1):
                trainer.learn(words, sizes)

        def done() -> pa.RecordBatch:
            if held:
                learn()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([seen], pa.int64()), pa.array([to_bytes(trainer.model)], pa.binary())], ["bucket", "n", "weights"])

        for whole in batches:
            for batch in pieces(whole, "numbers", BUCKET_WORDS // 4):
                buckets = np.asarray(batch.column(0))
                cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
                for a, b in zip(cuts, cuts[1:]):
                    if now != buckets[a]:
                        if now is not None:
                            yield done()
                        now, seen, trainer = int(buckets[a]), 0, Trainer(from_bytes(plain, data), rate)
                    words, sizes = _numbers(batch.column(1).slice(a, b - a))
                    if most and seen + len(words) > most:
                        keep = int(np.searchsorted(np.cumsum(sizes), most - seen, side="right"))
                        words, sizes = words[: int(sizes[:keep].sum())], sizes[:keep]
                    if len(words):
                        held.append((words, sizes))
                        seen += len(words)
                    while sum(len(h[0]) for h in held) >= 2 * BUCKET_WORDS:
                        learn(2 * BUCKET_WORDS)
        if now is not None:
            yield done()

    return rows.select("bucket", "numbers").mapInArrow(run, "bucket long, n long, weights binary")


def _average(rows: DataFrame) -> bytes | None:
    """The mean of weights, weighed by words: sums of ``ADDED_BY_ONE`` rows, of as many of those, and so on, each in the order of buckets."""

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        n, sums = 0, None
        for bucket, size, data in zip(*(table.column(c).to_pylist() for c in ("bucket", "n", "sums"))):
            part = np.frombuffer(data, "<f8")
            n, sums = n + size, part if sums is None else sums + part
        return pa.table({"bucket": pa.array([bucket // ADDED_BY_ONE], pa.int64()), "n": pa.array([n], pa.int64()), "sums": pa.array([sums.tobytes()], pa.binary())})

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [(np.frombuffer(w, "<f4").astype("<f8") * n).tobytes() for n, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.binary())], ["bucket", "n", "sums"])

    schema = "bucket long, n long, sums binary"
    now = scratch.written(rows.mapInArrow(weighed, schema), "weights")
    while now.count() > 1:
        before, now = now, scratch.written(now.groupBy(F.floor(F.col("bucket") / ADDED_BY_ONE).alias("of")).applyInArrow(added, schema), "weights")
        scratch.remove(rows.sparkSession, before)
    last = now.first()
    scratch.remove(rows.sparkSession, now)
    return (np.frombuffer(last.sums, "<f8") / last.n).astype("<f4").tobytes() if last else None


def fit(training: DataFrame, table: WordTable) -> Gru:
    """A model of all training documents, rows (row, doc_id, n_tokens, numbers) of ``encoded``.

    The pilot is on documents chosen by their hashes, up to its bounds; then every
    bucket goes through all its own, and the results are averaged.
    """
    model = Gru()
    counts = np.zeros(model.words, np.int64)
    top = table.counts[: model.words]
    counts[: len(top)] = top
    model.begin(counts, table.rest(model.words)[0][:GROUPS])
    plain = Gru(model.classes, model.class_words, model.state)
    # rows without an id are dealt by their place; equal rows with an id are interchangeable
    hashed = training.select("numbers", F.xxhash64(F.coalesce("doc_id", "row"), "n_tokens", F.crc32("numbers")).alias("h"))
    documents = int(table.counts[table.words.index(END)]) if END in table.words else 1
    each = max(1, min(PILOT_DOCUMENTS, 2 * PILOT_WORDS * documents // max(1, table.total)))
    thinned = hashed.where(F.pmod("h", F.lit(max(1, documents // (2 * each))).cast("long")) == 0)  # so that few rows meet, however many there are
    sample = thinned.select("h", F.substring("numbers", 1, 2 * PILOT_EACH).alias("numbers")).orderBy("h", "numbers").limit(each)
    pilot = sample.coalesce(1).sortWithinPartitions("h", "numbers").select(F.lit(0).cast("long").alias("bucket"), "numbers")
    first = _trained(pilot, model, PILOT_RATE, PILOT_WORDS).first()
    if first is not None and first.n:
        model = from_bytes(plain, first.weights)
    buckets = max(1, round(table.total / BUCKET_WORDS))
    dealt = hashed.withColumn("bucket", F.pmod("h", F.lit(buckets).cast("long"))).repartition(buckets, "bucket").sortWithinPartitions("bucket", "h", "numbers")
    data = _average(_trained(dealt, model, RATE))
    return from_bytes(plain, data) if data else model


def _scored(rows: DataFrame, model: Gru) -> DataFrame:
    """The rows of ``encoded`` without rare tokens and numbers, and with the recurrent model's part of the score in ``learned``."""
    plain = Gru(model.classes, model.class_words, model.state, groups=model.groups)
    shared = rows.sparkSession.sparkContext.broadcast((plain, to_bytes(model)))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "part"]
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("learned", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = from_bytes(*shared.value)
        held, words = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            read = [_numbers(b.column(len(names))) for b in held]
            numbers, sizes = np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            learned = np.diff(np.concatenate([[0.0], np.cumsum(log_probabilities(model, numbers, sizes))])[edges]) / np.log(10)
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(learned[at : at + b.num_rows])], [*names, "learned"])
                at += b.num_rows

        for whole in batches:
            for batch in pieces(whole, "numbers"):
                held.append(batch)
                words += batch.column(len(names)).nbytes // 2
                if words >= BUFFER_WORDS:
                    yield from told()
                    held, words = [], 0
        if held:
            yield from told()

    return rows.select(*names, "numbers").mapInArrow(run, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), logarithms to base 10.

    Null texts count as empty and have one token, the end; null ids stay, and are
    in training or not by the empty text.  Whole texts are scored, however long: a
    text is read in one piece, with some ten bytes a byte of it, and its numbers (two
    bytes a word) are scored in one stream.  Repeated rows are documents of their
    own.  Of words with equal counts those of smaller bytes have the better places
    in the table.  Without any training document all tokens are unknown; an empty
    table gives an empty one.  Other columns, whatever their names, aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    counts, table = count_tokens(rows.where("not held_out").select("text"))
    read = scratch.written(encoded(rows, table, Gru().words), "encoded")
    model = fit(read.where("not held_out").select("row", "doc_id", "n_tokens", "numbers"), table)
    scored = scratch.written(_scored(read, model), "scored")
    # rare tokens, once for each document that has them, by an equality join; adaptive execution splits a word that many
    # held-out documents have and no training document does
    rare = read.select("row", F.explode("rare").alias("r")).select("row", F.col("r.w").alias("w"), F.col("r.n").alias("n")).join(counts, "w", "left")
    sums = rare.select("row", (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("share"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("known")).groupBy("row").agg(F.sum("share").alias("share"), F.sum("known").alias("known"))
    whole = scored.join(sums, "row", "left")
    share = F.coalesce("share", F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(table.total)).cast("long").alias("train_tokens"), (F.col("base") + share).alias("base_score"), (F.col("part") + F.col("learned") + share).alias("score"))
