"""Language-model scores by logistic mixing of hashed-context bit predictors.

Tokens are words and one end a text; a token is coded as its bytes and a closing blank, a byte as
eight bits. Predictors look at the last 1, 2, 3 and 5 bytes of the token and at all of it so
far: a context and the bits of the byte already coded are hashed to a slot that holds how
often 0 and 1 followed in the training texts. A bit's probability is the logistic function of
the weighted evidence of all predictors; the weights are chosen by a gate (longest context seen
before, place in the token). A last table, by gate and coarse probability, refines the result
towards what came out.

These contexts stay inside a token, so the spelled cost of a token depends on the token alone: counting,
training and scoring run once per distinct token, weighted by its count, in tasks that each
hold a bucket of tokens; within a batch of these, counting goes once over each distinct context
and scoring once over each distinct beginning of a token, told apart by 64-bit hashes. Counts are sums over all training texts. Weights are learned online, a
small batch of tokens after the other with the token's own occurrence left out of the counts,
in every group over all its tokens; the groups' weights are averaged by bits seen. Groups are
ranges of the tokens' hashes, as many as the number of distinct tokens asks for, so the model
is the same whatever the number of partitions. This part of it has a fixed size, whatever the corpus.

A last predictor looks at the token before (at a text's start, the end of another): a bit says
whether the token is drawn from what followed there in the training texts or is spelled, and
is summed out. Its probability is the logistic function of a weight chosen by a gate, how often
the context was seen; the weights maximise the likelihood of all training tokens, each left out
of its own counts. Counts of pairs are exact sums over all training texts in hash buckets, so
they grow with the corpus; they are sent rounded down, which keeps the sum of probabilities
at most one.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm import kernel as K
from graphloom.llm.chunks import BLOB as PAIRS, answered, bucket_bits, each_chunk, from_answers, to_blobs, write_chunks
from graphloom.sources.scratch import discard, materialize, materialize_bucketed

U = K.U
ORDERS = (1, 2, 3, 5, 0)  # 0: the whole token so far
P = len(ORDERS)
#: Bits of each predictor's slot number.
SLOTS = (20, 20, 20, 22, 22)
WHOLE = P - 1
PLACES = 4
#: Gates: how often the whole token so far was seen, or else the longest context that was; place in the token.
CONFIDENCE = np.array([1, 2, 4, 16, 256])
GATES = (P + len(CONFIDENCE)) * PLACES
BINS = 33
PRIOR = 0.4
#: The end of a text as a token: a byte that UTF-8 never has.
END = 0xFF
PARTS = 8
END_HASH = K.word_hashes(np.array([END], np.uint8), np.array([0]), np.array([1]))[0]
#: Numbers that a byte stands for: eighths of a doubling to 2^16, quarters to 2^48.
DOUBLINGS = np.concatenate([np.arange(128) / 8, 16 + np.arange(128) / 4])
#: Counts of pairs as one byte: whole numbers by these steps.
STEPS = np.unique(np.rint(np.exp2(np.concatenate([np.arange(128) / 8, 16 + np.arange(200) / 4])) - 1))[:256]
#: Distinct tokens of a group in which weights are learned, about.
GROUP = 1 << 14
#: Gates of the token before: doublings of how often it was seen, 0 where never.
SEEN = 32
#: Half doublings of how likelier the token before makes a token than its spelling; the first for never.
GAINS = 128


def held_out(ids, null, fold: int, out_fold: int) -> np.ndarray:
    return np.array([not z and zlib.crc32(str(i).encode()) % fold == out_fold for i, z in zip(ids.tolist(), null.tolist())], bool)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes with an end after each text, starts and ends of tokens, first token of each text."""
    off = offsets + 2 * np.arange(len(offsets))
    out, inside = np.full(off[-1], 32, np.uint8), np.ones(off[-1], bool)
    out[off[1:] - 1] = END
    inside[off[1:] - 1] = inside[off[1:] - 2] = False
    out[inside] = K.LOWER[data]
    return (out, *K.words(out, off))


def unique(keys: np.ndarray):
    """Sorted distinct keys, a place of each and the number among them of every entry; the places need no stable sort, as equal keys stand for equal bytes."""
    order = keys.argsort()
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse


def joined(data, starts, ends) -> np.ndarray:
    """The bytes of the given words, each with a line feed after it."""
    n = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(n)])
    where = np.minimum(np.repeat(starts - at[:-1], n) + np.arange(at[-1]), len(data) - 1)
    out = data[where]
    out[at[1:] - 1] = 10
    return out


BLOB = "bucket int, chunk long, counts binary, words binary"


def _emitter(bits, fold, out_fold):
    def run(batches):
        for chunk, ids, null, raw, off, _ in each_chunk(batches):
            data, starts, ends, first = tokens(raw, off)
            h = K.word_hashes(data, starts, ends)
            keys, at, inverse = unique(h)
            train = np.repeat(~held_out(ids, null, fold, out_fold), np.diff(first))
            counts = np.bincount(inverse, train, len(keys)).astype(np.uint32)
            cuts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=U) << U(64 - bits)), len(keys))
            full = np.flatnonzero(np.diff(cuts))
            words = [zlib.compress(joined(data, starts[at[cuts[b] : cuts[b + 1]]], ends[at[cuts[b] : cuts[b + 1]]]).tobytes(), 1) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk), pa.int64()), pa.array([zlib.compress(counts[cuts[b] : cuts[b + 1]].tobytes(), 1) for b in full], pa.binary()), pa.array(words, pa.binary())], names=["bucket", "chunk", "counts", "words"])

    return run


def distinct(counts: list[bytes], words: list[bytes]):
    """Distinct tokens of a bucket by their hashes: bytes, starts, ends, training counts; the place of every entry among them; hashes."""
    data = np.frombuffer(b"".join(zlib.decompress(w) for w in words), np.uint8)
    c = np.frombuffer(b"".join(zlib.decompress(x) for x in counts), np.uint32)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    keys, at, inverse = unique(K.word_hashes(data, starts, ends))
    return data, starts[at], ends[at], np.bincount(inverse, c, len(at)), inverse, keys


def spelled(data, starts, ends):
    """The tokens' bytes, each with a closing blank: byte, token, place, first byte of each token."""
    n = ends - starts + 1
    first = np.concatenate([[0], np.cumsum(n)])
    token = np.repeat(np.arange(len(n)), n)
    place = np.arange(first[-1]) - first[token]
    byte = data[np.repeat(starts, n) + place].copy()
    byte[first[1:] - 1] = 32
    return byte, token, place, first


def packed_before(byte, place) -> np.ndarray:
    """Each byte as the lowest of a number with the five before it in its token; a 1 stands where there is none."""
    out = byte.astype(U)
    for k in range(5):
        back = np.ones(len(byte), np.uint8)
        back[k + 1 :] = byte[: max(len(byte) - k - 1, 0)]
        back[place <= k] = 1
        out |= back.astype(U) << U(8 * (k + 1))
    return out


def context(packed, order: int) -> np.ndarray:
    """A hash of the last ``order`` bytes before each byte."""
    h = np.full(len(packed), U(order * 1000003))
    for k in range(order):
        h = h * U(257) + ((packed >> U(8 * (k + 1))) & U(255))
    return K.mix(h) * SPREAD


def whole_context(byte, token, place, first) -> np.ndarray:
    """A hash of all of the token before each byte."""
    return K.mix(K.word_hashes(byte, first[token], first[token] + place) + U(77)) * SPREAD


def coded(data, starts, ends):
    """For the tokens' bytes and closing blanks: token, byte, place, and a context hash for each predictor."""
    byte, token, place, first = spelled(data, starts, ends)
    packed = packed_before(byte, place)
    return token, byte, place, [context(packed, o) if o else whole_context(byte, token, place, first) for o in ORDERS]


def coded_once(data, starts, ends):
    """As ``coded``, with each byte after the same beginning of a token once: byte, place, contexts; then token and number among these of every byte."""
    byte, token, place, first = spelled(data, starts, ends)
    whole = whole_context(byte, token, place, first)
    _, at, inverse = unique(whole + byte * BYTES)
    packed = packed_before(byte, place)[at]
    return byte[at], place[at], [context(packed, o) if o else whole[at] for o in ORDERS], token, inverse


SPREAD = U(0x9E3779B97F4A7C15)
#: Tells the bytes after one context apart.
BYTES = U(0xD1B54A32D192ED03)
#: Hashes of the places in a byte's tree of bits, spread as the contexts are.
NODES = K.mix(np.arange(256, dtype=U) + U(1)) * SPREAD


def bit_slots(ctx, byte, b, which=range(P)):
    node = NODES.take((1 << b) | (byte.astype(np.int64) >> (8 - b)))
    return [((c + node) >> U(64 - SLOTS[k])).view(np.int64) for c, k in zip(ctx, which)], (byte >> (7 - b)) & 1


def batches_of(starts, ends, most: int = 100_000):
    """Ranges of tokens of about ``most`` bytes."""
    size = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(size, size[i] + most, "right")) - 1)
        yield i, j
        i = j


COUNTED = "g int, k int, p int, n long, v long, part binary"


def summed(keys, weight):
    """Distinct keys, a place of each and the sum of its weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), weight
    order = keys.argsort()
    ranked = keys[order]
    at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[at], order[at], np.add.reduceat(weight[order], at)


def met(held, k: int):
    """Contexts of predictor ``k``, bytes and how many of the tokens have that byte there, each once for a batch, as tokens share most of their contexts.

    ``held``: tokens and counts of the buckets; the longest context of a fixed number of bytes leaves its sums there instead, for the shorter ones."""
    for at, x in enumerate(held):
        if k in (WHOLE, WHOLE - 1):
            data, count = x
            ends = np.flatnonzero(data == 10)
            starts = np.concatenate([[0], ends + 1])[:-1]
            if k == WHOLE:
                again = count > 1  # a token seen once tells its whole nothing
                starts, ends, count = starts[again], ends[again], count[again]
            left = []
            for i, j in batches_of(starts, ends, 200_000):
                byte, token, place, first = spelled(data, starts[i:j], ends[i:j])
                if k == WHOLE:
                    whole = whole_context(byte, token, place, first)
                    _, one, weight = summed(whole + byte * BYTES, count[i:j][token])
                    yield whole[one], byte[one], weight
                else:
                    packed, weight = summed(packed_before(byte, place), count[i:j][token])[::2]
                    yield context(packed, ORDERS[k]), (packed & U(255)).astype(np.uint8), weight
                    left.append(shorter(packed, weight, ORDERS[k - 1]))
            if k != WHOLE:
                held[at] = shorter(*(np.concatenate(y) for y in zip(*left)), ORDERS[k - 1]) if left else (np.zeros(0, U), count)
        else:
            packed, weight = held[at] = shorter(*x, ORDERS[k])
            yield context(packed, ORDERS[k]), (packed & U(255)).astype(np.uint8), weight


def shorter(packed, weight, order: int):
    """The sums by the last ``order`` bytes before a byte, from those by more of them."""
    return summed(packed & U((1 << 8 * (order + 1)) - 1), weight)[::2]


def _counter(batches):
    """Sums of a task's buckets, one predictor after the other: the slots' counts, tokens and distinct tokens."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    rows: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for b, c, w in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            got = rows.setdefault(b, ([], []))
            got[0].append(c)
            got[1].append(w)
    held = []
    for b in list(rows):
        data, starts, ends, count, *_ = distinct(*rows.pop(b))
        seen = np.flatnonzero(count)
        held.append((joined(data, starts[seen], ends[seen]), count[seen].astype(np.uint64)))
    n, v = sum(int(c.sum()) for _, c in held), sum(len(c) for _, c in held)
    for k in reversed(range(P)):
        sums = np.zeros(2 << SLOTS[k], np.uint64)
        for ctx, byte, weight in met(held, k):
            for b in range(8):
                slots, bit = bit_slots([ctx], byte, b, (k,))
                np.add.at(sums, slots[0] * 2 + bit, weight)
        step = len(sums) // PARTS
        for p in range(PARTS):
            part = zlib.compress(sums[p * step : (p + 1) * step].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([k], pa.int32()), pa.array([p], pa.int32()), pa.array([n if k == p == 0 else 0]), pa.array([v if k == p == 0 else 0]), pa.array([part], pa.binary())], names=["g", "k", "p", "n", "v", "part"])


def _summed(last: bool):
    """Sums of the same part of several tasks; at last as levels."""

    def run(table: pa.Table) -> pa.Table:
        total = U(0)
        for x in table["part"]:
            total = total + np.frombuffer(zlib.decompress(x.as_py()), np.uint64)
        part = (levels(total) if last else total).tobytes()
        return pa.table({**{c: table[c][:1] for c in ("g", "k", "p")}, **{c: pa.array([sum(table[c].to_pylist())]) for c in ("n", "v")}, "part": pa.array([zlib.compress(part, 1)], pa.binary())})

    return run


def summed_by_tree(parts: DataFrame, fan: int = 16) -> list:
    """The parts' sums over all tasks, never more than ``fan`` of them in one place."""
    parts = materialize(parts, "counted")
    n = (parts.agg(F.max("g")).first()[0] or 0) + 1
    while n > fan:
        n = -(-n // fan)
        before, parts = parts, materialize(parts.withColumn("g", F.col("g") % n).groupBy("g", "k", "p").applyInArrow(_summed(False), COUNTED), "counted")
        discard(before)
    got = parts.groupBy("k", "p").applyInArrow(_summed(True), COUNTED).collect()  # 23 MB of levels at most
    discard(parts)
    return got


#: Counts travel as one byte each; small ones come back exactly.
LEVELS = np.rint(np.exp2(DOUBLINGS) - 1).astype(np.float64)


def levels(counts: np.ndarray) -> np.ndarray:
    """The level nearest to each count, by doublings."""
    d = np.log2(counts.astype(np.float64) + 1)
    return np.minimum(np.where(d < 16, np.rint(8 * d), 128 + np.rint(4 * (d - 16))), 255).astype(np.uint8)


@lru_cache(1)
def unpacked_counts(raw: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.split(flat, np.cumsum([2 << s for s in SLOTS])[:-1])


def _by_levels() -> tuple[np.ndarray, np.ndarray]:
    """Evidence, and how often the context was seen (0 for never), by two levels as one number after none, a 0 or a 1 is taken away."""
    zero, one = np.tile(LEVELS, 256), np.repeat(LEVELS, 256)
    less = [(zero, one), (np.maximum(zero - 1, 0), one), (zero, np.maximum(one - 1, 0))]
    zero, one = (np.concatenate(x) for x in zip(*less))
    return np.log((one + PRIOR) / (zero + PRIOR)).astype(np.float32), np.searchsorted(CONFIDENCE, zero + one, "right").astype(np.uint8)


EVIDENCE, SURE = _by_levels()


class Mixer:
    """``counts``: for each predictor the levels of the counts of 0 and 1 of all its slots, one after the other."""

    def __init__(self, counts: list[np.ndarray], w: np.ndarray | None = None, apm: np.ndarray | None = None):
        self.counts = [c.view("<u2") for c in counts]
        self.w = np.full((GATES, P), 0.3) if w is None else w
        self.apm = apm

    def evidence(self, slots, place, bit=None, weight=None):
        """Stretched probabilities by predictor, and the gate; ``bit``: without this occurrence."""
        xs, level = [], np.zeros(len(slots[0]), np.uint8)
        own = None if bit is None else (bit.astype(np.int64) + 1) << 16
        for k in range(P):
            at = self.counts[k].take(slots[k])
            if bit is not None:
                at = at + (own if k != WHOLE else own * (weight > 1))
            xs.append(EVIDENCE.take(at))
            sure = SURE.take(at)
            here = np.minimum(sure, 1)
            level = np.maximum(level, (here * np.uint8(P - 1) + sure) if k == WHOLE else here * np.uint8(k + 1))
        return xs, level * np.int64(PLACES) + np.minimum(place, PLACES - 1)

    def mixed(self, xs, gate):
        w = np.ascontiguousarray(self.w.T)
        z = w[0].take(gate) * xs[0]
        for k in range(1, P):
            z += w[k].take(gate) * xs[k]
        return np.clip(z, -14, 14)

    def learn(self, data, starts, ends, count, rate: float = 0.05):
        """One pass over a bucket's tokens in batches (steps scaled by the gradients seen); the last table is filled on the way."""
        if self.apm is None:
            self.apm = np.zeros((2, GATES, BINS))
        seen, scale = 0.0, np.full((GATES, P), 1e-6)
        for i, j in batches_of(starts, ends, 8_000):
            token, byte, place, ctx = coded(data, starts[i:j], ends[i:j])
            weight = count[i:j][token]
            seen += weight.sum() * 8
            for b in range(8):
                slots, bit = bit_slots(ctx, byte, b)
                xs, gate = self.evidence(slots, place, bit, weight)
                z = self.mixed(xs, gate)
                p = 1 / (1 + np.exp(-z))
                cell = gate * BINS + np.clip(np.rint(z * 1.25) + BINS // 2, 0, BINS - 1).astype(np.int64)
                self.apm[0] += np.bincount(cell, weight, GATES * BINS).reshape(GATES, BINS)
                self.apm[1] += np.bincount(cell, weight * bit, GATES * BINS).reshape(GATES, BINS)
                err = weight * (bit - p)
                norm = np.maximum(np.bincount(gate, weight, GATES), 1.0)
                g = np.stack([np.bincount(gate, err * xs[k], GATES) / norm for k in range(P)], 1)
                scale += g * g
                self.w += rate * g / np.sqrt(scale)
        return seen

    def costs(self, data, starts, ends) -> np.ndarray:
        """Bits of each token."""
        out, (total, ones) = np.zeros(len(starts)), self.apm.reshape(2, -1)
        for i, j in batches_of(starts, ends):
            byte, place, ctx, token, which = coded_once(data, starts[i:j], ends[i:j])
            given = np.ones(len(byte))  # eight factors of at least 1e-7
            for b in range(8):
                slots, bit = bit_slots(ctx, byte, b)
                xs, gate = self.evidence(slots, place)
                z = self.mixed(xs, gate)
                p = 1 / (1 + np.exp(-z))
                cell = gate * BINS + np.clip(np.rint(z * 1.25) + BINS // 2, 0, BINS - 1).astype(np.int64)
                p = (p + (ones.take(cell) + p) / (total.take(cell) + 1)) / 2
                given *= np.where(bit == 1, p, 1 - p)
            out[i:j] = np.bincount(token, -np.log2(given)[which], j - i)
        return out


LEARNED = "seen double, w array<double>, apm array<double>"


def _learner(counts, bits: int):
    """Weights and last tables learned in each of the groups that a table of buckets holds; a group is a range of ``bits`` leading bits of the hashes."""

    def run(table: pa.Table) -> pa.Table:
        data, starts, ends, count, _, keys = distinct(table["counts"].to_pylist(), table["words"].to_pylist())
        group = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(starts), np.int64)
        out = []
        for g in np.unique(group):
            some = (group == g) & (count > 0)
            m = Mixer(unpacked_counts(counts.value))
            if some.any():
                out.append((m.learn(data, starts[some], ends[some], count[some]), m.w.ravel(), m.apm.ravel()))
        return pa.table({"seen": pa.array([x[0] for x in out], pa.float64()), "w": pa.array([x[1] * x[0] for x in out], pa.list_(pa.float64())), "apm": pa.array([x[2] for x in out], pa.list_(pa.float64()))})

    return run


def _weighted(batches):
    """One row a task: bits seen, weights times bits, and the last table's counts, summed."""
    seen, w, apm = 0.0, np.zeros(GATES * P), np.zeros(2 * GATES * BINS)
    for batch in batches:
        for s, x, y in zip(*(batch.column(i) for i in range(3))):
            seen += s.as_py()
            w += x.values.to_numpy()
            apm += y.values.to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([w.tolist()]), pa.array([apm.tolist()])], names=["seen", "w", "apm"])


def learned_weights(blobs: DataFrame, sent, bits: int, v: int):
    """Weights and last table of all groups. A group has ``GROUP`` distinct tokens about, whatever the buckets are."""
    need = max(0, int(np.ceil(np.log2(max(v, 1) / GROUP))))
    found = materialize(blobs.groupBy(F.shiftright("bucket", max(bits - need, 0)).alias("group")).applyInArrow(_learner(sent, need), LEARNED), "learned")
    # a row a task, then few tasks: no task and not the driver sees the rows of all groups
    n = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = materialize(found.mapInArrow(_weighted, LEARNED), "learned").repartition(min(16, n)).mapInArrow(_weighted, LEARNED).collect()
    discard(found)
    seen = sum(r["seen"] for r in few)
    w = sum((np.array(r["w"]) for r in few), np.zeros(GATES * P)).reshape(GATES, P)
    apm = sum((np.array(r["apm"]) for r in few), np.zeros(2 * GATES * BINS)).reshape(2, GATES, BINS)
    # sums in another order differ in their last digits only
    return (np.round(w / seen, 9) if seen else np.full((GATES, P), 0.3)), apm


def _coster(counts, learned):
    def run(table: pa.Table) -> pa.Table:
        data, starts, ends, count, inverse, _ = distinct(table["counts"].to_pylist(), table["words"].to_pylist())
        cost = Mixer(unpacked_counts(counts.value), *learned).costs(data, starts, ends).astype(np.float32)
        at, out = 0, []
        for x in table["counts"].to_pylist():
            n = len(zlib.decompress(x)) // 4
            i = inverse[at : at + n]
            out.append(zlib.compress(count[i].astype(np.uint64).tobytes(), 1))
            out.append(cost[i].tobytes())
            at += n
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "counts": pa.array(out[::2], pa.binary()), "costs": pa.array(out[1::2], pa.binary())})

    return run


def pair_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = END_HASH
    return K.mix(before * U(0x9FB21C651E98DF25) + h)


def _pair_emitter(bits, fold, out_fold):
    def run(batches):
        for chunk, ids, null, raw, off, _ in each_chunk(batches):
            data, starts, ends, first = tokens(raw, off)
            keys, inverse = np.unique(pair_keys(K.word_hashes(data, starts, ends), first), return_inverse=True)
            train = np.repeat(~held_out(ids, null, fold, out_fold), np.diff(first))
            yield to_blobs(chunk, keys, np.bincount(inverse, train, len(keys)).astype(np.uint32), bits, True)

    return run


def _stepped(keys: np.ndarray, load: np.ndarray) -> np.ndarray:
    """For each entry the step at or below the sum of its key."""
    _, inverse = np.unique(keys, return_inverse=True)
    return (np.searchsorted(STEPS, np.bincount(inverse, load), "right") - 1).astype(np.uint8)[inverse]


def with_answers(batches, bits):
    """(ids, null, bytes' offsets, first tokens, for each token: count, spelled cost, count of the token before, of the pair)."""
    for batch in batches:
        head = pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5)], names=[*batch.schema.names[:4], "pairs"])
        for row, (_, ids, null, raw, off, more) in enumerate(each_chunk([head])):
            got = {x["bucket"]: (x["counts"], x["costs"]) for x in (batch.column(4)[row].as_py() or [])}
            data, starts, ends, first = tokens(raw, off)
            h = K.word_hashes(data, starts, ends)
            pair, at = np.unique(pair_keys(h, first), return_inverse=True)
            follows = STEPS[from_answers(more[0], pair, bits, np.uint8)][at]
            keys, inverse = np.unique(h, return_inverse=True)
            order = sorted(got)
            count = np.frombuffer(b"".join(zlib.decompress(got[b][0]) for b in order), np.uint64).astype(np.float64)[inverse]
            cost = np.frombuffer(b"".join(got[b][1] for b in order), np.float32).astype(np.float64)[inverse]
            before = np.empty_like(count)
            before[1:] = count[:-1]
            ended = np.searchsorted(keys, END_HASH)
            before[first[:-1]] = count[np.flatnonzero(inverse == ended)[:1]]
            yield ids, null, off, first, count, cost, before, follows


def seen_gate(before: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(before, 0.5))).astype(np.int64) + 1, SEEN - 1)


def _gainer(bits, fold, out_fold):
    """How many training tokens fall in each gate and gain, each left out of its counts."""

    def run(batches):
        sums = np.zeros(SEEN * GAINS)
        for ids, null, _, first, _, cost, before, follows in with_answers(batches, bits):
            train = np.repeat(~held_out(ids, null, fold, out_fold), np.diff(first))
            before, follows, cost = before[train] - 1, follows[train] - 1, cost[train]
            gain = np.log2(np.maximum(follows, 0.5) / np.maximum(before, 1)) + cost
            gain = np.where(follows > 0, np.clip(np.rint(2 * gain) + 32, 1, GAINS - 1), 0).astype(np.int64)
            sums += np.bincount(seen_gate(before) * GAINS + gain, minlength=SEEN * GAINS)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full].astype(np.int64))], names=["cell", "n"])

    return run


def trusted(cells: np.ndarray, rounds: int = 200) -> np.ndarray:
    """For each gate the probability that the token before gives the token; 0 where nothing was seen."""
    rho = np.exp2((np.arange(GAINS) - 32) / 2)
    rho[0] = 0
    n = cells.reshape(SEEN, GAINS)
    total = n.sum(1, keepdims=True)
    g = np.full((SEEN, 1), 0.5)
    for _ in range(rounds):
        g = (n * (g * rho / (1 - g + g * rho))).sum(1, keepdims=True) / np.maximum(total, 1)
        g = np.clip(g, 1e-4, 1 - 1e-4)
    g[0] = 0
    return np.where(total > 0, g, 0)[:, 0]


def _finisher(bits, fold, out_fold, n, v, trust):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def run(batches):
        for ids, null, off, first, count, cost, before, follows in with_answers(batches, bits):
            g = trust[seen_gate(before)]
            cost = -np.log2((1 - g) * np.exp2(-np.minimum(cost, 1000)) + g * np.minimum(follows / np.maximum(before, 1), 1)) + np.maximum(cost - 1000, 0) * (follows == 0)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (np.log10((count + 1) / (n + v + 1)), -cost * np.log10(2), (count > 0).astype(np.int64), cost)]
            base, score, known, total = (s[first[1:]] - s[first[:-1]] for s in sums)
            size = np.maximum(np.diff(off), 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(held_out(ids, null, fold, out_fold)), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(score), pa.array(total / size)], names=names)

    return run


def score_texts(docs: DataFrame, fold: int = 7, out_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row.

    Texts whose crc32 of the id falls in ``out_fold`` are scored and never learned from. A
    null text is empty: it has its end only. A null id is never held out. Without training
    texts every count is 0 and the weights stay at their start.
    """
    spark = docs.sparkSession
    bits = bucket_bits(spark)
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = write_chunks(docs, id_col, text_col)
    blobs = materialize_bucketed(table.mapInArrow(_emitter(bits, fold, out_fold), BLOB).repartition(n_tasks, "bucket"), "tokens", "bucket", n_tasks)
    parts = summed_by_tree(blobs.repartition(max(1, n_tasks // 4), "bucket").mapInArrow(_counter, COUNTED))
    flat = [np.zeros(2 << s, np.uint8) for s in SLOTS]  # 23 MB, whatever the corpus
    for r in parts:
        step = (2 << SLOTS[r["k"]]) // PARTS
        flat[r["k"]][r["p"] * step : (r["p"] + 1) * step] = np.frombuffer(zlib.decompress(r["part"]), np.uint8)
    n, v = sum(r["n"] for r in parts), sum(r["v"] for r in parts)
    sent = spark.sparkContext.broadcast(zlib.compress(b"".join(x.tobytes() for x in flat), 1))  # 23 MB at most
    learned = learned_weights(blobs, sent, bits, v)
    answers = blobs.groupBy("bucket").applyInArrow(_coster(sent, learned), "chunk long, bucket int, counts binary, costs binary")
    answers = materialize_bucketed(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "costs")).alias("answers")), "costs", "chunk", n_tasks)
    discard(blobs)
    pairs = answered(table.mapInArrow(_pair_emitter(bits, fold, out_fold), PAIRS), np.uint32, np.uint32, _stepped, "pairs", bucketed=True)
    known = table.join(answers, "chunk", "left").join(pairs, "chunk", "left")
    cells = np.zeros(SEEN * GAINS)
    for r in known.mapInArrow(_gainer(bits, fold, out_fold), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4,096 rows at most
        cells[r["cell"]] = r["n"]
    out = materialize(known.mapInArrow(_finisher(bits, fold, out_fold, n, v, trusted(cells)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"), "scores")
    discard(table, answers, pairs)
    return out


def op6(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
