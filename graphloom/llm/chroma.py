"""Chroma audio fingerprints: pitch-class frames, integral-image filters, packed integers, alignment.

A recording is mono PCM, one unsigned byte a sample. Overlapping frames are folded to the energy
of twelve pitch classes; an integral image over time and pitch class gives the sums of any
rectangle in four reads. Sixteen filters, each the log ratio of two groups of rectangles in a
window of ``SPAN`` frames, are quantised to two bits: one 32-bit integer for each place.

Recordings are aligned by keys of two integers ``GAP`` places apart. A recording has one key for
each place; a query is read from ``PHASES`` starts within a hop, so that a recording cut at any
sample still meets it, and asks for both integers as they are and with their least certain bit
turned. All shared keys vote for the offset between two recordings, and at the offset of most
votes the share of differing bits over the whole overlap decides.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm import kernel as K
from graphloom.operators.components import connected_components
from graphloom.sources.scratch import drop_columns_clash, materialize

FRAME, HOP, SPAN, GAP = 128, 32, 6, 2
#: Starts within a hop from which a query is read.
PHASES = 4
#: Places of a key up to which it meets queries in a join; recordings and queries of other keys meet in blocks.
MANY = 16
#: Bytes of the codes of a block, and votes or codes that are compared at once.
BLOCK, VOTES = 1 << 22, 1 << 21
#: Passes over the keys.
PASSES = 4


@lru_cache
def pitch_classes(rate: int) -> np.ndarray:
    """Weights from spectrum bins to pitch classes (A = 0), 28 Hz to half the rate."""
    hz = np.arange(FRAME // 2 + 1) * rate / FRAME
    out = np.zeros((len(hz), 12), np.float32)
    use = hz >= 28
    out[np.flatnonzero(use), np.rint(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters, by a rule: kinds in turn, heights 4..12, widths 4..``SPAN``."""
    out = []
    for i in range(16):
        h = 4 + (5 * i) % 9
        out.append((i % 6, (7 * i) % (13 - h), h, 4 + (3 * i) % (SPAN - 3)))
    return out


FILTERS = filters()
#: Gray codes of the four quantised values.
GRAY = np.array([0, 1, 3, 2], np.uint32)


@lru_cache
def bounds(rate: int) -> tuple[np.ndarray, ...]:
    """Quartiles of each filter over noise: the bounds of its four values, so that each comes as often."""
    noise = (K.stream(7, 1 << 19) >> np.uint64(56)).astype(np.uint8)
    return tuple(np.quantile(v, (0.25, 0.5, 0.75)) for v in values(noise, pitch_classes(rate)))


def _kind(area, kind, y, h, w):
    """Two groups of rectangles (first class, end class, first frame, end frame), summed."""
    hy, hw, ty, tw = y + h // 2, w // 2, h // 3, w // 3
    a = area
    if kind == 0:
        return a(y, y + h, 0, w), a(0, 12, 0, w)
    if kind == 1:
        return a(hy, y + h, 0, w), a(y, hy, 0, w)
    if kind == 2:
        return a(y, y + h, hw, w), a(y, y + h, 0, hw)
    if kind == 3:
        return a(y, hy, hw, w) + a(hy, y + h, 0, hw), a(y, hy, 0, hw) + a(hy, y + h, hw, w)
    if kind == 4:
        return a(y + ty, y + h - ty, 0, w), a(y, y + ty, 0, w) + a(y + h - ty, y + h, 0, w)
    return a(y, y + h, tw, w - tw), a(y, y + h, 0, tw) + a(y, y + h, w - tw, w)


def values(samples: np.ndarray, fold: np.ndarray):
    """The value of each filter at each place of one recording; one too short for a window is looped until it fills it."""
    if len(samples) < FRAME + (SPAN - 1) * HOP:
        samples = np.resize(samples, FRAME + (SPAN - 1) * HOP)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    chroma = np.empty((len(frames), 12), np.float64)
    for i in range(0, len(frames), 2048):
        part = (frames[i : i + 2048].astype(np.float32) - 128) * window
        chroma[i : i + 2048] = (np.abs(np.fft.rfft(part, axis=1)) ** 2).astype(np.float32) @ fold
    chroma /= chroma.sum(1, keepdims=True) + 1e-9
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = chroma.cumsum(0).cumsum(1)
    n = len(frames) - SPAN + 1

    def area(y0, y1, t0, t1):
        a, b = image[t0 : t0 + n], image[t1 : t1 + n]
        return b[:, y1] - a[:, y1] - b[:, y0] + a[:, y0]

    for kind, y, h, w in FILTERS:
        up, down = _kind(area, kind, y, h, w)
        yield np.log((1 + up) / (1 + down))


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """Packed integers of one recording."""
    if not len(samples):
        return np.zeros(0, np.uint32)
    out = np.uint32(0)
    for v, b in zip(values(samples, pitch_classes(rate)), bounds(rate)):
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(b, v)]
    return out


def turned(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers of one recording, and the same with the bit nearest to its bound turned."""
    if not len(samples):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    code, turn, near = np.uint32(0), np.uint32(0), np.float64(np.inf)
    for i, (v, b) in enumerate(zip(values(samples, pitch_classes(rate)), bounds(rate))):
        code = (code << np.uint32(2)) | GRAY[np.searchsorted(b, v)]
        gaps = np.abs(v[:, None] - b) / (b[2] - b[0])
        # Gray codes: the middle bound parts the high bit, the outer two the low one
        bit = np.uint32(1) << (2 * (15 - i) + (gaps.argmin(1) == 1)).astype(np.uint32)
        gap = gaps.min(1)
        turn, near = np.where(gap < near, bit, turn), np.minimum(gap, near)
    return code, code ^ turn


def phases_of(samples: np.ndarray, rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``turned`` of a query read from ``PHASES`` starts within a hop; a start after which no window is left has none."""
    starts = [p * HOP // PHASES for p in range(PHASES)]
    return [turned(samples[s:] if not s or len(samples) - s >= FRAME + (SPAN - 1) * HOP else samples[:0], rate) for s in starts]


MADE = "rec long, n_samples long, codes array<int>, phases array<struct<code array<int>, turned array<int>>>"


def _maker(rate, every):
    kind = pa.list_(pa.struct([("code", pa.list_(pa.int32())), ("turned", pa.list_(pa.int32()))]))

    def run(batches):
        for batch in batches:
            data, off = K.packed(batch.column(1))
            for i, j in K.slices(off):
                ids = batch.column(0).slice(i, j - i)
                codes, phases = [], []
                for k, rec in zip(range(i, j), ids.to_pylist()):
                    x = data[off[k] : off[k + 1]]
                    if rec is not None and every and rec % every == 0 and len(x):
                        got = phases_of(x, rate)
                        codes.append(got[0][0])
                        phases.append([{"code": c.view(np.int32), "turned": t.view(np.int32)} for c, t in got])
                    else:
                        codes.append(fingerprint(x, rate))
                        phases.append(None)
                n = np.array([len(c) for c in codes])
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(off[i : j + 1])), K.scattered(np.concatenate(codes).view(np.int32), n), pa.array(phases, kind)], names=["rec", "n_samples", "codes", "phases"])

    return run


def fingerprints(media: DataFrame, id_col: str, pcm_col: str, rate: int = 2000, every: int = 0) -> DataFrame:
    """``rec, n_samples, codes`` for every row, and for queries (ids divisible by ``every``) ``phases``; a null or empty recording has no codes."""
    media = drop_columns_clash(media, {id_col: "long", pcm_col: "binary"})
    return media.mapInArrow(_maker(rate, every), MADE)


def _later(codes):
    """The integer ``GAP`` places on, at the end the last one."""
    return F.concat(F.slice(codes, GAP + 1, F.size(codes)), F.array_repeat(F.element_at(codes, -1), F.least(F.lit(GAP), F.size(codes))))


def _keys(codes, later):
    return F.zip_with(codes, later, lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))


def _runs(keys):
    """``key, at`` of every place whose key is not that of the place before: a steady sound has its key once."""
    at = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: (i == 0) | (F.get(keys, i) != F.get(keys, i - 1)))
    return F.transform(at, lambda i: F.struct(F.get(keys, i).alias("key"), i.alias("at")))


def posts(codes: DataFrame) -> DataFrame:
    """``r, key, at`` of the keys by which recordings are found."""
    return codes.withColumn("k", _keys(F.col("codes"), _later(F.col("codes")))).select(F.col("rec").alias("r"), F.inline(_runs(F.col("k"))))


def probes(queries: DataFrame) -> DataFrame:
    """``q, key, place``: what queries ask for; both integers of a key as they are and with the least certain bit turned."""
    each = queries.select("q", F.posexplode("phases").alias("p", "x")).where("size(x.code) > 0").select("q", (F.col("p") * (HOP // PHASES)).alias("start"), "x.code", "x.turned")
    ways = F.array(*[F.struct(_keys(a, _later(b)).alias("k")) for a in (F.col("code"), F.col("turned")) for b in (F.col("code"), F.col("turned"))])
    each = each.select("q", "start", F.explode(ways).alias("w")).select("q", "start", F.col("w.k").alias("k"))
    return each.select("q", "start", F.inline(_runs(F.col("k")))).select("q", "key", (F.col("at") * HOP + F.col("start")).alias("place"))


def _errors(offset, phases, codes):
    """Share of differing bits where the query at the phase of ``offset`` and the recording overlap; null without overlap."""
    phase = F.pmod(-offset, F.lit(HOP)) / F.lit(HOP // PHASES)
    x = F.get(phases, phase.cast("int"))["code"]
    shift = ((offset + F.pmod(-offset, F.lit(HOP))) / F.lit(HOP)).cast("int")  # hops from the query's place to the recording's
    a, b = F.slice(x, F.greatest(-shift, F.lit(0)) + 1, F.greatest(F.size(x), F.lit(0))), F.slice(codes, F.greatest(shift, F.lit(0)) + 1, F.size(codes))
    # as long without the sign: the count of a negative integer has 32 bits more
    bits = F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    diff = F.aggregate(F.filter(bits, lambda n: n.isNotNull()), F.lit(0), lambda s, n: s + n)
    over = F.least(F.size(a), F.size(b))
    return F.when(over > 0, diff / (32 * over))


def _posts_of(code: np.ndarray, later: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``posts``, over many recordings in one array with their offsets: key, number of the recording, place."""
    n = np.diff(off)
    rec = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(code))
    key = (code.astype(np.int64) << 32) | later[np.minimum(i + GAP, off[1:][rec] - 1)].astype(np.int64)
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (rec[1:] != rec[:-1])
    return key[first], rec[first], (i - off[:-1][rec])[first]


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


class _Recordings:
    """A block of recordings with its posts in the order of their keys."""

    def __init__(self, ids, members, sizes, codes):
        self.ids, self.members, self.codes, self.off = ids, members, codes, _offsets(sizes)
        key, rec, at = _posts_of(codes, codes, self.off)
        order = np.argsort(key, kind="stable")
        self.key, self.rec, self.at = key[order], rec[order], at[order]

    def votes(self, sizes, code, turned):
        """``query, recording, offset, votes``: arrays of the offset of most votes of each pair, in parts of whole queries."""
        off = _offsets(sizes)
        probes = [_posts_of(a, b, off) for a in (code, turned) for b in (code, turned)]
        key, row, at = (np.concatenate(x) for x in zip(*probes))
        query, place = row // PHASES, at * PHASES + row % PHASES  # places and offsets in steps of a phase
        lo = np.searchsorted(self.key, key)
        n = np.searchsorted(self.key, key, "right") - lo
        order = np.flatnonzero(n)
        order = order[np.argsort(query[order], kind="stable")]
        query, place, lo, n = query[order], place[order], lo[order], n[order]
        back = int(place.max(initial=0))
        span = back + int(self.at.max(initial=0)) * PHASES + 1
        ends, i = np.cumsum(n), 0
        left = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + VOTES, "right")))
            m = n[i:j]
            to = np.repeat(lo[i:j] - _offsets(m)[:-1], m) + np.arange(m.sum())
            pair = np.repeat(query[i:j], m) * len(self.ids) + self.rec[to]
            code_, count = np.unique(pair * span + (self.at[to] * PHASES - np.repeat(place[i:j], m) + back), return_counts=True)
            if len(left[0]):
                code_, at_ = np.unique(np.concatenate([left[0], code_]), return_inverse=True)
                count = np.bincount(at_, np.concatenate([left[1], count])).astype(np.int64)
            # the last query may have more votes to come
            done = len(code_) if j == len(n) else int(np.searchsorted(code_, query[j] * len(self.ids) * span))
            left = code_[done:], count[done:]
            if done:
                yield self._best(code_[:done], count[:done], span, back)
            i = j

    def _best(self, code, count, span, back):
        pair, offset = code // span, (code % span - back) * (HOP // PHASES)
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        most = count == np.repeat(np.maximum.reduceat(count, starts), np.diff(np.r_[starts, len(pair)]))
        pair, offset, count = pair[most], offset[most], count[most]
        order = np.lexsort((offset, -np.abs(offset), pair))
        last = order[np.r_[pair[order][1:] != pair[order][:-1], True]]
        return pair[last] // len(self.ids), pair[last] % len(self.ids), offset[last], count[last]

    def errors(self, query, rec, offset, sizes, code):
        """As ``_errors``, for arrays of pairs; nan without overlap."""
        off = _offsets(sizes)
        start = -offset % HOP
        row, shift = query * PHASES + start // (HOP // PHASES), (offset + start) // HOP
        a, b = off[row] + np.maximum(-shift, 0), self.off[rec] + np.maximum(shift, 0)
        over = np.maximum(np.minimum(off[row + 1] - a, self.off[rec + 1] - b), 0)
        out, ends, i = np.full(len(rec), np.nan), np.cumsum(over), 0
        while i < len(rec):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - over[i] + VOTES, "right")))
            m = over[i:j]
            k, own = np.arange(m.sum()), _offsets(m)
            bits = np.bitwise_count(code[np.repeat(a[i:j] - own[:-1], m) + k] ^ self.codes[np.repeat(b[i:j] - own[:-1], m) + k])
            sums = _offsets(bits)
            some = m > 0
            out[i:j][some] = (sums[own[1:]] - sums[own[:-1]])[some] / (32 * m[some])
            i = j
        return out


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what ``u, v`` join, fewer than there are ids."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        # a lower label holds for all that had the higher one
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


PAIR = "q long, r long, offset long, votes long, errors double, others long"
PAIRS = [c.split()[0] for c in PAIR.split(", ")]
#: Cells of a block: ids, members, lengths of the lists, their integers, and the same turned.
CELLS = ("ids", "members", "sizes", "code", "turned")


def _packer(most):
    def run(batches):
        for batch in batches:
            ids, members, *lists = (batch.column(k) for k in range(5))
            at = [np.asarray(x.offsets).astype(np.int64) for x in lists]
            values = [np.asarray(x.values) for x in lists]
            for i, j in K.slices(at[1] * 4, most):
                cells = [np.asarray(x)[i:j].tobytes() for x in (ids, members)] + [v[a[i] : a[j]].tobytes() for v, a in zip(values, at)]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=list(CELLS))

    return run


def _blocks(rows: DataFrame, ways: int, most: int, name: str) -> DataFrame:
    """``rows`` of ``CELLS`` packed, many recordings a row: as many rows as ``ways`` or of up to ``most`` bytes of codes, or one recording."""
    total = 4 * (rows.select(F.sum(F.size("code"))).first()[0] or 0)
    most = min(most, total // ways + 1)
    return materialize(rows.select(*CELLS).repartition(max(1, -(-total // most))).mapInArrow(_packer(most), ", ".join(f"{c} binary" for c in CELLS)), name)


def _comparer(most_errors, pairs):
    def run(batches):
        last = None
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(10))):
                own, (ids, _, sizes, code, turned) = [c.as_buffer() for c in row[:5]], [c.as_buffer() for c in row[5:]]
                if last is None or not all(a.equals(b) for a, b in zip(last, own)):
                    last = own
                    block = _Recordings(*(np.frombuffer(b, t) for b, t in zip(own, (np.int64, np.int64, np.int32, np.uint32))))
                ids, sizes, code, turned = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int32), np.frombuffer(code, np.uint32), np.frombuffer(turned, np.uint32)
                for q, r, offset, votes in block.votes(sizes, code, turned):
                    errors = block.errors(q, r, offset, sizes, code)
                    ok = (errors <= most_errors) & (ids[q] != block.ids[r])
                    u, v, offset, votes, errors, others = ids[q[ok]], block.ids[r[ok]], offset[ok], votes[ok], errors[ok], block.members[r[ok]]
                    if not len(u):
                        continue
                    if not pairs:
                        a, b = _forest(u, v)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=PAIRS)
                        order = np.lexsort((offset, v, -votes, errors, u))
                        first = np.flatnonzero(np.r_[True, u[order][1:] != u[order][:-1]])
                        others = np.add.reduceat(others[order], first)
                        u, v, offset, votes, errors = (x[order[first]] for x in (u, v, offset, votes, errors))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, offset, votes, errors, others)], names=PAIRS)

    return run


def _in_blocks(codes: DataFrame, queries: DataFrame, most_errors: float, pairs: bool) -> DataFrame:
    """``PAIR`` of every query against every recording, in arrays, block by block: nothing is a row for each pair but the result.

    With ``pairs`` the result has a row for each aligned pair. Else it has, for a query and a block,
    the closest recording and the members of all that align, and rows without errors whose ``q, r``
    join what is joined by the block's alignments.
    """
    none = F.array().cast("array<int>")
    right = queries.select(F.col("q").alias("ids"), F.lit(0).cast("long").alias("members"), F.transform("phases", lambda x: F.size(x.code)).alias("sizes"), F.flatten("phases.code").alias("code"), F.flatten("phases.turned").alias("turned"))
    left = codes.select(F.col("rec").alias("ids"), "members", F.array(F.size("codes")).alias("sizes"), F.col("codes").alias("code"), none.alias("turned"))
    # a query asks for four keys a code: its blocks are smaller
    left, right = _blocks(left, 32, BLOCK, "blocks"), _blocks(right, 4, BLOCK // 4, "asking")
    return left.hint("shuffle_replicate_nl").crossJoin(right.toDF(*[f"q_{c}" for c in CELLS])).mapInArrow(_comparer(most_errors, pairs), PAIR)


def _aligned(codes: DataFrame, queries: DataFrame, most_errors: float, pairs: bool) -> DataFrame:
    """``PAIR`` of ``codes`` with ``rec, codes, members``; rows as ``_in_blocks`` says."""
    asked = probes(queries)
    # keys in turn by their last bits, so that only a part of the index is on the way at a time
    met = None
    for k in range(PASSES):
        own = F.pmod("key", F.lit(PASSES)) == k
        some = materialize(posts(codes).where(own).join(asked.where(own).select("key"), "key", "left_semi"), "posts")
        met = some if met is None else met.unionByName(some)
    many = materialize(met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("key"), "many")
    recs = materialize(met.join(many, "key", "left_semi").select(F.col("r").alias("rec")).distinct(), "many_recordings")
    asking = materialize(asked.join(many, "key", "left_semi").select("q").distinct(), "many_queries")
    pairs_of = asked.join(met.join(many, "key", "left_anti"), "key").where("q <> r")
    votes = pairs_of.groupBy("q", "r", (F.col("at") * HOP - F.col("place")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("q", "r").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")).alias("b")).select("q", "r", "b.offset", "b.votes")
    # these are compared in blocks, by all of their keys
    best = best.join(recs.select(F.col("rec").alias("r"), F.lit(True).alias("many_r")), "r", "left").join(asking.withColumn("many_q", F.lit(True)), "q", "left")
    best = materialize(best.where("many_r is null or many_q is null").drop("many_r", "many_q"), "votes")
    full = best.join(codes.select(F.col("rec").alias("r"), "codes", "members"), "r").join(queries.select("q", "phases"), "q")
    full = full.select("q", "r", "offset", "votes", _errors(F.col("offset"), F.col("phases"), F.col("codes")).alias("errors"), F.col("members").alias("others")).where(F.col("errors") <= most_errors)
    return full.unionByName(_in_blocks(codes.join(recs, "rec", "left_semi"), queries.join(asking, "q", "left_semi"), most_errors, pairs))


def alignments(codes: DataFrame, queries: DataFrame, most_errors: float = 0.3) -> DataFrame:
    """``q, r, offset, votes, errors``: recordings that each query aligns with.

    ``codes`` has ``rec, codes`` of distinct ids and codes; ``queries`` has ``q, phases``. A key that a
    query and a recording share votes for the offset of their places, in samples (the query's place
    p is at p + offset in the recording). The offset of most votes is kept, of equal ones the one
    nearest to 0, and the bit errors over the whole overlap decide. Keys of up to ``MANY`` places
    meet queries in a join; the recordings and the queries that have any other key are compared with
    each other in blocks of arrays, so that a key of all recordings needs no row for each pair.
    """
    return _aligned(codes.withColumn("members", F.lit(1).cast("long")), queries, most_errors, True).drop("others")


def search_recordings(media: DataFrame, id_col: str, pcm_col: str, every: int = 20, rate: int = 2000, most_errors: float = 0.3) -> DataFrame:
    """One row for each row of ``media``: its codes, its class, and for queries (ids divisible by ``every``) what they align with.

    Recordings of equal codes are one from here on. ``n_aligned`` counts the recordings that a query
    was aligned with, those of equal codes included; ``best_id, best_offset, best_errors`` describe
    the closest other one (fewest bit errors, then most votes, then smallest id; the offset in
    samples). They are null for other rows. ``class_id`` is the smallest id reachable over
    alignments and equal codes. Rows of one id are one recording in the search, by its smallest
    codes; rows without id or codes have no class and align with nothing.
    """
    made = fingerprints(media, id_col, pcm_col, rate, every)
    made = materialize(made.withColumn("row", F.monotonically_increasing_id()).withColumn("h1", F.xxhash64("codes")).withColumn("h2", F.hash("codes")), "codes")
    is_q = F.expr(f"rec % {every} = 0")
    named = made.where("rec is not null and size(codes) > 0").groupBy("rec").agg(F.min(F.struct("h1", "h2", "row")).alias("h"))
    named = materialize(named.select("rec", "h.*"), "named")
    cls = named.groupBy("h1", "h2").agg(F.min(F.struct("rec", "row")).alias("c"), F.count("*").alias("members"), F.min(F.when(is_q, F.struct("rec", "row"))).alias("asker"))
    cls = materialize(cls.select("h1", "h2", F.col("c.rec").alias("cls"), F.col("c.row").alias("row"), "members", F.col("asker.row").alias("asker")), "classes")
    codes = materialize(made.select("row", "codes").join(cls.select("row", F.col("cls").alias("rec"), "members"), "row").select("rec", "codes", "members"), "recordings")
    queries = materialize(made.where("phases is not null").select("row", "phases").join(cls.select(F.col("asker").alias("row"), F.col("cls").alias("q")), "row").select("q", "phases"), "queries")
    found = materialize(_aligned(codes, queries, most_errors, False), "aligned")
    joined = connected_components(found.select(F.col("q").alias("u"), F.col("r").alias("v"))).toDF("cls", "class_id")
    best = found.where("errors is not null").groupBy("q").agg(F.sum("others").alias("others"), F.min(F.struct("errors", (-F.col("votes")).alias("v"), "r", "offset")).alias("b"))
    cls = cls.drop("row", "asker")
    of = named.drop("row").join(cls, ["h1", "h2"]).join(joined, "cls", "left").join(best.withColumnRenamed("q", "cls"), "cls", "left").withColumn("is_q", is_q)
    # the smallest id of a class has the next one as its copy
    second = named.join(cls.select("h1", "h2", "cls"), ["h1", "h2"]).where("rec <> cls").groupBy("cls").agg(F.min("rec").alias("second"))
    of = of.join(second, "cls", "left")
    copy = F.when(F.col("rec") == F.col("cls"), F.col("second")).otherwise(F.col("cls"))
    of = of.select(F.col("rec").alias("id"), F.coalesce("class_id", "cls").alias("class_id"),
        F.when(F.col("is_q"), F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_aligned"),
        F.when(F.col("is_q"), F.when(F.col("members") > 1, copy).otherwise(F.col("b.r"))).alias("best_id"),
        F.when(F.col("is_q"), F.when(F.col("members") > 1, 0).otherwise(F.col("b.offset"))).alias("best_offset"),
        F.when(F.col("is_q"), F.when(F.col("members") > 1, 0.0).otherwise(F.col("b.errors"))).alias("best_errors"))
    out = made.select("rec", "n_samples", "codes").join(of, made["rec"] == F.col("id"), "left")
    return out.select(F.col("rec").alias("doc_id"), "n_samples", F.size("codes").alias("n_codes"), "codes", "class_id", "n_aligned", "best_id", "best_offset", "best_errors")


def op1(spark, sf_dir: str) -> DataFrame:
    """The tables hold no sound: the bytes of each whole text are played as 8-bit PCM."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search_recordings(docs.select("doc_id", F.col("text").cast("binary").alias("pcm")), "doc_id", "pcm")
