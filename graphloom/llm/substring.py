"""Removal of repeated word windows by difference-cover anchors.

With the cover {0, 1, 3} modulo 7 any two places i and j have a shift k < 7 for which i+k and
j+k are both cover places. Two equal windows of 13 words therefore hold equal anchors of 7
words at cover places of the same shift. Hashing only the anchors (three of seven places)
and keeping those that two documents share leaves as candidates every window that can
repeat; each is then extended to its 13 words, hashed whole to 128 bits, and compared by the
smallest document that holds it.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import kernel as K
from graphloom.llm.chunks import BLOB, NONE, answered, bucket_bits, each_chunk, from_answers, to_blobs, write_chunks

#: Perfect difference covers: period -> places.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}


def _prepared(data, offsets, window, period):
    """Word starts, ends, first words, document of each word, hashes, anchor places and their hashes."""
    starts, ends, first = K.words(data, offsets)
    h = K.word_hashes(data, starts, ends)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - first[:-1][doc]
    anchor = window - period + 1
    at = np.flatnonzero(np.isin(place % period, COVERS[period]) & (place + anchor <= counts[doc]))
    return h, first, doc, place, at, K.windows(h, anchor)[at]


def _distinct(keys, doc, more=None):
    """Sorted distinct keys (told apart by ``more`` too), their ``more``, the place of each entry among them, and the smallest and largest doc of each."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    cut = np.flatnonzero(new)
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    other = None if more is None else m[cut]
    if not len(k):
        return k, other, inverse, doc[:0], doc[:0]
    return k[cut], other, inverse, np.minimum.reduceat(doc[order], cut), np.maximum.reduceat(doc[order], cut)


def _candidates(h, first, doc, place, at, shared, window, period):
    """Places of windows that hold a shared anchor, and both halves of their hashes."""
    hit = np.zeros(len(h) + 1, np.int64)
    hit[at[shared]] = 1
    run = np.concatenate([[0], np.cumsum(hit)])
    n = np.diff(first)
    places = np.flatnonzero(place + window <= n[doc])
    places = places[run[places + period] > run[places]]
    return places, K.windows(h, window)[places], K.windows(K.mix(h ^ K.U(0xA0761D6478BD642F)), window)[places]


def _anchor_emitter(window, period, bits):
    def run(batches):
        for chunk, _, _, data, off, _ in each_chunk(batches):
            _, _, doc, _, at, keys = _prepared(data, off, window, period)
            yield to_blobs(chunk, _distinct(keys, doc[at])[0], None, bits, True)

    return run


def _twice(keys, _):
    """Which keys come from more than one chunk."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


#: What goes with a window's key: its other 64 bits, and the smallest document of the chunk that holds it.
HELD = np.dtype([("more", "<u8"), ("low", "<i8")])


def _smaller(keys, held):
    """Whether another chunk has the key in a smaller document."""
    low = held["low"]
    order = np.lexsort((held["more"], keys))
    k, m = keys[order], held["more"][order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    least = np.minimum.reduceat(low[order], np.flatnonzero(new)) if len(k) else low
    out = np.empty(len(k), bool)
    out[order] = least[np.cumsum(new) - 1] < low[order]
    return out


def _windows_of(chunk, data, off, shared_bits, window, period, bits):
    h, first, doc, place, at, keys = _prepared(data, off, window, period)
    k, _, inverse, lo, hi = _distinct(keys, doc[at])
    shared = ((lo < hi) | from_answers(shared_bits, k, bits, None, True))[inverse]
    return first, doc, *_candidates(h, first, doc, place, at, shared, window, period)


def _window_emitter(window, period, bits):
    def run(batches):
        for chunk, ids, _, data, off, (shared,) in each_chunk(batches):
            _, doc, places, keys, more = _windows_of(chunk, data, off, shared, window, period, bits)
            k, more, _, lo, _ = _distinct(keys, ids[doc[places]], more)
            held = np.empty(len(k), HELD)
            held["more"], held["low"] = more, lo
            yield to_blobs(chunk, k, held, bits, False)

    return run


def _finisher(window, period, bits, with_text):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text

    def run(batches):
        for chunk, ids, null, data, off, (shared, smaller) in each_chunk(batches):
            first, doc, places, keys, more = _windows_of(chunk, data, off, shared, window, period, bits)
            own = ids[doc[places]]
            k, _, inverse, lo, _ = _distinct(keys, own, more)
            gone = places[((lo[inverse] < own) | from_answers(smaller, k, bits, None, True)[inverse]) & ~null[doc[places]]]
            edge = np.zeros(first[-1] + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + window, -1)
            keep = np.cumsum(edge)[:-1] <= 0
            sums = np.concatenate([[0], np.cumsum(~keep)])
            removed, sha, texts = sums[first[1:]] - sums[first[:-1]], [], []
            raw = data.tobytes()
            for i in range(len(ids)):
                w = raw[off[i] : off[i + 1]].split()
                if removed[i]:
                    w = compress(w, keep[first[i] : first[i + 1]].tolist())
                t = b" ".join(w)
                sha.append(hashlib.sha256(t).hexdigest())
                if with_text:
                    texts.append(t.decode())
            cols = [pa.array(ids, mask=null), pa.array(np.diff(first)), pa.array(removed), pa.array(sha)] + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, period: int = 7, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, the kept ``text``, for every row.

    A word goes when a window of ``window`` words that covers it also starts in a document with
    a smaller id. Windows are judged on the input. Rows with equal ids never remove each
    other's words; a row without an id loses none and removes none. A null text has no words.
    """
    spark = docs.sparkSession
    bits = bucket_bits(spark)
    table = write_chunks(docs, id_col, text_col)
    shared = answered(table.mapInArrow(_anchor_emitter(window, period, bits), BLOB), np.uint32, np.uint8, _twice, "shared")
    one = table.join(shared, "chunk", "left")
    smaller = answered(one.mapInArrow(_window_emitter(window, period, bits), BLOB), np.uint64, HELD, _smaller, "smaller")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return one.join(smaller, "chunk", "left").mapInArrow(_finisher(window, period, bits, with_text), out)


def op8(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP8_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws)-11)) i from w where len(ws)>=13),
s as (select doc_id, i, md5(array_to_string(ws[i:i+12],' ')) h from p),
f as (select h, min(doc_id) lo from s group by 1),
g as (select distinct doc_id, i+k pos from s join f using(h), (select unnest(range(13)) k) where lo<doc_id),
r as (select doc_id, list(pos) gone, count(*) n from g group by 1)
select w.doc_id, len(ws)::bigint n_words, coalesce(n,0)::bigint n_removed,
  sha256(array_to_string(case when n is null then ws else list_filter(ws, lambda x, i: not list_contains(gone, i)) end, ' ')) kept_sha256
from w left join r using(doc_id)
"""
