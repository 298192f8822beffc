"""Quality scores by logistic regression on hashed word n-grams, trained with FTRL-proximal.

Features of a text, each hashed to a slot of one table and weighted by its share of its family:
words, word pairs, and pairs and triples of word shapes (case, kind of first and last
character, length, same as the word before), and one slot for the size of the text. A score is the sparse
dot product of these with the weights, through the logistic function.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.llm import kernel as K
from graphloom.sources.scratch import drop_columns_clash

U = K.U
#: Kinds of bytes for shapes.
KIND = np.full(256, 4, np.uint8)
KIND[128:] = 3
KIND[48:58] = 2
KIND[65:91] = 1
KIND[97:123] = 0
FAMILIES = 4


def features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """(slots, first feature of each text) for each family, and the slot of each text's size."""
    starts, ends, first = K.words(data, offsets)
    h = K.word_hashes(K.LOWER[data], starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    shape = np.zeros(len(h), U)
    if len(h):
        upper = np.concatenate([[0], np.cumsum(KIND[data] == 1)])
        caps = upper[ends] - upper[starts]
        size = ends - starts
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        last = data[ends - 1]
        code = np.where(KIND[last] == 4, last, KIND[last])
        case = np.where(caps == 0, 0, np.where(caps * 2 > size, 2, 1))
        shape = K.mix(((KIND[data[starts]].astype(U) * U(256) + code.astype(U)) * U(4) + case.astype(U)) * U(32) + np.minimum(np.log2(size).astype(np.int64), 6).astype(U) * U(2) + same.astype(U) + U(99))
    out = []
    for seed, hashes, k in ((1, h, 1), (2, h, 2), (3, shape, 1), (4, shape, 3)):
        g = K.windows(hashes, k)
        keep = np.arange(len(g)) + k <= first[1:][doc[: len(g)]]
        g = K.mix(g[keep] + U(seed * 7919)) >> U(64 - bits)
        out.append((g.astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])))
    size = K.mix(np.minimum(np.log2(n + 1) * 2, 40).astype(U) + U(424242)) >> U(64 - bits)
    return out, size.astype(np.int64)


def scores(data, offsets, w: np.ndarray, bias: float, bits: int) -> np.ndarray:
    fams, size = features(data, offsets, bits)
    z = bias + w[size]
    for slots, first in fams:
        sums = np.concatenate([[0.0], np.cumsum(w[slots])])
        z = z + (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _featurizer(bits):
    def run(batches):
        for batch in batches:
            data, off = K.packed(batch.column(1))
            for i, j in K.slices(off):
                fams, size = features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                slots, values, counts = [], [], []
                for d in range(j - i):
                    s = np.concatenate([[size[d]], *(f[first[d] : first[d + 1]] for f, first in fams)])
                    v = np.concatenate([[1.0], *(np.full(first[d + 1] - first[d], 1 / max(1, first[d + 1] - first[d])) for f, first in fams)])
                    u, inv = np.unique(s, return_inverse=True)
                    slots.append(u.astype(np.int32))
                    values.append(np.bincount(inv, v).astype(np.float32))
                    counts.append(len(u))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), K.scattered(np.concatenate(slots), np.array(counts)), K.scattered(np.concatenate(values), np.array(counts))], names=["key", "label", "slots", "values"])

    return run


def ftrl(rows, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int):
    """Weights and bias from (slots, values, label), one row at a time in the order given."""
    z, n, w = (np.zeros(1 << bits) for _ in range(3))
    zb = nb = b = 0.0
    for _ in range(epochs):
        for s, x, y in rows:
            zi, ni = z[s], n[s]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, b + float(wi @ x)))))
            g = (p - y) * x
            z[s] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[s] = ni + g * g
            gb = p - y
            zb += gb - (math.sqrt(nb + gb * gb) - math.sqrt(nb)) / alpha * b
            nb += gb * gb
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
    live = np.abs(z) > l1
    w[live] = -(z[live] - np.sign(z[live]) * l1) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return w, b


def _trainer(bits, alpha, beta, l1, l2, epochs):
    def run(table: pa.Table) -> pa.Table:
        # rows by key, without moving them; a key has one row
        y, order = table["label"].to_numpy(), np.argsort(table["key"].to_numpy(), kind="stable")
        parts = [(s.values.to_numpy(), v.values.to_numpy(), s.offsets.to_numpy()) for s, v in zip(table["slots"].chunks, table["values"].chunks)]
        at = [(k, i) for k, (_, _, o) in enumerate(parts) for i in range(len(o) - 1)]

        class Rows:
            def __iter__(self):
                for r in order:
                    k, i = at[r]
                    s, v, o = parts[k]
                    yield s[o[i] : o[i + 1]], v[o[i] : o[i + 1]].astype(np.float64), y[r]

        w, b = ftrl(Rows(), bits, alpha, beta, l1, l2, epochs)
        at = np.flatnonzero(w)
        return pa.table({"slot": pa.array(np.append(at, -1).astype(np.int64)), "w": pa.array(np.append(w[at], b))})

    return run


def remainder(col, mod: int):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, bits: int = 18, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.0, epochs: int = 4, fold: int = 4, out_fold: int = 2):
    """(weights, bias) from at most ``sample`` labelled documents, those of the smallest hash of their id.

    Of the rows of one id the smallest text is used. Rows of the held-out fold, and rows without id
    or label, are never used. Without any
    usable row the weights are zero and the bias 0.
    """
    docs = drop_columns_clash(docs, {"doc_id": "long", "text": "string"})
    labels = drop_columns_clash(labels, {"doc_id": "long", "quality": "int"})
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder("doc_id", fold) != out_fold))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("label")).withColumn("key", F.xxhash64("doc_id"))
    chosen = usable.orderBy("key", "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("key", "doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("key", "text", "label")
    made = rows.mapInArrow(_featurizer(bits), "key long, label int, slots array<int>, values array<float>")
    # one bounded task: the sample, never the corpus
    got = made.groupBy(F.lit(0).alias("one")).applyInArrow(_trainer(bits, alpha, beta, l1, l2, epochs), "slot long, w double")
    w, bias = np.zeros(1 << bits), 0.0
    for slot, x in got.collect():
        if slot < 0:
            bias = x
        else:
            w[slot] = x
    return w, bias


def _scorer(model, bits, cut, text_at, names):
    def run(batches):
        w, bias = model.value
        for batch in batches:
            data, off = K.packed(batch.column(text_at))
            for i, j in K.slices(off):
                s = scores(data[off[i] : off[j]], off[i : j + 1] - off[i], w, bias, bits)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(s), pa.array((s >= cut).astype(np.int32))], names=names)

    return run


def _scored(docs: DataFrame, text: str, model, cut: float, bits: int) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_scorer(model, bits, cut, docs.columns.index(text), schema.names), schema)


def accepted(docs: DataFrame, labels: DataFrame, cut: float = 0.7, bits: int = 18, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bits=bits, **how))
    names = docs.columns
    flat = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    return _scored(flat, f"_d{names.index(text_col)}", model, cut, bits).where("predicted = 1").select(*flat.columns).toDF(*names)


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.7, bits: int = 18, fold: int = 4, out_fold: int = 2, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; a null text scores as an empty one.

    The score is a function of the text alone. A null id is in no fold: held_out is false.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bits=bits, fold=fold, out_fold=out_fold, **how))
    docs = drop_columns_clash(docs, {"doc_id": "long", "text": "string"})
    rows = docs.select("doc_id", "text", F.coalesce(remainder("doc_id", fold) == out_fold, F.lit(False)).alias("held_out"))
    return _scored(rows, "text", model, cut, bits).select("doc_id", "held_out", "score", "predicted")


def op4(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
