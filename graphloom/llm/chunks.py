"""Exchange of packed array data between chunks of texts and buckets of hashes.

Counting every word or window of a corpus as rows costs tens of bytes a row. Here texts are
first written once as chunks of 384 kB (a longer text is one chunk). A pass turns a chunk into sorted distinct 64-bit
keys with small payloads and sends each bucket of keys as one binary row; bucket tasks sort
and reduce all of it in arrays and send back one answer array per chunk and bucket. A key
that a third of all documents hold is sent once per chunk. Chunks are written in buckets of
their id, so joining the answers back does not move the texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm import kernel as K
from graphloom.sources.scratch import drop_columns_clash, materialize, materialize_bucketed

CHUNK = "chunk long, ids array<long>, lens array<int>, text binary"
NONE = np.iinfo(np.int64).max


def _chunker(most: int):
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 24
        ids, lens, parts, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sum(ids, [])], pa.list_(pa.int64())), pa.array([np.concatenate(lens).astype(np.int32)], pa.list_(pa.int32())), pa.array([b"".join(parts)], pa.binary())], names=["chunk", "ids", "lens", "text"])

        for batch in batches:
            data, off = K.packed(batch.column(1))
            for i, j in K.slices(off, most):
                ids.append(batch.column(0).slice(i, j - i).to_pylist())
                lens.append(np.diff(off[i : j + 1]))
                parts.append(data[off[i] : off[j]].tobytes())
                held += len(parts[-1])
                if held >= most:
                    yield row()
                    ids, lens, parts, held, n = [], [], [], 0, n + 1
        if ids:
            yield row()

    return run


def write_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3 << 17) -> DataFrame:
    """All rows of ``docs`` as chunks of about ``most`` bytes; a longer text is a chunk of its own."""
    docs = drop_columns_clash(docs, {id_col: "long", text_col: "string"})
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize_bucketed(docs.mapInArrow(_chunker(most), CHUNK), "chunks", "chunk", n)


def each_chunk(batches: Iterator[pa.RecordBatch]):
    """(chunk, ids with nulls as the largest long, which ids are null, bytes, offsets, answers by bucket of each further column)."""
    for batch in batches:
        for r in range(batch.num_rows):
            cols = [batch.column(c) for c in range(batch.num_columns)]
            raw = cols[1].slice(r, 1).flatten()
            ids = raw.fill_null(NONE).to_numpy(zero_copy_only=False)
            lens = cols[2].slice(r, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.frombuffer(memoryview(cols[3][r].as_buffer()), np.uint8)
            more = []
            for c in cols[4:]:
                got = c[r].as_py() or []
                more.append({x["bucket"]: x["answer"] for x in got})
            yield cols[0][r].as_py(), ids, raw.is_null().to_numpy(zero_copy_only=False), data, np.concatenate([[0], np.cumsum(lens)]), more


BLOB = "bucket int, chunk long, keys binary, load binary"


def to_blobs(chunk: int, keys: np.ndarray, load: np.ndarray | None, bits: int, narrow: bool):
    """Rows of the exchange for sorted distinct keys; narrow keeps 32 bits besides the bucket's."""
    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
    cuts = np.append(cuts, len(keys))
    full = np.flatnonzero(np.diff(cuts))
    send = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32) if narrow else keys
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk), pa.int64()), pa.array([send[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()), pa.array([load[cuts[b] : cuts[b + 1]].tobytes() if load is not None else b"" for b in full], pa.binary())],
        names=["bucket", "chunk", "keys", "load"],
    )


def from_answers(answers: dict[int, bytes], keys: np.ndarray, bits: int, dtype, packed_bits: bool = False) -> np.ndarray:
    """The answers for sorted distinct keys, in their order."""
    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
    cuts = np.append(cuts, len(keys))
    out = np.zeros(len(keys), bool if packed_bits else dtype)
    for b in np.flatnonzero(np.diff(cuts)):
        n = cuts[b + 1] - cuts[b]
        got = np.frombuffer(answers[int(b)], np.uint8 if packed_bits else dtype)
        out[cuts[b] : cuts[b + 1]] = np.unpackbits(got, count=n).astype(bool) if packed_bits else got
    return out


def bucket_bits(spark) -> int:
    """Bits of the bucket number: two buckets or more for each shuffle partition."""
    return max(4, int(np.ceil(np.log2(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def _answerer(key_type, load_type, reduce: Callable):
    def run(table: pa.Table) -> pa.Table:
        keys, load = ([np.frombuffer(x, t) for x in table[c].to_pylist()] for c, t in (("keys", key_type), ("load", load_type)))
        at = np.cumsum([0] + [len(k) for k in keys])
        out = reduce(np.concatenate(keys), np.concatenate(load))
        got = [(np.packbits(out[i:j]) if out.dtype == bool else out[i:j]).tobytes() for i, j in zip(at[:-1], at[1:])]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "answer": pa.array(got, pa.binary())})

    return run


def answered(blobs: DataFrame, key_type, load_type, reduce: Callable, name: str, bucketed: bool = False) -> DataFrame:
    """Exchange: all blobs of a bucket meet; ``reduce(keys, loads)`` gives one answer for each entry. ``bucketed`` as the chunks are, to join more than once."""
    n = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = blobs.groupBy("bucket").applyInArrow(_answerer(key_type, load_type, reduce), "chunk long, bucket int, answer binary")
    got = got.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
    return materialize_bucketed(got, name, "chunk", n) if bucketed else materialize(got, name)
