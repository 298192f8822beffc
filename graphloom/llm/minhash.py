"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of word shingles (64-bit hashes) and a MinHash signature.
   Texts with equal sets are one class from here on, so copies cost one row each.
2. Band keys of the signatures give candidates: first each class of a bucket against the
   bucket's smallest class. Buckets that this leaves in several components form groups, in
   which the documents outside the largest component search the whole group, block against
   block inside a task: no pair becomes a row before it is verified.
3. Candidates compare their signatures batch by batch. After each batch the posterior
   probability (Jeffreys-free uniform prior) that the similarity reaches the threshold is
   compared with ``miss``; a pair below it is pruned. Survivors are verified on full sets.
4. Components of the verified links.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm import kernel as K
from graphloom.operators.components import connected_components
from graphloom.sources.scratch import by_position, drop_columns_clash, materialize

U = K.U


def shingle_sets(data, offsets, width: int):
    """For packed texts: distinct shingle hashes of each, concatenated and sorted, and how many each has."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets)
    h = K.word_hashes(data, starts, ends)
    whole = K.windows(h, width)
    sets, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(sizes)):
        a, b = first[i], first[i + 1]
        n = b - a
        if n >= width:
            s = np.unique(whole[a : b - width + 1])
        elif n:
            s = K.windows(h[a:b], n)
        else:
            continue
        sizes[i] = len(s)
        sets.append(s)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), sizes


def signatures(flat, sizes, n_hashes: int):
    """MinHash values as uint32, one row for each nonempty set."""
    full = np.flatnonzero(sizes)
    out = np.empty((len(full), n_hashes), np.uint32)
    if len(full):
        at = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
        a, b = K.stream(101, n_hashes) | U(1), K.stream(102, n_hashes)
        for lo in range(0, n_hashes):
            out[:, lo] = (np.minimum.reduceat(flat * a[lo] + b[lo], at) >> U(32)).astype(np.uint32)
    return full, out


SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, sig binary, bands array<long>"


def _sketcher(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            data, off = K.packed(batch.column(1))
            for i, j in K.slices(off):
                flat, sizes = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                full, sig = signatures(flat, sizes, bands * rows)
                n = j - i
                s = np.zeros((2, n), U)
                if len(full):
                    at = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
                    s[0, full] = np.add.reduceat(K.mix(flat + U(1)), at)
                    s[1, full] = np.add.reduceat(K.mix(flat ^ U(0x5555555555555555)), at)
                keys = np.zeros((len(full), bands), U)
                for r in range(rows):
                    keys = K.mix(keys + sig[:, r::rows][:, :bands].astype(U) + U(r + 1))
                raw, sigs, k = (sig & 0xFFFF).astype(np.uint16), [None] * n, np.zeros(n, np.int64)
                for t, d in enumerate(full):
                    sigs[d] = raw[t].tobytes()
                k[full] = bands
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(sizes), pa.array(s[0].view(np.int64)), pa.array(s[1].view(np.int64)), pa.array(sigs, pa.binary()), K.scattered(keys.view(np.int64).ravel(), k)],
                    names=["doc_id", "n_shingles", "s1", "s2", "sig", "bands"],
                )

    return run


def _beta_sf(m: int, n: int, t: float) -> float:
    """P(similarity >= t | m of n values agree) under a uniform prior: a binomial sum."""
    return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))


@lru_cache
def least_matches(n_hashes: int, batch: int, threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """For each number of values compared, the fewest agreements whose posterior still reaches ``miss``."""
    out = []
    for n in [*range(batch, n_hashes, batch), n_hashes]:
        out.append((n, next((m for m in range(n + 1) if _beta_sf(m, n, threshold) >= miss), n)))
    return tuple(out)


def _pruner(rows: tuple[tuple[int, int], ...]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(K.packed(batch.column(c))[0].tobytes(), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
            alive, hits, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, least in rows:
                hits[alive] += (x[alive, at:n] == y[alive, at:n]).sum(1)
                alive, at = alive[hits[alive] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["a", "b"])

    return run


def _verifier(width: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            (d1, o1), (d2, o2) = K.packed(batch.column(2)), K.packed(batch.column(3))
            for i in range(batch.num_rows):
                x, y = (shingle_sets(d[o[i] : o[i + 1]], np.array([0, o[i + 1] - o[i]]), width)[0] for d, o in ((d1, o1), (d2, o2)))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and den * both >= num * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def _blocks_compared(member_of, sigs, docs, rule, width, num, den, block):
    """Links between documents of different components of a group.

    The group's largest component is searched by all others: blocks of the documents outside
    it against blocks of all, never more than two blocks in a task.
    """
    sizes = member_of.groupBy("group", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("group").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all_n"), F.max("n").alias("main_n"))
    rows = member_of.join(sizes, "group").withColumn("na", F.ceil((F.col("all_n") - F.col("main_n")) / block).cast("int")).withColumn("nb", F.ceil(F.col("all_n") / block).cast("int")).where("na > 0")
    rows = rows.join(sigs, "doc_id").join(docs, "doc_id")
    at = F.xxhash64("doc_id")
    right = rows.withColumn("bb", F.pmod(at, F.col("nb"))).withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("left", F.lit(False))
    left = rows.where("comp <> main").withColumn("ba", F.pmod(at, F.col("na"))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("left", F.lit(True))
    cols = ["group", F.col("ba").cast("long").alias("ba"), F.col("bb").cast("long").alias("bb"), "left", "doc_id", "comp", "sig", "text"]
    return left.select(*cols).unionByName(right.select(*cols)).groupBy("group", "ba", "bb").applyInArrow(_block_comparer(rule, width, num, den), "a long, b long")


def _block_comparer(rule, width, num, den):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["left"].to_numpy()
        sig = np.frombuffer(K.packed(table["sig"])[0].tobytes(), np.uint16).reshape(len(table), -1)
        ids, comp = table["doc_id"].to_numpy(), table["comp"].to_numpy()
        data, off = K.packed(table["text"])
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}

        def set_of(i):
            if i not in sets:
                sets[i] = shingle_sets(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), width)[0]
            return sets[i]

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        found = []
        for i in a:
            alive, hits, at = b[(comp[b] != comp[i])], None, 0
            hits = np.zeros(len(alive), np.int64)
            for n, least in rule:
                hits += (sig[alive, at:n] == sig[i, at:n]).sum(1)
                ok = hits >= least
                alive, hits, at = alive[ok], hits[ok], n
            for j in alive[np.argsort(-hits, kind="stable")]:
                ri, rj = root(comp[i]), root(comp[j])
                if ri == rj:
                    continue
                x, y = set_of(i), set_of(j)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and den * both >= num * (len(x) + len(y) - both):
                    found.append((ids[i], ids[j]))
                    parent[rj] = ri
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 85, den: int = 100, bands: int = 31, rows: int = 6, batch: int = 16, miss: float = 1e-6, block: int = 512) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Two texts are linked when den * |common shingles| >= num * |all shingles|. Words are runs
    of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z. A text with fewer words than
    ``width`` has its whole word sequence as the one shingle; one without words, or null, has
    none and is linked with nothing. Rows that share an id count as one document with several
    texts. A row without an id has no component and is not kept. A pair at the threshold is
    missed by the bands with probability (1 - t^rows)^bands (4e-7 at the defaults) and by the
    pruning with less than ``miss``.
    """
    docs = drop_columns_clash(docs, {id_col: "long", text_col: "string"}).toDF("doc_id", "text")
    made = materialize(docs.mapInArrow(_sketcher(width, bands, rows), SKETCH), "minhash")
    named = made.where("doc_id is not null and n_shingles > 0")
    keys = ["s1", "s2", "n_shingles"]
    groups = named.groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    member = materialize(named.select("doc_id", *keys).join(groups, keys).select("doc_id", "rep").distinct(), "members")
    reps = materialize(named.join(groups.select(*keys, F.col("rep").alias("doc_id")), [*keys, "doc_id"]).select("doc_id", "sig", "bands", "s1").dropDuplicates(["doc_id", "s1"]), "reps")
    buckets = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    hubs = buckets.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub <> top")
    shared = materialize(buckets.join(hubs.select("band", "key", "hub"), ["band", "key"]), "buckets")
    sigs = reps.select("doc_id", "sig")
    rule = least_matches(bands * rows, batch, num / den, miss)
    docs = materialize(docs.join(shared.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sigs.toDF("a", "x"), "a").join(sigs.toDF("b", "y"), "b").select("a", "b", "x", "y")
        left = materialize(pairs.mapInArrow(_pruner(rule), "a long, b long").distinct(), "candidates")
        full = left.join(docs.toDF("a", "x"), "a").join(docs.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return materialize(full.mapInArrow(_verifier(width, num, den), "a long, b long").distinct(), "links")

    links = verified(shared.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct())
    comp = materialize(connected_components(links, "a", "b"), "components").toDF("doc_id", "comp")
    # what the buckets still hold apart: documents not connected to their hub, and all they could be linked with
    open_ = shared.join(comp, "doc_id", "left").select("band", "key", "hub", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    many = open_.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("band", "key")
    open_ = materialize(open_.join(many, ["band", "key"], "left_semi").select("hub", "doc_id", "comp").distinct(), "open")
    group = connected_components(open_, "hub", "doc_id").toDF("doc_id", "group")
    member_of = materialize(open_.select("doc_id", "comp").distinct().join(group, "doc_id"), "groups")
    links2 = materialize(_blocks_compared(member_of, sigs, docs, rule, width, num, den, block), "links")
    final = connected_components(comp.toDF("a", "b").unionByName(links2), "a", "b").toDF("rep", "component_id")
    of = member.join(final, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    return (
        made.select("doc_id", "n_shingles").join(of, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose id stands for its component, with all columns; rows without id stay. Columns are told by place, so others may have any name."""
    flat, at = by_position(docs)
    id_ = F.col(at["doc_id"]).cast("long")
    kept = near_duplicates(flat.select(id_.alias("doc_id"), F.col(at["text"]).alias("text")), **how).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return flat.join(kept, id_ == F.col("_id"), "left_semi").unionByName(flat.where(id_.isNull())).toDF(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(ws)=0 then [] when len(ws)<5 then [array_to_string(ws,' ')]
    else list_transform(range(1,len(ws)-3), lambda i: array_to_string(ws[i:i+4],' ')) end)) sh from w),
h as (select doc_id, sh from s),
n as (select doc_id, count(*) n from h group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from h a join h b on a.sh=b.sh and a.doc_id<b.doc_id group by 1,2),
l as (select a,b from p join n x on x.doc_id=a join n y on y.doc_id=b where 100*c >= 85*(x.n+y.n-c)),
e as (select a u,b v from l union all select b,a from l),
cc(v,comp) using key (v) as (
  select doc_id, doc_id from documents
  union
  select e.v, min(cc.comp) from cc join e on e.u=cc.v join recurring.cc r on r.v=e.v where cc.comp<r.comp group by e.v)
select d.doc_id, coalesce(n.n,0)::bigint n_shingles, cc.comp component_id, d.doc_id=cc.comp kept
from documents d left join n using(doc_id) join cc on cc.v=d.doc_id
"""
