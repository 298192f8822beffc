"""Mixing sources to target weights by Poisson replication.

A source with n documents and a share w of a mixture of T documents has the repetition rate
w * T / n. Each document draws its number of copies from a Poisson distribution of that mean,
by inverting the distribution at a number hashed from the seed and the document's id: the
draw needs no state, no shuffle and comes out the same in a retried task. A mean over
``CHUNK`` is the sum of equal smaller means, each with its own draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.sources.scratch import by_position, materialize

CHUNK = 32.0
TERMS = 128
#: Rates of so many sources at most are broadcast: 1 KB each.
FEW = 10_000


def _uniform(*parts):
    """A number in [0, 1) with 52 bits from the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source_col: str = "source") -> DataFrame:
    """``source, n, rate, draws, cdf`` for every source with documents, a null source too.

    Without ``weights`` all sources weigh the same; a source they do not name weighs 0. Weights
    are scaled to sum to 1 over the sources present. ``total`` is the size of the mixture in
    documents, that of ``docs`` if not given.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.lit(1.0))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        n = n.withColumn("w", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0))
    sums = n.agg(F.sum("w").alias("ws"), F.sum("n").alias("ns"))
    size = F.col("ns").cast("double") if total is None else F.lit(float(total))
    r = n.crossJoin(F.broadcast(sums))  # one row of totals
    r = r.withColumn("rate", F.when(F.col("ws") > 0, size * F.col("w") / F.col("ws") / F.col("n")).otherwise(0.0))
    r = r.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK).cast("int"))).withColumn("m", F.col("rate") / F.col("draws"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-F.col("m")).alias("p"), F.array(F.exp(-F.col("m"))).alias("c")),
        lambda a, k: F.struct((a["p"] * F.col("m") / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * F.col("m") / k)).alias("c")),
        lambda a: a["c"],
    )
    return r.select("source", "n", "rate", "draws", cdf.alias("cdf"))


def _mixed(docs: DataFrame, weights, total, seed, id_col, source_col) -> DataFrame:
    """Columns of ``docs`` by place (``_d0, _d1, ...``) with ``_copy, _copies, _key``, dealt and sorted by the key."""
    spark = docs.sparkSession
    flat, at = by_position(docs)
    rates = materialize(repetition_rates(flat, weights, total, at[source_col]), "rates")
    if rates.count() <= FEW:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col(at[id_col]).cast("string"), F.lit(""))
    rows = flat.join(rates.select(F.col("source").alias("_source"), F.col("draws").alias("_draws"), F.col("cdf").alias("_cdf")), F.col(at[source_col]).eqNullSafe(F.col("_source")))
    drawn = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.col("_draws") - 1), lambda i: _uniform(F.lit(str(seed)), key, i.cast("string"))),
        F.lit(0),
        lambda n, u: n + F.size(F.filter(F.col("_cdf"), lambda c: c <= u)),
    )
    rows = rows.withColumn("_copies", drawn).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}o"), key, F.col("_copy").cast("string"))), 1, 15), 16, 10).cast("long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.select(*flat.columns, "_copy", "_copies", order.alias("_key"))
    return out.repartition(n, "_key").sortWithinPartitions("_key")


def mix_rows(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 20, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Each row of ``docs`` as often as it is drawn, with its own columns only, whatever their names."""
    out = _mixed(docs, weights, total, seed, id_col, source_col)
    return out.drop("_copy", "_copies", "_key").toDF(*docs.columns)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 20, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Each row of ``docs`` as often as it is drawn, with ``copy`` (1..copies), ``copies`` and ``order_key``, in a global random order.

    Rows with equal ids draw equal counts; a null id draws as the empty one, a null source is a
    source. A row drawn 0 times goes; an empty table gives an empty one. The order: rows are dealt
    to partitions by the hash of ``order_key`` and sorted by it in each, so any prefix of the files
    is a random sample of the mixture. Columns of ``docs`` with the names of the three new ones are
    left out; of columns of one name the first stays.
    """
    out = _mixed(docs, weights, total, seed, id_col, source_col)
    at = by_position(docs)[1]
    return out.select(*[F.col(d).alias(c) for c, d in at.items() if c.lower() not in ("copy", "copies", "order_key")], F.col("_copy").alias("copy"), F.col("_copies").alias("copies"), F.col("_key").alias("order_key"))


def op3(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
with recursive n as (select source, count(*) n from documents group by 1),
t as (select sum(n)::double ns, count(*)::double ws from n),
r as (select source, ns*1.0::double/ws/n rate from n, t),
m as (select source, rate, greatest(1, ceil(rate/32.0::double)::int) draws, rate/greatest(1, ceil(rate/32.0::double)::int) m from r),
c(source, k, p, c) as (
  select source, 0, exp(-m), exp(-m) from m
  union all
  select c.source, c.k+1, c.p*m.m/(c.k+1), c.c+c.p*m.m/(c.k+1) from c join m on m.source is not distinct from c.source where c.k<128),
cdf as (select source, list(c order by k) cdf from c group by 1),
d as (
  select d.*, list_sum(list_transform(range(draws), lambda i: len(list_filter(cdf, lambda x:
    x <= ('0x'||substr(md5('20:'||coalesce(doc_id::varchar,'')||':'||i::varchar),1,13))::bigint / 4503599627370496.0::double))))::int copies
  from documents d join m on m.source is not distinct from d.source join cdf on cdf.source is not distinct from d.source),
e as (select *, unnest(range(1, copies+1))::int copy from d where copies>0)
select doc_id, text, lang, source, n_chars, copy, copies,
  ('0x'||substr(md5('20o:'||coalesce(doc_id::varchar,'')||':'||copy::varchar),1,15))::bigint order_key from e
"""
