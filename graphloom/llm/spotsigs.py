"""SpotSigs fingerprints in DataFrame functions only.

A text is lower-cased and cut to words of letters and digits. Common words (anchors) and the
start of the text begin a spot: the anchors that stand together and the chain of the next
content words, anchors in between left out. The set of hashed spots is the fingerprint.
Fingerprints are compared by the Jaccard similarity of their sets; in a join, sets are
partitioned by length so that only partitions whose lengths can reach the threshold meet, and
pruned by the prefix that two similar sets must share.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.sources.scratch import drop_columns_clash, materialize

ANCHORS = (
    "a an and are as at be by for from has in is it of on or that the this to was with "
    "au ce dans de des du elle en est et il la le les pas pour qui que sur un une "
    "auf das dem den der des die ein eine ist mit nicht sich sie und von zu "
    "al con del el los las no para por se su y"
).split()
MARK = "\u0001"


def _let(value, use):
    """``use`` of a value that is computed once: inside array functions an expression used twice is computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spots(text, chain: int = 2):
    """The sorted distinct spot hashes (int) of a text column."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))

    def of(words):
        # an anchor clings to what follows it; two words of text are apart by one blank
        marked = F.transform(words, lambda w: F.concat(w, F.when(w.isin(*ANCHORS), F.lit(MARK)).otherwise(F.lit(" "))))
        heads = F.split(F.concat(F.lit("^" + MARK), F.array_join(marked, "")), " ")
        return _let(F.filter(words, lambda w: ~w.isin(*ANCHORS)), lambda content: joined(heads, content))

    def joined(pairs, content):
        for k in range(1, chain):
            pairs = F.zip_with(pairs, F.slice(content, k + 1, F.size(content)), lambda x, y: F.when(x.contains(MARK), F.concat(x, F.lit(" "), F.coalesce(y, F.lit("")))))
        # pairs past the end of the heads have no head
        return F.transform(F.filter(pairs, lambda x: F.coalesce(x.contains(MARK), F.lit(False))), lambda x: F.hash(x))

    return F.sort_array(F.array_distinct(_let(F.split(plain, " "), of)))


def jaccard(x, y):
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(both / (F.size(x) + F.size(y) - both), F.lit(1.0))


def _as_text(sig):
    return F.array_join(F.transform(sig, lambda h: F.lpad(F.lower(F.hex(F.shiftright(F.shiftleft(h.cast("long"), 32), 32).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next row in descending ``doc_id``, after the last the first.

    Rows are dealt to ranges of equal size, however the ids lie. Inside a range the next row comes
    from a window; only the range's last row looks outside, at one row a range. Nulls come last;
    rows with equal ids follow each other in the order of their texts, a null text first.
    """
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    # bounds of ranges are found from rows that the driver samples: the starts of texts order them as well
    starts = [order[0], F.substring("text", 1, 64).asc_nulls_first()]
    rows = materialize(docs.select("doc_id", "text").repartitionByRange(n, *starts).withColumn("p", F.spark_partition_id()), "ranges")
    first = rows.groupBy("p").agg(F.min_by("text", F.struct(F.col("doc_id").isNull().alias("a"), (-F.col("doc_id").cast("decimal(20,0)")).alias("b"), F.col("text").isNotNull().alias("c"), "text")).alias("t"))
    ring = Window.orderBy("p")  # a row a range
    after = materialize(first, "firsts")
    after = after.withColumn("t", F.struct("t")).select("p", F.coalesce(F.lead("t").over(ring), F.first("t").over(ring)).alias("t")).select(F.col("p").alias("_p"), F.lit(True).alias("_last"), F.col("t.t").alias("_first"))
    w = Window.partitionBy("p").orderBy(*order)
    inner = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())
    out = inner.join(after, (F.col("p") == F.col("_p")) & (F.col("is_last") == F.col("_last")), "left")
    return out.select("doc_id", "text", F.when(F.col("is_last"), F.col("_first")).otherwise(F.col("next_text")).alias("next_text"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = 2) -> DataFrame:
    """``doc_id, n_chars, sig`` for every row. A null text is empty; an empty text has the one spot of its start."""
    docs = drop_columns_clash(docs, {id_col: "long", text_col: "string"}).toDF("doc_id", "text")
    return docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), spots(F.col("text"), chain).alias("sig"))


def near_sets(sigs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``a, b, likeness`` for pairs of classes of equal sets, a < b, of Jaccard ``threshold`` or more.

    ``sigs`` has ``doc_id, sig``. A class is named by its smallest id. Sets meet when one of the
    first n - ceil(t n) + 1 of their sorted hashes is equal and their lengths allow it.
    """
    cls = sigs.groupBy("sig").agg(F.min("doc_id").alias("a"))
    cls = materialize(cls.withColumn("n", F.size("sig")).where("n > 0"), "spots")
    part = F.floor(F.log(F.col("n")) / math.log(1 / threshold)).cast("int")
    prefix = F.slice("sig", 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    own = cls.select("a", "n", part.alias("p"), F.explode(prefix).alias("h"))
    probe = own.unionByName(own.withColumn("p", F.col("p") + 1)).select(F.col("a").alias("x"), F.col("n").alias("nx"), "p", "h")
    met = own.join(probe, ["p", "h"]).where((F.col("x") != F.col("a")) & (F.least("n", "nx") >= threshold * F.greatest("n", "nx")))
    pairs = met.select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b")).distinct()
    full = pairs.join(cls.select("a", F.col("sig").alias("sa")), "a").join(cls.select(F.col("a").alias("b"), F.col("sig").alias("sb")), "b")
    return full.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = drop_columns_clash(spark.read.parquet(f"{sf_dir}/documents.parquet"), {"doc_id": "long", "text": "string"})
    rows = with_next(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))")).alias("edited"))
    sigs = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spots(F.col("text")).alias("sig"), spots(F.col("edited")).alias("edited_sig"), spots(F.col("next_text")).alias("next_sig"))
    return sigs.select("doc_id", "n_chars", "edited_sha256", _as_text(F.col("sig")).alias("fingerprint"), _as_text(F.col("edited_sig")).alias("edited_fingerprint"), jaccard(F.col("sig"), F.col("edited_sig")).alias("near_edited"), jaccard(F.col("sig"), F.col("next_sig")).alias("near_next"))
