"""An ordered map ``key, value`` with range aggregates. Aggregates run in key order. A null value is a value: what counts is whether the key is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.operators.graph import running_sums, with_sequence
from graphloom.sources.scratch import discard, materialize


def bounds(key: Column, lo: Column, lo_kind: Column, hi: Column, hi_kind: Column) -> Column:
    """Whether a key is in a range of included, excluded or unbounded ends; a reversed range holds nothing."""
    low = F.when(lo_kind == "unbounded", F.lit(True)).when(lo_kind == "included", key >= lo).otherwise(key > lo)
    high = F.when(hi_kind == "unbounded", F.lit(True)).when(hi_kind == "included", key <= hi).otherwise(key < hi)
    return low & high


def replay(log: DataFrame) -> DataFrame:
    """``key, value`` after a log ``seq, op, key, value`` of insert and remove: the last one of each key counts."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("l"))
    return last.where("l.op = 'insert'").select("key", F.col("l.value").alias("value"))


def previous(log: DataFrame) -> DataFrame:
    """``seq, was_there, old``: what each operation of a log found at its key (what insert and remove return)."""
    w = Window.partitionBy("key").orderBy("seq")
    before = F.lag(F.struct("op", "value")).over(w)
    return log.withColumn("b", before).select("seq", F.coalesce(F.col("b.op") == "insert", F.lit(False)).alias("was_there"), F.when(F.col("b.op") == "insert", F.col("b.value")).alias("old"))


def _joined(kv: DataFrame, new: DataFrame, how: str) -> DataFrame:
    return kv.select("key", F.col("value").alias("old"), F.lit(True).alias("is_old")).join(new.select("key", F.col("value").alias("new"), F.lit(True).alias("is_new")), "key", how)


def upsert(kv: DataFrame, new: DataFrame, merge=None) -> DataFrame:
    """Entries of both; at shared keys the new value, or ``merge(old, new)``."""
    both = F.col("new") if merge is None else merge(F.col("old"), F.col("new"))
    return _joined(kv, new, "full_outer").select("key", F.when(F.col("is_old").isNull(), F.col("new")).when(F.col("is_new").isNull(), F.col("old")).otherwise(both).alias("value"))


# what may be done at the entry of a key; ``keys`` names the entries asked for, each once
def or_insert(kv: DataFrame, keys: DataFrame, value: Column) -> DataFrame:
    """Adds missing keys with the given value, which may use ``key``; present ones stay."""
    return upsert(kv, keys.select("key").distinct().withColumn("value", value), lambda old, new: old)


def or_default(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds missing keys with the zero of the value's type; present ones stay."""
    kind = kv.schema["value"].dataType
    zero = F.lit("") if kind.typeName() == "string" else F.lit(0).cast(kind)
    return or_insert(kv, keys, zero)


def and_modify(kv: DataFrame, keys: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Changes the values of keys that are there; others are not added."""
    return update_or_insert_with(kv, keys, change, None)


def update_or_insert_with(kv: DataFrame, keys: DataFrame, change: Callable[[Column], Column], value: Column | None) -> DataFrame:
    """Changes the values of keys that are there and, with ``value``, adds those that are not."""
    asked = keys.select("key").distinct().withColumn("value", F.lit(None).cast(kv.schema["value"].dataType) if value is None else value)
    j = _joined(kv, asked, "left" if value is None else "full_outer")
    return j.select("key", F.when(F.col("is_old").isNull(), F.col("new")).when(F.col("is_new").isNull(), F.col("old")).otherwise(change(F.col("old"))).alias("value"))


def update(kv: DataFrame, where: Column, value: Column) -> DataFrame:
    return kv.withColumn("value", F.when(where, value).otherwise(F.col("value")))


def remove(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key"), "key", "left_anti")


def get(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, is_there, value`` of the keys asked for."""
    return keys.select("key").join(kv.select("key", "value", F.lit(True).alias("h")), "key", "left").select("key", F.coalesce("h", F.lit(False)).alias("is_there"), "value")


def first(kv: DataFrame) -> DataFrame:
    return kv.groupBy().agg(F.min(F.struct("key", "value")).alias("m")).where("m is not null").select("m.*")


def last(kv: DataFrame) -> DataFrame:
    return kv.groupBy().agg(F.max(F.struct("key", "value")).alias("m")).where("m is not null").select("m.*")


def pop_first(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first entry, and the map without it."""
    top = first(kv)
    return top, remove(kv, top)


def pop_last(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    top = last(kv)
    return top, remove(kv, top)


def totals(kv: DataFrame, **aggregates: Column) -> DataFrame:
    """One row: ``len, is_empty`` and the given aggregates of all entries."""
    return kv.agg(F.count("*").alias("len"), (F.count("*") == 0).alias("is_empty"), *[c.alias(n) for n, c in aggregates.items()])


def clear(kv: DataFrame) -> DataFrame:
    return kv.limit(0)


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two maps hold the same entries: one join by key, none of them leaves the executors."""
    j = _joined(a, b, "full_outer")
    return j.where("is_old is null or is_new is null or not (old <=> new)").isEmpty()


def scan(kv: DataFrame, lo=None, lo_kind="unbounded", hi=None, hi_kind="unbounded", descending: bool = False) -> DataFrame:
    """Entries of a range in key order; the filter reaches the file scan."""
    rows = kv
    if lo_kind != "unbounded":
        rows = rows.where(F.col("key") >= lo if lo_kind == "included" else F.col("key") > lo)
    if hi_kind != "unbounded":
        rows = rows.where(F.col("key") <= hi if hi_kind == "included" else F.col("key") < hi)
    return rows.orderBy(F.col("key").desc() if descending else F.col("key"))


def keys(kv: DataFrame, descending: bool = False) -> DataFrame:
    return scan(kv, descending=descending).select("key")


def values(kv: DataFrame, descending: bool = False) -> DataFrame:
    """Values in key order."""
    return scan(kv, descending=descending).select("value")


def _holds_nothing() -> Column:
    """Whether a range is reversed, or has equal ends of which one is excluded."""
    both = (F.col("lo_kind") != "unbounded") & (F.col("hi_kind") != "unbounded")
    return both & ((F.col("lo") > F.col("hi")) | ((F.col("lo") == F.col("hi")) & ((F.col("lo_kind") == "excluded") | (F.col("hi_kind") == "excluded"))))


def _ends(ranges: DataFrame, rows: DataFrame, step: dict[str, str]) -> DataFrame:
    """``rid, side`` and the running sums of ``rows`` (``x, rank`` 1 and values) before each bounded end; keys of any type that sorts.

    Ends and entries are sorted together, an end before or after the entries of its key.
    """
    lo = F.struct(F.col("lo").alias("x"), F.when(F.col("lo_kind") == "included", 0).otherwise(2).alias("rank"), F.lit("lo").alias("side"), F.col("lo_kind").alias("kind"))
    hi = F.struct(F.col("hi").alias("x"), F.when(F.col("hi_kind") == "included", 2).otherwise(0).alias("rank"), F.lit("hi").alias("side"), F.col("hi_kind").alias("kind"))
    ends = ranges.select("rid", F.explode(F.array(lo, hi)).alias("e")).select("rid", "e.*").where("kind <> 'unbounded'").drop("kind")
    both = rows.select("x", "rank", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("string").alias("side"), *step)
    both = both.unionByName(ends.select("x", "rank", "rid", "side", *[F.lit(0).cast("long").alias(c) for c in step]))
    return running_sums(both, ["x", "rank", "rid", "side"], step).where("rid is not null").select("rid", "side", *[f"run_{c}" for c in step])


def range_sums(kv: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rid, total, n`` for ranges ``rid, lo, lo_kind, hi, hi_kind`` (``rid`` unique); 0 for an empty range.

    The difference of two running sums over entries and ends in one order: the cost is that of
    sorting entries and ranges, however wide these are.
    """
    rows = kv.select(F.col("key").alias("x"), F.lit(1).alias("rank"), F.coalesce("value", F.lit(0)).cast("long").alias("s"), F.lit(1).cast("long").alias("c"))
    at = _ends(ranges, rows, {"s": "sum", "c": "sum"}).groupBy("rid").agg(*[F.max(F.when(F.col("side") == e, F.col(f"run_{c}"))).alias(f"{e}_{c}") for e in ("lo", "hi") for c in "sc"])
    whole = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.count("*").alias("all_c"))
    j = ranges.join(at, "rid", "left").crossJoin(F.broadcast(whole))  # one row of totals
    val = lambda c: F.when(_holds_nothing(), 0).otherwise(F.coalesce(f"hi_{c}", f"all_{c}") - F.coalesce(f"lo_{c}", F.lit(0))).cast("long")
    return j.select("rid", val("s").alias("total"), val("c").alias("n"))


def range_fold(kv: DataFrame, ranges: DataFrame, lift: Column, merge: Callable[[str], Column], identity: Column | None = None) -> DataFrame:
    """``rid, value``: a fold of any monoid that an aggregate function gives, over each range; ``identity`` for an empty range.

    Entries are numbered in key order; blocks of 2^l of them are folded level by level from the
    level below (twice the entries in all). A range of places is made of two blocks a level at most.
    """
    entries = materialize(with_sequence(kv.select("key", lift.alias("f")), "key", name="k"), "entries")
    level = entries.select((F.col("k") - 1).alias("b"), "f")
    blocks = [materialize(level, "fold")]
    while blocks[-1].count() > 1:
        blocks.append(materialize(blocks[-1].groupBy(F.shiftright("b", 1).alias("b")).agg(merge("f").alias("f")), "fold"))
    rows = entries.select(F.col("key").alias("x"), F.lit(1).alias("rank"), F.lit(1).cast("long").alias("c"))
    at = _ends(ranges, rows, {"c": "sum"}).groupBy("rid").agg(*[F.max(F.when(F.col("side") == e, F.col("run_c"))).alias(e) for e in ("lo", "hi")])
    n = entries.count()
    asked = ranges.withColumn("none", _holds_nothing()).select("rid", "none").join(at, "rid", "left")
    asked = asked.where("not none").select("rid", F.coalesce("lo", F.lit(0)).alias("i"), F.coalesce("hi", F.lit(n)).alias("j")).where("i < j")  # places i to j-1
    found = None
    asked = materialize(asked, "asked")
    for b in blocks:
        take = asked.select("rid", F.explode(F.filter(F.array(F.when(F.col("i") % 2 == 1, F.col("i")), F.when((F.col("j") % 2 == 1) & (F.col("j") > F.col("i")) & ~((F.col("i") % 2 == 1) & (F.col("j") - 1 == F.col("i"))), F.col("j") - 1)), lambda x: x.isNotNull())).alias("b"))
        got = take.join(b, "b").select("rid", "f")
        found = got if found is None else found.unionByName(got)
        asked = asked.select("rid", F.shiftright(F.col("i") + 1, 1).alias("i"), F.shiftright("j", 1).alias("j")).where("i < j")
    got = materialize(found.groupBy("rid").agg(merge("f").alias("value")), "folds")
    discard(*blocks, entries)
    out = ranges.select("rid").join(got, "rid", "left")
    return out if identity is None else out.select("rid", F.coalesce("value", identity).alias("value"))
