"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Two lines match when they are equal and not blank, or when both have ``least`` characters or
more and one edit of a character turns one into the other (in shorter lines one character is
most of what they say: list numbers, names). A line goes when a line at an earlier place
(document id, then line number) matches it; matches are judged on the input. Blank lines, empty
or of white space only, never go.

Two lines one edit apart agree before and after a window that holds the edit. So:

1. Lines that share a half (from the start or from the end) with a different line are found by
   one aggregation; only they can have a match.
2. They are cut into ``PIECES`` windows; a line keeps the windows around which another line agrees.
3. For each of these the deletion neighbourhood is emitted: every variant with one character of
   the window deleted, hashed together with what stands before and after. Equal variants with
   the same place deleted are lines one substitution apart; a variant equal to a whole line is
   one deletion apart. The earliest line of each key is joined back, and the pair is verified
   with the edit distance itself.

No step emits the pairs of a group: a key meets only the earliest line that holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.sources.scratch import by_position, drop_columns_clash, materialize

PIECES = 16
LAST = 2**63 - 1
#: A line that is not blank.
FULL = r"[^\x20\x09-\x0D]"


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """``doc, th, line_no, line``: the lines of at least ``least`` characters that are not blank; a null id stands after all others."""
    cols = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cols.where((F.char_length("line") >= least) & F.col("line").rlike(FULL))


def repeated_lines(docs: DataFrame, least: int = 20, edits: int = 1, copies: int = 1) -> DataFrame:
    """``doc, th, gone``: for each document with repeated lines, the numbers of these lines."""
    if edits not in (0, 1):
        raise ValueError(f"edits is 0 or 1, not {edits}")
    seen = lines_of(docs, min(least, copies) if edits else copies)
    pos = F.struct("doc", "line_no")
    h = [F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")]
    # exact copies: one row a distinct line
    placed = seen.select(*h, "doc", "line_no", "th", (F.char_length("line") >= copies).alias("whole"))
    firsts = placed.groupBy("h1", "h2").agg(F.min(pos).alias("first"), F.count("*").alias("copies"), F.first("whole").alias("whole"))
    firsts = materialize(firsts, "lines")
    marks = firsts.where("copies > 1 and whole").select("h1", "h2", "first", F.lit(False).alias("near"))
    if edits:
        near = _near(docs, firsts, least)
        marks = marks.unionByName(near.join(firsts, ["h1", "h2"]).select("h1", "h2", "first", F.lit(True).alias("near")))
    marks = marks.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("near").alias("near"))
    gone = placed.drop("whole").join(marks, ["h1", "h2"]).where(F.col("near") | (pos > F.col("first")))
    return gone.groupBy("doc", "th").agg(F.collect_set("line_no").alias("gone"))


def _near(docs: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """``h1, h2`` of the distinct lines that match an earlier, different one."""
    rows = lines_of(docs, least).select(F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "doc", "line_no", "line")
    n = F.char_length("line").cast("int")
    keys = rows.select("h1", n.alias("n"), "line").select("h1", F.explode(F.array_distinct(F.array(*[
        F.struct(F.xxhash64(F.lit(side), base, part(base)).alias("key"))
        for base in (F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int"))
        for side, part in (("a", lambda b: F.left("line", b)), ("z", lambda b: F.right("line", b)))
    ]))).alias("k")).select("h1", F.col("k.key").alias("key"))
    halves = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    hot = keys.join(halves, "key", "left_semi").select("h1").distinct()
    one = rows.join(hot, "h1", "left_semi").join(firsts.select("h1", "h2", "first"), ["h1", "h2"])
    one = one.where(F.struct("doc", "line_no") == F.col("first")).groupBy("h1", "h2", "first").agg(F.min("line").alias("line"))
    one = materialize(one.select("h1", "h2", "first", "line", F.char_length("line").cast("int").alias("n")), "lines")
    # full: the line among lines of its own length or one longer; cut: among lines one shorter
    wins = []
    for base, kind in (("n", "full"), ("n - 1", "cut")):
        w = one.withColumn("base", F.expr(base)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
        w = w.withColumn("p", F.floor(F.col("k") * F.col("base") / PIECES).cast("int")).withColumn("s", (F.col("base") - F.floor((F.col("k") + 1) * F.col("base") / PIECES)).cast("int"))
        w = w.where("n - p - s > 0")
        wins.append(w.select("h1", "h2", "first", "n", "base", "k", "p", F.lit(kind).alias("kind"), F.xxhash64("base", "k", F.left("line", F.col("p")), F.right("line", F.col("s"))).alias("around"), F.expr("substring(line, p + 1, n - p - s)").alias("win")))
    wins = materialize(wins[0].unionByName(wins[1]), "windows")
    met = wins.groupBy("around").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("around")
    wins = wins.join(met, "around", "left_semi")
    hole = wins.select("h1", "h2", "first", "kind", "around", "p", "win", F.explode(F.expr("sequence(1, length(win))")).alias("i"))
    hole = hole.withColumn("rest", F.expr("concat(substring(win, 1, i - 1), substring(win, i + 1, length(win)))"))
    same = hole.where("kind = 'full'").select(F.xxhash64(F.lit("s"), "around", F.col("p") + F.col("i"), "rest").alias("key"), F.lit(0).alias("side"), "h1", "h2", "first")
    less = hole.where("kind = 'cut'").select(F.xxhash64(F.lit("d"), "around", "rest").alias("key"), F.lit(1).alias("side"), "h1", "h2", "first")
    whole = wins.where("kind = 'full'").select(F.xxhash64(F.lit("d"), "around", "win").alias("key"), F.lit(2).alias("side"), "h1", "h2", "first")
    variants = materialize(same.unionByName(less).unionByName(whole), "variants")
    by = F.struct("first", "h1", "h2")
    earliest = variants.groupBy("key", "side").agg(F.min(by).alias("e"), F.count("*").alias("m"))
    # substitution: the earliest of the same side; deletion: the earliest of the other side
    earliest = earliest.withColumn("to", F.when(F.col("side") == 1, 2).when(F.col("side") == 2, 1).otherwise(0))
    pairs = variants.join(earliest.select("key", F.col("to").alias("side"), "e"), ["key", "side"]).where(F.col("first") > F.col("e.first"))
    pairs = pairs.select("h1", "h2", F.col("e.h1").alias("g1"), F.col("e.h2").alias("g2")).distinct()
    a = one.select("h1", "h2", F.col("line").alias("x"))
    b = one.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("y"))
    checked = pairs.join(a, ["h1", "h2"]).join(b, ["g1", "g2"]).where(F.levenshtein("x", "y", 1) == 1)
    return checked.select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, least: int = 20, edits: int = 1, id_col: str = "doc_id", text_col: str = "text", copies: int = 1) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` for every row, ``text`` without its repeated lines.

    Lines are parts between line feeds. Copies go of lines of ``copies`` characters or more, and
    with ``edits`` = 1 (0: copies only) lines one edit apart of ``least`` characters or more. Blank
    lines stay. Rows with equal ids and texts are one document, so they remove nothing from each
    other; a row without an id stands after all others. A null text stays null and has no lines.
    """
    docs = drop_columns_clash(docs, {id_col: "long", text_col: "string"}).toDF("doc_id", "text")
    gone = repeated_lines(docs, least, edits, copies)
    keyed = docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("th", F.xxhash64("text"))
    out = keyed.join(gone, ["doc", "th"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return out.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def without_repeated_lines(docs: DataFrame, least: int = 20, edits: int = 1, copies: int = 1) -> DataFrame:
    """The rows of ``docs`` with all columns, ``text`` without its repeated lines and ``n_chars`` to match.

    A row that lost lines and has no text but white space left goes. Columns are told by place, so
    others may have any name.
    """
    flat, at = by_position(docs)
    text, id_ = at["text"], F.col(at["doc_id"]).cast("long")
    gone = repeated_lines(flat.select(id_.alias("doc_id"), F.col(text).alias("text")), least, edits, copies)
    keyed = flat.withColumn("_doc", F.coalesce(id_, F.lit(LAST))).withColumn("_th", F.xxhash64(text))
    out = keyed.join(gone.toDF("_doc", "_th", "_gone"), ["_doc", "_th"], "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    out = out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept))
    if "n_chars" in at:
        kind = dict(flat.dtypes)[at["n_chars"]]
        out = out.withColumn(at["n_chars"], F.when(F.col("_gone").isNull(), F.col(at["n_chars"])).otherwise(F.char_length(text).cast(kind)))
    return out.where(F.col("_gone").isNull() | F.col(text).rlike(FULL)).select(*flat.columns).toDF(*docs.columns)


OP5_SQL = """
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) no, unnest(string_split(text, chr(10))) line from documents),
k as (select * from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ff as (select line, min(row(doc_id, no)) pos, length(line)::int n from k group by 1),
f as (select * from ff where n >= 20),
p as (
  select a.line x, b.line y, a.pos px, b.pos py, a.n from f a join f b on a.n=b.n and a.line<>b.line and substr(a.line,1,a.n//2)=substr(b.line,1,a.n//2)
  union select a.line, b.line, a.pos, b.pos, a.n from f a join f b on a.n=b.n and a.line<>b.line and right(a.line,a.n//2)=right(b.line,a.n//2)
  union select a.line, b.line, a.pos, b.pos, a.n from f a join f b on a.n=b.n+1 and substr(a.line,1,b.n//2)=substr(b.line,1,b.n//2)
  union select a.line, b.line, a.pos, b.pos, a.n from f a join f b on a.n=b.n+1 and right(a.line,b.n//2)=right(b.line,b.n//2)),
c as (select * from p where case when length(x)=length(y)
  then len(list_filter(range(1,n+1), lambda i: substr(x,i::int,1)<>substr(y,i::int,1)))=1
  else len(list_filter(range(1,n+1), lambda i: substr(x,1,i::int-1)||substr(x,i::int+1)=y))>0 end),
near as (select distinct case when px>py then x else y end line from c),
g as (select k.doc_id, k.no from k join ff f using(line) left join near using(line) where row(k.doc_id,k.no)>f.pos or near.line is not null)
select d.doc_id, case when d.text is null then null when bool_or(g.no is not null) then coalesce(string_agg(l.line, chr(10) order by l.no) filter (where g.no is null), '') else d.text end as text,
  count(l.no) n_lines, count(g.no) n_removed
from documents d left join l using(doc_id) left join g on g.doc_id=l.doc_id and g.no=l.no group by d.doc_id, d.text
"""


def op5(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
