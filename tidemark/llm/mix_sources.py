"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document draws an exponential key, -ln(u) / w, from a hash u of its id and its
quality weight w; within a source, ascending keys are a weighted draw without
replacement. A source's word budget is met by whole epochs first, and what remains by
the documents with the smallest keys, up to the budget: the last of these gives only the
words that still fit (rows equal to it in all columns share them evenly).

No source is sorted as a whole: keys are dealt into cells, cell sums give the cell where
the budget ends, and only the rows of that cell are sorted. What is left is a row for
each source, and every document is decided by itself, from its key. Cells are cut on the
distribution that a source's keys have, a mixture of exponential ones by its counted weights,
so they hold about as many rows each, whatever the weights are.

The quality weight is made of text statistics: the share of characters that mark
boiler-plate, how far the mean length of words is from usual, and the share of lines that
repeat others. The length of words tells nothing where scripts have no spaces (two and a
half bytes a character or more), so it counts as usual there.

Targets are computed over one row a source, in one task. Null sources are one source, in
last place. Null and empty texts have size 0 and take nothing; null ids draw by a checksum
of the text. An empty table gives an empty result. Other columns are kept by ``mixed`` and
ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, cut, small, unit_hash, words

#: Weights are counted in classes, so many for a factor of e: about three times as many in all, as the least weight is 0.05.
CLASSES = 20

#: Characters that mark boiler-plate and garbage; their share lowers a document's weight.
JUNK = "#$%&*!|"


#: Sources whose mixtures are broadcast: a kilobyte each.
MOST_SHARES = 20_000


@dataclass(frozen=True)
class Mix:
    """weights: of the sources by name, repeating; share: of all words; cap: of a source's words; seed: of the draw."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    seed: str = "mix-1"


def quality(text=None):
    """Weight in [0.05, 1]: falls with the share of JUNK characters, with the distance of the characters a word (less one, for the space) from 4 to 8 where words have spaces between them, and with repeated lines. 1 without a word."""
    text = F.col("text") if text is None else text
    length, count = F.length(text), words(text)
    junk = length - F.length(F.translate(text, JUNK, ""))
    mean = length / F.nullif(count, F.lit(0)) - 1
    lines = length - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    fine = 1 - F.least(F.lit(1.0), 4.0 * junk / F.nullif(length, F.lit(0)))
    usual = 1 - F.least(F.lit(1.0), F.greatest(4.0 - mean, mean - 8.0, F.lit(0.0)) / 8.0)
    fresh = F.size(F.array_distinct(F.split(text, "\n"))) / lines
    usual = F.when(F.octet_length(text) >= 2.5 * length, 1.0).otherwise(usual)
    return F.when(count > 0, 0.05 + 0.95 * (fine * usual * fresh)).otherwise(1.0)


def keyed(docs: DataFrame, mix: Mix) -> DataFrame:
    """_row (the row itself), doc_id, size and what decides on it: _src, _key, _id, _sum."""
    own = F.concat(F.lit("-"), F.crc32(F.coalesce("text", F.lit(""))).cast("string"))
    u = unit_hash(F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), own))
    return docs.select(
        F.struct(*docs.columns).alias("_row"),
        "doc_id",
        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("_src"),
        words(F.col("text")).alias("size"),
        (-F.log(u) / quality()).alias("_key"),
        F.floor(F.log(quality()) * CLASSES).cast("int").alias("_class"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("_sum"),
    )


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source_size and target by _src. The excess over caps is dealt again: all uncapped sources get the same words per weight, the largest level at which the words of the sources before it, by cap per weight, are used up."""
    every = Window.orderBy("_src")
    weight = F.get(F.array(*map(F.lit, mix.weights)), (F.row_number().over(every) - 1) % len(mix.weights))
    t = sizes.select("_src", "source_size", weight.alias("_w"), (F.lit(mix.cap) * F.col("source_size")).alias("_cap"))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_src").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spent = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    left = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    t = t.withColumn("_level", (mix.share * F.sum("source_size").over(whole) - spent) / left)
    return t.select("_src", "source_size", F.least("_cap", F.max("_level").over(whole) * F.col("_w")).alias("target"))


def celled(rows: DataFrame) -> DataFrame:
    """rows with ``_cell``: rising with the key within a source, about equally full."""
    classes = cut(rows.groupBy("_src", "_class").agg(F.count(F.lit(1)).alias("_n")))
    total = classes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    shares = classes.groupBy("_src").agg(F.array_sort(F.collect_list(F.struct((F.exp((F.col("_class") + 0.5) / CLASSES)).alias("w"), F.col("_n").cast("double").alias("n")))).alias("_mix"), F.sum("_n").alias("_all"))
    n = cells(total)
    rows = rows.join(small(shares, shares.count(), MOST_SHARES), "_src")
    under = F.aggregate("_mix", F.lit(0.0), lambda s, x: s + x["n"] * (1 - F.exp(-x["w"] * F.col("_key"))))
    return rows.withColumn("_cell", F.least(F.floor(under / F.col("_all") * n), F.lit(n - 1)).cast("int")).drop("_mix", "_all", "_class")


def plan(rows: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """A row for each source: its target, epochs and the key at which its last epoch ends; and the number of sources."""
    rows = celled(rows)
    sums = cut(rows.groupBy("_src", "_cell").agg(F.sum("size").alias("_words")))
    t = targets(sums.groupBy("_src").agg(F.sum("_words").alias("source_size")), mix)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    t = t.withColumn("epochs", epochs).withColumn("_rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    t = cut(t)
    sources = t.count()
    running = F.sum("_words").over(Window.partitionBy("_src").orderBy("_cell"))
    ends = sums.withColumn("_start", running - F.col("_words")).join(small(t.select("_src", "_rest"), sources), "_src")
    ends = ends.where("_start < _rest and _start + _words >= _rest").select("_src", "_cell", "_start", "_rest")
    last = rows.join(small(ends, sources), ["_src", "_cell"]).groupBy("_src", "_start", "_rest", "_key", "_id", "_sum", "size").agg(F.count(F.lit(1)).alias("_n"))
    here = F.col("size") * F.col("_n")
    last = last.withColumn("_before", F.col("_start") + F.sum(here).over(Window.partitionBy("_src").orderBy("_key", "_id", "_sum", "size")) - here)
    last = last.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + here >= F.col("_rest")))
    last = last.select("_src", F.struct("_key", "_id", "_sum", "size").alias("_end"), F.floor((F.col("_rest") - F.col("_before")) / F.col("_n")).alias("_part"))
    return cut(t.drop("_rest").join(last, "_src", "left")), sources


def decided(rows: DataFrame, decisions: DataFrame, sources: int) -> DataFrame:
    at = F.struct("_key", "_id", "_sum", "size")
    more = F.when(at < F.col("_end"), F.col("size")).when(at == F.col("_end"), F.col("_part")).otherwise(0)
    return rows.join(small(decisions, sources), "_src").withColumn("taken", F.col("epochs") * F.col("size") + F.coalesce(more, F.lit(0)))


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    rows = cut(keyed(docs, mix).drop("_row"))
    return decided(rows, *plan(rows, mix)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; a part of half a document or more counts as a whole one."""
    rows = cut(keyed(docs, mix).drop("_row", "doc_id"))
    copies = F.coalesce(F.round(F.col("taken") / F.nullif("size", F.lit(0))), F.col("epochs")).cast("int")
    out = decided(keyed(docs, mix), *plan(rows, mix)).where(copies > 0)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select("_row.*")


#: u is the same hash in both engines; weights, caps and budgets are exact numbers of words.
SQL = r"""
with p as (
  select doc_id, source, text, length(text) as chars, string_split(text, chr(10)) as lines,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    length(text) - length(translate(text, '#$%&*!|', '')) as junk,
    (cast('0x' || substr(md5(concat_ws(':', 'mix-1', cast(doc_id as varchar))), 1, 13) as bigint)::double + 0.5) / 4503599627370496.0 as u
  from documents),
q as (
  select *, chars::double / nullif(size, 0) - 1 as mean from p),
d as (
  select doc_id, source, size,
    -ln(u) / case when size > 0 then 0.05::double + 0.95::double * (
      (1 - least(1.0::double, 4.0::double * junk / nullif(chars, 0)))
      * case when strlen(text) >= 2.5::double * chars then 1.0::double else 1 - least(1.0::double, greatest(4.0::double - mean, mean - 8.0::double, 0.0::double) / 8.0::double) end
      * (len(list_distinct(lines))::double / len(lines))) else 1.0::double end as key
  from q),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rn from d group by source),
w as (select *, case (rn - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, 2.0::double * source_size as cap from s),
l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from w window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(cap, max(level) over () * w) as target from l),
e as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as epochs from t),
r as (
  select d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target)::bigint - e.epochs * e.source_size as rest,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from d join e on d.source is not distinct from e.source)
select doc_id, size::bigint as size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from r
"""
