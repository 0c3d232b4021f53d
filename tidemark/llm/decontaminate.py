r"""Benchmark decontamination by templates, with DataFrame functions only.

Texts are cut into lower-cased words (runs of letters and digits). Numbers, units after a
number and names (capitalised words inside a sentence) become typed placeholders, so that
a question with other numbers or names has the same template. Names are known by their
capital, so each window has two more forms for texts in another case: with names as plain
words, and with all its words bare. Windows of five words are hashed in these forms and
hash-joined with those of the benchmark; one that matches in any form occurs. A text holds an item if at
least ``covered`` of the item's windows occur in it; then the values in the slots of both
are laid side by side along each offset on which that share of windows matches, and along
the one on which most do (of equal ones, each), and each value of the item must stand for one value of the text throughout, whatever its case: the share of consistent slots must
reach ``consistent`` on one of the offsets; the best of these is told. Windows with fewer than two plain words say nothing as templates and
are left out. An item that has no other windows is sought as it stands: by its windows of
five bare words (lower-cased, without placeholders), or as a whole run if it has fewer than
five words, so that an item of one word is held by every text with that word.

Copies share the verdict, which goes by a text's checksum. What is broadcast is counted
first, texts by their bytes; beyond the bounds the joins shuffle, with heavy windows, items
and copies dealt out. Null and
empty texts, and items without a word, match nothing. Repeated rows give repeated
results, null ids stay null. Empty tables give an empty result. Other columns are ignored
(``cleaned`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, dealt_join, key_join, small, written

#: Units that make the word after a number a slot.
UNITS = "km cm mm m kg g mg lb lbs oz l ml s sec seconds min minutes h hr hours days weeks months years miles feet ft inches in yards percent dollars euros pounds cents usd eur degrees mph kph watts volts people".split()

NAME, UNIT = "\u0002", "\u0003"

#: The codes of a number, a name and a unit.
PLACES = (1, 2, 3)

#: Words of a text that are hashed at once.
PART = 256

#: Window hashes up to which texts are searched by a broadcast of them alone, and bytes of items that are broadcast: 50 MB each at most, as held.
MOST_HASHES, ITEM_BYTES = 1_000_000, 8 << 20


@dataclass(frozen=True)
class Leak:
    covered: float = 0.6
    consistent: float = 0.7


def tokens(text: Column) -> Column:
    """Lower-cased words; names and units keep a mark in front."""
    marked = F.regexp_replace(text, rf"(?i)([0-9]\x20?)({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    marked = F.regexp_replace(marked, r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll},;:]\x20)", NAME)
    return F.filter(F.split(F.lower(marked), rf"[^\p{{L}}\p{{N}}{NAME}{UNIT}]+"), lambda t: t != "")


def kind(token: Column) -> Column:
    """1 number, 2 name, 3 unit, 0 a plain word."""
    c = F.ascii(token)
    return F.when((c >= 48) & (c <= 57), 1).when(c == 2, 2).when(c == 3, 3).otherwise(0)


def windows(words: str, n: int = 5) -> Column:
    """Hashes of all windows of n (1 to 5) words, from a column of ``codes`` or ``bare_codes``."""
    c = F.col(words)
    if n == 1:
        return c
    starts = F.slice(c, 1, F.greatest(F.size(c) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(c, i + k) for k in range(1, n)]))


def codes(words: Column) -> Column:
    return F.transform(words, lambda t: F.when(kind(t) == 0, F.xxhash64(t)).otherwise(kind(t).cast("long")))


def bare(token: Column) -> Column:
    """The word without its mark."""
    return F.when(kind(token) >= 2, F.substring(token, 2, 1 << 30)).otherwise(token)


def bare_codes(words: Column) -> Column:
    return F.transform(words, lambda t: F.xxhash64(bare(t)))


def parts(df: DataFrame, *keys: str) -> DataFrame:
    """keys, _from and _t: the words of the column text in rows of PART and the four that follow, so that long texts stay small."""
    df = df.select(*keys, tokens(F.col("text")).alias("_t"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_t") - 1, F.lit(0)), F.lit(PART))
    df = df.select(*keys, F.explode(F.transform(starts, lambda k: F.struct(k.alias("k"), F.slice("_t", k + 1, PART + 4).alias("t")))).alias("_p"))
    return df.select(*keys, F.col("_p.k").alias("_from"), F.col("_p.t").alias("_t"))


def forms(df: DataFrame, *keys: str) -> DataFrame:
    """keys and the words of the column _t as codes: _c with placeholders, _b bare, _n with placeholders but for names.

    Without a placeholder all three are the same; then _b and _n are null.
    """
    df = df.select(*keys, "_t", codes(F.col("_t")).alias("_c"))
    df = df.select(*keys, "_c", F.when(F.arrays_overlap("_c", F.array(*map(F.lit, PLACES))), bare_codes(F.col("_t"))).alias("_b"))
    return df.withColumn("_n", F.when(F.array_contains("_c", PLACES[1]), F.zip_with("_c", "_b", lambda c, b: F.when(c == 2, b).otherwise(c))))


def placed(df: DataFrame, *keys: str, runs: list[int]) -> DataFrame:
    """keys, pos and hash of every window of the column text in its forms, and of every run of as many bare words as in runs."""
    keys += ("_from",)
    df = forms(parts(df, *keys[:-1]), *keys).withColumn("_r", F.coalesce("_b", "_c"))
    every = [windows("_c"), *[F.when(F.col(c).isNotNull(), windows(c)) for c in ("_n", "_b")], *[windows("_r", n) for n in runs if n < 5]]
    df = df.select(*keys, F.explode(F.array(*every)).alias("_w")).select(*keys, F.posexplode("_w").alias("pos", "hash"))
    return df.withColumn("pos", F.col("pos") + F.col("_from")).drop("_from")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item, pos, hash, run of the windows an item is sought by; run is their length in bare words, 0 for those of templates in all forms.

    An item is a distinct text of the benchmark. Templates must say something; items without such windows come as bare words.
    """
    df = forms(benchmark.select("item", tokens(F.col("text")).alias("_t")), "item").withColumn("_b", F.coalesce("_b", "_c")).withColumn("_n", F.coalesce("_n", "_c"))
    every = F.arrays_zip(windows("_c").alias("c"), windows("_n").alias("n"), windows("_b").alias("b"))
    at = df.select("item", "_c", F.posexplode(every).alias("at", "w"))
    plain = F.size(F.filter(F.slice("_c", F.col("at") + 1, 5), lambda x: ~x.between(1, 3)))
    at = at.where(plain >= 2).select("item", "at", F.explode(F.array_distinct(F.array("w.c", "w.n", "w.b"))).alias("hash"))
    said = cut(at.withColumn("run", F.lit(0)))
    rest = df.join(said.select("item").distinct(), "item", "left_anti").where(F.size("_b") > 0)
    run = F.least(F.size("_b"), F.lit(5))
    own = F.when(run == 5, windows("_b"))
    for n in (4, 3, 2, 1):
        own = own.when(run == n, windows("_b", n))
    return said.union(rest.select("item", F.posexplode(own).alias("at", "hash"), run.alias("run")))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def leaks(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """doc_id, item_id, covered, slots, consistent, form for every row of docs that holds an item of the benchmark."""
    items = cut(benchmark.where("text is not null").select("item_id", "text", F.md5("text").alias("item")))
    texts = items.groupBy("item").agg(F.first("text").alias("text"))
    wins = cut(item_windows(texts))
    n = wins.count()
    rows = items.count()
    runs = sorted(r.run for r in wins.select("run").distinct().collect() if r.run)
    at = placed(docs.select(text_key().alias("key"), "text"), "key", runs=runs)
    hits = met(at, wins, n).groupBy("key", "item", (F.col("pos") - F.col("at")).alias("offset")).agg(F.collect_set("at").alias("ats"))
    whole = wins.groupBy("item").agg(F.count_distinct("at").alias("windows"))
    hits = hits.select("key", "item", "offset", "ats", F.size("ats").alias("n"))
    found = hits.groupBy("key", "item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("_all"),
        F.max("n").alias("_most"),
        F.collect_list(F.struct("n", "offset", F.array_min("ats").alias("lo"), F.array_max("ats").alias("hi"))).alias("_at"),
    )
    found = found.join(small(whole, n), "item").withColumn("covered", F.col("_all") / F.col("windows")).where(F.col("covered") >= leak.covered)
    judged = F.filter("_at", lambda o: (o["n"] == F.col("_most")) | (o["n"] / F.col("windows") >= leak.covered))
    found = found.select("key", "item", "covered", F.explode(judged).alias("best"))
    found = cut(found.select("key", "item", "covered", "best.n", "best.offset", "best.lo", (F.col("best.hi") - F.col("best.lo") + 5).alias("len")))
    rows_of = docs.select("doc_id", text_key().alias("key"), "text")
    held = written(key_join(rows_of, cut(found.select("key").distinct()), "key", "left_semi"), "held")
    mine = held.groupBy("key").agg(F.first("text").alias("text")).select("key", tokens(F.col("text")).alias("mine"))
    theirs = texts.select("item", tokens(F.col("text")).alias("theirs"))
    side = found.join(mine, "key")
    if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= ITEM_BYTES:
        side = side.join(F.broadcast(theirs), "item")
    else:
        side = dealt_join(side, theirs, "item", "key", counts=found.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    pair = F.arrays_zip(F.slice("theirs", F.col("lo") + 1, F.col("len")).alias("i"), F.slice("mine", F.col("lo") + F.col("offset") + 1, F.col("len")).alias("d"))
    pair = F.filter(pair, lambda p: (kind(p["i"]) > 0) & ((kind(p["i"]) == kind(p["d"])) | (bare(p["i"]) == bare(p["d"]))))
    slots = F.transform(pair, lambda p: F.struct(bare(p["i"]).alias("i"), bare(p["d"]).alias("d")))
    side = side.withColumn("_slots", slots).withColumn("_pairs", F.array_distinct("_slots"))
    names = F.size(F.array_distinct(F.transform("_pairs", lambda p: p["i"])))
    side = side.withColumn("consistent", F.when(F.size("_pairs") > 0, names / F.size("_pairs")).otherwise(1.0))
    same = F.forall("_slots", lambda p: p["i"] == p["d"])
    side = side.where(F.col("consistent") >= leak.consistent)
    told = F.struct("n", same.alias("same"), "consistent", F.size("_slots").alias("slots"))
    side = side.groupBy("key", "item", "covered").agg(F.max(told).alias("_told")).select(
        "key", "item", "covered", "_told.slots", "_told.consistent", F.when(F.col("_told.same"), "verbatim").otherwise("other values").alias("form")
    )
    side = side.join(small(items.select("item", "item_id"), rows), "item")
    told = F.collect_list(F.struct("item_id", "covered", "slots", "consistent", "form")).alias("_items")  # as many as items at most
    side = cut(side.groupBy("key").agg(told))
    return key_join(held.select("key", "doc_id"), side, "key").select("doc_id", F.inline("_items"))


def met(at: DataFrame, wins: DataFrame, n: int) -> DataFrame:
    """The windows of texts (hash and more) with the n windows of items that have their hash."""
    if n <= BROADCAST_ROWS:
        return at.join(F.broadcast(wins), "hash")
    spots = cut(wins.groupBy("hash").agg(F.collect_list(F.struct("item", "at", "run")).alias("_spots")))
    if spots.count() <= MOST_HASHES:  # few windows of the texts are left to be shuffled
        at = cut(at.join(F.broadcast(spots.select("hash")), "hash", "left_semi"))
    return dealt_join(at, spots, "hash", "key").select(*at.columns, F.inline("_spots"))


def cleaned(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """The rows of docs that hold no item. Rows without an id are judged by their text, like all others."""
    bad = leaks(docs.select(F.struct("doc_id", text_key().alias("k")).alias("doc_id"), "text"), benchmark, leak)
    bad = cut(bad.select(F.col("doc_id.k").alias("_key")).distinct())
    whole = docs.select(F.struct(*docs.columns).alias("_row"), text_key().alias("_key"))
    return key_join(whole, bad, "_key", "left_anti").select("_row.*")
