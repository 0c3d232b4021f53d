"""BagMinHash near-duplicate classes over multisets of five-word shingles.

A text is the multiset of its runs of five lower-cased words (one run of all its words
if it has fewer). Every shingle owns independent Poisson processes over the discretised
weight axis, one for each interval (0,1], (1,2], (2,4], (4,8] ...; a point of an interval
that a count covers only in part is kept if the unit it falls into, found by halving, is
covered. Each point carries a time and a signature position, and a position keeps its
first point. Two signatures agree at a position with the probability of the weighted
Jaccard similarity. A text stops drawing points once all its positions hold earlier ones.

Signatures are cut into bands. In every band bucket the members are held against two
centres: the text that meets most others, and one at random. Where a bucket then still
holds several components, all similar pairs across components are looked up by their
prefixes: with the shingles of both in one order, rare ones first, two similar texts share
one of the first fifth, so early that enough can still follow. What a multitude of texts
has in common stands last in that order, so a common passage or a group of edited copies
makes no pairs. Each pair is verified on the whole texts: sum of the smaller counts over
sum of the larger.

No task gets a whole bucket, class or group of copies: keys with many rows are dealt out
(``dealt_join``), and the text of a centre goes to each part of its pairs.

Null and empty texts are equal to each other and near to no other text. Repeated rows and
null ids are kept; a class is named by its smallest doc_id (null if it has none). An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_join, key_join, small, written

#: Counters by which shingles are ordered. They only decide how many pairs are looked at, never which links are found.
CELLS = 1 << 17
#: Bytes of text that a task takes at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Near:
    """Words of a shingle, least similarity of a link, and bands of rows of the signature."""

    shingle: int = 5
    similar: float = 0.8
    bands: int = 20
    rows: int = 4


U = np.uint64
_P, _MIX1, _MIX2 = U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_P_INV = U(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> U(33))
    x *= _MIX1
    x ^= x >> U(33)
    x *= _MIX2
    x ^= x >> U(33)
    return x


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from running sums over all bytes; two numbers a byte are held at once."""
    power = np.full(len(buf), _P)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(buf) + 1, U)
    np.add(buf, U(1), out=total[1:])
    total[1:] *= power
    np.cumsum(total, out=total)
    power[1:] = _P_INV
    power[0] = 1
    np.cumprod(power, out=power)
    return mixed((total[end] - total[start]) * power[start])


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle of each text, the text's number and a 64-bit hash. Texts stand one after another."""
    raw = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    buf = np.frombuffer(b" " + b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    space = _SPACE[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U)
    word = word_hashes(buf, start, end)
    doc = np.searchsorted(ends, start, side="left")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    size = np.minimum(words, count)
    out = np.zeros(len(word), U)
    for k in range(words):  # a text of fewer words has one shingle of them all
        use = word[k:] * U(2 * k + 3)
        out = out * _P
        out[: len(use)] += np.where(k < size[doc[: len(use)]], mixed(use), U(0))
    keep = np.arange(len(word)) + size[doc] <= (first + count)[doc]
    return doc[keep], mixed(out[keep])


def bags(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multisets: text's number, 44-bit element and count, sorted by text and element."""
    doc, h = shingles(texts, words)
    key = (doc.astype(U) << U(44)) | (h >> U(20))
    key.sort()
    key, count = np.unique(key, return_counts=True)
    return (key >> U(44)).astype(np.int64), key & U((1 << 44) - 1), count


def signatures(texts: list[str], m: int, words: int) -> np.ndarray:
    """A row of m times (as 64-bit patterns) for each text; infinite where a text has no shingle."""
    doc, element, weight = bags(texts, words)
    sig = np.full(len(texts) * m, np.inf)
    level = np.zeros(len(doc), np.int64)
    parts = [(doc, element, weight, level)]
    many = np.flatnonzero(weight > 1)
    k = 1
    while len(many):  # interval k > 0 is (2^(k-1), 2^k]
        parts.append((doc[many], element[many], weight[many], np.full(len(many), k)))
        many = many[weight[many] > (1 << k)]
        k += 1
    doc, element, weight, level = (np.concatenate(x) for x in zip(*parts, strict=True))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    seed = mixed(element * _MIX1 + level.astype(U) * _P)
    time = np.zeros(len(doc))
    j = 0
    while len(doc):
        j += 1
        h = mixed(seed + U(j * int(_MIX2) & (1 << 64) - 1))
        time = time - np.log(((h >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)) / width
        g = mixed(h ^ _P)
        unit = low + 1 + ((g >> U(32)) & (width - 1).astype(U)).astype(np.int64)  # its leading halvings, bit by bit
        ok = unit <= weight
        place = doc * m + ((g & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
        np.minimum.at(sig, place[ok], time[ok])
        most = sig.reshape(-1, m).max(axis=1)
        on = time < most[doc]
        doc, low, width, weight, seed, time = doc[on], low[on], width[on], weight[on], seed[on], time[on]
    return sig.reshape(-1, m)


def banded(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each band of each signature."""
    bits = mixed(sig.view(U)).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=U) * _P, (len(sig), bands)).copy()
    for r in range(rows):
        out = mixed(out + bits[:, :, r])
    return out.view(np.int64)


def chunks(batch: pa.RecordBatch, *cols: str):
    """Parts of a batch with about CHUNK bytes of text each."""
    size = sum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0)) for c in cols)
    part = np.cumsum(size) // CHUNK if len(size) else size
    for at in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
        if len(at):
            yield batch.slice(at[0], len(at))


def _sketch(near: Near):
    def run(batches):
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for b in chunks(whole, "text"):
                texts = [t or "" for t in b.column("text").to_pylist()]
                sig = signatures(texts, near.bands * near.rows, near.shingle)
                has = np.isfinite(sig[:, 0])
                flat = banded(sig, near.bands, near.rows)[has].reshape(-1)
                offsets = np.concatenate([[0], np.cumsum(has * near.bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["key", "doc_id", "bands"])

    return run


def overlaps(a: list[str], b: list[str], words: int) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    sides = []
    for texts in (a, b):
        doc, element, count = bags(texts, words)
        sides.append(((doc.astype(U) << U(44)) | element, count, np.bincount(doc, count, minlength=len(texts))))
    (ka, ca, na), (kb, cb, nb) = sides
    both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    common = np.bincount((both >> U(44)).astype(np.int64), np.minimum(ca[ia], cb[ib]), minlength=len(a))
    return common / np.maximum(na + nb - common, 1)


def _verify(near: Near):
    def run(batches):
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for x in chunks(whole, "ta", "tb"):
                j = overlaps(*([t or "" for t in x.column(c).to_pylist()] for c in ("ta", "tb")), near.shingle)
                out = pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(j)], ["a", "b", "similarity"])
                yield out.filter(pa.array(j >= near.similar - 1e-12))

    return run


def text_key(text=None):
    """16 bytes that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(text if text is not None else F.col("text"), F.lit(""))))


def sketches(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """key, doc_id, bands for every row."""
    return docs.select(text_key().alias("key"), "doc_id", "text").mapInArrow(_sketch(near), "key binary, doc_id long, bands array<long>")


def texts_of(keys: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """key, text for the given keys, from the row with the smallest doc_id."""
    need = cut(keys.join(reps.select("key", F.col("doc_id").alias("_id")), "key"))
    held = docs.select(text_key().alias("key"), "doc_id", "text").join(small(need, need.count()), "key").where(F.col("doc_id").eqNullSafe(F.col("_id")))
    return written(held.groupBy("key").agg(F.first("text").alias("text")), "texts")


def verified(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """a, b, similarity of those pairs (a, b) of text keys whose texts are similar. Each pair's texts meet once, whole."""
    at_a, at_b = (pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")) for c in "ab")
    out = dealt_join(pairs, texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a", "b", counts=at_a)
    out = dealt_join(out, texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b", "a", counts=at_b)
    return cut(out.select("a", "b", "ta", "tb").mapInArrow(_verify(near), "a binary, b binary, similarity double"))


def _units(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The multisets with every occurrence as an element of its own."""
    doc, element, count = bags(texts, words)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(doc, count), mixed(np.repeat(element, count) + nth.astype(U) * _P)


def _count(near: Near):
    def run(batches):
        import pyarrow.compute  # noqa: F401

        seen = np.zeros(CELLS, np.int64)
        for whole in batches:
            for b in chunks(whole, "text"):
                _, e = _units([t or "" for t in b.column("text").to_pylist()], near.shingle)
                seen += np.bincount((e % U(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["cell", "n"])

    return run


def _prefixes(seen, near: Near):
    def run(batches):
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for b in chunks(whole, "text"):
                doc, e = _units([t or "" for t in b.column("text").to_pylist()], near.shingle)
                order = np.lexsort((e, seen.value[(e % U(CELLS)).astype(np.int64)], doc))
                doc, e = doc[order], e[order]
                n = np.bincount(doc, minlength=b.num_rows)[doc]
                pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
                on = pos <= n - np.ceil(near.similar * n - 1e-9)
                at = pa.array(doc[on])
                yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("label").take(at), pa.array(e[on].view(np.int64)), pa.array(pos[on]), pa.array(n[on])], ["key", "label", "element", "pos", "n"])

    return run


def across(mixed_keys: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) of keys with different labels that can be similar; none that is similar is missing."""
    rows = written(mixed_keys.join(texts, "key").select("key", "label", "text"), "mixed")
    counts = rows.mapInArrow(_count(near), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
    seen = np.ones(CELLS, np.int64)
    seen[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    p = written(rows.mapInArrow(_prefixes(rows.sparkSession.sparkContext.broadcast(seen), near), "key binary, label binary, element long, pos long, n long"), "prefixes")
    left = F.least(F.expr("x.n - x.pos"), F.expr("y.n - y.pos"))
    enough = left >= near.similar / (1 + near.similar) * F.expr("x.n + y.n") - 1e-9
    return p.alias("x").join(p.alias("y"), (F.expr("x.element = y.element and x.label < y.label")) & enough).select(*_ordered("x.key", "y.key")).distinct()


def components(links: DataFrame) -> DataFrame:
    """key, label (the smallest key of its component) for every key of links (a, b). Each round takes the smallest label of a neighbour, then the label of one's label."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct())
    labels = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("key"), F.least("u", "m").alias("label")))
    n = labels.count()
    while True:
        seen = key_join(edges, labels.select(F.col("key").alias("v"), "label"), "v", by="u", rows=n).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(seen, labels["key"] == seen["u"]).select("key", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = cut(step)
        jump = step.select(F.col("key").alias("label"), F.col("label").alias("next"))
        step = cut(key_join(step, jump, "label", by="key", rows=n).select("key", "old", F.col("next").alias("label")))
        if step.where(F.col("label") != F.col("old")).isEmpty():
            return step.select("key", "label")
        labels = step.select("key", "label")


def _ordered(x: str, y: str, *more: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), *more]


def classes(docs: DataFrame, near: Near) -> tuple[DataFrame, DataFrame]:
    """key, doc_id of every row; and for every key its class_id, class_size, and key and doc_id of the row that stands for the class."""
    members = written(sketches(docs, near), "sketches")
    reps = written(members.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "reps")
    banded = reps.where(F.size("bands") > 0).select("key", F.explode("bands").alias("band"))
    filled = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = cut(key_join(banded, filled, "band", by="key"))
    # The text that meets most others is likely the one that they were made from; a second centre is taken at random.
    met = shared.join(shared.groupBy("key").agg(F.sum("n").alias("met")), "key")
    first = F.max(F.struct("met", "key")).alias("first")
    second = F.max(F.struct(F.xxhash64("key").alias("h"), "key")).alias("second")
    centres = met.groupBy("band").agg(first, second).select("band", F.array("first.key", "second.key").alias("c"))
    pairs = key_join(shared.select("band", "key"), cut(centres), "band", by="key").select("key", F.explode("c").alias("c")).where("key != c")
    pairs = cut(pairs.select(*_ordered("key", "c")).distinct())
    texts = texts_of(shared.select("key").distinct(), docs, reps)
    links = verified(pairs, texts, near)
    labels = components(links)
    at = key_join(shared.select("band", "key"), labels, "key", "left").select("band", "key", F.coalesce("label", "key").alias("label"))
    several = at.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band")
    open_keys = key_join(at, cut(several), "band", by="key").select("key", "label").distinct()
    more = verified(cut(across(open_keys, texts, near).join(pairs, ["a", "b"], "left_anti")), texts, near)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = cut(key_join(reps.select("key", "doc_id", "copies"), labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("_no"), F.col("doc_id").alias("id"), "key")).alias("_s")
    found = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), stands)
    found = found.select("label", "class_id", "class_size", F.col("_s.key").alias("of_key"), F.col("_s.id").alias("of_id"))
    return members.select("key", "doc_id"), cut(key_join(named.select("key", "label"), cut(found), "label", by="key").drop("label"))


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, class_id, class_size for every row of docs (doc_id, text): rows of one class are linked by similar texts."""
    members, of_key = classes(docs, near)
    return key_join(members, of_key, "key", "left").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """docs without near copies: of each class the row with the smallest doc_id stays, or if none has an id, that with the smallest checksum of its text.

    Of rows with the same id and text one stays, whether the id is null or not: that whose
    columns have the smallest checksum.
    """
    members, of_key = classes(docs, near)
    each = cut(members.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows")))
    each = cut(key_join(each, of_key, "key", by="doc_id").withColumn("_stays", (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id"))))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), text_key().alias("_key"), F.col("doc_id").alias("_id"))

    def among(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select("key", F.col("doc_id").alias("id"))
        return rows.join(small(some, some.count()), (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("id")), how)

    out = among(whole, each.where("not _stays"), "left_anti")
    twice = each.where("_stays and rows > 1")
    if twice.isEmpty():
        return out.select("_row.*")
    once = among(out, twice, "left_semi").groupBy("_key", "_id").agg(F.min_by("_row", F.struct(F.xxhash64(F.to_json("_row")), F.md5(F.to_json("_row")))).alias("_row"))
    return among(out, twice, "left_anti").select("_row.*").union(once.select("_row.*"))
