"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to order three, counted over its training
texts and then frozen. A byte costs what it costs in the longest context that the tree
knows: -log2(c / (n + d)) if the byte was seen there c times (n: the context's count, d:
its distinct bytes), else the escape's -log2(d / (n + d)) and the cost in the context
shortened by a byte; below order zero all 256 bytes cost the same (escape method C). A
text's code length is exact: the sum over all its bytes. The shortest one names the
language, and the score is its share of probability among all of them.

As the trees are frozen, costs are tables: the three- and four-byte strings that any
language has seen are held by hash with exact comparison, for all languages at once, and
so are the escapes of three-byte contexts; below that two dense tables, of at most 257 x
257 pairs of bytes a language, do. Costs and sums are double precision. Rows are scored in
NumPy by those tables, a few thousand bytes at a time.

Training counts whole texts of at most about ``Ppm.texts`` documents a language, by a hash
of their id: the one bound. The strings they hold are counted before the tables are built;
if the tables would take more than ``Ppm.table_mb`` the sample is halved, so what is
broadcast is bounded for any number of languages. lang, source and doc_id play no part in
a prediction. Null texts and texts without letters are ``und`` with score 0. Null ids are
scored and count as held out of training. Repeated rows get equal results; ties go to the
first language by name. Without training rows all are ``und``. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

U = np.uint64
#: Characters of text that a task takes at once, and bytes that are looked up at once.
CHUNK, SLICE = 2 << 20, 1 << 16


@dataclass(frozen=True)
class Ppm:
    texts: int = 1500
    table_mb: int = 256


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes behind three zero bytes for each text, and where the texts' bytes begin."""
    raw = [b"\0\0\0" + t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size + 3


def grams(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte of each text, it and the three bytes before it, as one number."""
    b = buf.astype(np.uint32)
    four = b[3:] | b[2:-1] << 8 | b[1:-2] << 16 | b[:-3] << 24
    real = np.ones(len(buf), bool)
    for k in (1, 2, 3):
        real[starts - k] = False
    return four[real[3:]]


def chunks(texts: list[str]) -> list[np.ndarray]:
    """The numbers of the texts, in runs of about CHUNK characters."""
    ends = np.cumsum([len(t) for t in texts]) // CHUNK
    return np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1) if texts else []


def _counts(batches):
    for b in batches:
        lang, texts = b.column("lang").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
        for part in chunks(texts):
            for x in sorted({lang[i] for i in part}):
                gram, n = np.unique(grams(*joined([texts[i] for i in part if lang[i] == x])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Table:
    """Rows of numbers by key, in open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.tags, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros((1 << self.bits, values.shape[1]))
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # whoever finds its slot free takes it, the others go one on
            free = self.tags[at] < 0
            self.tags[at[free]] = left[free]
            won = self.tags[at] == left
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)
        held = self.tags >= 0
        self.values[held] = values[self.tags[held]]
        self.tags[held] = keys[self.tags[held]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U) * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of keys, and the places of those that it does not hold."""
        at = self._slot(keys)
        out = self.values[at]
        look, lost = np.flatnonzero(self.tags[at] != keys), []
        at = at[look]
        while len(look):
            none = self.tags[at] < 0
            lost.append(look[none])
            at, look = (at[~none] + 1) & ((1 << self.bits) - 1), look[~none]
            found = self.tags[at] == keys[look]
            out[look[found]] = self.values[at[found]]
            at, look = at[~found], look[~found]
        return out, np.concatenate(lost) if lost else look


class Model:
    """The frozen trees of all languages, as cost tables."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        L = len(self.langs)
        used = np.zeros(256, bool)
        for gram, _ in counts.values():
            for k in range(4):
                used[gram >> 8 * k & 255] = True
        self.byte = np.full(256, used.sum(), np.int64)  # all bytes never seen share one number
        self.byte[used] = np.arange(used.sum())
        self.K = K = int(used.sum()) + 1
        self.escape2, self.low = np.zeros((K * K, L)), np.zeros((K * K, L))
        seen3, seen4 = {}, {}
        for j, x in enumerate(self.langs):
            gram, n = counts[x]
            s, c1, c2 = (self.byte[gram >> 8 * k & 255] for k in range(3))
            cost = self._order(np.zeros_like(s), s, n, 1, np.full((1, K), 8.0))
            self.low[:, j] = self._order(c1, s, n, K, np.broadcast_to(cost, (K, K))).reshape(-1)
            three, at = np.unique(gram & 0xFFFFFF, return_inverse=True)
            seen3[x] = self._known(three, np.bincount(at, n))
            pair = self.byte[three >> 8 & 255] + K * self.byte[three >> 16 & 255]
            total, distinct = np.bincount(pair, np.bincount(at, n), minlength=K * K), np.bincount(pair, minlength=K * K)
            known = distinct > 0
            self.escape2[known, j] = -np.log2(distinct[known] / (total[known] + distinct[known]))
            seen4[x] = self._known(gram, n)
        every = np.unique(np.concatenate([g for g, *_ in seen3.values()])) if seen3 else np.zeros(0, np.int64)
        cost = self._cost2(every)
        for j, x in enumerate(self.langs):
            cost[np.searchsorted(every, seen3[x][0]), j] = seen3[x][1]
        self.three = Table(every.astype(np.int64), cost)
        every = np.unique(np.concatenate([g for _, _, g, _ in seen4.values()])) if seen4 else np.zeros(0, np.int64)
        escape = np.zeros((len(every), L))
        for j, x in enumerate(self.langs):
            escape[np.searchsorted(every, seen4[x][2]), j] = seen4[x][3]
        self.escape3 = Table(every.astype(np.int64), escape)
        every = np.unique(np.concatenate([g for g, *_ in seen4.values()])) if seen4 else np.zeros(0, np.int64)
        cost = self._cost3(every.astype(np.int64))
        for j, x in enumerate(self.langs):
            cost[np.searchsorted(every, seen4[x][0]), j] = seen4[x][1]
        self.four = Table(every.astype(np.int64), cost)

    def _order(self, context, symbol, n, contexts, lower):
        """Costs (contexts x symbols) of one order over those of the order below."""
        K = self.K
        seen = np.bincount(context * K + symbol, n, minlength=contexts * K).reshape(contexts, K)
        total, distinct = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
        whole = np.maximum(total + distinct, 1)
        escape = np.where(distinct > 0, -np.log2(np.maximum(distinct, 1) / whole), 0.0)
        return np.where(seen > 0, -np.log2(np.maximum(seen, 1) / whole), escape + lower)

    @staticmethod
    def _known(gram: np.ndarray, n: np.ndarray):
        """The strings seen and their costs; their contexts and the costs of an escape there."""
        context, at, distinct = np.unique(gram >> 8, return_inverse=True, return_counts=True)
        whole = np.bincount(at, n) + distinct
        return gram, -np.log2(n / whole[at]), context, -np.log2(distinct / whole)

    def _cost2(self, gram: np.ndarray) -> np.ndarray:
        """Costs of three-byte strings by the escape from order two."""
        s, c1, c2 = (self.byte[gram >> 8 * k & 255] for k in range(3))
        return self.escape2[c2 * self.K + c1] + self.low[c1 * self.K + s]

    def _cost3(self, gram: np.ndarray) -> np.ndarray:
        """Costs of four-byte strings by the escape from order three."""
        three = gram & 0xFFFFFF
        out, lost = self.three.get(three)
        out[lost] = self._cost2(three[lost])
        escape, none = self.escape3.get(gram >> 8)
        escape[none] = 0.0  # no language knows the context
        return out + escape

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each byte behind its context, for every language."""
        out, lost = self.four.get(gram)
        out[lost] = self._cost3(gram[lost])
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        buf, starts = joined(texts)
        gram = grams(buf, starts)
        ends = np.append(starts[1:], len(buf) + 3) - 3 * np.arange(1, len(texts) + 1) - 3
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(0, len(gram), SLICE):
            some = gram[k : k + SLICE].astype(np.int64)
            cost = self.costs(some)
            first = np.searchsorted(ends, k, side="right")
            doc = np.searchsorted(ends, np.arange(k, k + len(some)), side="right") - first
            for j in range(len(self.langs)):
                add = np.bincount(doc, cost[:, j])
                out[first : first + len(add), j] += add
        return out


def trained_on(doc_id: Column) -> Column:
    """Documents whose id's checksum is no multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def learned(docs: DataFrame, ppm: Ppm) -> Model:
    rows = docs.where(trained_on(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    h, texts = F.pmod(F.xxhash64("doc_id", F.lit("ppm")), F.lit(1 << 30)), ppm.texts
    while True:
        share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, texts / n) * (1 << 30)))])
        some = rows.where(h < F.element_at(share, F.col("lang"))).select("lang", "text")
        counted = cut(some.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
        strings = counted.agg(F.count_distinct("gram")).first()[0]
        if strings * (len(sizes) + 1) * 8 * 4 <= ppm.table_mb << 20 or texts <= 1:
            break
        texts //= 2
    counted = counted.toArrow()
    lang = np.array(counted.column("lang").to_pylist(), object)
    gram, n = counted.column("gram").to_numpy(), counted.column("n").to_numpy().astype(np.float64)
    return Model({x: (gram[lang == x], n[lang == x]) for x in sizes})


def predicted(docs: DataFrame, ppm: Ppm = Ppm()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, ppm))

    def run(batches):
        m = model.value
        for b in batches:
            texts = [t if on else "" for t, on in zip(b.column("text").to_pylist(), b.column("letters").to_pylist(), strict=True)]
            pred, score = [], []
            for part in chunks(texts):
                some = [texts[i] for i in part]
                if not m.langs:
                    pred, score = pred + ["und"] * len(some), score + [0.0] * len(some)
                    continue
                bits = m.lengths(some)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
                for t, k, p in zip(some, best, share, strict=True):
                    pred.append(m.langs[k] if t else "und")
                    score.append(float(p) if t else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True)).alias("held_out"), "text", letters.alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
