r"""Personal data by candidate gradient boosting.

Base spans (emails, IPv4 addresses, card numbers that pass Luhn, international phone
numbers) come from fixed formats and always stay. High-recall generators propose further,
overlapping candidates: addresses with a spelled-out at or dot, quads joined by commas, spaced,
bracketed or other dots, long digit runs with any separators, phone-like groups without a plus,
values assigned to words like token or password, long hexadecimal words. A candidate is a whole
run, however long. Boosted trees
(Spark ML) judge a candidate by its format and its context. They learn from weak labels of
candidates that touch no base span, as only these can be added: what was rewritten without
its format (spelled-out address, comma quad, dotted card, no plus, a secret without its
name) is positive in its own context, and so are candidates of confirmed form (spelled-out
address; behind a hint word: quad, Luhn, 9 to 15 digits of a phone) and long mixed values
assigned to a secret's name; all others are negative. On the half of the texts that the
trees have not seen, probabilities are calibrated for each kind by isotonic regression, and
the threshold of the kind is the lowest one with ``precision``; a kind without one adds
nothing. Of overlapping chosen candidates that with the higher calibrated probability
stays, and none may touch a base span.

Training, calibration and thresholds count the candidates of every distinct text, whole, and
those of ``Boost.made`` generated texts, half of them held out, with personal data of every kind
and numbers that are none. Equal candidates are one row with its count; generated ones count
several times where the table has more, so that both weigh about the same. So what is found does
not hang on the size of the table, nor on a kind's being in it. Every row is searched on its
whole text; time grows with its length.
Null and empty texts have no spans. Repeated rows get equal results, null ids stay null.
An empty table gives an empty result. Other columns are kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)


@dataclass(frozen=True)
class Boost:
    rounds: int = 20
    depth: int = 5
    precision: float = 0.98
    made: int = 2000


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every base format and every generator needs.
_ANY = re.compile(r"[0-9@=:\uff20]|[(\[{<]\x20?at\x20?[)\]}>]|\x20dot\x20", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base formats, sorted."""
    out, last = [], 0
    at = t.find("@")
    while at >= 0:  # the leftmost match at an at sign begins where the run of local characters before it does
        start = at
        while start > last and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at) if start < at else None
        if m:
            out.append((start, EMAIL, m.end()))
            last = m.end()
        at = t.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(t):
        d = digits_of(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(t):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


_NAMED = r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b[\x20\"']*+[:=][\x20\"']*+"
_SPELLED_AT = r"\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?|\x20at\x20|\uff20"
#: Dots other than the full stop: middle dot, one dot leader, bullet, ideographic and fullwidth ones.
_DOTS = "\u00b7\u2024\u2022\u3002\uff0e"
_SPELLED_DOT = rf"\x20?[(\[{{<]\x20?(?:dot|\.)\x20?[)\]}}>]\x20?|\x20dot\x20|[{_DOTS}]"
_AT = re.compile(rf"@|{_SPELLED_AT}", re.I)
_DOT = re.compile(_SPELLED_DOT, re.I)
_AFTER_AT = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_SPELLED_DOT})[A-Za-z0-9-]++)*+", re.I)
_BETWEEN = re.compile(rf"\x20?[(\[{{<]\x20?(?:dot|\.)\x20?[)\]}}>]\x20?|\x20dot\x20|\x20?[.,{_DOTS}]\x20?", re.I)
_QUAD = re.compile(rf"(?<![0-9])[0-9]++(?:(?:{_BETWEEN.pattern})[0-9]++){{3}}", re.I)
GENERATORS = (
    (IP, _QUAD),
    (CARD, re.compile(rf"(?<![0-9])[0-9](?:[\x20._/\u2010-\u2013{_DOTS}-]?[0-9]){{10,}}+")),
    (PHONE, re.compile(rf"(?<![0-9])[+(]?[0-9](?:[\x20()./\u2010-\u2013{_DOTS}-]{{0,2}}[0-9]){{6,}}+")),
    (SECRET, re.compile(_NAMED + r"([A-Za-z0-9_/+-]{6,}+)")),
    (SECRET, re.compile(r"(?<![A-Za-z0-9])(?=[a-f]*+[0-9])([0-9a-f]{20,}+)(?![A-Za-z0-9])")),
)
_NAME_BEFORE = re.compile(_NAMED + r"$")
_HINTS = (re.compile(r"(?i)mail|contact"), re.compile(r"(?i)\bip\b|address|host"), re.compile(r"(?i)card|pay|visa"), re.compile(r"(?i)phone|call|tel|fax"))
#: Names of the features, in the order of ``described``.
FEATURES = ("kind", "length", "digits", "letters", "upper", "marks", "spaces", "distinct", "entropy", "hex", "luhn", "quad", "plus", "at", "brackets", "groups", "named", "quoted", "hint", "word_before", "word_after", "digit_beside", "line_start", "canonical")


def candidates(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything the generators propose."""
    out, last = set(), 0
    for m in _AT.finditer(t):
        start = m.start()
        while start > last and t[start - 1] in _LOCAL:
            start -= 1
        last = m.end()
        domain = _AFTER_AT.match(t, last)
        # "at" as a word is one of many; a dot has to follow
        if start < m.start() and domain and (m[0].strip().lower() != "at" or "." in domain[0] or _DOT.search(domain[0])):
            out.add((start, EMAIL, domain.end()))
    for kind, p in GENERATORS:
        for m in p.finditer(t):
            g = 1 if p.groups else 0
            out.add((m.start(g), kind, m.end(g)))
    return sorted(out)


_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def plain(s: str, kind: int) -> str:
    """An address or quad with its separators written in one way, so that forms which were never taught look like those that were."""
    if kind == EMAIL:
        return _DOT.sub(".", _AT.sub("@", s))
    if kind == IP:
        return ".".join(_BETWEEN.split(s))
    return s


def canonical(s: str, kind: int) -> bool:
    """Whether a plainly written candidate is of its kind's format."""
    if kind == EMAIL:
        return bool(_ADDRESS.fullmatch(s))
    if kind == IP:
        parts = s.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    d = digits_of(s)
    return kind == CARD and 12 <= len(d) <= 19 and luhn(d) or kind == PHONE and 9 <= len(d) <= 15


def described(t: str, start: int, kind: int, end: int) -> list[float]:
    s, before, after = plain(t[start:end], kind), t[max(0, start - 24) : start], t[end : end + 2]
    d = digits_of(s)
    share = [s.count(c) / len(s) for c in set(s)]
    quad = kind == IP and canonical(s, IP)
    letters = sum(c.isalpha() for c in s)
    spaces = s.count(" ")
    return [
        kind,
        len(s),
        len(d),
        letters,
        sum(c.isupper() for c in s),
        len(s) - len(d) - letters - spaces,
        spaces,
        len(share),
        -sum(p * math.log2(p) for p in share),
        sum(c in "0123456789abcdefABCDEF" for c in s) / len(s),
        float(12 <= len(d) <= 19 and luhn(d)),
        float(quad),
        float(t[start] == "+" or before[-1:] == "+"),
        float("@" in s),
        float("(" in s or "[" in s),
        len(re.findall("[0-9]+" if kind in (CARD, PHONE) else r"[^\x20().-]+", s)),
        float(bool(_NAME_BEFORE.search(before))),
        float(before[-1:] in ('"', "'") and before != ""),
        float(kind < SECRET and bool(_HINTS[kind].search(before))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:].isdigit() or after[:1].isdigit()),
        float(start == 0 or before[-1:] == "\n"),
        float(canonical(s, kind)),
    ]


def weak_label(t: str, start: int, kind: int, end: int, seen: list[float]) -> int:
    """By evidence other than the base formats; for secrets by the assignment to a name."""
    value = t[start:end]
    f = dict(zip(FEATURES, seen, strict=True))
    if kind == EMAIL:
        return int("@" not in value and bool(f["canonical"]))
    if kind < SECRET:
        return int(bool(f["hint"]) and not f["digit_beside"] and bool((f["quad"], f["luhn"], 9 <= f["digits"] <= 15)[kind - IP]))
    return int(bool(f["named"]) and len(value) >= 16 and bool(re.search("[0-9]", value)) and bool(re.search("[A-Za-z]", value)))


class Cover:
    """What spans cover, as disjoint intervals."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for start, _, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, span: tuple[int, int, int]) -> bool:
        k = bisect_left(self.starts, span[2])
        return k > 0 and self.ends[k - 1] > span[0]

    def add(self, span: tuple[int, int, int]) -> None:
        """A span that touches nothing so far."""
        k = bisect_left(self.starts, span[0])
        self.starts.insert(k, span[0])
        self.ends.insert(k, span[2])


#: Forms that are taught, by kind: what stands for at and dot, between quads, between digits, before a phone's.
TAUGHT = {
    EMAIL: ((" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]")),
    IP: (",", "[.]", " . ", "(dot)"),
    CARD: (".", "_", "/"),
    PHONE: ("", "00"),
}


def rewritten(value: str, kind: int, form: int) -> str:
    """A base span in a form that is not its base format; a secret as it is."""
    if kind == SECRET:
        return value
    put = TAUGHT[kind][form % len(TAUGHT[kind])]
    if kind == EMAIL:
        local, domain = value.rsplit("@", 1)
        return local + put[0] + domain.replace(".", put[1])
    if kind == IP:
        return value.replace(".", put)
    if kind == CARD:
        d = digits_of(value)
        return put.join(d[k : k + 4] for k in range(0, len(d), 4))
    return put + value[1:]


def _card(rng: random.Random) -> str:
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return d + next(c for c in "0123456789" if luhn(d + c))


def generated(n: int, seed: int = 20) -> list[str]:
    """Texts of made-up words with an address, host, card, phone or secret each, or with numbers that are none."""
    rng = random.Random(seed)
    word = lambda low=2, high=9: "".join(rng.choice("aeiourstlnmdcpgbvfhk") for _ in range(rng.randint(low, high)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hints = {EMAIL: ("mail", "contact", "write to"), IP: ("host", "ip", "address"), CARD: ("card", "pay with", "visa"), PHONE: ("call", "phone", "tel")}
    out = []
    for i in range(n):
        kind = i % 7
        if kind == EMAIL:
            value = f"{word()}{rng.choice(['.', '_', '', '-'])}{word()}{rng.choice(['', digits(2)])}@{word(3)}.{rng.choice(['com', 'org', 'net', 'de', 'co.uk', 'example.org'])}"
        elif kind == IP:
            value = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        elif kind == CARD:
            c = _card(rng)
            value = rng.choice(["", " ", "-"]).join(c[k : k + 4] for k in range(0, 16, 4))
        elif kind == PHONE:
            mark = rng.choice("   -.")
            value = f"+{rng.randint(1, 99)}{mark}{rng.choice(['', '(0)'])}{digits(rng.randint(2, 4))}{mark}{digits(rng.randint(3, 5))}{rng.choice([mark, mark, ''])}{digits(rng.randint(2, 4))}"
        elif kind == SECRET:
            value = f"{rng.choice(['token', 'password', 'api_key', 'secret'])}{rng.choice([' = ', ': ', '='])}{''.join(rng.choice('0123456789abcdefABCDEFghkm') for _ in range(rng.randint(20, 40)))}7f"
        elif kind == 5:
            value = rng.choice([f"{digits(3)},{digits(3)},{digits(3)},{digits(3)}", f"{digits(rng.randint(7, 16))}", f"20{digits(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {digits(2)}:{digits(2)}", f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"])
        else:
            value = rng.choice([f"{word()} at {word()}. {word()}", f"{rng.randint(256, 999)}.{digits(3)}.{digits(2)}.{digits(1)}", f"{digits(1)}.{digits(1)}", f"{word()} at noon", "".join(rng.choice("ghijklmn0123") for _ in range(24))])
        lead = f"{rng.choice(hints[kind])} " if kind in hints and rng.random() < 0.6 else ""
        before, after = (" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(2))
        out.append(rng.choice([f"{before} {lead}{value} {after}", f"{before} {lead}{value}.", f"{lead}{value}", f"{before}\n{lead}{value}\n{after}"]))
    return out


def examples(t: str) -> Iterator[tuple[list[float], int, int]]:
    """Features, label and kind of the candidates to learn from."""
    base = base_spans(t)
    covered = Cover(base)
    sources = [(s, s, kind, e) for s, kind, e in base]
    for c in candidates(t):
        if not covered.touches(c):
            seen = described(t, *c)
            label = weak_label(t, *c, seen)
            yield seen, label, c[1]
            name = _NAME_BEFORE.search(t[max(0, c[0] - 24) : c[0]])
            if c[1] == SECRET and label and name:
                sources.append((c[0] - len(name[0]), *c))
    for before, s, kind, e in sources:
        near = t[max(0, before - 64) : before]
        new = rewritten(t[s:e], kind, s)
        span, local = (len(near), kind, len(near) + len(new)), near + new + t[e : e + 64]
        here = Cover([span])
        if not Cover(base_spans(local)).touches(span):
            for c in candidates(local):
                if here.touches(c):
                    yield described(local, *c), int(c == span), c[1]


class Trees:
    """Boosted trees as plain tuples: (feature, threshold, left, right) or a leaf's value."""

    def __init__(self, model):
        def node(n):
            if n.subtreeDepth() == 0:
                return n.prediction()
            s = n.split()
            return s.featureIndex(), s.threshold(), node(n.leftChild()), node(n.rightChild())

        self.trees = [(w, node(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))

        def walk(n, rows, w):
            if not len(rows):
                return
            if not isinstance(n, tuple):
                margin[rows] += w * n
                return
            low = x[rows, n[0]] <= n[1]
            walk(n[2], rows[low], w)
            walk(n[3], rows[~low], w)

        for w, t in self.trees:
            walk(t, np.arange(len(x)), w)
        return 1 / (1 + np.exp(-2 * margin))


#: Steps of probability in which held-out candidates are counted.
STEPS = 1000


@dataclass(frozen=True)
class Judge:
    """The trees, and for each kind that may add spans its threshold (a step) and calibrated probability by step."""

    trees: Trees | None
    thresholds: dict[int, int]
    calibrated: dict[int, list[float]]

    def judged(self, t: str, spans: list[tuple[int, int, int]]) -> list[tuple[float, tuple[int, int, int]]]:
        """Calibrated probability and span of those that reach the threshold of their kind."""
        at = steps(self.trees.probability(np.array([described(t, *c) for c in spans], float)))
        return [(self.calibrated[c[1]][k], c) for k, c in zip(at.tolist(), spans, strict=True) if k >= self.thresholds[c[1]]]


def steps(p: np.ndarray) -> np.ndarray:
    return np.minimum((p * STEPS).astype(np.int64), STEPS - 1)


def isotonic(n: np.ndarray, hits: np.ndarray) -> list[float]:
    """The rising step function nearest to the share of hits, by pooling neighbours that fall; steps without rows follow the one below."""
    pools = []  # rows, hits, first step
    for k in np.flatnonzero(n):
        pools.append([int(n[k]), int(hits[k]), int(k)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            rows, hit, _ = pools.pop()
            pools[-1][0] += rows
            pools[-1][1] += hit
    out = np.zeros(len(n))
    for rows, hit, k in pools:
        out[k:] = hit / rows
    return out.tolist()


#: Examples in a batch, as a text may hold any number.
BATCH = 4096


def _train(batches):
    names, types = ["key", "place", "x", "label", "kind", "half", "made"], [pa.binary(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], names)

    out = []
    for b in batches:
        for t, half in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True):
            if not t or not _ANY.search(t):
                continue
            key, made = hashlib.md5(t.encode()).digest(), half is not None
            for place, x in enumerate(examples(t)):
                out.append((key, place, *x, half if made else key[0] & 1, made))
                if len(out) == BATCH:
                    yield batch(out)
                    out = []
    yield batch(out)


def _held(trees: Trees):
    def run(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("label"), b.column("weight"), pa.array(steps(trees.probability(x)))], ["kind", "label", "weight", "step"])

    return run


def learned(docs: DataFrame, boost: Boost) -> DataFrame:
    """The examples of all distinct texts and of the generated ones (made): features, label, kind, half and how many are like that."""
    rows = docs.where("text is not null").select("text", F.lit(None).cast("int").alias("half"))
    made = docs.sparkSession.createDataFrame([(t, i // 7 % 2) for i, t in enumerate(generated(boost.made))], "text string, half int")
    each = rows.unionByName(made).mapInArrow(_train, "key binary, place int, x array<double>, label int, kind int, half int, made boolean").distinct()
    return each.groupBy("x", "label", "kind", "half", "made").agg(F.count(F.lit(1)).alias("n"))


#: The most bins whose square is an int.
MOST_BINS = 46_340


def fitted(docs: DataFrame, boost: Boost) -> Judge:
    """Trees from one half of all texts, calibration and thresholds from counts over the other half."""
    seen = written(learned(docs, boost), "pii-train")
    first, table, made = seen.agg(F.count_if(F.col("half") == 0), *[F.coalesce(F.sum(F.when(F.col("made") == m, F.col("n"))), F.lit(0)) for m in (False, True)]).first()
    seen = seen.withColumn("weight", F.col("n") * F.when(F.col("made"), max(1, round(table / max(made, 1)))).otherwise(1))
    learn = seen.where("half = 0").select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double"))
    # MLlib looks for splits in a sample of maxBins squared rows; with as many as there are it takes all
    bins = max(32, min(MOST_BINS, math.isqrt(first) + 1))
    trees = Trees(GBTClassifier(maxIter=boost.rounds, maxDepth=boost.depth, maxBins=bins, weightCol="weight", seed=7).fit(learn))
    counted = seen.where("half = 1").select("x", "label", "kind", "weight").mapInArrow(_held(trees), "kind int, label int, weight long, step long")
    count, hit = np.zeros((len(KINDS), STEPS), np.int64), np.zeros((len(KINDS), STEPS), np.int64)
    for r in counted.groupBy("kind", "step").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("hits")).collect():  # kinds x STEPS rows at most
        count[r.kind, r.step], hit[r.kind, r.step] = r.n, r.hits
    thresholds, calibrated = {}, {}
    for k in range(len(KINDS)):
        above, hits = (np.cumsum(x[k][::-1])[::-1] for x in (count, hit))
        scale = isotonic(count[k], hit[k])
        good = np.flatnonzero((count[k] > 0) & (hits >= boost.precision * above) & (np.array(scale) > 0.5))
        if len(good):
            thresholds[k], calibrated[k] = int(good[0]), scale
    return Judge(trees, thresholds, calibrated)


def spans_of(t: str, judge: Judge) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and those together with the added ones."""
    if not _ANY.search(t):
        return [], []
    base = base_spans(t)
    if not judge.thresholds:
        return base, base
    covered = Cover(base)
    more = [c for c in candidates(t) if c[1] in judge.thresholds and not covered.touches(c)]
    if not more:
        return base, base
    chosen = list(base)
    for _, c in sorted((-p, c) for p, c in judge.judged(t, more)):
        if not covered.touches(c):
            covered.add(c)
            chosen.append(c)
    return base, sorted(chosen)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def found(docs: DataFrame, boost: Boost = Boost()) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, all spans, and the counts of secrets and of all spans for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, boost))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                base, every = spans_of(t or "", model.value)
                n = [sum(k == kind for _, k, _ in base) for kind in range(SECRET)]
                out.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), sum(k == SECRET for _, k, _ in every), len(every)))
            cols = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, ty) for c, ty in zip(cols, types, strict=True)]], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, boost: Boost = Boost(), to: str = "redacted") -> DataFrame:
    """docs with the text in which every span stands as its kind in square brackets. Of overlapping spans the first is named."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, boost))

    @F.pandas_udf("string")
    def redact(text):
        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for s, k, e in spans_of(t, model.value)[1]:
                if s >= at:
                    out += [t[at:s], f"[{KINDS[k]}]"]
                at = max(at, e)
            return "".join(out) + t[at:]

        return text.map(one, na_action=None)

    return docs.withColumn(to, redact("text"))
