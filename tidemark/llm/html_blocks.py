"""Main text of web pages: a bidirectional LSTM labels every block of a page.

A page is cut into blocks, the runs of text between block elements. A block is described by its
tag path (elements, and the words of their class, id and role), its words by hash, and a few
measures. The network reads a page's whole sequence of blocks in both directions and tells for
each whether it belongs to the article; those that do are joined, in page order.

There are no labels. Training pages are a sample of pages with landmark elements: there, blocks
inside ``article`` or ``main`` and outside ``nav``, ``aside`` and the like are the article. Each
such page is also laid out anew several times, its texts set into other elements and class
names, with and without landmarks, notices, forms, adverts and comments among them; so the
network learns what such names, places and texts mean together, not one layout.

The sample is bounded (``Labeller.pages``, of ``Labeller.chars`` at most); every page is labelled,
from its whole text. The weights take 0.2 MB and are sent to the tasks with their code. A task
holds an Arrow batch and the blocks of ``GROUP`` characters of pages, at least one page.

Defined results. Null and empty pages, and pages without article, have an empty text. Broken
markup is read as browsers do in the main: unclosed elements end with their parents, stray end
tags are ignored, an unfinished tag at the end is dropped, after a quote that stays open tags end
at the next ``>``. Text in scripts, styles, templates,
titles and drawings is markup. A line break inside a block is white space. Equal pages have equal
texts, null ids are kept. Without any page to learn from, layouts of generated words are learnt.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of pages whose blocks are labelled together.
GROUP = 4_000_000

#: Steps whose gate inputs are held at once.
STEPS = 2048


@dataclass(frozen=True)
class Labeller:
    #: Training pages at most, and their characters at most.
    pages: int = 240
    chars: int = 100_000
    #: Blocks of a training sequence at most: a window of the page.
    window: int = 96
    #: New layouts of training pages, and copies with their texts dealt anew to their blocks; each page has its part.
    layouts: int = 1500
    shuffles: int = 500
    epochs: int = 12
    batch: int = 24
    rate: float = 0.01
    #: Decay of the words' vectors: what a text is called weighs more than what it says.
    decay: float = 1.0
    path_buckets: int = 1024
    word_buckets: int = 512
    width: int = 24
    hidden: int = 16
    seed: int = 7


# Blocks ------------------------------------------------------------------------------------

#: Fixed values of HTML: elements that break text into blocks, that have no content, and whose content is not text of the page.
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object".split())
#: Elements nested deeper are not seen in paths.
DEPTH = 512
#: What a start tag ends, unless an element of the second list stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_P, _A, _P_BORDERS, _NO_BORDERS = {"p"}, {"a"}, {"td", "th", "caption", "button", "object"}, frozenset()

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: For the rest of a page in which a quote stays open.
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_TAG_START = re.compile(r"</?[a-zA-Z]")
_COMMENT_END = re.compile(r"--!?>")
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0


def _named(tag: str, attributes: str) -> str:
    """The element and the words of its class, id and role."""
    words = [w.lower() for m in _NAMED.finditer(attributes) for w in _WORD.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or ""))]
    return " ".join([tag, *dict.fromkeys(words)])


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space turned into single spaces, references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    run: list[str] = []
    linked, anchors, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            out.append(Block(tuple(name for _, name in stack), text, linked))
        run.clear()
        linked = 0

    def pop(tags: set[str], borders: set[str] | frozenset[str] = _NO_BORDERS) -> None:
        """Ends the innermost element of these, and all inside it, unless a border stands between."""
        nonlocal anchors
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                anchors -= sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in borders:
                return

    def say(text: str) -> None:
        nonlocal linked
        run.append(text)
        if anchors:
            linked += len(text)

    pattern = _TAG
    while at < n:
        low = page.find("<", at)
        say(page[at:low] if low >= 0 else page[at:])
        if low < 0:
            break
        if not _TAG_START.match(page, low):
            if page.startswith("<!--", low):
                m = _COMMENT_END.search(page, low + 4)
                at = m.end() if m else n
            elif page[low + 1 : low + 2] in ("!", "?", "/"):
                at = page.find(">", low) + 1 or n
            else:
                say("<")
                at = low + 1
            continue
        m = pattern.match(page, low)
        if not m:
            pattern = _LOOSE_TAG
            m = pattern.match(page, low)
        if not m:
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            elif tag in ("br", "p"):
                say(" ")
            if tag not in VOID:
                pop({tag})
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else n
        elif tag in VOID:
            if tag in BLOCK:
                flush()
            say(" ")
        else:
            if tag in BLOCK:
                flush()
                pop(_P, _P_BORDERS)
                if tag in ENDS:
                    pop(*ENDS[tag])
            if tag == "a":
                pop(_A)
                anchors += len(stack) < DEPTH
            if len(stack) < DEPTH:
                stack.append((tag, _named(tag, m[3])))
    flush()
    return out


# Features ----------------------------------------------------------------------------------

#: Measures of a block beside its path and words.
MEASURES = 6


def _hash(s: str, buckets: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % buckets


def path_tokens(path: tuple[str, ...]) -> list[str]:
    """Elements and names anywhere above the block, and the innermost element."""
    said = {w if i == 0 else "." + w for name in path for i, w in enumerate(name.split(" "))}
    inner = next((name.split(" ")[0] for name in reversed(path) if name.split(" ")[0] in BLOCK), "")
    return sorted(said) + [f">{inner}"]


def measures(b: Block, place: float) -> list[float]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    return [np.log1p(words) / 4, min(1.0, b.linked / n), b.text[-1] in ".!?…。", sum(map(b.text.count, ",.;:!?")) / words, place, "©" in b.text]


@dataclass
class Features:
    """Features of a list of blocks: bucket numbers with the block that each starts at, word shares, measures."""

    paths: np.ndarray
    path_of: np.ndarray
    words: np.ndarray
    share: np.ndarray
    word_of: np.ndarray
    measures: np.ndarray

    def __len__(self) -> int:
        return len(self.measures)


def features(page: list[Block], how: Labeller, known: dict) -> Features:
    """``known`` keeps the buckets of paths and words between calls."""
    paths, path_of, words, share, word_of = [], [], [], [], []
    for i, b in enumerate(page):
        p = known.get(b.path)
        if p is None:
            p = known[b.path] = [_hash(t, how.path_buckets) for t in path_tokens(b.path)]
        paths += p
        path_of += [i] * len(p)
        seen = Counter(b.text.lower().split(" "))
        scale = 1 / np.sqrt(8 + sum(c * c for c in seen.values()))  # few words say little
        for w, c in seen.items():
            k = known.get(w)
            if k is None:
                k = known[w] = _hash(w, how.word_buckets)
            words.append(k)
            share.append(c * scale)
        word_of += [i] * len(seen)
    m = [measures(b, i / max(1, len(page) - 1)) for i, b in enumerate(page)]
    return Features(*(np.array(a, np.int64) for a in (paths, path_of, words)), np.array(share), np.array(word_of, np.int64), np.array(m, float).reshape(-1, MEASURES))


# Network -----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _flipped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence reversed within its length."""
    t = np.arange(x.shape[1])[None, :]
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return np.take_along_axis(x, at[:, :, None], 1)


def _lstm(x: np.ndarray, w: dict, side: str, keep: bool = False):
    """Hidden states of sequences (b, t, width), padding after their ends; with ``keep``, also what the way back needs."""
    b, n, _ = x.shape
    hidden = len(w[f"{side}_h"])
    h, c = np.zeros((b, hidden)), np.zeros((b, hidden))
    out, kept = np.empty((b, n, hidden)), []
    for low in range(0, n, STEPS):
        gates = x[:, low : low + STEPS] @ w[f"{side}_x"] + w[f"{side}_b"]
        for t in range(gates.shape[1]):
            z = gates[:, t] + h @ w[f"{side}_h"]
            s = _sigmoid(z[:, : 3 * hidden])
            i, f, o, g = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :], np.tanh(z[:, 3 * hidden :])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, low + t] = h
            if keep:
                kept.append((*before, i, f, o, g, tc))
    return out, kept


def _lstm_back(x: np.ndarray, w: dict, side: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
    b, n, hidden = dout.shape
    dh, dc = np.zeros((b, hidden)), np.zeros((b, hidden))
    dz = np.empty((b, n, 4 * hidden))
    states = np.empty((b, n, hidden))
    for t in range(n - 1, -1, -1):
        h0, c0, i, f, o, g, tc = kept[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        states[:, t] = h0
        dh = dz[:, t] @ w[f"{side}_h"].T
        dc = dc * f
    grad[f"{side}_x"] = np.tensordot(x, dz, ([0, 1], [0, 1]))
    grad[f"{side}_h"] = np.tensordot(states, dz, ([0, 1], [0, 1]))
    grad[f"{side}_b"] = dz.sum((0, 1))
    return dz @ w[f"{side}_x"].T


def started(how: Labeller) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(how.seed)
    d, h = how.width, how.hidden
    w = {"path": rng.normal(0, 0.3, (how.path_buckets, d)), "word": rng.normal(0, 0.1, (how.word_buckets, d)), "measure": rng.normal(0, 0.3, (MEASURES, d)), "in_b": np.zeros(d)}
    for side in ("ahead", "back"):
        w[f"{side}_x"] = rng.normal(0, d**-0.5, (d, 4 * h))
        w[f"{side}_h"] = rng.normal(0, h**-0.5, (h, 4 * h))
        w[f"{side}_b"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]
    w["out"] = rng.normal(0, 0.1, 2 * h + d)
    w["out_b"] = np.zeros(1)
    return w


def _inputs(f: Features, w: dict) -> np.ndarray:
    x = f.measures @ w["measure"] + w["in_b"]
    for rows, of, scale in ((w["path"][f.paths], f.path_of, 0.5), (w["word"][f.words] * f.share[:, None], f.word_of, 1.0)):
        if len(of):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            x[of[starts]] += scale * np.add.reduceat(rows, starts, axis=0)
    return np.tanh(x)


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in xs])
    out = np.zeros((len(xs), lengths.max(), xs[0].shape[1]))
    for row, x in zip(out, xs, strict=True):
        row[: len(x)] = x
    return out, lengths


def labelled(pages: list[Features], w: dict) -> list[np.ndarray]:
    """Probability of being article for every block of every page; pages of about equal length go together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    for _, some in groupby(enumerate(order), key=lambda k: (k[0] // 256, len(pages[k[1]]).bit_length())):
        at = [i for _, i in some]
        x, lengths = _padded([_inputs(pages[i], w) for i in at])
        ahead, _ = _lstm(x, w, "ahead")
        back, _ = _lstm(_flipped(x, lengths), w, "back")
        z = np.concatenate([ahead, _flipped(back, lengths), x], 2) @ w["out"] + w["out_b"]
        for k, i in enumerate(at):
            out[i] = _sigmoid(z[k, : lengths[k]])
    return out


def fitted(examples: list[tuple[Features, np.ndarray]], how: Labeller) -> dict[str, np.ndarray]:
    """Weights after ``epochs`` rounds of Adam on cross-entropy, averaged over the last third; path names, words and their vectors are dropped out at random."""
    rng = np.random.default_rng(how.seed)
    w = started(how)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    mean, averaged = {k: np.zeros_like(v) for k, v in w.items()}, 0
    order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]))
    batches = [order[i : i + how.batch] for i in range(0, len(order), how.batch)]
    for epoch in range(how.epochs):
        rate = how.rate * (1 - epoch / how.epochs)
        for k in rng.permutation(len(batches)):
            some = [examples[i] for i in batches[k]]
            fs = [_thinned(f, rng) for f, _ in some]
            xs = [_inputs(f, w) for f in fs]
            x, lengths = _padded(xs)
            mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
            flipped = _flipped(x, lengths)
            ahead, kept_a = _lstm(x, w, "ahead", keep=True)
            back, kept_b = _lstm(flipped, w, "back", keep=True)
            top = np.concatenate([ahead, _flipped(back, lengths), x], 2)
            y, _ = _padded([label[:, None] for _, label in some])
            dz = (_sigmoid(top @ w["out"] + w["out_b"]) - y[:, :, 0]) * mask / mask.sum()
            grad = {"out": np.tensordot(dz, top, ([0, 1], [0, 1])), "out_b": dz.sum(keepdims=True)[0]}
            dtop = dz[:, :, None] * w["out"]
            h = how.hidden
            dx = dtop[:, :, 2 * h :] + _lstm_back(x, w, "ahead", kept_a, dtop[:, :, :h], grad)
            dx = dx + _flipped(_lstm_back(flipped, w, "back", kept_b, _flipped(dtop[:, :, h : 2 * h], lengths), grad), lengths)
            dx = dx * (1 - x * x) * mask[:, :, None]
            grad |= {"path": np.zeros_like(w["path"]), "word": np.zeros_like(w["word"]), "measure": np.zeros_like(w["measure"]), "in_b": dx.sum((0, 1))}
            for f, d in zip(fs, dx, strict=True):
                np.add.at(grad["path"], f.paths, 0.5 * d[f.path_of])
                np.add.at(grad["word"], f.words, d[f.word_of] * f.share[:, None])
                grad["measure"] += f.measures.T @ d[: len(f)]
            step += 1
            for name, g in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                w[name] = w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
            w["word"] = w["word"] * (1 - rate * how.decay)
            if 3 * epoch >= 2 * how.epochs:
                averaged += 1
                mean = {name: m + w[name] for name, m in mean.items()}
    return {name: m / averaged for name, m in mean.items()}


def _thinned(f: Features, rng: np.random.Generator) -> Features:
    p, q = rng.random(len(f.paths)) > 0.04, rng.random(len(f.words)) > 0.2
    mute = rng.random(len(f)) < 0.5
    q &= ~mute[f.word_of] if len(f.word_of) else q
    return Features(f.paths[p], f.path_of[p], f.words[q], f.share[q], f.word_of[q], f.measures)


# Training pages ----------------------------------------------------------------------------

#: What the parts of a page other than the article are called: elements, then names.
PARTS = {
    "menu": ("nav ul div header td", "nav navbar navigation menu mainmenu breadcrumb breadcrumbs topbar toc pagination tabs links"),
    "header": ("header div section", "header masthead siteheader top branding logo hero banner"),
    "footer": ("footer div section", "footer bottom copyright legal colophon imprint sitefooter"),
    "sidebar": ("aside div section td", "sidebar side widget related recommended aside rail popular trending teaser more tags"),
    "notice": ("div section dialog aside p", "cookie cookies consent notice gdpr alert popup modal overlay privacy warning message newsletter disclaimer"),
    "advert": ("div ins aside section", "ad ads advert advertisement adverts sponsored sponsor promo promotion adsense commercial banner"),
    "form": ("form fieldset", "form search login signup subscribe contact newsletter register"),
    "comments": ("section div ol ul article", "comments comment reply replies discussion responses respond thread disqus commentlist reader"),
    "share": ("div ul p", "share social sharing follow buttons author byline meta"),
}
ARTICLE = ("article main div section td", "article content main post entry story body text articlebody maincontent page single")
WRAPPERS = ("div", "section", "main", "div wrapper", "div container", "div page", "div row", "div layout", "div site", "div inner", "td", "div col")
OUTSIDE = frozenset("nav aside footer form dialog button select label fieldset option optgroup menu".split())
#: Short texts of such parts, by way of example; texts of the pages themselves are used as well.
SAYINGS = {
    "notice": ["We use cookies to improve your experience.", "This site uses cookies. By continuing you accept them.", "Accept all", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Usamos cookies."],
    "footer": ["© 2024 All rights reserved.", "Copyright", "Privacy policy", "Imprint", "Terms of use", "Contact"],
    "form": ["Search", "Your name", "Email", "Send", "Log in", "Subscribe to our newsletter", "Submit"],
    "comments": ["Comments", "3 comments", "Reply", "Leave a reply", "I agree with this.", "Thanks for sharing!", "anna wrote:", "Posted by guest"],
    "share": ["Share", "Tweet", "Follow us", "By the editors", "Updated yesterday"],
    "menu": ["Home", "About", "News", "Contact", "Archive", "Next", "Previous"],
    "header": ["Daily news", "Welcome", "The site"],
    "sidebar": ["Related articles", "Most read", "Recent posts", "Categories", "Tags", "See also"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Limited offer", "Shop today and save."],
}


def taught(page: list[Block]) -> np.ndarray | None:
    """Labels of a page with landmarks: inside ``article`` or ``main`` and not inside a part that is something else; None without landmarks."""
    tags = [[name.split(" ") for name in b.path] for b in page]
    if not any(n[0] in ("article", "main") for p in tags for n in p):
        return None
    named = {w for _, names in PARTS.values() for w in names.split()} - set(ARTICLE[1].split())
    label = np.zeros(len(page))
    for i, p in enumerate(tags):
        at = max((k for k, n in enumerate(p) if n[0] in ("article", "main")), default=None)
        if at is not None:
            label[i] = not any(n[0] in OUTSIDE for n in p) and not any(w in named for n in p for w in n[1:]) and not any(n[0] == "header" for n in p[:at])
    return label


def _pseudo(rng: np.random.Generator, n: int) -> str:
    return " ".join("".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 9))) for _ in range(n)).capitalize() + "."


def laid_out(main: list[str], rest: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The article's texts in a layout drawn at random, with other parts around, between and after them."""
    pick = lambda xs: str(rng.choice(xs))
    outer = ["html", pick(["body", "body", "body home", "body page"])] + [pick(WRAPPERS) for _ in range(rng.integers(0, 3))]
    out: list[tuple[Block, float]] = []

    def named(tag: str, names: str, often: float) -> str:
        words = [tag]
        if rng.random() < often:
            words += [pick(names.split()) for _ in range(rng.integers(1, 3))]
            words += [pick(["wrapper", "box", "block", "inner", "area", "site", "left", "item", "x"])] if rng.random() < 0.3 else []
        return " ".join(words)

    def part(kind: str, path: list[str]) -> None:
        tags, names = PARTS[kind]
        tag = pick(tags.split())
        plain = tag in ("nav", "footer", "aside", "form", "header") or (kind in ("menu", "footer") and rng.random() < 0.1)
        at = [*path, named(tag, names, 0.6 if plain else 1.0)]
        like = kind in ("advert", "comments", "sidebar", "notice")
        for _ in range(int(rng.integers(1, 8 if kind in ("menu", "comments", "sidebar") else 4))):
            said = pick(SAYINGS[kind]) if rng.random() < 0.45 or not rest else pick(main) if like and main and rng.random() < 0.6 else pick(rest)
            inner = {"menu": ["ul", "li", "a"], "comments": [pick(["li", "div comment", "article comment", "div"]), "p"], "form": [pick(["label", "p", "div", "button"])]}.get(kind, [pick(["p", "div", "ul", "h3", "span"])])
            inner = inner if rng.random() < 0.8 else []
            linked = len(said) if "a" in inner or rng.random() < 0.2 else 0
            out.append((Block((*at, *inner), said, linked), 0.0))

    before = [k for k in ("menu", "header", "notice", "advert", "form", "sidebar", "share") if rng.random() < 0.45]
    after = [k for k in ("advert", "comments", "share", "sidebar", "form", "notice", "menu", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    for kind in before:
        part(kind, outer)
    tag = pick(ARTICLE[0].split())
    own = [*outer, named(tag, ARTICLE[1], 0.7 if tag != "div" else 0.85)] + [pick(["div", "div body", "section", "div text", "div content"]) for _ in range(rng.integers(0, 2))]
    for i, text in enumerate(main):
        if rng.random() < 0.3:  # articles have short lines, too
            text = " ".join(text.split(" ")[: rng.integers(1, 12)])
        if i and rng.random() < 0.15:
            part(pick(["advert", "share", "sidebar", "notice"]), own)
        inner = [pick(["h1", "h1", "h2", "header h"])] if i == 0 else [pick(["p", "p", "p", "p", "p", "div", "blockquote", "ul", "h2", "h3", "td", "pre", "figcaption", "dd"])]
        inner = ["header", "h1"] if inner == ["header h"] else ["ul", "li"] if inner == ["ul"] else inner
        inner = [] if rng.random() < 0.05 else inner
        out.append((Block((*own, *inner, *(["b"] if rng.random() < 0.1 else [])), text, len(text) if rng.random() < 0.02 else 0), 1.0))
    for kind in after:
        part(kind, own if rng.random() < 0.25 else outer)
    return [b for b, _ in out], np.array([y for _, y in out])


def examples(pages: list[str], how: Labeller) -> list[tuple[Features, np.ndarray]]:
    rng = np.random.default_rng(how.seed)
    known: dict = {}
    out = []

    def add(page: list[Block], label: np.ndarray) -> None:
        low = int(rng.integers(0, max(1, len(page) - how.window + 1)))
        f = features(page, how, known)
        if len(page) > how.window:  # measures keep the place in the whole page
            part = features(page[low : low + how.window], how, known)
            part.measures[:, 4] = f.measures[low : low + how.window, 4]
            f = part
        out.append((f, label[low : low + how.window]))

    cut = [(page, label) for page in map(blocks, pages) if (label := taught(page)) is not None and label.any()]
    texts = []
    for page, label in cut:
        for k in range(-(-how.shuffles // len(cut)) + 1):  # texts change places, so that what an element is called outweighs the words
            order = rng.permutation(len(page)) if k else range(len(page))
            add([Block(b.path, page[i].text, b.linked and len(page[i].text)) for b, i in zip(page, order, strict=True)], label)
        texts.append(([b.text for b, y in zip(page, label, strict=True) if y], [b.text for b, y in zip(page, label, strict=True) if not y]))
    while len(texts) < 40:
        texts.append(([_pseudo(rng, int(rng.integers(3, 60))) for _ in range(rng.integers(1, 12))], [_pseudo(rng, int(rng.integers(1, 8))) for _ in range(6)]))
    for main, rest in texts:
        for _ in range(-(-how.layouts // len(texts))):
            n = int(rng.integers(1, min(len(main), 16) + 1))
            low = int(rng.integers(0, len(main) - n + 1))
            add(*laid_out(main[low : low + n], rest, rng))
    return out


# Spark -------------------------------------------------------------------------------------


def trained(pages: DataFrame, how: Labeller) -> dict[str, np.ndarray]:
    """The weights, fitted in one task on distinct pages of least hash."""
    some = pages.where(F.length("html").between(1, how.chars)).select(F.xxhash64("html").alias("h"), "html")
    least = some.select("h").distinct().orderBy("h").limit(how.pages)
    some = some.join(F.broadcast(least), "h").groupBy("h").agg(F.min("html").alias("html")).orderBy("h").coalesce(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column(1).to_pylist()]
        w = fitted(examples(texts, how), how)
        yield pa.RecordBatch.from_pydict({"name": list(w), "w": [v.astype(np.float64).tobytes() for v in w.values()], "shape": [list(v.shape) for v in w.values()]}, pa.schema([("name", pa.string()), ("w", pa.binary()), ("shape", pa.list_(pa.int32()))]))

    rows = some.mapInArrow(fit, "name string, w binary, shape array<int>").collect()
    if not rows:  # no partition, so no task
        return fitted(examples([], how), how)
    return {r["name"]: np.frombuffer(r["w"]).reshape(r["shape"]) for r in rows}


def main_text(page: list[Block], p: np.ndarray) -> str:
    return "\n".join(b.text for b, y in zip(page, p, strict=True) if y > 0.5)


def _grouped(pages: list[str | None]) -> Iterator[tuple[int, int]]:
    low = chars = 0
    for i, t in enumerate(pages):
        chars += len(t or "")
        if chars > GROUP and i > low:
            yield low, i
            low, chars = i, len(t or "")
    yield low, len(pages)


def extracted(pages: DataFrame, how: Labeller = Labeller()) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select("page_id", "url", "html")
    weights = pages.sparkSession.sparkContext.broadcast(trained(pages, how))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for low, high in _grouped(batch.column(2).to_pylist()):
                part = batch.slice(low, high - low)
                if len(known) > 200_000:
                    known.clear()
                found = [blocks(t or "") for t in part.column(2).to_pylist()]
                told = labelled([features(p, how, known) for p in found], weights.value)
                texts = [main_text(p, y) for p, y in zip(found, told, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(label, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
