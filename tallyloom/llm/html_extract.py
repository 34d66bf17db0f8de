"""Main text of web pages: a bidirectional LSTM in numpy labels the sequence of a page's blocks.

A page is cut into leaf blocks: text between the borders of block elements, with the path of open elements above it. A block's
vector is the mean of learned vectors of its hashed path tokens (element names, words of class and id) beside the mean of
learned vectors of its hashed words, and four numbers (length, share of linked words, place, end mark). The network reads the
blocks of the whole page in both directions and labels each as main text or not.

It is trained here, on at most ``SAMPLE`` pages (those with the smallest hashes; the bound does not depend on the
input). Labels come from the elements that say what they hold (``article`` and ``main`` against ``nav``,
``header``, ``footer``, ``aside``, ``form`` and classes of adverts, notices and comments). So that labels do not hang on
these names alone, training pages are also rewritten: elements take other names and classes in use, lose them, and more
menus, notices, forms, sidebars, adverts and reader comments made from other pages' text are put around the article.

White space inside a block, as Unicode has it, becomes one space; blocks without text are none. Null or empty pages have the
empty text. Repeated rows are extracted each. A page that names no main text is not taught as one without; where no page
names it, long text outside other parts is the article of the rewritten pages. Without any training page nothing is taken as
main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, split_words

SAMPLE = 300
COPIES = 4
EPOCHS = 6
BATCH = 32
RATE = 0.01
BUCKETS = 4096
DIM = 12
UNITS = 12
NUMBERS = 4
# Padded blocks that are labelled together, and bytes of pages that are parsed together.
CELLS = 60_000
PAGE_BYTES = 4_000_000

# Element kinds of the markup language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style template noscript iframe svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_BLOCK = frozenset(("p",))
SAME_CLOSES = frozenset("li dt dd tr td th option".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S
)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[a-z]+")
LINKED = "\x00"


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float


def _tokens_of(name: str, attributes: str) -> tuple[str, ...]:
    words = [w for value in NAMED.findall(attributes) for w in PART.findall(value.lower())] if "=" in attributes else []
    return (name, *("." + w for w in words))


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order. Elements without an end are closed by the markup's own rules; stray ends are ignored."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(t for t, _ in buffer)).split())
            if text:
                size = sum(len(t) for t, _ in buffer)
                path = tuple(token for _, tokens in stack for token in tokens)
                out.append(Block(path, text, sum(len(t) for t, linked in buffer if linked) / max(1, size)))
            buffer.clear()

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            buffer.append((page[at:], links > 0))
            break
        if m.start() > at:
            buffer.append((page[at : m.start()], links > 0))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                links -= name == "a" and links > 0
            elif any(name == n for n, _ in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
            else:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at) if not m[3].rstrip().endswith("/") else None
            at = at if m[3].rstrip().endswith("/") else (end.start() if end else len(page))
            if end:
                close = page.find(">", end.start())
                at = close + 1 if close >= 0 else len(page)
            continue
        if name in INLINE:
            links += name == "a"
            if name == "br":
                buffer.append((" ", False))
            continue
        flush()
        links = 0
        if stack and (stack[-1][0] in CLOSED_BY_BLOCK or (name in SAME_CLOSES and stack[-1][0] == name)):
            stack.pop()
        if name not in VOID:
            stack.append((name, _tokens_of(name, m[3])))
    flush()
    return out


# ---- features ----------------------------------------------------------------------------------------------------------


def _bucket(token: str) -> int:
    h = 2166136261
    for byte in token.encode():
        h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % BUCKETS


def _word_buckets(words: pa.Array) -> np.ndarray:
    """A bucket per distinct word, from its bytes."""
    raw = words.cast(pa.large_binary())
    sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
    flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat(first, sizes).astype(np.uint64)
    mixed = (flat + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    total = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    return ((total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class Features:
    """Of all blocks of some pages: flat path and word buckets with their offsets, and the numbers."""

    paths: np.ndarray
    path_ends: np.ndarray
    words: np.ndarray
    word_ends: np.ndarray
    numbers: np.ndarray


def features_of(pages: list[list[Block]]) -> Features:
    blocks = [b for page in pages for b in page]
    known: dict[tuple[str, ...], list[int]] = {}
    paths = []
    for b in blocks:
        if b.path not in known:
            known[b.path] = [_bucket(t) for t in b.path] + [_bucket("leaf " + (b.path[-1] if b.path else ""))]
        paths.append(known[b.path])
    offsets, flat = split_words(pa.array([b.text for b in blocks], pa.string()))
    coded = flat.dictionary_encode()
    words = _word_buckets(coded.dictionary)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages]) if pages else np.zeros(0)
    numbers = np.stack(
        [np.log1p(np.diff(offsets)) / 4, [b.linked for b in blocks], place, [b.text[-1] in ".!?…" for b in blocks]], 1
    ) if blocks else np.zeros((0, NUMBERS))
    return Features(
        np.array([x for p in paths for x in p], np.int64), np.cumsum([0] + [len(p) for p in paths]), words, offsets, numbers.astype(np.float32)
    )


def _means(table: np.ndarray, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros((len(ends) - 1, table.shape[1]), np.float32)
    full = np.diff(ends) > 0
    step = 20_000
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        some = full[a:b]
        if some.any():
            sums = np.add.reduceat(table[buckets[ends[a] : ends[b]]], (ends[a:b] - ends[a])[some])
            out[a:b][some] = sums / np.diff(ends[a : b + 1])[some][:, None]
    return out


# ---- network -----------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    p: dict[str, np.ndarray]

    def inputs(self, f: Features) -> np.ndarray:
        return np.concatenate([_means(self.p["path"], f.paths, f.path_ends), _means(self.p["word"], f.words, f.word_ends), f.numbers], 1)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores of blocks; ``x`` is pages by blocks by inputs, padded at the end."""
        rows, steps = mask.shape
        states, tape = [], {}
        for d in ("f", "b"):
            read = x @ self.p["W" + d] + self.p["c" + d]
            h = c = np.zeros((rows, UNITS), np.float32)
            hs, kept = np.zeros((rows, steps, UNITS), np.float32), []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                a = read[:, t] + h @ self.p["U" + d]
                gates = _sigmoid(a[:, : 3 * UNITS])
                i, f, o = gates[:, :UNITS], gates[:, UNITS : 2 * UNITS], gates[:, 2 * UNITS :]
                g, m = np.tanh(a[:, 3 * UNITS :]), mask[:, t, None]
                new_c = f * c + i * g
                tc = np.tanh(new_c)
                if keep:
                    kept.append((t, h, c, i, f, o, g, tc, m))
                h, c = m * o * tc + (1 - m) * h, m * new_c + (1 - m) * c
                hs[:, t] = h
            states.append(hs)
            tape[d] = kept
        H = np.concatenate(states, 2)
        out = H @ self.p["wo"] + self.p["co"][0]
        return (out, H, tape) if keep else out

    def backward(self, x, mask, target):
        out, H, tape = self.forward(x, mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("path", "word")}
        do = ((_sigmoid(out) - target) * mask / mask.sum()).astype(np.float32)
        g["wo"], g["co"] = np.einsum("rt,rtk->k", do, H), np.array([do.sum()], np.float32)
        dH = do[:, :, None] * self.p["wo"]
        dx = np.zeros_like(x)
        for k, d in enumerate(("f", "b")):
            dh_next = dc_next = np.zeros((len(x), UNITS), np.float32)
            dread = np.zeros((*mask.shape, 4 * UNITS), np.float32)
            for t, h, c, i, f, o, gg, tc, m in reversed(tape[d]):
                dh = dh_next + dH[:, t, k * UNITS : (k + 1) * UNITS]
                dc = dc_next * m + dh * m * o * (1 - tc * tc)
                da = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * m * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                dread[:, t] = da
                g["U" + d] += h.T @ da
                dh_next = dh * (1 - m) + da @ self.p["U" + d].T
                dc_next = dc_next * (1 - m) + dc * f
            g["W" + d], g["c" + d] = np.einsum("rti,rtj->ij", x, dread), dread.sum((0, 1))
            dx += dread @ self.p["W" + d].T
        return g, dx

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For every page, whether each block is main text."""
        x = self.inputs(features_of(pages))
        sizes = np.array([len(p) for p in pages], np.int64)
        starts = np.cumsum(sizes) - sizes
        out: list = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort(sizes, kind="stable").tolist() if sizes[i]]
        while order:
            widest = sizes[order[-1]]
            many = max(1, CELLS // int(widest))
            pick, order = order[-many:], order[:-many]
            padded, mask = _padded(x, starts[pick], sizes[pick])
            score = self.forward(padded, mask)
            for row, i in enumerate(pick):
                out[i] = score[row, : sizes[i]] > 0
        return out


def _padded(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(sizes.max())
    mask = at < sizes[:, None]
    padded = np.zeros((*mask.shape, x.shape[1]), np.float32)
    padded[mask] = x[(starts[:, None] + at)[mask]]
    return padded, mask.astype(np.float32)


# ---- training ----------------------------------------------------------------------------------------------------------

# Words of a block that counts as main text where no page names it.
LONG = 10
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Elements and class words that say what they hold.
MAIN_NAMES = frozenset(("article", "main"))
OTHER_NAMES = frozenset("nav header footer aside form button select dialog menu head title".split())
OTHER_WORDS = frozenset(
    ".ad .ads .advert .advertisement .sponsored .banner .promo .nav .navigation .menu .breadcrumb .breadcrumbs .sidebar .widget "
    ".related .footer .header .cookie .consent .notice .alert .popup .modal .newsletter .subscribe .share .social .comment "
    ".comments .reply .replies .discussion .disqus .login .search".split()
)
# A word after one of these says what the page has, not what the element is.
MODIFIERS = frozenset((".has", ".no", ".with", ".without", ".not"))
# What pages in use call these parts: each entry is an opening element.
MAIN_FORMS = [
    ("article", ""), ("article", ' class="post"'), ("main", ""), ("main", ' id="main"'), ("div", ' class="content"'), ("div", ' id="content"'),
    ("div", ' class="post-body"'), ("div", ' class="entry-content"'), ("div", ' class="article-body"'), ("section", ' class="story"'),
    ("div", ' class="main-content"'), ("div", ' class="text"'), ("div", ' role="main"'),
]
MENU_FORMS = [("nav", ""), ("div", ' class="menu"'), ("header", ""), ("div", ' class="navigation"'), ("ul", ' class="nav"'), ("nav", ' class="breadcrumb"')]
SHORT_FORMS = [
    ("div", ' class="ad"'), ("div", ' class="advert"'), ("aside", ""), ("aside", ' class="sidebar"'), ("div", ' class="sidebar"'), ("div", ' class="notice"'),
    ("div", ' class="cookie-notice"'), ("div", ' id="cookie-banner"'), ("form", ""), ("form", ' class="newsletter"'), ("div", ' class="promo"'),
    ("section", ' class="related"'), ("div", ' class="widget"'), ("div", ' class="sponsored"'), ("header", ""), ("footer", ""), ("div", ' class="share"'),
    ("div", ' class="alert"'), ("div", ' role="alert"'), ("div", ' class="popup"'),
]
COMMENT_FORMS = [("section", ' class="comments"'), ("div", ' class="comments"'), ("div", ' id="comments"'), ("div", ' class="comment"'), ("ol", ' class="comment-list"'), ("div", ' class="replies"')]
FOOTER_FORMS = [("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer"'), ("footer", ' class="site-footer"')]
WRAPPERS = ["", "", '<div id="page">', '<div class="wrapper"><div class="container">', "<div>"]


def _elements(path: tuple[str, ...]) -> list[list[str]]:
    """The open elements, each its name and words, without words after a modifier."""
    out: list[list[str]] = []
    before = ""
    for token in path:
        if not token.startswith("."):
            out.append([token])
        elif out and before not in MODIFIERS:
            out[-1].append(token)
        before = token
    return out


def named_label(block: Block) -> bool:
    """What the elements above a block say: in the article or main element, and in nothing of another name there.

    Words count on elements inside it, and outside it on the nearest element with a name that says something; the page's own
    body never counts. On an article or main element itself only the first word says what it is.
    """
    elements = _elements(block.path)
    at = next((i for i, e in enumerate(elements) if e[0] in MAIN_NAMES), None)
    if at is None:
        return False
    for name, *words in elements[at:]:
        if name in OTHER_NAMES or OTHER_WORDS.intersection(words[:1] if name in MAIN_NAMES else words):
            return False
    outside = [e for e in elements[:at] if e[0] not in ("html", "body")]
    # A form may hold a whole page.
    if any(e[0] in OTHER_NAMES and e[0] != "form" for e in outside):
        return False
    nearest = next((e for e in reversed(outside) if len(e) > 1), [""])
    return not OTHER_WORDS.intersection(nearest[1:])


def long_blocks(page: list[Block]) -> list[Block]:
    """Where no page of a table names its main text: long text, hardly linked, in nothing of another name, and its headings."""
    out: list[Block] = []
    follows = False
    for block in reversed(page):
        inside = [e for e in _elements(block.path) if e[0] not in ("html", "body", "form")]
        other = any(e[0] in OTHER_NAMES or OTHER_WORDS.intersection(e[1:]) for e in inside)
        heading = bool(inside) and inside[-1][0] in HEADINGS
        follows = not other and block.linked < 0.3 and (len(block.text.split()) >= LONG or heading and follows)
        if follows:
            out.append(block)
    return out[::-1]


def _body(path: tuple[str, ...]) -> str:
    """The opening of a page whose body has the words it has in the path: they are above all of a page's blocks alike."""
    words, own = [], False
    for token in path:
        if not token.startswith("."):
            own = token == "body"
        elif own:
            words.append(token[1:])
    return "<html><body class=\"" + " ".join(words) + '">' if words else "<html><body>"


def _wrapped(rng, forms: list[tuple[str, str]], inner: str) -> str:
    name, attributes = forms[rng.integers(len(forms))]
    return f"<{name}{attributes}>{inner}</{name}>"


def rewritten(rng, main: list[Block], texts: list[str]) -> tuple[list[Block], list[bool]]:
    """A page of the same article, given by its blocks, in another dress, and the labels of its blocks."""

    def some_text(most: int) -> str:
        words = texts[rng.integers(len(texts))].split()
        start = rng.integers(max(1, len(words) - 3))
        return html.escape(" ".join(words[start : start + 1 + rng.integers(most)]))

    def menu() -> str:
        items = "".join(f'<li><a href="/">{some_text(2)}</a></li>' for _ in range(1 + rng.integers(8)))
        return _wrapped(rng, MENU_FORMS, f"<ul>{items}</ul>")

    def short() -> str:
        tag = ("", "p", "h3", "li", "label")[rng.integers(5)]
        inner = some_text(25) if not tag else "".join(f"<{tag}>{some_text(25)}</{tag}>" for _ in range(1 + rng.integers(3)))
        return _wrapped(rng, SHORT_FORMS, inner)

    def comments() -> str:
        inner = "".join(f"<p>{some_text(60)}</p>" if rng.random() < 0.6 else f'<div class="comment"><p>{some_text(40)}</p></div>' for _ in range(1 + rng.integers(4)))
        return _wrapped(rng, COMMENT_FORMS, inner)

    leaf = {"h1": "h1", "h2": "h2", "li": "li", "blockquote": "blockquote"}
    body = []
    for b in main:
        name = next((t for t in reversed(b.path) if not t.startswith(".")), "p")
        body.append(f"<{leaf.get(name, 'p')}>{html.escape(b.text)}</{leaf.get(name, 'p')}>")
        if rng.random() < 0.05:
            body.append("<!--cut-->" + short() + "<!--cut-->")
    mark = "\x01"
    inside = "".join(body).replace("<!--cut-->", mark)
    article = _wrapped(rng, MAIN_FORMS, inside)
    parts = [menu() for _ in range(rng.integers(3))] + [short() for _ in range(rng.integers(4))]
    rng.shuffle(parts)
    after = [short() for _ in range(rng.integers(3))] + [comments() for _ in range(rng.integers(2))]
    if rng.random() < 0.3:
        head = html.escape(main[0].text) if main else "x"
        parts.insert(0, f"<header><h2>{some_text(6)}</h2></header><title>{head}</title>")
    tail = _wrapped(rng, FOOTER_FORMS, f"<p>&copy; {some_text(20)}</p>" if rng.random() < 0.5 else f"&copy; {some_text(20)}") if rng.random() < 0.8 else ""
    wrapper = (_body(main[0].path) if main else "<html><body>") + WRAPPERS[rng.integers(len(WRAPPERS))]
    before = blocks_of(wrapper + "".join(parts))
    whole = blocks_of(wrapper + "".join(parts) + article.replace(mark, "") + "".join(after) + tail)
    # Blocks of the article are those between the ones before and after it, without what was put inside it.
    own = blocks_of(wrapper + article.replace(mark, ""))
    put = [b for piece in inside.split(mark)[1::2] for b in blocks_of(piece)]
    left: dict[str, int] = {}
    for b in put:
        left[b.text] = left.get(b.text, 0) + 1
    labels = [False] * len(whole)
    for i, b in enumerate(own):
        if left.get(b.text, 0):
            left[b.text] -= 1
        else:
            labels[len(before) + i] = True
    return whole, labels


def train(pages: list[str], seed: int = 7) -> Labeller | None:
    rng = np.random.default_rng(seed)
    cut = [blocks_of(p) for p in pages]
    cut = [c for c in cut if c]
    texts = [b.text for c in cut for b in c]
    if not texts:
        return None
    # A page that does not name its main text says nothing of what is main: it only gives text for the others.
    sets = [(c, labels) for c, labels in ((c, [named_label(b) for b in c]) for c in cut) if any(labels)]
    articles = [[b for b, label in zip(c, labels, strict=True) if label] for c, labels in sets]
    if not articles:
        articles = [a for a in map(long_blocks, cut) if a]
    if not articles:
        return None
    sets += [rewritten(rng, a, texts) for a in articles for _ in range(COPIES)]
    f = features_of([c for c, _ in sets])
    target = np.array([x for _, labels in sets for x in labels], np.float32)
    sizes = np.array([len(c) for c, _ in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    width = 2 * DIM + NUMBERS

    def small(*shape):
        return (rng.standard_normal(shape) * 0.3).astype(np.float32)

    p = {"path": small(BUCKETS, DIM), "word": small(BUCKETS, DIM) * np.float32(0.1), "wo": small(2 * UNITS), "co": np.zeros(1, np.float32)}
    for d in ("f", "b"):
        p |= {"W" + d: small(width, 4 * UNITS), "U" + d: small(UNITS, 4 * UNITS), "c" + d: np.zeros(4 * UNITS, np.float32)}
    net = Labeller(p)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(sets))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            flat = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[pick], sizes[pick], strict=True)])
            part = _subset(f, flat)
            x = net.inputs(part)
            own = np.cumsum(sizes[pick]) - sizes[pick]
            padded, mask = _padded(x, own, sizes[pick])
            goal = np.zeros(mask.shape, np.float32)
            goal[mask > 0] = target[flat]
            g, dx = net.backward(padded, mask, goal)
            dx = dx[mask > 0]
            for name, buckets, ends, lo in (("path", part.paths, part.path_ends, 0), ("word", part.words, part.word_ends, DIM)):
                n = np.diff(ends)
                g[name] = np.zeros_like(p[name])
                np.add.at(g[name], buckets, np.repeat(dx[:, lo : lo + DIM] / np.maximum(1, n)[:, None], n, 0))
            step += 1
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] * g[k] - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
    return net


def _subset(f: Features, rows: np.ndarray) -> Features:
    def picked(flat, ends):
        n = np.diff(ends)[rows]
        after = np.concatenate([[0], np.cumsum(n)])
        return flat[np.arange(after[-1]) + np.repeat(ends[:-1][rows] - after[:-1], n)], after

    paths, path_ends = picked(f.paths, f.path_ends)
    words, word_ends = picked(f.words, f.word_ends)
    return Features(paths, path_ends, words, word_ends, f.numbers[rows])


def fitted(pages: DataFrame, most: int = SAMPLE) -> Labeller | None:
    """A labeller trained on a bounded sample: the pages with the smallest hashes, those that name their main text first."""
    keyed = pages.where("html IS NOT NULL").withColumn("__h", F.xxhash64(F.lit("pages"), "page_id", "url", "html"))
    keyed = keyed.withColumn("__other", ~F.col("html").rlike("(?i)<(article|main)[\\s/>]"))
    # Hashes are ordered first, so only the chosen pages travel.
    chosen = keyed.select("__other", "__h").orderBy("__other", "__h").limit(most).distinct()
    found = keyed.select("__other", "__h", "html").join(F.broadcast(chosen), ["__other", "__h"]).orderBy("__other", "__h").limit(most).collect()
    return train([r.html for r in found])


def extracted(spark: SparkSession, pages: DataFrame, net: Labeller | None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    sent = spark.sparkContext.broadcast(net)
    kinds = dict(pages.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            source = batch.column(2)
            for a, b in slices(pc.fill_null(pc.binary_length(source), 0).to_numpy(zero_copy_only=False), PAGE_BYTES):
                cut = [blocks_of(p or "") for p in source.slice(a, b - a).to_pylist()]
                marks = model.label(cut) if model else [np.zeros(len(c), bool) for c in cut]
                texts = ["\n\n".join(x.text for x, m in zip(c, mark.tolist(), strict=True) if m) for c, mark in zip(cut, marks, strict=True)]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )
