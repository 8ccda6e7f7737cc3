"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf blocks in page order.  Each block has a vector of its tag path (tags, classes, ids and
roles, hashed), of its words (hashed) and of a few numbers.  A bidirectional LSTM in numpy reads the whole
sequence and says for each block whether it belongs to the article, with the context of the whole document.

It is trained here, on at most ``PAGES`` pages in hashed order, without hand labels: blocks under
elements that name their role teach it (``PLAIN`` and ``ASIDE`` hold the fixed words).  Training pages are varied:
the elements around blocks are exchanged for others of the same role, blocks of other
roles are put in, and meaningless names are added, so it learns roles that the sample lacks.

Defined cases: a null page is empty and has the empty text, as has a page without a block that is taken; blocks
without text are none; unclosed and stray tags are tolerated; a script, style or comment that is not closed
runs to the end.  Repeated rows are extracted one by one.  An empty table gives an
empty result, and without any page to train on no block is taken.  ``text`` and ``n_chars`` replace columns of these names;
``html`` goes, all others stay.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from capweave.llm.tables import first_by_hash, ship_package
from capweave.llm.words import chunks

PAGES = 160
VARIANTS = 6
PATH_SIZE = 384
WORD_SIZE = 32
NUMBERS = 6
HIDDEN = 16
ROUNDS = 5
BATCH = 24
LONGEST_TRAINED = 80

# Fixed words: names that say what a block is.
ASIDE = {
    "t:nav", "t:header", "t:footer", "t:aside", "t:form", "t:button", "t:select", "t:label", "t:dialog", "t:menu", "t:head", "t:title",
    "c:ad", "c:ads", "c:advert", "c:advertisement", "c:sponsored", "c:promo", "c:banner", "c:cookie", "c:consent", "c:notice", "c:alert",
    "c:popup", "c:modal", "c:sidebar", "c:widget", "c:menu", "c:nav", "c:navigation", "c:navbar", "c:breadcrumb", "c:breadcrumbs", "c:header",
    "c:footer", "c:comment", "c:comments", "c:reply", "c:replies", "c:share", "c:social", "c:related", "c:newsletter", "c:subscribe",
    "c:login", "c:search", "c:copyright", "c:form", "c:complementary", "c:contentinfo", "c:disqus", "c:toolbar", "c:pagination",
    "c:masthead", "c:topbar", "c:warning", "c:gdpr", "c:privacy", "c:signup",
}
PLAIN = {"t:article", "t:main", "c:article", "c:main", "c:content", "c:post", "c:entry", "c:story", "c:body"}
_BLOCKS = set(
    "address article aside blockquote body button canvas dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is not shown as text.
_HIDDEN = re.compile(r"</(script|style|template|noscript|textarea|iframe|svg|math|object)\s*>", re.I)
_RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "svg", "math", "object"}
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>?)")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# An element that ends when one of the others begins.
_ENDS = {"p": _BLOCKS - {"button", "label"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_BARRIER = {"article", "section", "div", "table", "ul", "ol", "dl", "td", "th", "body", "html", "main", "nav", "aside", "footer", "header", "form"}


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, names of the path, share of the text in links) of each leaf block."""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = [0, 0]  # characters inside links of the block; depth of links

    def close_block() -> None:
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            if text:
                names = tuple(n for _, own in stack for n in own)
                out.append((text, names, linked[0] / max(1, sum(map(len, pieces)))))
            pieces.clear()
            linked[0] = 0

    def add(text: str) -> None:
        if text:
            pieces.append(text)
            linked[0] += len(text) * (linked[1] > 0)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m.group() == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            if name in _BLOCKS:
                close_block()
            places = [k for k, (tag, _) in enumerate(stack) if tag == name]
            if places:
                if any(tag in _BLOCKS for tag, _ in stack[places[-1] :]):
                    close_block()
                del stack[places[-1] :]
            linked[1] = sum(tag == "a" for tag, _ in stack)
            continue
        if name in _RAW and not m.group(3).endswith("/"):
            for end in _HIDDEN.finditer(page, at):
                if end.group(1).lower() == name:
                    at = end.end()
                    break
            else:
                at = len(page)
            continue
        if name in _BLOCKS:
            close_block()
            for k in range(len(stack) - 1, -1, -1):
                tag = stack[k][0]
                if name in _ENDS.get(tag, ()):
                    del stack[k:]
                    break
                if tag in _BARRIER:
                    break
        elif name == "br":
            add(" ")
        if name not in _VOID and not m.group(3).endswith("/"):
            own = [f"t:{name}"]
            for value in _NAMES.findall(m.group(3)):
                own += [f"c:{x}" for x in re.split(r"[^a-z0-9]+", value.strip("\"'").lower()) if x]
            stack.append((name, tuple(own)))
            linked[1] += name == "a"
    close_block()
    return out


@lru_cache(maxsize=1 << 16)
def _place(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_SIZE


def vectors(pages: list[list[tuple[str, tuple[str, ...], float]]]) -> list[np.ndarray]:
    """A matrix for each page, a row for each block."""
    every = [b for page in pages for b in page]
    n = len(every)
    out = np.zeros((n, PATH_SIZE + WORD_SIZE + NUMBERS), dtype=np.float32)
    row = np.repeat(np.arange(n), [len(b[1]) for b in every])
    out[row, [_place(x) for b in every for x in b[1]]] = 1.0
    size = np.array([len(b[0]) for b in every], dtype=np.float32)
    n_words = np.zeros(n, dtype=np.float32)
    for at, words in chunks(pa.array([b[0] for b in every], pa.large_string())):
        text = np.repeat(np.arange(words.n), words.count)
        cell = (words.hashes() % np.uint64(WORD_SIZE)).astype(np.int64)
        bag = np.bincount(text * WORD_SIZE + cell, minlength=words.n * WORD_SIZE).reshape(words.n, WORD_SIZE)
        n_words[at : at + words.n] = words.count
        out[at : at + words.n, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.sqrt(bag / np.maximum(1, words.count)[:, None])
    place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages]) if n else np.zeros(0)
    numbers = [np.log1p(size) / 8, np.log1p(n_words) / 6, [b[2] for b in every], [b[0][-1:] in ".!?" for b in every], place, np.ones(n)]
    out[:, PATH_SIZE + WORD_SIZE :] = np.stack([np.asarray(x, dtype=np.float32) for x in numbers], 1) if n else 0
    bounds = np.cumsum([0, *(len(p) for p in pages)])
    return [out[a:b] for a, b in zip(bounds, bounds[1:])]


def role(names: tuple[str, ...]) -> int | None:
    """1 for the article, 0 for what stands beside it, None if no name says so."""
    if ASIDE.intersection(names):
        return 0
    return 1 if PLAIN.intersection(names) else None


# The network.


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _start(seed: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    size = PATH_SIZE + WORD_SIZE + NUMBERS
    p = {}
    for way in "fb":
        p[f"x{way}"] = draw.standard_normal((size, 4 * HIDDEN)) * 0.1
        p[f"h{way}"] = draw.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2
        p[f"c{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    p["o"] = draw.standard_normal(2 * HIDDEN) * 0.2
    p["s"] = np.zeros(size)  # straight from a block's own vector
    p["b"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(x: np.ndarray, mask: np.ndarray, p: dict, way: str, keep: bool):
    """Hidden states of one direction over a padded batch (page, block, feature)."""
    n, steps, _ = x.shape
    gates = x @ p[f"x{way}"] + p[f"c{way}"]
    h = np.zeros((n, HIDDEN), dtype=np.float32)
    c = np.zeros_like(h)
    out = np.zeros((n, steps, HIDDEN), dtype=np.float32)
    trace = []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = gates[:, t] + h @ p[f"h{way}"]
        i, f, o = (_squash(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, t, None]
        new = f * c + i * g
        th = np.tanh(new)
        if keep:
            trace.append((t, i, f, o, g, c, th, h, m))
        c = np.where(m, new, c)
        h = np.where(m, o * th, h)
        out[:, t] = h
    return out, trace


def _back(dout: np.ndarray, x: np.ndarray, trace: list, p: dict, way: str) -> dict:
    dgates = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
    dh = np.zeros((len(x), HIDDEN), dtype=np.float32)
    dc = np.zeros_like(dh)
    dw = np.zeros_like(p[f"h{way}"])
    for t, i, f, o, g, c, th, h, m in reversed(trace):
        dh = dh + dout[:, t]
        live = dh * m
        do, dnew = live * th, dc * m + live * o * (1 - th**2)
        z = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g**2)], 1)
        dgates[:, t] = z
        dw += h.T @ z
        dc = np.where(m, dnew * f, dc)
        dh = np.where(m, z @ p[f"h{way}"].T, dh)
    flat = dgates.reshape(-1, 4 * HIDDEN)
    return {f"x{way}": x.reshape(-1, x.shape[2]).T @ flat, f"h{way}": dw, f"c{way}": flat.sum(0)}


def scores(pages: list[np.ndarray], p: dict, keep: bool = False):
    """Probability of each block, page by page; padded to the longest of the batch."""
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, PATH_SIZE + WORD_SIZE + NUMBERS), dtype=np.float32)
    mask = np.zeros((len(pages), steps), dtype=bool)
    for k, page in enumerate(pages):
        x[k, : len(page)], mask[k, : len(page)] = page, True
    f, trace_f = _run(x, mask, p, "f", keep)
    b, trace_b = _run(x, mask, p, "b", keep)
    both = np.concatenate([f, b], 2)
    z = both @ p["o"] + x @ p["s"] + p["b"]
    return _squash(z), (x, mask, both, trace_f, trace_b)


def _varied(page, draw: np.random.Generator, words: list[str]):
    """A training page with elements exchanged and blocks put in; (block, label) pairs."""
    aside, plain = sorted(ASIDE), sorted(PLAIN)
    wrap = plain[draw.integers(len(plain))]
    tags = ["t:p", "t:p", "t:p", "t:h1", "t:h2", "t:li", "t:blockquote", "t:td", "t:pre", "t:div", "t:figcaption", "t:span"]
    out = []

    def beside(text: str, inside: bool):
        own = ["t:html", "t:body", *([wrap] if inside else []), "t:div", aside[draw.integers(len(aside))], tags[draw.integers(len(tags))]]
        return (text, tuple(own), float(draw.random() < 0.5)), 0

    def some_words() -> str:
        return " ".join(words[k] for k in draw.integers(0, len(words), draw.integers(2, 60)))

    for block, label in page:
        text, names, links = block
        if draw.random() < 0.15:
            out.append(beside(some_words(), draw.random() < 0.5))
        if label == 1:
            kept = [wrap if n in PLAIN else n for n in names]
            if draw.random() < 0.6:
                kept[-1] = tags[draw.integers(len(tags))]
            neutral = [("t:div",), ("t:section",), ("t:div", "t:div"), ("t:ul",), ("t:table", "t:tr"), ()][draw.integers(6)]
            names = (*kept[:-1], *neutral, kept[-1])
        elif draw.random() < 0.6:
            (text, names, links), label = beside(text, False)
        if draw.random() < 0.25:
            names = (*names, f"c:x{draw.integers(10_000)}")
        out.append(((text, names, links), label))
    if draw.random() < 0.5:
        out += [beside(some_words(), draw.random() < 0.5) for _ in range(draw.integers(1, 4))]
    return out


def train(pages: list[str], seed: int = 5) -> dict[str, np.ndarray] | None:
    """Weights of the network; None if no page has both kinds of blocks."""
    draw = np.random.default_rng(seed)
    known = []
    for page in pages:
        labelled = [(b, role(b[1])) for b in blocks(page)]
        labelled = [(b, y) for b, y in labelled if y is not None]
        if labelled:
            known.append(labelled)
    if {y for page in known for _, y in page} != {0, 1}:
        return None
    words = sorted({w for page in known for b, _ in page for w in b[0].split()})
    rows = []
    for page in known:
        for v in range(VARIANTS):
            varied = page if v == 0 else _varied(page, draw, words)
            begin = int(draw.integers(0, max(1, len(varied) - LONGEST_TRAINED + 1)))
            rows.append(varied[begin : begin + LONGEST_TRAINED])
    x = vectors([[b for b, _ in row] for row in rows])
    y = [np.array([label for _, label in row], dtype=np.float32) for row in rows]
    p = _start(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(ROUNDS):
        # Sequences of about one length together, the batches in any order.
        order = np.argsort([len(row) + draw.random() * 4 for row in x])
        for at in draw.permutation(np.arange(0, len(order), BATCH)):
            part = order[at : at + BATCH]
            prob, (xs, mask, both, tf, tb) = scores([x[k] for k in part], p, keep=True)
            want = np.zeros_like(prob)
            for k, n in enumerate(part):
                want[k, : len(y[n])] = y[n]
            dz = ((prob - want) * mask / mask.sum()).astype(np.float32)
            slope = {"o": np.tensordot(dz, both, 2), "s": np.tensordot(dz, xs, 2), "b": dz.sum(keepdims=True).reshape(1)}
            dboth = dz[:, :, None] * p["o"]
            slope |= _back(dboth[:, :, :HIDDEN], xs, tf, p, "f") | _back(dboth[:, :, HIDDEN:], xs, tb, p, "b")
            norm = np.sqrt(sum(float((g**2).sum()) for g in slope.values()))
            step += 1
            for k, g in slope.items():
                g = g * min(1.0, 2.0 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g**2
                p[k] -= 0.02 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return p


def main_texts(pages: list[str], p: dict[str, np.ndarray] | None) -> list[str]:
    found = [blocks(x) for x in pages]
    out = [""] * len(pages)
    if p is None:
        return out
    made = vectors(found)
    order = sorted((k for k in range(len(pages)) if len(made[k])), key=lambda k: len(made[k]))
    at = 0
    while at < len(order):  # pages of about the same number of blocks together, a bounded number of cells
        to = at + 1
        while to < len(order) and to - at < 256 and (to - at + 1) * len(made[order[to]]) <= 20_000:
            to += 1
        part = order[at:to]
        prob, _ = scores([made[k] for k in part], p)
        for row, k in enumerate(part):
            out[k] = "\n".join(b[0] for b, q in zip(found[k], prob[row]) if q >= 0.5)
        at = to
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with text and n_chars in place of html."""
    spark = pages.sparkSession
    ship_package(spark)
    order = F.xxhash64("page_id", "url", F.lit(5))
    chosen = first_by_hash(pages.select("page_id", "url", "html").filter("html IS NOT NULL"), order, PAGES)
    shared = spark.sparkContext.broadcast(train([r.html for r in chosen.select("html").collect()]))
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = main_texts([x or "" for x in some.column("html").to_pylist()], shared.value)
                sizes = pa.array([len(x) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(texts, pa.string()), sizes], [*kept, "text", "n_chars"])

    schema = pages.select(*kept).schema.add("text", StringType()).add("n_chars", LongType())
    return pages.select(*kept, "html").mapInArrow(read, schema)
