"""Main text of web pages: a recurrent network labels the blocks of a page in their order.

A page is cut into blocks (runs of text between block-level tags). A block is described by hashed vectors of its tag path
with class, id and role words, by hashed vectors of its words, and by a few measures. A bidirectional LSTM, written in
numpy, reads all blocks of the page and labels each of them with the whole document as context.

There are no labelled pages, so the network learns from pages whose own markup tells: inside ``article`` or ``main`` and in
none of the known kinds of boilerplate. Each training page is also rewritten: its container and boilerplate get other names
in use on the web, and notices, side columns, forms, comments and adverts holding text of other pages are put around
and into it, so that the network learns from paths and context rather than from the words.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import Rolling, mix, with_columns, words

#: Bound of the training sample: pages with the smallest hash of their id, of at most LONGEST characters.
SAMPLE_PAGES = 240
LONGEST = 60_000
VARIANTS = 3
STEPS = 320
BATCH = 24
CROP = 48
WIDTH = 24  # of the path and of the word vectors
HIDDEN = 16
MEASURES = 4
RATE = 0.01
ADDED = ["text", "n_chars", "n_blocks"]

# Element names of HTML.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "label", "legend", "li",
    "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead",
    "title", "tr", "ul",
}
# An element of the first kind ends open ones of the second (end tags that may be left out).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "dl", "select", "td", "th", "article", "section", "div", "main", "body", "form"}
NEVER = {"head", "title"}  # as elements; class, id and role may hold these words

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z0-9]+")

# Names that mark boilerplate and main text in class, id and role attributes, used to name training pages anew.
BOILERPLATE = {
    "nav": ["nav", "div.menu", "div.navbar", "div.navigation", "ul.breadcrumb", "div.topnav"],
    "header": ["header", "div.header", "div.site-header", "div.masthead", "div.banner"],
    "footer": ["footer", "div.footer", "div.site-footer", "div.copyright", "div.legal"],
    "aside": ["aside", "div.sidebar", "div.widget", "div.related", "section.recommended", "div.rail"],
    "notice": ["div.cookie-notice", "div.consent", "div.notice", "div.alert", "section.gdpr", "div.popup", "div.modal"],
    "ad": ["div.ad", "div.advert", "div.ads", "div.sponsored", "div.promo", "ins.adsbygoogle", "aside.advertisement"],
    "form": ["form", "form.search", "form.newsletter", "div.subscribe", "div.signup", "form.login"],
    "comments": ["section.comments", "div.comments", "div.comment-list", "ol.commentlist", "div.discussion", "div.replies"],
    "share": ["div.share", "div.social", "ul.share-buttons", "div.tags", "div.byline-links"],
}
CONTAINERS = ["article", "main", "div.content", "div.article", "div.post", "div.entry-content", "section.article-body", "div.story", "div.main-content", "div.post-body", "div.text"]
KNOWN = {w for group in BOILERPLATE.values() for name in group for w in WORD.findall(name)} - {"div", "section", "ul", "ol", "ins", "list", "site", "main"}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order; raw elements and comments leave, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not any(tag in NEVER for tag, _ in stack):
                out.append(Block(tuple(x for _, names in stack for x in names), text, linked))
            parts.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if any(tag == "a" for tag, _ in stack[-3:]):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCKS:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(t in BLOCKS for t, _ in stack[i:]) and tag not in BLOCKS:
                        break  # an inline end tag does not close blocks
                    del stack[i:]
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            close()
            _imply_ends(stack, tag)
        if tag in VOID or attributes.endswith("/"):
            continue
        named = [w for a in NAMES.findall(attributes) for w in WORD.findall("".join(a).lower())] if "=" in attributes else []
        stack.append((tag, (tag, *named)) if tag in BLOCKS else (tag, ()))
    close()
    return out


def _imply_ends(stack: list, tag: str) -> None:
    if tag in BLOCKS:  # any block ends an open paragraph, with the inline elements in it
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == "p":
                del stack[i:]
                break
            if stack[i][0] in BLOCKS:
                break
    if tag in ENDS:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ENDS[tag]:
                del stack[i:]
                break
            if stack[i][0] in SCOPES:
                break


def markup_says(b: Block) -> bool:
    """Main text by the page's own markup: in an article or main element and in nothing known as boilerplate."""
    return bool({"article", "main"} & set(b.path)) and not KNOWN & set(b.path)


def rewritten(blocks: list[Block], label: list[bool], others: list[str], rng: random.Random) -> tuple[list[Block], list[bool]]:
    """The page under other names, with boilerplate that holds other pages' text around and inside its main text."""
    name = lambda x: tuple(WORD.findall(x.lower()))
    container = name(rng.choice(CONTAINERS))
    outer = [(), ("div",), ("div", "wrapper"), ("div", "page", "div", "row"), ("table", "tbody", "tr", "td")][rng.randrange(5)]
    swap = {kind: name(rng.choice(names)) for kind, names in BOILERPLATE.items()}
    main_tags = {"article", "main"}

    def renamed(b: Block, main: bool) -> Block:
        path = [x for x in b.path if x not in ("html", "body")]
        if main:
            after = max(i for i, x in enumerate(path) if x in main_tags) + 1
            return Block(("html", "body", *outer, *container, *path[after:]), b.text, b.linked)
        kind = next((k for k in swap if k in path), None)
        path = [*swap[kind], *path[path.index(kind) + 1 :]] if kind else path
        return Block(("html", "body", *outer, *path), b.text, b.linked)

    page = [(renamed(b, m), m) for b, m in zip(blocks, label)]
    for _ in range(rng.randrange(2, 7)):
        kind = rng.choice(list(BOILERPLATE))
        inner = rng.choice([("p",), ("div",), ("ul", "li"), (), ("h3",), ("div", "p"), ("label",)])
        inside = rng.random() < 0.4
        path = ("html", "body", *outer, *(container if inside else ()), *name(rng.choice(BOILERPLATE[kind])), *inner)
        made = []
        for _ in range(rng.randrange(1, 5)):
            text = rng.choice(others)
            short = " ".join(text.split()[: rng.randrange(2, 12)]) if kind not in ("comments", "aside") and rng.random() < 0.6 else text
            made.append((Block(path, short, len(short) if kind in ("nav", "share") or rng.random() < 0.3 else 0), False))
        where = [i for i, (_, m) in enumerate(page) if m] if inside else [0, len(page)]
        at = rng.choice(where or [0])
        page[at:at] = made
    return [b for b, _ in page], [m for _, m in page]


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _vectors(n: int, seed: int) -> np.ndarray:
    bits = mix(np.arange(n * WIDTH, dtype=np.uint64) + np.uint64(seed << 40))
    return ((bits >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1) * np.float32(1.7)


_WORDS = _vectors(4096, 2).reshape(4096, WIDTH)


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    have = _PATHS.get(path)
    if have is None:
        if len(_PATHS) > 200_000:
            _PATHS.clear()
        have = np.zeros(WIDTH * 2, np.float32)
        for depth, token in enumerate(reversed(path)):
            seed = int.from_bytes(token.encode()[:8].ljust(8, b"\0"), "little") ^ len(token) ^ (int.from_bytes(token.encode()[8:16].ljust(8, b"\0"), "little") << 1 & (1 << 64) - 1)
            v = _vectors(1, int(mix(np.array([seed], np.uint64))[0]) & 0xFFFFF)
            have[:WIDTH] += v
            have[WIDTH:] += v * np.float32(0.6**depth)
        have[:WIDTH] /= np.sqrt(max(1, len(path)))
        _PATHS[path] = have
    return have


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: path vectors, word vectors, measures."""
    raw = [b.text.encode() for b in blocks]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offsets[1:])
    low, starts, ends, row = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    out = np.zeros((len(blocks), WIDTH * 3 + MEASURES), np.float32)
    out[:, : 2 * WIDTH] = [path_vector(b.path) for b in blocks]
    count = np.bincount(row, minlength=len(blocks)).astype(np.float32)
    if len(starts):
        h = (Rolling(low).of(starts, ends) & np.uint64(4095)).astype(np.int64)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first], 2 * WIDTH : 3 * WIDTH] = np.add.reduceat(_WORDS[h], first, axis=0) / np.sqrt(count[row[first]])[:, None] / 2
    chars = np.array([len(b.text) for b in blocks], np.float32)
    out[:, -4] = np.log1p(count) / 4
    out[:, -3] = np.array([min(b.linked, len(b.text)) for b in blocks]) / np.maximum(chars, 1)
    out[:, -2] = np.array([b.text[-1:] in ".!?" for b in blocks])
    out[:, -1] = np.log1p(np.arange(len(blocks))) / 4
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Two LSTMs, one for each direction, and a logistic output over both states."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, inputs: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * HIDDEN)).astype(np.float32)
            p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            p[f"b{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        p["o"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        p["c"] = np.zeros(1, np.float32)
        return cls(p)

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States for inputs (time, page, feature); a masked step leaves the state as it is."""
        steps, pages = mask.shape
        gates_x = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h = np.zeros((pages, HIDDEN), np.float32)
        c = h.copy()
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gates_x[t] + h @ self.p[f"h{d}"]
            gate = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tanh, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._direction("f", x, mask), self._direction("b", x, mask)], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss over unmasked blocks, by back-propagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._direction(d, x, mask, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        error = (_sigmoid(both @ self.p["o"] + self.p["c"]) - y) * mask / max(1, mask.sum())
        g = {"o": np.einsum("tp,tph->h", error, both), "c": np.array([error.sum()], np.float32)}
        for k, d in enumerate("fb"):
            into = error[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dh = np.zeros_like(into[0])
            dc = dh.copy()
            gx = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            for t, h, c, i, f, o, u, tanh, m in reversed(kept[d]):
                dh = dh + into[t]
                dh_in, dc_in = dh * m, dc * m
                dn = dc_in + dh_in * o * (1 - tanh**2)
                gate = np.concatenate([dn * u * i * (1 - i), dn * c * f * (1 - f), dh_in * tanh * o * (1 - o), dn * i * (1 - u**2)], axis=1)
                gx[t] = gate
                gh += h.T @ gate
                dh = dh * ~m + gate @ self.p[f"h{d}"].T
                dc = dc * ~m + dn * f
            g[f"x{d}"] = np.einsum("tpi,tpg->ig", x, gx, optimize=True)
            g[f"b{d}"] = gx.sum(axis=(0, 1))
            g[f"h{d}"] = gh
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = True
    return x, mask


def train(pages: list[str], seed: int = 11) -> Network | None:
    """A network trained on the pages whose markup tells what is main text; None if there are none."""
    rng = random.Random(seed)
    told = []
    for page in pages:
        blocks = blocks_of(page)
        label = [markup_says(b) for b in blocks]
        if any(label):
            told.append((blocks, label))
    if not told:
        return None
    texts = [b.text for blocks, _ in told for b in blocks][:20_000]
    data = []
    for blocks, label in told:
        for k in range(VARIANTS + 1):
            b, m = (blocks, label) if k == 0 else rewritten(blocks, label, texts, rng)
            data.append((features(b), np.array(m, np.float32)))
    net = Network.fresh(data[0][0].shape[1])
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, STEPS + 1):
        batch = []
        for _ in range(BATCH):
            x, y = data[rng.randrange(len(data))]
            at = rng.randrange(max(1, len(x) - CROP + 1))
            batch.append((x[at : at + CROP], y[at : at + CROP]))
        x, mask = padded([x for x, _ in batch])
        y = padded([y[:, None] for _, y in batch])[0][:, :, 0]
        rate = RATE * min(1, 2 - 2 * step / (STEPS + 1))
        for k, g in net.gradients(x, mask, y).items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label_pages(pages: list[list[Block]], net: Network | None, steps_at_once: int = 20_000) -> list[np.ndarray]:
    """For each page the blocks that are main text; pages of like length are read together."""
    if net is None:
        return [np.array([markup_says(b) for b in p], bool) for p in pages]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        longest = len(pages[order[-1]])
        group, order = order[-max(1, steps_at_once // longest) :], order[: -max(1, steps_at_once // longest)]
        flat = features([b for i in group for b in pages[i]])
        bounds = np.cumsum([0, *(len(pages[i]) for i in group)])
        x, mask = padded([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
        p = net.probabilities(x, mask)
        for k, i in enumerate(group):
            out[i] = p[: len(pages[i]), k] >= 0.5
    return out


def fit(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Network | None:
    """Train on a bounded sample of the pages."""
    short = df.where(F.char_length(html_col).between(1, LONGEST))
    # Ids first: every task sends its smallest ones, but only the pages chosen in the end send their html.
    ids = [r[0] for r in short.where(F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_PAGES).collect()]
    picked = {r[0]: r[1] for r in short.where(F.col(id_col).isin(ids)).groupBy(id_col).agg(F.min(html_col)).collect()}
    return train([picked[i] for i in dict.fromkeys(ids)])


def extract(df: DataFrame, net: Network | None, html_col: str = "html") -> DataFrame:
    """The input's columns with text (main blocks joined by an empty line), n_chars and n_blocks.

    Null or empty html gives an empty text. Input columns of those names are replaced.
    """
    kept = df.select(*with_columns(df, ADDED))
    at = kept.columns.index(html_col)
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                pages = [blocks_of(h or "") for h in batch.column(at).to_pylist()]
                texts, many = [], []
                for blocks, main in zip(pages, label_pages(pages, net)):
                    texts.append("\n\n".join(b.text for b, m in zip(blocks, main) if m))
                    many.append(int(main.sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(many, pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)
