"""HTML main text by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags) by a scanner whose time is
linear in the page.  Each block has a vector of its tag path, with the words of class, id
and role attributes and their parts, hashed; of its words, hashed; and a few numbers
(length, link share, place, share of the page's text beside it).  A bidirectional LSTM in
numpy reads the page's whole block sequence, so every block is judged with what stands
before and after it, and marks it as article or not.

There is no labelled table of blocks: the network is trained on a bounded sample of
pages whose semantic containers (article, main, nav, footer, ...) give labels.  In most
copies the containers are renamed (class names of the same role, table cells, plain
boxes, meaningless names), and menus, notices, adverts, reader comments and the like are
put before, into and after the article, so that the network also learns from words,
links and neighbours.  Other pages are composed from seeded parts around paragraphs of
the sample.

Bounds, all parameters of `block_model`: `max_pages` pages of at most `max_chars`
characters are learned from, in windows of at most `train_blocks` blocks.  Extraction
reads whole pages.

Defined results: null, empty and text-free pages give an empty text; script, style and
similar elements, comments and the head are never text; character references are
decoded once, those beyond Unicode become U+FFFD; unclosed or stray tags are tolerated;
a head without an end tag ends where a body element or text begins; a tag that never
ends because of a stray quotation mark ends at its first `>`, and from there on marks no
longer protect a `>`; very long pages take time in proportion to their length; an empty
table gives no rows; a null page_id or url is kept; repeated rows are treated alike;
columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import hash_sample, map_rows

#: a quoted value begins only after an equals sign; other quotation marks are ordinary characters
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?>"[^"]*"|'[^']*'|[^\s>]*+))*+)>""")
NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
START = re.compile(r"<(?=/?[a-zA-Z]|[!?]|/>)")
COMMENT_END = re.compile(r"--!?>")
PARTS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"\s+")
ENDLESS = re.compile(r"&#0*(?:[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{7,});?")
ZEROS = re.compile(r"&#0{8,}")
#: element names by kind; fixed values of the HTML standard
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style noscript template svg head title iframe object canvas textarea".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script template noscript noframes head".split())
CLOSES_P = BLOCK - {"body", "button", "html", "caption", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
ENDS_LIKE = frozenset("li dd dt tr td th option".split())
LIST_BOXES = frozenset("ul ol dl table menu select".split())
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in RAW}
PATH_DIM, WORD_DIM, EXTRA = 96, 48, 12
DIM = PATH_DIM + WORD_DIM + EXTRA
HIDDEN = 20
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_main_blocks int"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: names of containers by role; used for training only
ROLES = {
    "main": "article main articlebody post-content entry-content article-body story post entry content body-text prose",
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs tabs pager toc topnav",
    "header": "header masthead topbar branding logo site-title page-head",
    "notice": "notice cookie consent gdpr banner alert popup modal overlay message disclaimer toast privacy",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion commercial partner adslot",
    "comments": "comments comment discussion responses replies disqus feedback talkback commentlist respond thread conversation reactions",
    "sidebar": "sidebar aside widget widgets rail secondary",
    "form": "form newsletter subscribe signup search login contact register subscription optin mailing",
    "related": "related recommended trending popular teaser teasers recirc most-read",
    "share": "share social sharing follow",
    "footer": "footer colophon copyright legal site-info credits",
}
ROLE_OF = {name: role for role, names in ROLES.items() for name in names.split()}
ELEMENTS = {"main": "article main", "menu": "nav", "header": "header", "notice": "div section aside dialog", "ad": "aside div", "comments": "section div ol", "sidebar": "aside", "form": "form", "related": "aside section", "share": "div ul", "footer": "footer"}
STYLES = ("semantic", "both", "classes", "classes", "cells", "boxes")


class Page:
    """Leaf blocks of a page, in order: texts, characters inside links, and the node of each.

    Nodes are the open elements met, as (parent node, words): the element's name, and the
    words of its class, id and role.  Node 0 is the page.
    """

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.link_chars: list[int] = []
        self.at: list[int] = []
        self.parents: list[int] = [0]
        self.words: list[tuple[str, ...]] = [()]

    def path(self, node: int) -> tuple[str, ...]:
        out: list[str] = []
        while node:
            out[:0] = self.words[node]
            node = self.parents[node]
        return tuple(out)


def scan(page: str | None) -> Page:
    """The blocks of `page`, in time proportional to its length."""
    out = Page()
    if not page:
        return out
    stack: list[tuple[str, int]] = []  # name, node
    places: dict[str, list[int]] = {}  # places of the open elements of each name in the stack
    boxes: list[int] = []  # places of the open block elements
    lists: list[int] = []  # places of the open list-like elements
    piece: list[str] = []
    link_chars, silent, links, broken = 0, 0, 0, False
    last_gt, n, at = page.rfind(">"), len(page), 0
    find, match, start = page.find, TAG.match, START.search

    def flush() -> None:
        nonlocal link_chars
        if piece:
            raw = "".join(piece)
            if "&" in raw:
                raw = html.unescape(ENDLESS.sub("�", ZEROS.sub("&#0", raw)))
            text = SPACES.sub(" ", raw).strip()
            if text:
                out.texts.append(text)
                out.link_chars.append(link_chars)
                out.at.append(stack[-1][1] if stack else 0)
            piece.clear()
        link_chars = 0

    def pop_to(k: int) -> None:
        nonlocal silent, links
        while len(stack) > k:
            name, _ = stack.pop()
            places[name].pop()
            if name in BLOCK:
                boxes.pop()
            if name in LIST_BOXES:
                lists.pop()
            silent -= name in SILENT
            links -= name == "a"

    def last(name: str) -> int:
        found = places.get(name)
        return found[-1] if found else -1

    while at < n:
        m = start(page, at) if at < last_gt else None
        lt = m.start() if m else n
        end = lt if lt < last_gt else n  # behind the last `>` no tag can end
        if end > at:
            part = page[at:end]
            if stack and stack[-1][0] == "head" and part.strip():
                pop_to(len(stack) - 1)
            if not silent:
                piece.append(part)
                if links:
                    link_chars += len(part)
        if end == n:
            break
        c = page[lt + 1]
        if c in "!?" or page[lt + 2] == ">" and c == "/":
            if page.startswith("<!--", lt):
                m = COMMENT_END.search(page, lt + 2)
                at = m.end() if m else n
            else:
                at = find(">", lt) + 1
            continue
        m = None if broken else match(page, lt)
        if m:
            closing, name, rest, at = m.group(1), m.group(2), m.group(3), m.end()
        else:
            broken = True
            at = find(">", lt) + 1
            body = page[lt + 1 : at - 1]
            closing = "/" if body.startswith("/") else ""
            name, _, rest = body.lstrip("/").replace("\t", " ").replace("\n", " ").partition(" ")
            name = name.partition("/")[0]
        name = name.lower()
        if closing:
            if name in BLOCK or name in SILENT:
                flush()
            k = last(name)
            # a stray inline end tag does not leave its block
            if k >= 0 and (name in BLOCK or not boxes or boxes[-1] < k):
                pop_to(k)
            continue
        if name not in IN_HEAD and (k := last("head")) >= 0:
            pop_to(k)
        if name in BLOCK or name in SILENT:
            flush()
            if name in CLOSES_P and (k := last("p")) >= 0 and k == (boxes[-1] if boxes else -1):
                pop_to(k)
            if name in ENDS_LIKE and (k := last(name)) > (lists[-1] if lists else -1):
                pop_to(k)
        if name in VOID:
            piece.append(" ")
            continue
        if rest.endswith("/") and name not in BLOCK:
            continue
        words = [name]
        if rest:
            for a in NAMES.findall(rest):
                words += (a[0] or a[1] or a[2]).split()
        out.parents.append(stack[-1][1] if stack else 0)
        out.words.append(tuple(words))
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            boxes.append(len(stack))
        if name in LIST_BOXES:
            lists.append(len(stack))
        stack.append((name, len(out.words) - 1))
        silent += name in SILENT
        links += name == "a"
        if name in RAW:
            m = RAW_END[name].search(page, at)
            close = m.start() if m else n
            if not silent:
                piece.append(page[at:close])
            at = close
    flush()
    return out


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of every leaf block with text, in page order.

    The path holds element names, each followed by its class, id and role words.
    """
    p = scan(page)
    return [(p.path(k), t, c) for k, t, c in zip(p.at, p.texts, p.link_chars, strict=True)]


def page_of(seq: list[tuple[tuple[str, ...], str, int]]) -> Page:
    """A page whose blocks have the paths given; equal beginnings of paths share nodes."""
    out, known = Page(), {(): 0}
    for path, text, link_chars in seq:
        for k in range(1, len(path) + 1):
            if path[:k] not in known:
                known[path[:k]] = len(out.words)
                out.parents.append(known[path[: k - 1]])
                out.words.append((path[k - 1],))
        out.texts.append(text)
        out.link_chars.append(link_chars)
        out.at.append(known[path])
    return out


class Vectors:
    """Inputs of the network; remembers the hashes of up to `max_words` words."""

    def __init__(self, max_words: int = 200_000):
        self.paths: dict[str, list[tuple[int, float]]] = {}
        self.words: dict[str, int] = {}
        self.max_words = max_words

    def _path(self, word: str) -> list[tuple[int, float]]:
        got = self.paths.get(word)
        if got is None:
            low = word.lower()
            parts = {low} | {x for x in PARTS.findall(CAMEL.sub("-", word).lower()) if x != low}
            got = []
            for x in sorted(parts):
                h = zlib.crc32(x.encode())
                got.append((h % PATH_DIM, 1.0 if h >> 16 & 1 else -1.0))
            if len(self.paths) < self.max_words:
                self.paths[word] = got
        return got

    def _word(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        got = (h % WORD_DIM) * 2 + (h >> 16 & 1)
        if len(self.words) < self.max_words:
            self.words[word] = got
        return got

    def __call__(self, page: Page) -> np.ndarray:
        """(blocks, DIM)."""
        n = len(page.texts)
        x = np.zeros((n, DIM), dtype=np.float32)
        if not n:
            return x
        nodes = np.zeros((len(page.words), PATH_DIM), dtype=np.float32)
        box, depth = np.zeros(len(page.words), dtype=np.int64), np.zeros(len(page.words))  # box: innermost node above that is no text element
        for k in range(1, len(page.words)):
            up, words = page.parents[k], page.words[k]
            row = nodes[k]
            row[:] = nodes[up]
            for w in words:
                for i, v in self._path(w):
                    row[i] += v
            box[k] = box[up] if words[0] not in BLOCK or words[0] in ("p", "li", "td", "option", "blockquote", *HEADINGS) else k
            depth[k] = depth[up] + 1
        at = np.array(page.at)
        x[:, :PATH_DIM] = np.clip(nodes[at], -4, 4)
        look, known = self._word, self.words.get
        lists = [t.lower().split() for t in page.texts]
        count = np.array([len(w) for w in lists])
        codes = np.fromiter((look(w) if (c := known(w)) is None else c for ws in lists for w in ws), dtype=np.int64, count=int(count.sum()))
        owner = np.repeat(np.arange(n), count)
        sums = np.bincount(owner * WORD_DIM + codes // 2, weights=np.where(codes % 2, 1.0, -1.0), minlength=n * WORD_DIM).reshape(n, WORD_DIM)
        # of one length whatever the text repeats, so that no text drowns the path
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = 2.0 * sums / np.maximum(1e-9, np.sqrt((sums**2).sum(axis=1)))[:, None]
        chars = np.array([len(t) for t in page.texts])
        home = box[at]
        beside = np.bincount(home, weights=chars, minlength=len(page.words))[home] / chars.sum()
        place = np.arange(n) / n
        own = [page.words[k][0] if k else "" for k in page.at]
        up = [page.words[page.parents[k]][0] if k and page.parents[k] else "" for k in page.at]
        extra = (
            np.minimum(3.0, np.log1p(count) / 2), np.minimum(1.0, np.array(page.link_chars) / np.maximum(1, chars)), np.array([t.count(".") for t in page.texts]) / (1 + count), np.array([t[-1] in ".!?…" for t in page.texts]),
            np.array([a in HEADINGS or b in HEADINGS for a, b in zip(own, up, strict=True)]), place, 1.0 - place, np.array([a == "p" or b == "p" for a, b in zip(own, up, strict=True)]),
            beside, chars / chars.sum(), np.minimum(2.0, depth[at] / 8), np.array(["©" in t or "(c)" in t for t in page.texts]),
        )
        x[:, PATH_DIM + WORD_DIM :] = np.stack([np.asarray(e, dtype=np.float32) for e in extra], axis=1)
        return x


def vectors(seq: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """(blocks, DIM) inputs of blocks given by their paths."""
    return Vectors()(page_of(seq))


class Network:
    """Bidirectional LSTM with a logistic output, in numpy."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        s = 1 / DIM**0.5
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, s, (DIM + HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["o"] = rng.normal(0, 0.3, 2 * HIDDEN)
        self.p["ob"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x (time, pages, DIM), mask (time, pages); hidden states in reading order of `d`."""
        w, c0 = self.p["w" + d], self.p["c" + d]
        steps, pages = x.shape[:2]
        inputs = x @ w[:DIM] + c0
        h, c = np.zeros((pages, HIDDEN), inputs.dtype), np.zeros((pages, HIDDEN), inputs.dtype)
        out = np.zeros((steps, pages, HIDDEN), inputs.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ w[DIM:]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            c = m * c_new
            h = m * (o * tc)
            out[t] = h
        return out

    def predict(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """Article probability of each block of each page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(seqs)
        order = sorted((k for k in range(len(seqs)) if len(seqs[k])), key=lambda k: len(seqs[k]))
        while order:
            longest = len(seqs[order[-1]])
            group = [k for k in order[-64:] if 2 * len(seqs[k]) + 32 >= longest]
            del order[-len(group) :]
            x, mask = _pad([seqs[k] for k in group])
            p = self._score(np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2))
            for j, k in enumerate(group):
                out[k] = p[: len(seqs[k]), j]
        return out

    def _score(self, h: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(h @ self.p["o"] + self.p["ob"], -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        kept = {d: [] for d in "fb"}
        hs = {d: self._run(x, mask, d, kept[d]) for d in "fb"}
        h = np.concatenate([hs["f"], hs["b"]], axis=2)
        d_out = (self._score(h) - y) * mask / mask.sum()
        g = {"o": np.einsum("tp,tph->h", d_out, h), "ob": np.array([d_out.sum()])}
        for k, d in enumerate("fb"):
            w = self.p["w" + d]
            dh_out = d_out[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            gw, gc = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t, h0, c0, i, f, o, gg, tc in reversed(kept[d]):
                m = mask[t][:, None]
                dh = (dh + dh_out[t]) * m
                dc = dc * m + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                gw[:DIM] += x[t].T @ dz
                gw[DIM:] += h0.T @ dz
                gc += dz.sum(axis=0)
                dh = dz @ w[DIM:].T
                dc = dc * f
            g["w" + d], g["c" + d] = gw, gc
        return g


def _pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, seqs))
    x, mask = np.zeros((longest, len(seqs), DIM), dtype=seqs[0].dtype), np.zeros((longest, len(seqs)), dtype=seqs[0].dtype)
    for j, s in enumerate(seqs):
        x[: len(s), j] = s
        mask[: len(s), j] = 1
    return x, mask


def _role(words: tuple[str, ...]) -> str:
    """Role of an element by its name and classes, '' if none tells."""
    for w in words:
        low = w.lower()
        if low in ROLE_OF:
            return ROLE_OF[low]
    for w in words[1:]:
        for x in PARTS.findall(CAMEL.sub("-", w).lower()):
            if ROLE_OF.get(x, "main") != "main":
                return ROLE_OF[x]
    return ""


def labelled_parts(page: Page) -> list[tuple[str, list]] | None:
    """Parts (role, [(inner element words, text, characters in links)]) of a page with an article container; None without one.

    The innermost container with a role decides; a header inside an article is part of it.
    """
    out: list[tuple[str, list]] = []
    known = False
    before = None
    for node, text, link_chars in zip(page.at, page.texts, page.link_chars, strict=True):
        chain = []
        while node:
            chain.append(node)
            node = page.parents[node]
        role, home, inner = "", 0, []
        for k in chain[::-1]:
            found = _role(page.words[k])
            if found and not (found == "header" and role == "main"):
                role, home, inner = found, k, []
            else:
                inner.append(page.words[k])
        known |= role == "main"
        if before != (role, home):
            out.append((role, []))
            before = (role, home)
        out[-1][1].append((inner, text, link_chars))
    return out if known else None


class Composer:
    """Labelled pages for training: real parts under other containers, with seeded parts added, or seeded parts alone."""

    def __init__(self, paragraphs: list[str], rng: np.random.Generator):
        self.paragraphs, self.rng = paragraphs, rng

    def pick(self, *names):
        return names[int(self.rng.integers(len(names)))]

    def some(self, lo: int, hi: int) -> range:
        return range(int(self.rng.integers(lo, hi)))

    def words(self, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi))
        found = " ".join(self.pick(*self.paragraphs) for _ in range(2)).split()
        a = int(self.rng.integers(max(1, len(found) - n)))
        return " ".join(found[a : a + n])

    def item(self, path: str, text: str, linked: float = 0.0) -> tuple:
        return [(w,) for w in path.split()], text, int(linked * len(text))

    def part(self, role: str) -> tuple[str, list]:
        pick, words, item, some = self.pick, self.words, self.item, self.some
        if role == "menu":
            box = pick("ul li a", "a", "ul li a", "ol li a", "p a", "span a")
            got = [item(box, words(1, 4), 1.0) for _ in some(2, 12)]
        elif role == "header":
            got = [item(pick("a", "p", "h1", "span", ""), words(1, 6), float(self.rng.random() < 0.5)) for _ in some(1, 3)]
        elif role == "notice":
            got = [item(pick("p", "span", "", "p"), words(4, 40)) for _ in some(1, 3)]
            if self.rng.random() < 0.4:
                got.append(item("button", words(1, 4)))
        elif role == "ad":
            got = [item(pick("p", "", "a", "p a"), words(2, 30), float(self.rng.random() < 0.3)) for _ in some(1, 3)]
        elif role == "comments":
            line = pick("div p", "li", "p", "div", "li p", "blockquote p", "div div p")
            got = [item(pick("h2", "h3", "h4", "p"), words(1, 4))] if self.rng.random() < 0.6 else []
            for _ in some(1, pick(3, 6, 12)):
                if self.rng.random() < 0.4:
                    got.append(item(pick("div span", "p b", "div a", "cite"), words(1, 3)))
                got.append(item(line, pick(words(3, 50), pick(*self.paragraphs))))
        elif role == "sidebar":
            got = [item(pick("ul li a", "p", "h3", "div", "h4"), words(2, 25), float(self.rng.random() < 0.6)) for _ in some(1, 6)]
        elif role == "form":
            got = [item(pick("label", "button", "p", "fieldset legend", "select option", "div label"), words(1, 10)) for _ in some(1, 5)]
            if self.rng.random() < 0.6:  # an invitation before the fields
                got = [item(pick("p", "p", "p", "h3", "div p"), pick(words(3, 35), pick(*self.paragraphs))) for _ in some(1, 3)] + ([item("button", words(1, 4))] if self.rng.random() < 0.5 else got[:2])
        elif role == "related":
            got = [item(pick("ul li a", "h4 a", "p a", "h3 a"), words(3, 12), 1.0) for _ in some(1, 6)]
        elif role == "share":
            got = [item(pick("a", "li a", "span"), words(1, 3), 1.0) for _ in some(1, 5)]
        elif role == "footer":
            sign = pick("© ", "Copyright ", "", "")
            got = [item(pick("", "p", "ul li a", "small", "span"), sign + words(2, 25), float(self.rng.random() < 0.4)) for _ in some(1, 4)]
        else:
            got = [item(pick("h1", "h2", "header h1", "h1"), words(3, 14))]
            for _ in some(1, 14):
                kind = self.rng.random()
                if kind < 0.08:
                    got.append(item(pick("h2", "h3"), words(2, 10)))
                elif kind < 0.16:
                    got += [item(pick("ul li", "ol li"), words(3, 20)) for _ in some(2, 5)]
                elif kind < 0.22:
                    got.append(item(pick("blockquote p", "blockquote", "pre", "table tr td", "figure figcaption"), words(4, 30)))
                else:
                    got.append(item(pick("p", "p", "p", "p b", "div p", "section p", "p em", "p b"), pick(*self.paragraphs), float(self.rng.random() * 0.2 * (self.rng.random() < 0.3))))
        return role, got

    def container(self, role: str, style: str) -> list[tuple[str, ...]]:
        """Elements a part stands in; 'semantic' elements, role names as classes, table cells, or boxes without a telling name."""
        pick, rng = self.pick, self.rng
        name = pick(*ROLES[role].split()) if role else "x"
        if rng.random() < 0.5:
            name = pick(pick("site", "page", "js", "c", "the", "my", "user", "top", "main" if role != "main" else "l") + "-" + name, name + "-" + pick("box", "wrap", "block", "area", "item", "list", "bar"))
        element = pick(*ELEMENTS[role].split()) if role else "div"
        if style == "semantic":
            return [(element,)]
        if style == "both":
            return [(element, name)]
        if style == "classes":
            return [(pick("div", "div", "section", "td", "center"), *([name] if rng.random() < 0.9 else [pick("a1", "b2", "x9"), name]))]
        if style == "cells":
            return [("table",), ("tr",), ("td",)]
        return [("div",)] * int(rng.integers(1, 3))

    def page(self, real: list[tuple[str, list]] | None) -> tuple[Page, np.ndarray]:
        """A page with the `real` parts, or composed ones, and its labels."""
        pick, rng, some = self.pick, self.rng, self.some
        style = pick(*STYLES)
        named = style not in ("cells", "boxes")
        if real is None:
            before = [r for r in ("header", "menu", "notice", "ad") if rng.random() < 0.6]
            after = [r for r, p in (("share", 0.2), ("comments", 0.4), ("sidebar", 0.4), ("form", 0.3), ("related", 0.4), ("footer", 0.85)) if rng.random() < p and (named or r != "comments")]
            rng.shuffle(before)
            parts = [self.part(r) for r in (*before, "main", *after)]
        else:
            parts = list(real)
            if rng.random() < 0.5:
                first = next(k for k, (r, _) in enumerate(parts) if r == "main")
                parts.insert(int(rng.integers(first + 1)), self.part(pick("notice", "notice", "header", "ad", "menu")))
            if rng.random() < 0.5:
                last = max(k for k, (r, _) in enumerate(parts) if r == "main")
                parts.insert(last + 1, self.part(pick("sidebar", "related", "form", "share", *(["comments"] * 3 if named else []))))
        out, labels, made = Page(), [], {}

        def node(parent: int, words: tuple[str, ...]) -> int:
            out.parents.append(parent)
            out.words.append(words)
            return len(out.words) - 1

        top = 0
        for words in pick((), (("div", pick("wrapper", "page", "container", "root")),), (("div",), ("div",))) if real is None or style == "boxes" else ():
            top = node(top, words)
        base = node(node(top, ("html",)), ("body",))

        def put(parent: int, role: str, items: list, nested: bool) -> None:
            box = parent
            use = "classes" if nested and (not named or style == "semantic" and role in ("comments", "form", "notice", "share") and rng.random() < 0.7) else style
            for words in self.container(role, use) if role else []:
                box = node(box, words)
            shared: dict[tuple, int] = {}
            inside = [k for k in range(1, len(items)) if rng.random() < 0.03] if role == "main" else []
            ends = [pick("comments", "comments", "comments", "form", "form", "form", "share", "related", "ad", "notice") for _ in some(1, 3)] if role == "main" and rng.random() < 0.6 else []
            for k, (inner, text, link_chars) in enumerate(items):
                if k in inside:
                    put(box, *self.part(pick("ad", "related", "share", "notice", "form")), True)
                at = box
                for j, words in enumerate(inner):
                    key = tuple(inner[: j + 1])
                    if j == len(inner) - 1 or key not in shared:
                        shared[key] = node(at, words)
                    at = shared[key]
                if text:
                    out.texts.append(text)
                    out.link_chars.append(link_chars)
                    out.at.append(at)
                    labels.append(float(role == "main"))
            for other in ends:
                put(box, *self.part(other), True)

        for role, items in parts:
            put(base, role, items, False)
        return out, np.array(labels)


def train(pages: list[str], rounds: int = 800, pool: int = 1300, batch: int = 24, train_blocks: int = 120, seed: int = 5) -> dict:
    """Weights of a network fitted on `pool` pages: those given, as they are and under other containers, and composed ones."""
    rng = np.random.default_rng(seed)
    scanned = [p for p in map(scan, pages) if p.texts]
    known = [(p, parts) for p in scanned if (parts := labelled_parts(p)) is not None]
    paragraphs = [text for _, parts in known for role, items in parts if role == "main" for inner, text, _ in items if len(text) > 60 and ("p",) in inner[-2:]]
    paragraphs = paragraphs or ["The quick brown fox jumps over the lazy dog while the other animals look on. It was a long day.", "A plain paragraph of words stands here, so that a page has something to say; it ends soon."]
    make, vec = Composer(paragraphs, rng), Vectors()
    xs, ys = [], []
    for k in range(pool):
        parts = known[int(rng.integers(len(known)))] if known and k % 3 else None
        if parts and k % 6 == 1:
            x, y = vec(parts[0]), np.array([float(role == "main") for role, items in parts[1] for _ in items])
        else:
            page, y = make.page(parts[1] if parts else None)
            x = vec(page)
        a = int(rng.integers(max(1, len(y) - train_blocks + 1)))
        xs.append(x[a : a + train_blocks].astype(np.float64))
        ys.append(y[a : a + train_blocks])
    net = Network()
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    by_length = np.array(sorted(range(len(xs)), key=lambda k: len(xs[k])))
    for step in range(1, rounds + 1):
        a = int(rng.integers(max(1, len(by_length) - batch + 1)))
        some = by_length[a : a + batch]  # pages of like length, so that little is padding
        x, mask = _pad([xs[k] for k in some])
        y = np.zeros(mask.shape)
        for j, k in enumerate(some):
            y[: len(ys[k]), j] = ys[k]
        grads = net.gradients(x, mask, y)
        scale = min(1.0, 2.0 / (sum(float((g**2).sum()) for g in grads.values()) ** 0.5 + 1e-9))
        for k, g in grads.items():
            g = g * scale
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            net.p[k] -= 0.02 * (1 - step / (rounds + 40)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in net.p.items()}


def block_model(pages: DataFrame, max_pages: int = 300, max_chars: int = 100_000, train_blocks: int = 120) -> dict:
    """Train on at most `max_pages` pages (by hash) of at most `max_chars` characters, `train_blocks` blocks of each."""
    some = hash_sample(pages.where(F.length("html").between(1, max_chars)), ["html"], max_pages).collect()
    return train([r["html"] for r in some], train_blocks=train_blocks)


def extract(pages: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """One row per row of `pages` (page_id, url, html); see SCHEMA."""

    def start():
        net, vec = Network(), Vectors()
        net.p = model

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"text": [], "n_chars": [], "n_blocks": [], "n_main_blocks": []}
            scanned = [scan(p) for p in batch.column(2).to_pylist()]
            for page, p in zip(scanned, net.predict([vec(s) for s in scanned]), strict=True):
                kept = [t for t, v in zip(page.texts, p, strict=True) if v >= threshold]
                text = "\n\n".join(kept)
                for k, v in zip(out, (text, len(text), len(page.texts), len(kept)), strict=True):
                    out[k].append(v)
            return {"page_id": batch.column(0), "url": batch.column(1)} | out

        return step

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), SCHEMA, start)
