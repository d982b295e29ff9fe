"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags. A block's input is the hashed tag path above it (tags,
parent>child pairs, words of class, id and role), its hashed words and a few measures (length, link share, place,
punctuation). A bidirectional LSTM in numpy reads the sequence of a page's blocks and labels each main text or not, so
a block's neighbours and the whole page take part in its label.

The network is fitted on the driver on TRAIN_PAGES made-up pages with known labels, a third of them in layouts whose tags
and names tell nothing (seeded: the same weights every time); no row of the input is learned from. Labelling reads each page where it lies: no shuffle; what is broadcast is
the weights (about 100 kB).

Edge cases: null or empty html, and pages without main text, give an empty text; character references without a
semicolon or cut off at the end are decoded as browsers do; unclosed tags are closed by the next block, an
unclosed head by its first text or tag of the body; repeated rows
are extracted each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, MEASURES = 192, 32, 11
INPUT = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 16
TRAIN_PAGES = 900
#: Blocks, padding included, that are labelled together; a longer page is read in strips of as many.
CELLS = 8192
#: Characters of html whose pages are labelled together.
GROUP_CHARS = 4_000_000
#: Elements that start and end a block, elements without content, and elements whose content is never shown as text.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style template head title noscript iframe object svg canvas audio video select textarea button option".split())
#: Start tags that leave an open head open; all others, and text, end it.
HEAD_TAGS = frozenset("html head base link meta script style template title noscript".split())
#: Words that pages put around their text, in four languages, as beginnings.
AROUND = (
    "copyright", "©", "rights", "reserved", "cookie", "subscri", "newsletter", "advert", "sponsor", "login", "log", "sign", "privacy", "terms", "contact", "imprint", "impressum",
    "datenschutz", "anzeige", "werbung", "anmelden", "abonn", "publicidad", "aviso", "derechos", "suscr", "privacidad", "publicit", "droits", "mentions", "connexion", "share",
    "comment", "reply", "related", "search", "home", "menu", "skip", "follow",
)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z0-9]+")


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str]]] = []
        self.hidden = 0
        self.text: list[str] = []
        self.linked = self.links = 0
        self.out: list[tuple[str, list[tuple[str, list[str]]], float]] = []

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.out.append((text, [s for s in self.stack if s[0] in BLOCKS or s[0] == "a"], self.linked / max(len(text), 1)))
            self.text, self.linked = [], 0

    def _leave_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self._pop(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs) -> None:
        if tag not in HEAD_TAGS:
            self._leave_head()
        if tag in BLOCKS:
            self.flush()
            if tag != "hr":
                # a block ends an open paragraph and what stands inside it
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == "p":
                        self._pop(k)
                        break
                    if self.stack[k][0] in BLOCKS:
                        if tag == "li" and self.stack[k][0] == "li":
                            self._pop(k)
                        break
        elif tag == "br" and not self.hidden:
            self.text.append(" ")
        if tag in VOID:
            return
        names = [w for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for w in _WORDS.findall(v.lower())]
        self.stack.append((tag, names))
        self.hidden += tag in HIDDEN_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self, k: int) -> None:
        for tag, _ in self.stack[k:]:
            self.hidden -= tag in HIDDEN_TAGS
            self.links -= tag == "a"
        del self.stack[k:]

    def handle_endtag(self, tag) -> None:
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                break
            if tag not in BLOCKS and tag not in HIDDEN_TAGS and self.stack[k][0] in BLOCKS:
                break  # an inline end tag does not reach out of its block

    def handle_data(self, data) -> None:
        if self.hidden and data.strip():
            self._leave_head()
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[tuple[str, list[tuple[str, list[str]]], float]]:
    """(text, path above it, share of linked characters) of a page's leaf blocks, in page order."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


class Inputs:
    """Blocks to input vectors; hashed places are remembered."""

    def __init__(self) -> None:
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: list[tuple[str, list[str]]]) -> np.ndarray:
        key = tuple((t, *n) for t, n in path)
        if (v := self.paths.get(key)) is None:
            v = np.zeros(PATH_DIM, dtype=np.float32)
            up = ""
            for tag, names in path:
                for token in (tag, f"{up}>{tag}", *(f".{n}" for n in names)):
                    v[crc32(token.encode()) % PATH_DIM] = 1.0
                up = tag
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[key] = v
        return v

    def page(self, page: list, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The inputs of the page's blocks lo .. hi - 1."""
        some = page[lo:hi]
        x = np.zeros((len(some), INPUT), dtype=np.float32)
        for k, (text, path, linked) in enumerate(some):
            at_page = lo + k
            x[k, :PATH_DIM] = self.path(path)
            words = text.lower().split()
            for w in words:
                if (at := self.words.get(w)) is None:
                    if len(self.words) > 500_000:
                        self.words.clear()
                    at = self.words[w] = crc32(w.encode()) % WORD_DIM
                x[k, PATH_DIM + at] += 1.0
            n = len(words)
            x[k, PATH_DIM : PATH_DIM + WORD_DIM] *= 0.25 / max(n, 1) ** 0.5
            dots = text.count(".") + text.count("!") + text.count("?")
            around = sum(w.startswith(AROUND) for w in words)
            x[k, -MEASURES:] = (
                min(np.log1p(len(text)) / 8, 1.5), min(linked, 1.0), at_page / len(page), 1.0 / (1 + at_page), n < 4,
                min(dots / max(n, 1), 1.0), "©" in text, min(around / max(n, 1) * 4, 1.0), around > 0, n >= 12 and dots > 0 and linked < 0.3, len(page) == 1,
            )
        return x


class BiLSTM:
    """One bidirectional layer and a logistic output. Sequences are padded; a mask keeps padding out of state and loss."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @staticmethod
    def fresh(seed: int = 11) -> BiLSTM:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = (r.standard_normal((INPUT, 4 * HIDDEN)) * 0.15).astype(np.float32)
            w[f"h{d}"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
            w[f"b{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN).astype(np.float32)  # open forget gates
        w["o"] = (r.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
        w["c"] = np.zeros(1, dtype=np.float32)
        return BiLSTM(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """States of one direction; x: (time, batch, input), already reversed for b."""
        steps, n, _ = x.shape
        pre = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ self.w[f"h{d}"]
            g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = (f * c + i * u) * m
            th = np.tanh(c_new)
            kept.append((h, c, i, f, o, u, th, m))
            h, c = o * th * m, c_new
            hs[t] = h
        return hs, kept

    def forward(self, x: np.ndarray, mask: np.ndarray):
        hf, kf = self._run(x, mask, "f")
        hb, kb = self._run(x[::-1], mask[::-1], "b")
        both = np.concatenate([hf, hb[::-1]], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["c"]))), both, kf, kb

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, kf, kb = self.forward(x, mask)
        err = (p - y) * mask / mask.sum()
        out = {"o": np.einsum("tn,tnh->h", err, both), "c": np.array([err.sum()], np.float32)}
        d_both = err[:, :, None] * self.w["o"]
        for d, kept, grad, seq in (("f", kf, d_both[:, :, :HIDDEN], x), ("b", kb, d_both[::-1, :, HIDDEN:], x[::-1])):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            for t in range(len(kept) - 1, -1, -1):
                h, c, i, f, o, u, th, m = kept[t]
                dh = (dh + grad[t]) * m
                dc = (dc + dh * o * (1 - th * th)) * m
                dz[t] = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                gh += h.T @ dz[t]
                dh, dc = dz[t] @ self.w[f"h{d}"].T, dc * f
            out[f"h{d}"] = gh
            flat = dz.reshape(-1, 4 * HIDDEN)
            out[f"x{d}"], out[f"b{d}"] = seq.reshape(-1, INPUT).T @ flat, flat.sum(axis=0)
        return out

    def _walk(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple[np.ndarray, np.ndarray]):
        """(share of the output, state) of one direction, each step's only; x: (time, batch, input) in that direction's order."""
        pre = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        weight = self.w["o"][:HIDDEN] if d == "f" else self.w["o"][HIDDEN:]
        (h, c), out = state, np.zeros(mask.shape, np.float32)
        for t in range(len(pre)):
            z = pre[t] + h @ self.w[f"h{d}"]
            g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            m = mask[t][:, None]
            c = (g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])) * m
            h = g[:, 2 * HIDDEN :] * np.tanh(c) * m
            out[t] = h @ weight
        return out, (h, c)

    def label(self, pages: list, inputs: Inputs | None = None, cells: int = CELLS) -> list[np.ndarray]:
        """Probability of main text for each block of each page; with inputs, pages are lists of blocks, else arrays.

        Pages of like length go together, at most ``cells`` padded blocks at once; a longer page passes in strips, twice
        (forward and backward), with the state handed on. No states are kept, so memory does not grow with a page's blocks
        but for one number each.
        """
        part = lambda k, lo, hi: pages[k][lo:hi] if inputs is None else inputs.page(pages[k], lo, hi)
        rest = lambda n: (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(pages[order[n]]) <= cells:
                n += 1
            some, order = order[:n], order[n:]
            longest = len(pages[some[-1]])
            strips = [(lo, min(lo + cells, longest)) for lo in range(0, longest, cells)]
            total = np.zeros((longest, n), np.float32)
            whole = padded([part(k, 0, None) for k in some]) if len(strips) == 1 else None
            for d, way in (("f", 1), ("b", -1)):
                state = rest(n)
                for lo, hi in strips[::way]:
                    x, mask = whole or padded([part(k, lo, hi) for k in some])
                    got, state = self._walk(x[::way], mask[::way], d, state)
                    total[lo:hi] += got[::way]
            p = 1 / (1 + np.exp(-(total + self.w["c"])))
            for j, k in enumerate(some):
                out[k] = p[: len(pages[k]), j]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


def made_up_page(r: random.Random) -> tuple[str, list[str]]:
    """(html, main-text blocks) of a random layout; main and other blocks draw from the same words."""
    syllables = ["an", "er", "the", "ou", "le", "ion", "st", "re", "mi", "que", "ein", "und", "la", "ver"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    say = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi))) + r.choice([".", ".", "", "!"])
    noise = lambda: r.choice(["", "", f' class="{word()}"', f' id="{word()}"', f' class="{word()} c{r.randint(1, 99)}"'])
    named = lambda *names: r.choice([f' class="{n}"' for n in names] + [f' id="{n}"' for n in names] + [f' class="{word()} {n}"' for n in names])
    main: list[str] = []

    def keep(lo: int, hi: int) -> str:
        t = say(lo, hi)
        main.append(t)
        return t

    def items(n: int, link: float = 0.9) -> str:
        return "".join(f'<li{noise()}>{f"<a href=/{word()}>{say(1, 3)}</a>" if r.random() < link else say(1, 6)}</li>' for _ in range(n))

    def other(kind: str) -> str:
        if kind == "nav":
            tag, name = r.choice([("nav", noise()), ("div", named("nav", "menu", "navbar", "breadcrumb", "navigation")), ("ul", named("menu", "nav"))])
            return f"<{tag}{name}><ul>{items(r.randint(2, 9))}</ul></{tag}>" if tag != "ul" else f"<ul{name}>{items(r.randint(2, 9))}</ul>"
        if kind == "header":
            return f"<header{noise()}><{(t := r.choice(['div', 'p', 'h1', 'h2']))}>{say(1, 8)}</{t}><p>{say(2, 9)}</p></header>"
        if kind == "ad":
            return f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{r.choice([say(3, 30), f'<p>{say(3, 40)}</p>', f'<a href=/x>{say(2, 9)}</a>'])}</div>"
        if kind == "aside":
            tag, name = r.choice([("aside", noise()), ("div", named("sidebar", "related", "widget", "side"))])
            return f"<{tag}{name}><h3>{say(1, 4)}</h3><p>{say(4, 40)}</p><ul>{items(r.randint(1, 6))}</ul></{tag}>"
        if kind == "notice":
            return f"<div{named('cookie', 'notice', 'consent', 'popup', 'alert', 'gdpr', 'paywall')}><p>{say(4, 30)}</p></div>"
        if kind == "form":
            return f"<form{noise()}><label>{say(1, 4)}</label><input name=q><p>{say(2, 12)}</p></form>" if r.random() < 0.6 else f"<div{named('newsletter', 'subscribe', 'login', 'signup', 'search')}><p>{say(3, 20)}</p></div>"
        if kind == "comments":
            tag, name = r.choice([("section", named("comments", "comment", "responses", "discussion", "replies")), ("div", named("comments", "comment", "disqus", "replies"))])
            body = "".join(f"<{(t := r.choice(['div', 'li', 'article']))}{named('comment', 'reply')}><p>{say(5, 70)}</p></{t}>" for _ in range(r.randint(1, 5)))
            return f"<{tag}{name}><h3>{say(1, 3)}</h3>{body}</{tag}>"
        if kind == "share":
            return f"<div{named('share', 'social', 'tags', 'meta', 'byline')}>{r.choice([say(1, 6), f'<ul>{items(3)}</ul>'])}</div>"
        tag, name = r.choice([("footer", noise()), ("footer", noise()), ("div", named("footer", "copyright", "legal"))])
        return f"<{tag}{name}>{r.choice(['&copy; ', ''])}{say(3, 20)}{r.choice(['', f'<p>{say(3, 30)}</p>', f'<ul>{items(4)}</ul>'])}</{tag}>"

    def paragraph() -> str:
        k = r.random()
        if r.random() < 0.08:  # an article may hold what pages put around theirs
            main.append(r.choice(["All rights reserved.", "We use cookies.", "Sponsored", "Subscribe", "Home", "Comments", "Advertisement"]) if r.random() < 0.6 else f"{r.choice(['Copyright', 'Contact', 'Share', 'Privacy', 'Terms', 'Related', 'Cookies'])} {say(0, 12)}".strip())
            return f"<p{noise()}>{main[-1]}</p>"
        if k < 0.55:
            return f"<p{noise()}>{keep(1, 90)}</p>"
        if k < 0.65:
            return f"<p><b>{keep(1, 50)}<br>"  # left open
        if k < 0.72:
            t = r.choice(["h2", "h3", "h4"])
            return f"<{t}>{keep(1, 8)}</{t}>"
        if k < 0.8:
            return "<ul>" + "".join(f"<li>{keep(2, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.86:
            return f"<blockquote>{f'<p>{keep(4, 40)}</p>' if r.random() < 0.5 else keep(4, 40)}</blockquote>"
        if k < 0.9:
            return f"<pre>{keep(3, 20)}</pre>"
        if k < 0.94:
            return "<table>" + "".join(f"<tr><td>{keep(1, 4)}</td><td>{keep(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if k < 0.97:
            return f"<div{noise()}><p>{keep(3, 60)}</p></div>"
        return f"<figure><img src=x><figcaption>{keep(2, 12)}</figcaption></figure>"

    if (plain := r.random()) < 0.34:
        page = _nameless(r, main, say, items, word, plain / 0.34)
        return f"<!DOCTYPE html><html><head><title>{say(1, 9)}</title></head><body>{page}</body></html>", main
    before = [other(k) for k in ("nav", "header", "ad", "notice", "form", "share") if r.random() < {"nav": 0.8, "header": 0.5, "ad": 0.6}.get(k, 0.25)]
    r.shuffle(before)
    body = []
    if r.random() < 0.8:
        body.append(f"<header{noise()}><h1>{keep(1, 14)}</h1></header>" if r.random() < 0.15 else f"<h1{noise()}>{keep(1, 60)}</h1>")
    for _ in range(r.randint(12, 60) if r.random() < 0.12 else r.randint(0 if body else 1, 9)):
        body.append(paragraph())
        if r.random() < 0.06:
            body.append(other(r.choice(["ad", "aside", "form", "share", "nav"])))
    late = [other(k) for k in ("share", "comments", "aside") if r.random() < 0.15]
    inside = r.random() < 0.5
    tag, name = r.choice([("article", noise()), ("article", noise()), ("article", ""), ("main", noise()), ("div", named("content", "post", "entry", "article", "story", "main")), ("section", named("content", "article", "post"))])
    core = f"<{tag}{name}>" + "".join(body) + ("".join(late) if inside else "") + f"</{tag}>"
    if tag == "article" and r.random() < 0.25:
        core = f"<main{noise()}>{core}</main>"
    if r.random() < 0.2:
        core = f"<div{named('container', 'wrapper', 'page', 'row')}>{core}</div>"
    after = ([] if inside else late) + [other(k) for k in ("comments", "aside", "ad", "form", "nav", "footer") if r.random() < {"footer": 0.85, "comments": 0.3, "aside": 0.3}.get(k, 0.15)]
    page = f"<!DOCTYPE html><html><head><title>{say(1, 9)}</title><style>p{{}}</style></head><body>" + "".join(before) + core + "".join(after) + "</body></html>"
    if r.random() < 0.05:
        page = page.replace("</body></html>", "")
    return page, main


def _nameless(r: random.Random, main: list[str], say, items, word, kind: float) -> str:
    """The body of a page whose tags and names tell nothing: divisions with numbered classes, tables for layout, bare text."""
    div = lambda inner: f"<div{r.choice(['', f' class=c{r.randint(1, 9)}', f' class="{word()}"', f' id=x{r.randint(1, 99)}'])}>{inner}</div>"
    sentences = lambda n: " ".join(say(6, 18).rstrip(".!") + "." for _ in range(n))

    def text(n: int) -> str:
        main.append(sentences(n))
        return main[-1]

    around = lambda *w: f"{r.choice(w)} {say(0, 6)}".strip()
    menu = lambda: r.choice([div, str])("".join(f"<a href=/{word()}>{r.choice(['Home', 'Contact', say(1, 2), say(1, 3)])}</a>{r.choice([' ', ' | ', '<br>'])}" for _ in range(r.randint(2, 8))))
    foot = lambda: r.choice([f"Copyright {r.randint(1999, 2030)}", f"&copy; {r.randint(1999, 2030)} {say(1, 4)}", around("All rights reserved.", "Privacy", "Terms", "Impressum", "Alle Rechte vorbehalten.", "Todos los derechos reservados.")])
    extra = lambda: r.choice([lambda: around("Advertisement", "Sponsored", "Anzeige", "Publicidad"), lambda: around("We use cookies", "Cookies", "Subscribe to our newsletter", "Sign up", "Log in"), lambda: f"<ul>{items(r.randint(2, 5), 1.0)}</ul>", lambda: around("Share", "Follow us", "Related", "Search", "Comments")])()
    if kind < 0.15:  # nothing but text
        t = text(r.randint(1, 6))
        return r.choice([t, f"<p>{t}</p>", div(t), div(div(t))])
    wrap = r.choice([lambda x: f"<p>{x}</p>", div, div])
    core = "".join(wrap(text(r.randint(1, 5))) for _ in range(r.randint(1, 7)))
    if kind < 0.45:  # a table for layout: menu and text side by side, rows above and below
        cells = [f"<td>{menu()}</td>", f"<td>{core}</td>"] + ([f"<td>{extra()}</td>"] if r.random() < 0.4 else [])
        rows = ([f"<tr><td>{menu()}</td></tr>"] if r.random() < 0.4 else []) + [f"<tr>{''.join(cells)}</tr>"] + ([f"<tr><td>{foot()}</td></tr>"] if r.random() < 0.8 else [])
        return f"<table>{''.join(rows)}</table>"
    above = [div(f()) for f in (menu, extra) if r.random() < 0.5]
    below = [div(f()) for f in (extra, menu, foot) if r.random() < 0.5]
    inner = r.choice([div, lambda x: div(div(x)), str])(core)
    return "".join(above) + inner + "".join(below)


def training_set(n: int = TRAIN_PAGES, seed: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
    r, inputs, xs, ys = random.Random(seed), Inputs(), [], []
    for _ in range(n):
        html, main = made_up_page(r)
        page, k, y = blocks(html), 0, []
        for text, _, _ in page:  # main blocks come in page order, so the next one decides
            hit = k < len(main) and text == _SPACE.sub(" ", main[k]).strip()
            y.append(float(hit))
            k += hit
        if page:
            xs.append(inputs.page(page))
            ys.append(np.array(y, np.float32))
    return xs, ys


def fit(n: int = TRAIN_PAGES, epochs: int = 14, batch: int = 16, rate: float = 0.012, seed: int = 11) -> BiLSTM:
    xs, ys = training_set(n)
    net, r = BiLSTM.fresh(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(epochs):
        order = np.argsort([len(x) + r.random() * 6 for x in xs])  # batches of like length
        starts = np.arange(0, len(xs), batch)
        r.shuffle(starts)
        for lo in starts:
            some = order[lo : lo + batch]
            x, mask = padded([xs[k] for k in some])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(some):
                y[: len(ys[k]), j] = ys[k]
            step += 1
            for k, g in net.gradient(x, mask, y).items():
                g = np.clip(g, -1, 1) + 1e-5 * net.w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                net.w[k] -= (rate * (1 - 0.8 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


_FITTED: list[BiLSTM] = []


def fitted() -> BiLSTM:
    if not _FITTED:
        _FITTED.append(fit())
    return _FITTED[0]


def main_text(net: BiLSTM, inputs: Inputs, pages: list[str | None]) -> list[str]:
    cut = [blocks(h) for h in pages]
    labels = net.label(cut, inputs)
    return ["\n\n".join(t for (t, _, _), q in zip(p, y, strict=True) if q >= 0.5) for p, y in zip(cut, labels, strict=True)]


def _groups(b: pd.DataFrame, most: int, chars: int = GROUP_CHARS) -> Iterator[pd.DataFrame]:
    """Consecutive rows, at most ``most`` and about ``chars`` characters of html together."""
    size = b["html"].str.len().fillna(0).to_numpy(dtype=np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(b):
        hi = max(lo + 1, min(lo + most, int(np.searchsorted(ends, ends[lo] - size[lo] + chars, side="right"))))
        yield b.iloc[lo:hi]
        lo = hi


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", group: int = 256) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages."""
    weights = pages.sparkSession.sparkContext.broadcast(fitted().w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, inputs = BiLSTM(weights.value), Inputs()
        for b in batches:
            for some in _groups(b, group):
                text = main_text(net, inputs, list(some["html"]))
                yield pd.DataFrame({"page_id": some["page_id"], "url": some["url"], "text": text, "n_chars": pd.array([len(t) for t in text], dtype="int64")})

    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return slim.mapInPandas(run, f"page_id {dict(slim.dtypes)['page_id']}, url string, text string, n_chars long")
