"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

Each leaf block of a page is a position of the chain, with features of its
ancestors (tags, and words of class, id and role) and of its text; the labels
are main text or not.  Weights are trained by gradient ascent on the exact
conditional likelihood (forward-backward) of labelled pages, and pages are
decoded by Viterbi.

The labelled pages are made by ``labelled_pages`` from page layouts with a known
article: none of their words are those of a corpus, so the model learns layout.
Training takes a second or two on the driver and does not depend on the input;
pages are then handled row by row, without a shuffle.

Defined results: a null, empty or textless page has no blocks and the text is
empty.  Whole pages are read, whatever their length.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom_blocks import Block, blocks

SIZE = 1 << 12
TRAINING_PAGES, ROUNDS = 160, 30


def _hash(name: str) -> int:
    out = 2166136261
    for c in name.encode():
        out = (out ^ c) * 16777619 & 0xFFFFFFFF
    return (out ^ out >> 15) % SIZE


@lru_cache(maxsize=50_000)
def _path_features(path) -> tuple[int, ...]:
    names = {f"tag:{e.tag}" for e in path} | {f"mark:{w}" for e in path for w in e.marks}
    names |= {f"last:{path[-1].tag}" if path else "last:"} | {f"pair:{a.tag}>{b.tag}" for a, b in zip(path[:-1], path[1:], strict=True)}
    return tuple(sorted({_hash(n) for n in names}))


def features(block: Block) -> list[int]:
    """The features of a block, as places in the weights."""
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    own = [f"words:{min(7, int(math.log2(words)))}", f"links:{min(4, block.linked * 4 // n)}", f"ends:{text[-1] in '.!?:;'}", f"starts:{text[0].isupper()}"]
    if "©" in text or "copyright" in text[:200].lower():
        own.append("copyright")
    return [*_path_features(block.path), *map(_hash, own)]


class Chain:
    """A chain of two labels: weights by feature and label, start and transition weights."""

    def __init__(self, emit: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.emit, self.start, self.move = emit, start, move

    def scores(self, xs: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[x].sum(0) for x in xs])

    def viterbi(self, xs: list[list[int]]) -> list[int]:
        """The likeliest labels of a page."""
        if not xs:
            return []
        s = self.scores(xs).tolist()
        m00, m01, m10, m11 = self.move.ravel().tolist()
        a, b = self.start[0] + s[0][0], self.start[1] + s[0][1]
        back = []
        for e0, e1 in s[1:]:
            back.append((int(b + m10 > a + m00), int(b + m11 > a + m01)))
            a, b = max(a + m00, b + m10) + e0, max(a + m01, b + m11) + e1
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def marginals(self, xs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each position's label, and the expected number of each transition."""
        s = self.scores(xs)
        n = len(s)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = self.start + s[0]
        for i in range(1, n):
            f[i] = np.logaddexp(f[i - 1][0] + self.move[0], f[i - 1][1] + self.move[1]) + s[i]
        for i in range(n - 2, -1, -1):
            v = s[i + 1] + b[i + 1]
            b[i] = np.logaddexp(self.move[:, 0] + v[0], self.move[:, 1] + v[1])
        total = np.logaddexp(*f[-1])
        pairs = f[:-1, :, None] + self.move + (s + b)[1:, None, :] - total
        return np.exp(f + b - total), np.exp(pairs).sum(0)


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, rate: float = 0.5, ridge: float = 1e-3) -> Chain:
    """A chain fitted to pages of (features of each block, labels), by AdaGrad on the penalised likelihood."""
    chain = Chain(np.zeros((SIZE, 2)), np.zeros(2), np.zeros((2, 2)))
    sums = [np.full_like(w, 1e-6) for w in (chain.emit, chain.start, chain.move)]
    pages = [p for p in pages if p[0]]
    for _ in range(rounds):
        grads = [-ridge * len(pages) * w for w in (chain.emit, chain.start, chain.move)]
        for xs, ys in pages:
            p, moves = chain.marginals(xs)
            gap = np.eye(2)[ys] - p
            for x, g in zip(xs, gap, strict=True):
                grads[0][x] += g  # a block's features are distinct but for hash collisions, which only weaken one
            grads[1] += gap[0]
            grads[2] -= moves
            np.add.at(grads[2], (ys[:-1], ys[1:]), 1.0)
        for w, g, s in zip((chain.emit, chain.start, chain.move), grads, sums, strict=True):
            s += g * g
            w += rate * g / np.sqrt(s)
    return chain


_WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et magna aliqua enim minim veniam quis nostrud".split()


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Pages of varied layout, as blocks and labels; main text carries a mark that is taken off before features are made."""
    rng = random.Random(seed)

    def prose(lo: int, hi: int) -> str:
        words = [rng.choice(_WORDS) for _ in range(rng.randint(lo, hi))]
        return " ".join(words).capitalize() + rng.choice([".", ".", "", "!", "?"])

    def main(text: str) -> str:
        return "\x01" + text

    def listing(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{prose(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def article() -> str:
        body = [f"<h1>{main(prose(2, 10))}</h1>"]
        for _ in range(rng.randint(1, 9)):
            kind, text = rng.random(), main(prose(1, 60) if rng.random() < 0.8 else prose(60, 300))
            if kind < 0.6:
                body.append(f"<p>{text}</p>")
            elif kind < 0.7:
                body.append(f"<p><b>{text}<br><p>{main(prose(3, 40))}</p>")
            elif kind < 0.76:
                body.append(f"<h2>{text[:40]}</h2>")
            elif kind < 0.82:
                body.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.88:
                body.append("<ul>" + "".join(f"<li>{main(prose(2, 14))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                body.append(f"<pre>{text}</pre>")
            elif kind < 0.96:
                body.append(f'<div class="ad">{prose(2, 12)}</div>')
            else:
                body.append(f"<table><tr><td>{main(prose(1, 4))}</td><td>{main(prose(1, 4))}</td></tr></table>")
        if rng.random() < 0.15:
            body.append(f'<div class="share">{listing(3)}</div>')
        return "".join(body)

    def junk() -> str:
        return rng.choice([
            lambda: f"<nav>{listing(rng.randint(2, 7))}</nav>",
            lambda: f'<div class="{rng.choice(["menu", "nav", "navbar", "breadcrumb", "topbar"])}">{listing(4)}</div>',
            lambda: f'<header>{rng.choice([f"<h1>{prose(1, 4)}</h1>", f"<div>{prose(1, 6)}</div>"])}</header>',
            lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo"])}">{prose(2, 25)}</div>',
            lambda: f'<aside class="{rng.choice(["sidebar", "related", "widget"])}"><h3>{prose(1, 3)}</h3><p>{prose(3, 30)}</p>{listing(3)}</aside>',
            lambda: f'<div class="sidebar" id="sidebar"><p>{prose(4, 30)}</p></div>',
            lambda: f'<div class="{rng.choice(["cookie", "cookie-notice", "notice", "consent", "popup", "newsletter"])}"><p>{prose(4, 25)}</p><button>{prose(1, 2)}</button></div>',
            lambda: f'<form action="/s"><label>{prose(1, 3)}</label><input name="q"><button>{prose(1, 2)}</button></form>',
            lambda: f'<section class="{rng.choice(["comments", "comment-list", "responses"])}" id="comments"><h2>{prose(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{prose(3, 60)}</p></div>' for _ in range(3)) + "</section>",
            lambda: f'<div class="comment"><p>{prose(5, 50)}</p></div>',
        ])()

    def foot() -> str:
        return rng.choice([f"<footer>&copy; {prose(1, 4)} &middot; {prose(2, 20)}</footer>", f'<div class="footer">{prose(2, 20)}</div>', f'<div id="footer"><p>{prose(2, 20)}</p>{listing(2)}</div>'])

    out = []
    for _ in range(n):
        before = "".join(junk() for _ in range(rng.randint(0, 4)))
        after = "".join(junk() for _ in range(rng.randint(0, 3)))
        holder = rng.choice(["article", "article", "main", "div class=content", "div class=article", "div id=main", 'div class="post entry"', "section class=story"])
        inside = f"<article>{article()}</article>" if holder == "main" and rng.random() < 0.5 else article()
        late = "".join(junk() for _ in range(rng.randint(0, 1))) if rng.random() < 0.3 else ""
        close = "" if rng.random() < 0.08 else f"</{holder.split()[0]}>"
        page = f"<!DOCTYPE html><html><head><title>{prose(2, 6)}</title><style>p{{}}</style></head><body>{before}<{holder}>{inside}{late}{close}{after}{foot()}"
        page += "" if rng.random() < 0.1 else "</body></html>"
        found = blocks(page)
        labels = [int("\x01" in b.text) for b in found]
        out.append(([Block(b.text.replace("\x01", "").strip() or "x", b.path, b.linked) for b in found], labels))
    return out


@lru_cache(maxsize=1)
def fitted() -> Chain:
    """The chain trained on the labelled pages; the same in every process."""
    return train([([features(b) for b in page], labels) for page, labels in labelled_pages()])


def main_text(page: str | None, chain: Chain) -> str:
    """The main text: its blocks, joined by one line feed."""
    found = blocks(page or "")
    labels = chain.viterbi([features(b) for b in found])
    return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), chain: Chain | None = None) -> DataFrame:
    """The kept columns and text, a row for each row of pages."""
    chain = chain or fitted()
    shared = pages.sparkSession.sparkContext.broadcast((chain.emit, chain.start, chain.move))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (pages.schema[k] for k in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*shared.value)
        for batch in batches:
            texts = [main_text(x.as_py(), own) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return pages.select(*keep, F.col(html_col)).mapInArrow(run, f"{kinds}, text string")
