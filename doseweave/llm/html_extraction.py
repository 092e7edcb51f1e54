"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Two labels, main text or not, with weights for ancestor-tag, name and text features and for label changes. It is trained
by gradient ascent on the conditional likelihood of labelled pages and decoded by Viterbi. The labelled pages are made
here from a seed: page parts in many spellings, around paragraphs of made-up words, each part knowing its label.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from doseweave.llm.common import map_texts
from doseweave.llm.page_blocks import FEATURES, block_features, leaf_blocks

TRAINING_PAGES = 600
STEPS = 150
SEED = 7


class PageMaker:
    """Random labelled pages: (html, one label per leaf block)."""

    def __init__(self, seed: int = SEED):
        self.draw = np.random.default_rng(seed)

    def pick(self, *choices):
        return choices[int(self.draw.integers(len(choices)))]

    def chance(self, p: float) -> bool:
        return bool(self.draw.random() < p)

    def words(self, low: int, high: int, stop: bool = True) -> str:
        parts = ["an", "the", "lo", "mer", "ti", "sha", "oun", "red", "vi", "cor", "as", "en"]
        made = ["".join(self.pick(*parts) for _ in range(int(self.draw.integers(1, 4)))) for _ in range(int(self.draw.integers(low, high + 1)))]
        for i in range(9, len(made) - 1, 11):
            made[i] += "."
        return " ".join(made).capitalize() + ("." if stop else "")

    def links(self, low: int, high: int) -> tuple[str, int]:
        n = int(self.draw.integers(low, high + 1))
        return "<ul>" + "".join(f'<li><a href="/x">{self.words(1, 3, False)}</a></li>' for _ in range(n)) + "</ul>", n

    def wrapped(self, tag: str, name: str | None, inner: str) -> str:
        mark = f' {self.pick("class", "id")}="{name}"' if name else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    def boilerplate(self) -> tuple[str, list[int]]:
        kind = self.pick("nav", "ad", "foot", "head", "side", "note", "form", "comments", "share")
        paragraphs = [self.words(3, 30) for _ in range(int(self.draw.integers(1, 4)))]
        body, count = "".join(f"<p>{p}</p>" for p in paragraphs), len(paragraphs)
        if kind == "nav":
            inner, n = self.links(2, 8)
            return self.wrapped(*self.pick(("nav", None), ("div", "menu"), ("div", "navbar nav"), ("header", "site-header")), inner), [0] * n
        if kind == "ad":
            return self.wrapped(*self.pick(("div", "ad"), ("div", "advert"), ("aside", "sponsored"), ("div", "promo ads"), ("section", "ad-slot")), self.pick(self.words(4, 16), f"<p>{self.words(4, 16)}</p>")), [0]
        if kind == "foot":
            return self.wrapped(*self.pick(("footer", None), ("div", "footer"), ("div", "site-footer")), self.pick("&copy; ", "") + self.words(3, 14)), [0]
        if kind == "head":
            return self.wrapped(*self.pick(("header", None), ("div", "header"), ("div", "masthead")), self.pick(self.words(1, 6, False), f"<h1>{self.words(1, 6, False)}</h1>")), [0]
        if kind == "side":
            if self.chance(0.5):
                inner, n = self.links(2, 6)
                return self.wrapped(*self.pick(("aside", None), ("div", "sidebar"), ("div", "related")), f"<h3>{self.words(1, 3, False)}</h3>" + inner), [0] * (n + 1)
            return self.wrapped(*self.pick(("aside", None), ("div", "sidebar"), ("div", "widget")), body), [0] * count
        if kind == "note":
            return self.wrapped(*self.pick(("div", "cookie-notice"), ("div", "consent"), ("div", "newsletter"), ("dialog", None), ("div", "alert notice")), self.pick(self.words(4, 24), f"<p>{self.words(4, 24)}</p>")), [0]
        if kind == "form":
            return self.wrapped("form", self.pick(None, "search", "login"), f"<label>{self.words(1, 2, False)}</label><input><button>{self.words(1, 1, False)}</button>"), [0, 0]
        if kind == "comments":
            inner = self.pick(body, "".join(f"<li>{p}</li>" for p in paragraphs), "".join(f"<div><p>{p}</p></div>" for p in paragraphs))
            return self.wrapped(*self.pick(("div", "comments"), ("section", "comments"), ("ul", "comment-list"), ("div", "discussion"), ("ol", "comments")), inner), [0] * count
        return self.wrapped("div", self.pick("share", "social", "tags"), self.words(1, 5, False)), [0]

    def main(self) -> tuple[str, list[int]]:
        parts, labels = [], []

        def add(html: str, *own: int) -> None:
            parts.append(html)
            labels.extend(own)

        if self.chance(0.85):
            add(f"<h1>{self.words(2, 14, self.chance(0.5))}</h1>", 1)
        for _ in range(int(self.draw.integers(1, 12))):
            kind = self.draw.random()
            if kind < 0.75:
                add(f"<p>{self.pick('', '', '<b>')}{self.words(1, 90)}{self.pick('', '', '<br>')}</p>", 1)
            elif kind < 0.83:
                add(f"<{(t := self.pick('h2', 'h3'))}>{self.words(1, 8, self.chance(0.5))}</{t}>", 1)
            elif kind < 0.89:
                n = int(self.draw.integers(2, 6))
                add("<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(n)) + "</ul>", *[1] * n)
            elif kind < 0.93:
                add(f"<blockquote>{self.pick('{}', '<p>{}</p>').format(self.words(5, 40))}</blockquote>", 1)
            elif kind < 0.96:
                add(f"<pre>{self.words(3, 20)}</pre>", 1)
            else:
                html, own = self.boilerplate()
                add(html, *own)
        if self.chance(0.25):
            html, own = self.boilerplate()
            add(html, *own)
        return self.wrapped(*self.pick(("article", None), ("article", None), ("main", None), ("article", "post"), ("div", "content"), ("div", "article-body"), ("section", "story")), "".join(parts)), labels

    def page(self) -> tuple[str, list[int]]:
        before = [self.boilerplate() for _ in range(int(self.draw.integers(0, 4)))]
        after = [self.boilerplate() for _ in range(int(self.draw.integers(0, 4)))]
        parts = [*before, self.main(), *after]
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{''.join(p for p, _ in parts)}</body></html>", [x for _, own in parts for x in own]


class BlockLabeller:
    """Weights of the field: ``emission`` (score of label 1 over 0 per feature) and ``change`` (2 x 2)."""

    def __init__(self, emission: np.ndarray, change: np.ndarray):
        self.emission, self.change = emission, change

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi path over the blocks of one page."""
        if not rows:
            return []
        (stay0, to1), (to0, stay1) = self.change.tolist()
        weights, best0, best1, back = self.emission, 0.0, float(self.emission[rows[0]].sum()), []
        for row in rows[1:]:
            from0, from1 = best0 >= best1 + to0 - stay0, best0 + to1 >= best1 + stay1
            back.append((0 if from0 else 1, 0 if from1 else 1))
            best0, best1 = (best0 + stay0 if from0 else best1 + to0), (best0 + to1 if from1 else best1 + stay1) + float(weights[row].sum())
        path = [int(best1 > best0)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def train(pages: list[tuple[str, list[int]]], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-3) -> BlockLabeller:
    """Maximises the conditional log-likelihood of all pages together by forward-backward and Adam."""
    data = [(block_features(leaf_blocks(html)), labels) for html, labels in pages]
    data = [(rows, labels) for rows, labels in data if rows and len(rows) == len(labels)]
    count, length = len(data), max(len(rows) for rows, _ in data)
    x, y, mask = np.zeros((count, length, len(FEATURES))), np.zeros((count, length), int), np.zeros((count, length), bool)
    for i, (rows, labels) in enumerate(data):
        for t, row in enumerate(rows):
            x[i, t, row] = 1
        y[i, : len(rows)], mask[i, : len(rows)] = labels, True
    weights = np.zeros(len(FEATURES) + 4)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    both = mask[:, 1:]
    for step in range(1, steps + 1):
        change = weights[-4:].reshape(2, 2)
        score = np.stack([np.zeros((count, length)), x @ weights[:-4]], axis=2)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, length):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + change, axis=1) + score[:, t]
            forward[~mask[:, t], t] = forward[~mask[:, t], t - 1]
        for t in range(length - 2, -1, -1):
            after = np.logaddexp.reduce(change + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], after, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        one = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * mask
        pair = np.exp(forward[:, :-1, :, None] + change + (score + backward)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        slope = np.r_[np.einsum("itf,it->f", x, (y - one) * mask), (seen - pair.sum(axis=(0, 1))).ravel()] / count - decay * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return BlockLabeller(weights[:-4], weights[-4:].reshape(2, 2))


@cache
def default_labeller() -> BlockLabeller:
    maker = PageMaker()
    return train([maker.page() for _ in range(TRAINING_PAGES)])


def main_text(html: str, labeller: BlockLabeller) -> str:
    blocks = leaf_blocks(html)
    labels = labeller.decode(block_features(blocks))
    return "\n".join(text for (text, _, _), keep in zip(blocks, labels, strict=True) if keep)


def extracted(pages: DataFrame, labeller: BlockLabeller | None = None, keep=None) -> DataFrame:
    """Every row of ``pages`` with ``text``, the main text of its whole ``html``, and ``n_chars``, its code points.

    Character references are decoded, white space inside a block is one space and blocks are joined by line ends. Null
    and empty pages and pages without main text give an empty text. Columns of ``pages`` with the added names are
    replaced.
    """
    labeller = labeller or default_labeller()

    def work():
        def step(texts: list[bytes]) -> dict[str, list]:
            found = [main_text(t.decode("utf-8", "replace"), labeller) for t in texts]
            return {"text": found, "n_chars": [len(t) for t in found]}

        return step

    return map_texts(pages, work, "text string, n_chars long", "html", keep)
