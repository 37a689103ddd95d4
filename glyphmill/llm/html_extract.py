"""Operator 4, main text of web pages by a linear-chain conditional random field over leaf blocks.

The field is trained on labelled pages that this module writes from layouts of its own: random words
in random page frames (with and without semantic elements, nested or flat, class names of many
styles), whose blocks are known to be main text or not.  It sees ancestor tags, words of the ancestors'
class and id names, and shape of the text, never particular words of it.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_of
from .crf import Chain
from .dom import BLOCKS, Block, blocks

# Words that page authors use in class and id names, by what they name.
ASIDE = "ad ads advert advertisement sponsored promo banner sponsor nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar sidebar side rail widget related recommended recommendations popular trending share sharing social follow newsletter subscribe signup cookie cookies consent notice gdpr popup modal overlay comment comments reply replies respondents discussion disqus respond form login search tags tag meta byline author toc copyright legal disclaimer toolbar skip links alert".split()
CONTENT = "content article post entry story body main text prose markdown copy page blog single".split()
NAMED = frozenset(ASIDE) | frozenset(CONTENT)
COARSE = frozenset("nav aside footer header form article main section ul ol table figure blockquote pre button label figcaption a h1 h2 h3 h4 p li td div address details summary menu dialog".split())
AWAY = frozenset(ASIDE)
KEEP = frozenset(CONTENT)
MARKS = "\ue000\ue001"


def features(page: list[Block]) -> list[set[str]]:
    out, n = [], len(page)
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        f = {"bias"}
        inner = [t for t in b.tags if t in BLOCKS]
        f.update("in:" + t for t in set(b.tags) & COARSE)
        f.add("leaf:" + (inner[-1] if inner else "none"))
        named = b.names & NAMED
        f.update("name:" + w for w in named)
        if b.names & AWAY:
            f.add("names:aside")
        if b.names & KEEP:
            f.add("names:content")
        if not {"article", "main"} & set(b.tags) and not b.names & KEEP:
            f.add("outside")
        f.add(f"words:{min(6, words.bit_length())}")
        share = b.linked / max(1, len(b.text))
        f.add("links:" + ("none" if share == 0 else "few" if share < 0.3 else "half" if share < 0.8 else "all"))
        f.add("end:" + ("stop" if b.text[-1] in ".!?…\"”»:" else "open"))
        if b.text[0] in "©®" or "©" in b.text[:40]:
            f.add("copyright")
        f.add("commas" if "," in b.text else "no commas")
        f.add("place:" + ("first" if i == 0 else "last" if i == n - 1 else "early" if 5 * i < n else "late" if 5 * i >= 4 * n else "middle"))
        out.append(f)
    return out


class Layouts:
    """Random labelled pages.  Every text node is written by ``main`` or ``other``."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, stop: bool = True) -> str:
        r = self.r
        ws = ["".join(r.choice(["ka", "lo", "mi", "ren", "ta", "so", "vel", "un", "der", "ch"]) for _ in range(r.randint(1, 4))) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
        text = " ".join(ws).strip(",").capitalize()
        return text + (r.choice(["..", ".", ".", "!", "?"])[0] if stop else "")

    def main(self) -> list[tuple[str, int]]:
        """Main text: paragraphs of any length, headings, lists, quotes, tables, code."""
        r, out = self.r, []
        if r.random() < 0.9:
            out.append((f"<h1>{self.words(1, 14, r.random() < 0.4)}</h1>", 1))
        for _ in range(r.randint(1, 12)):
            k = r.random()
            if k < 0.66:
                text = self.words(*r.choice([(1, 4), (5, 20), (20, 90), (60, 200)]))
                if r.random() < 0.15:
                    text = f"<b>{self.words(1, 8)}</b> " + text
                if r.random() < 0.12:
                    text += f' <a href="/x">{self.words(1, 3, False)}</a> {self.words(2, 9)}'
                out.append((f"<p>{text}" + r.choice(["</p>", ""]), 1))
            elif k < 0.76:
                out.append((f"<h{r.randint(2, 4)}>{self.words(1, 8, False)}</h2>", 1))
            elif k < 0.84:
                out += [(f"<ul><li>{self.words(2, 18, r.random() < 0.5)}</li></ul>", 1) for _ in range(r.randint(1, 3))]
            elif k < 0.90:
                out.append((f"<blockquote>{self.words(5, 40)}</blockquote>", 1))
            elif k < 0.94:
                out.append((f"<table><tr><td>{self.words(1, 5, False)}</td></tr></table>", 1))
            elif k < 0.97:
                out.append((f"<figure><figcaption>{self.words(3, 14)}</figcaption></figure>", 1))
            else:
                out += self.aside(r.choice(["ad", "related", "share", "newsletter", "form", "comments", "header", "footer"]))
        return out

    def aside(self, name: str) -> list[tuple[str, int]]:
        r = self.r
        tag = r.choice(["div", "div", "aside", "section"]) if name not in ("nav", "footer", "header", "form") else r.choice([name, "div"])
        cls = r.choice([name, f"{name}-box", f"site-{name}", f"{name} wrap"])
        how = f' class="{cls}"' if r.random() < 0.85 or tag == "div" else ""
        inner = []
        for _ in range(r.randint(1, 5)):
            k = r.random()
            if name in ("nav", "related", "breadcrumb", "menu", "sidebar", "tags") and k < 0.75:
                inner.append(f'<ul><li><a href="/{k}">{self.words(1, 5, False)}</a></li></ul>')
            elif k < 0.25:
                inner.append(f"<h3>{self.words(1, 4, False)}</h3>")
            elif k < 0.8:
                inner.append(f"<p>{self.words(2, 40 if 'comment' in name else 16)}</p>")
            else:
                inner.append(f"<span>{self.words(1, 12)}</span>")
        if name == "header" and r.random() < 0.7:
            inner = [f"<h1>{self.words(1, 5, False)}</h1>", f'<nav><a href="/">{self.words(1, 2, False)}</a></nav>'][: r.randint(1, 2)] + inner[:1]
        if "form" in name and r.random() < 0.7:
            inner.append(f"<label>{self.words(1, 3, False)}</label><input><button>{self.words(1, 2, False)}</button>")
        if name == "footer" and r.random() < 0.6:
            inner.append(f"© {self.words(1, 6)}")
        return [(f"<{tag}{how}>" + "".join(inner) + f"</{tag}>", 0)]

    def page(self) -> list[tuple[str, int]]:
        r = self.r
        before = [x for name in r.sample(["nav", "header", "ad", "cookie-notice", "breadcrumb", "banner", "search-form", "menu", "promo"], r.randint(0, 4)) for x in self.aside(name)]
        after = [x for name in r.sample(["comments", "comment-list", "footer", "related", "sidebar", "share", "newsletter", "ad", "form", "tags", "popular", "legal"], r.randint(0, 5)) for x in self.aside(name)]
        if r.random() < 0.5:
            after += self.aside("footer")
        shell = r.choice(["<article>", "<article>", "<main>", '<main><article class="post">', '<div class="content">', '<div id="main-content">', '<div class="article-body">', '<section class="entry-content">', '<div class="story">', "<div>"])
        ends = "".join(f"</{t[1:].split()[0].split('>')[0]}>" for t in reversed(["<" + x for x in shell.split("<")[1:]]))
        return [("<html><body>", -1), *before, (shell, -1), *self.main(), (ends, -1), *after, ("</body></html>", -1)]


def labelled_pages(n: int, seed: int = 3) -> tuple[list[list[set[str]]], list[list[int]]]:
    """Features and labels.  A private mark in front of each text tells its label after parsing."""
    import re

    made, xs, ys = Layouts(seed), [], []
    for _ in range(n):
        html = "".join(h if y < 0 else re.sub(r">(?=[^<\s])", f">{MARKS[y]}", h) for h, y in made.page())
        found = blocks(html)
        labels = [next((MARKS.index(c) for c in b.text if c in MARKS), 0) for b in found]
        for b in found:
            b.text = b.text.translate(dict.fromkeys(map(ord, MARKS))) or "."
        if found:
            xs.append(features(found))
            ys.append(labels)
    return xs, ys


_MODEL: list[Chain] = []


def model() -> Chain:
    """Trained once in a session, on the driver, from 1000 pages."""
    if not _MODEL:
        _MODEL.append(Chain.train(*labelled_pages(1000)))
    return _MODEL[0]


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    keep = chain.decode(features(found))
    return "\n".join(b.text for b, y in zip(found, keep) if y)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars (code points).

    The whole html is read; null and empty html give an empty text.  Malformed pages are read as far as
    they go: unclosed elements end with the page.  Repeated rows are extracted each.
    """
    chain = chain or model()

    def run(batches):
        for batch in batches:
            texts = [main_text(h, chain) for h in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
