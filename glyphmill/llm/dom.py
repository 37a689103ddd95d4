"""Leaf blocks of a web page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

# Element classes of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style template iframe head title textarea select noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes xmp".split())
APART = BLOCKS | {"noscript", "xmp"}  # their text is a block of its own
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("table ul ol dl div section article aside body main nav form".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
IN_HEAD = frozenset("base link meta noscript noframes script style template title".split())
NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # ancestors, outermost first
    names: frozenset[str]  # words of the ancestors' class, id and role
    linked: int  # characters within links


def blocks(page: str) -> list[Block]:
    """All leaf blocks in page order; nothing is dropped but markup, what a
    page never shows as text (``HIDDEN``) and empty text.  Whether a style hides an element is not asked.  noscript is read
    like any element, the text of xmp stands for itself, markup and references in it too."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    parts: list[str] = []
    linked, links, hidden = 0, 0, 0
    shown: tuple = ((), frozenset())
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, shown[0], shown[1], min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal shown, linked
        if stack and stack[-1][0] == "head" and piece.strip():
            close(len(stack) - 1)
        if hidden or not piece:
            return
        if not parts:
            if not piece.strip():
                return
            shown = (tuple(t for t, _ in stack), frozenset().union(*(c for _, c in stack)) if stack else frozenset())
        parts.append(piece)
        if links:
            linked += len(piece.strip())

    def close(k: int) -> None:
        nonlocal links, hidden
        while len(stack) > k:
            t, _ = stack.pop()
            links -= t == "a"
            hidden -= t in HIDDEN

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in APART:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:  # its end tag may be left out
            close(len(stack) - 1)
        if tag in ("br", "wbr", "img", "input"):
            add(" " if tag == "br" else "")
            if tag == "br" and parts:
                parts.append(" ")
            continue
        if tag in APART:
            flush()
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in BARRIER:
                    break
        if tag in VOID:
            continue
        own = m[3]
        names = frozenset()
        if own and not own.isspace():
            names = frozenset(w.lower() for a in ATTR.finditer(own) for w in NAMES.findall(a[2] or a[3] or a[4] or ""))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag == "xmp":
                stack.append((tag, names))
                add(page[at : end.start() if end else n].replace("&", "&amp;"))
                flush()
                close(len(stack) - 1)
            at = end.end() if end else n
            continue
        if own.endswith("/") and tag not in BLOCKS:
            continue
        stack.append((tag, names))
        links += tag == "a"
        hidden += tag in HIDDEN
    flush()
    return out
