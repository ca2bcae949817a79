"""Markdown and HTML of one document: small parsers for Arrow UDFs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from . import commonmark

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "section", "article", "br", "tr", "table", "blockquote", "pre", "ul", "ol", "main", "header", "footer", "nav", "aside"}


class _ToMarkdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> str:
    """Headings, list items and paragraphs as Markdown, one block a line; scripts and styles go."""
    p = _ToMarkdown()
    p.feed(html or "")
    p.close()
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n\n".join(x for x in lines if x and x not in ("-", "•", "*"))


class _Blocks(HTMLParser):
    """Children of the body: headings, paragraphs, items of lists and code, each with its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.items: list[list[str]] = []
        self.open: list[int] = []  # open items, by their place in items

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") or tag in _VOID:
            return
        if self.stack and self.stack[0] == "p" and (tag in _BLOCKS or tag == "p" or re.fullmatch("h[1-6]", tag)):
            self._close(0)
        if tag == "li":
            if "li" in self.stack and not {"ul", "ol"} & set(self.stack[len(self.stack) - self.stack[::-1].index("li") :]):
                self._close(len(self.stack) - 1 - self.stack[::-1].index("li"))
            self.items.append([])
            self.open.append(len(self.items) - 1)
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            self._close(len(self.stack) - 1 - self.stack[::-1].index(tag))

    def handle_data(self, data):
        if self.stack:
            self.text.append(data)
            for i in self.open:
                self.items[i].append(data)

    def _close(self, at: int) -> None:
        for tag in self.stack[at:]:
            if tag == "li":
                self.open.pop()
        top = self.stack[0]
        del self.stack[at:]
        if not self.stack:
            texts = ["".join(x) for x in self.items] if top in ("ul", "ol") else ["".join(self.text)]
            kind = "li" if top in ("ul", "ol") else top
            if top in ("ul", "ol", "p", "pre", "code") or re.fullmatch("h[1-6]", top):
                self.out += [(kind, t.strip()) for t in texts if t.strip()]
            self.text, self.items = [], []

    def close(self):
        super().close()
        if self.stack:
            self._close(0)


def html_blocks(html: str | None) -> list[tuple[str, str]]:
    """(title, text) of each heading, paragraph, list item and piece of code right below the body. A paragraph's title is the page's first heading, a heading's itself."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    out, first = [], ""
    for kind, text in p.out:
        heading = kind[0] == "h"
        first = first or (text if heading else "")
        out.append((text if heading else first if kind == "p" else "", text))
    return out


def markdown_text(md: str | None) -> str:
    """Text of Markdown, a blank line between blocks."""
    return commonmark.text(md)


def heading_sections(md: str | None) -> list[tuple[int, str, str]]:
    """(level, heading, text) for each heading, as plain text; what is before the first has level 0."""
    return commonmark.sections(md)


def heading_list(md: str | None) -> list[tuple[int, str]]:
    """(level, text) of each heading that has text."""
    return [(level, title) for level, title, _ in heading_sections(md) if level and title]


PREAMBLE = "PRÉAMBULE"


def legal_sections(text: str | None) -> list[tuple[str, str, str]]:
    """(title, path, text) by article headings; the path starts with the Titre line last seen when the article begins. A text starts with its title."""
    out: list[tuple[str, str, list[str]]] = []
    titre, body = "", None
    for line in (text or "").split("\n"):
        bare = line.strip()
        if re.match(r"(?i)titre\s+", bare):
            titre = bare
            continue
        if re.fullmatch(r"(?i)article\s+(premier|\d+)\.?", bare) or (body is None and bare.upper() == PREAMBLE):
            body = [bare, ""]
            out.append((bare, f"{titre} -> {bare}" if titre else bare, body))
        elif bare or body:
            if body is None:
                body = []
                out.append((PREAMBLE, f"{titre} -> {PREAMBLE}" if titre else PREAMBLE, body))
            body.append(line)
    return [(title, path, joined) for title, path, lines in out if (joined := "\n".join(lines).strip())]
