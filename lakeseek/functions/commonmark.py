"""Markdown of one document as blocks and plain text, by the rules of CommonMark.

Blocks are made line by line: containers (quotes, items) take their lines off and what
is left is parsed again. Inline marks are taken out by delimiter runs. Time is linear in
the text but for nested containers, which go NESTED deep; deeper marks are
text. A closing run looks at the BACK openers before it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

NESTED, BACK = 60, 500
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^`]*|(?<=~).*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:( +)(.*)|\s*)$")
_QUOTE = re.compile(r" {0,3}> ?")
_HTML = re.compile(r" {0,3}<(?:(script|pre|style|textarea)\b|!--|[?]|![A-Za-z]|/?(?:address|article|aside|base|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$))", re.I)
_REF = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(<[^<>\n]*>|\S+)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
_PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*|[\w.+\-]+@[\w.\-]+)>")
_RAW = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9\-]*(?:\s+[A-Za-z_:][\w.:\-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|!--.*?-->|[?].*?[?]>|![A-Za-z][^>]*>)", re.S)
_DEST = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")


@dataclass
class Block:
    kind: str  # heading, paragraph, code, html, rule, quote, list, item
    text: str = ""
    level: int = 0
    inner: list[Block] = field(default_factory=list)


def blocks(md: str | None) -> tuple[list[Block], set[str]]:
    """A text's blocks, with raw inline text, and the labels of its link references."""
    labels: set[str] = set()
    return _parse((md or "").replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�").expandtabs(4).split("\n"), labels, 0), labels


def _starts(line: str) -> bool:
    """Whether a line begins a block that can end a paragraph."""
    item = _ITEM.match(line)
    return bool(_ATX.match(line) or _RULE.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _HTML.match(line) or (item and item[4] and item[2] in ("-", "+", "*", "1.", "1)")))


def _open(last: str, fenced: bool) -> bool:
    """Whether a container's last line is a paragraph's, which a line without the container's mark can go on with."""
    while m := _QUOTE.match(last) or (_ITEM.match(last) if not _RULE.match(last) else None):
        last = last[m.end() :] if m.re is _QUOTE else m[4] or ""
    return bool(last.strip()) and not fenced and not _ATX.match(last) and not _RULE.match(last) and not _FENCE.match(last) and not last.startswith("    ")


def _refs(text: str, labels: set[str]) -> str:
    """text without the link references that it begins with, whose labels are kept."""
    at = 0
    while m := _REF.match(text, at):
        labels.add(_label(m[1]))
        at = m.end()
    return text[at:]


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _parse(lines: list[str], labels: set[str], depth: int) -> list[Block]:
    out: list[Block] = []
    held: list[str] = []  # of a paragraph
    i, n = 0, len(lines)

    def end() -> None:
        text = _refs("\n".join(x.strip() for x in held), labels)
        if text.strip():
            out.append(Block("paragraph", text))
        held.clear()

    while i < n:
        line = lines[i]
        if not line.strip():
            end()
            i += 1
        elif held and (m := _SETEXT.match(line)):
            text = _refs("\n".join(x.strip() for x in held), labels)
            held.clear()
            if text.strip():
                out.append(Block("heading", text, 1 if m[1][0] == "=" else 2))
            else:
                held.append(line)
            i += 1
        elif not held and line.startswith("    "):
            j = i
            while j < n and (lines[j].startswith("    ") or not lines[j].strip()):
                j += 1
            out.append(Block("code", "\n".join(x[4:] for x in lines[i:j]).strip("\n") + "\n"))
            i = j
        elif m := _ATX.match(line):
            end()
            out.append(Block("heading", (m[2] or "").strip().rstrip("#") if set(m[2] or "") <= {"#"} else m[2].strip(), len(m[1])))
            i += 1
        elif m := _FENCE.match(line):
            end()
            indent, close = len(m[1]), re.compile(r" {0,3}" + re.escape(m[2][0]) + "{" + str(len(m[2])) + r",}[ \t]*$")
            j = i + 1
            while j < n and not close.match(lines[j]):
                j += 1
            out.append(Block("code", "".join(x[min(indent, len(x) - len(x.lstrip(" "))) :] + "\n" for x in lines[i + 1 : j])))
            i = j + 1
        elif _RULE.match(line):
            end()
            out.append(Block("rule"))
            i += 1
        elif depth < NESTED and _QUOTE.match(line):
            end()
            own: list[str] = []
            fenced = False
            while i < n and ((m := _QUOTE.match(lines[i])) or (lines[i].strip() and not _starts(lines[i]) and _open(own[-1], fenced))):
                own.append(lines[i][m.end() :] if m else lines[i].lstrip())
                fenced ^= bool(_FENCE.match(own[-1]))
                i += 1
            out.append(Block("quote", inner=_parse(own, labels, depth + 1)))
        elif depth < NESTED and (m := _ITEM.match(line)) and (not held or _starts(line)):
            end()
            i = _item(lines, i, m, labels, depth, out)
        elif not held and (m := _HTML.match(line)):
            stop = re.compile(rf"</{m[1]}>" if m[1] else "-->" if "<!--" in m[0] else r"[?]>" if "<?" in m[0] else r"$^", re.I)
            j = i
            while j < n and (m[1] or "<!--" in m[0] or "<?" in m[0] or lines[j].strip()) and not stop.search(lines[j]):
                j += 1
            out.append(Block("html", "\n".join(lines[i : j + 1])))
            i = j + 1
        else:
            held.append(line)
            i += 1
    end()
    return out


def _item(lines: list[str], i: int, m: re.Match, labels: set[str], depth: int, out: list[Block]) -> int:
    """Takes an item's lines from i on, into the list before it if that is of its kind; where the next block begins."""
    kind = m[2][-1]
    gap = len(m[3] or " ")
    indent = len(m[1]) + len(m[2]) + (gap if gap <= 4 and m[4] else 1)
    own = [(" " * (gap - 1) if gap > 4 else "") + (m[4] or "")]
    fenced, i = bool(_FENCE.match(own[0])), i + 1
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            j = i
            while j < len(lines) and not lines[j].strip():
                j += 1
            if (len(own) == 1 and not own[0].strip()) or j == len(lines) or not lines[j].startswith(" " * indent):
                break
            own += [""] * (j - i)
            i = j
            continue
        if line.startswith(" " * indent):
            own.append(line[indent:])
        elif not _starts(line) and not _ITEM.match(line) and _open(own[-1], fenced):
            own.append(line.lstrip())
        else:
            break
        fenced ^= bool(_FENCE.match(own[-1]))
        i += 1
    item = Block("item", inner=_parse(own, labels, depth + 1))
    if out and out[-1].kind == "list" and out[-1].text == kind:
        out[-1].inner.append(item)
    else:
        out.append(Block("list", kind, inner=[item]))
    while i < len(lines) and not lines[i].strip() and i + 1 < len(lines) and (nxt := _ITEM.match(lines[i + 1])) and nxt[2][-1] == kind and not _RULE.match(lines[i + 1]):
        i += 1  # blank lines between items of one list
    return i


def inline_text(raw: str, labels: set[str] = frozenset()) -> str:
    """Inline Markdown as text: escapes and entities decoded, emphasis, links, images and tags taken off; an image says nothing."""
    out: list[str] = []
    runs: list[list] = []  # delimiter runs: [place in out, character, length, opens, closes]
    opened: list[tuple[int, int, bool, int]] = []  # brackets: place in out, place in runs, image, place in raw
    unclosed: set[int] = set()  # lengths of backtick runs that nothing closes
    i, n = 0, len(raw)
    while i < n:
        c = raw[i]
        if c == "\\" and i + 1 < n and (raw[i + 1] in _PUNCT or raw[i + 1] == "\n"):
            out.append(raw[i + 1])
            i += 2
        elif c == "`":
            j = i
            while j < n and raw[j] == "`":
                j += 1
            close = re.compile(r"(?<!`)" + "`" * (j - i) + r"(?!`)").search(raw, j) if j - i not in unclosed else None
            if not close:
                unclosed.add(j - i)
            code = raw[j : close.start()].replace("\n", " ") if close else ""
            out.append(raw[i:j] if not close else code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code)
            i = close.end() if close else j
        elif c == "<" and (m := _AUTO.match(raw, i) or _RAW.match(raw, i)):
            out.append(m[1] if m.re is _AUTO else "")
            i = m.end()
        elif c == "&" and (m := re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]*);").match(raw, i)):
            out.append(html.unescape(m[0]))
            i = m.end()
        elif c in "*_":
            j = i
            while j < n and raw[j] == c:
                j += 1
            before, after = raw[i - 1] if i else " ", raw[j] if j < n else " "
            space, punct = (lambda x: x.isspace()), (lambda x: x in _PUNCT or not (x.isalnum() or x.isspace()))
            left = not space(after) and (not punct(after) or space(before) or punct(before))
            right = not space(before) and (not punct(before) or space(after) or punct(after))
            runs.append([len(out), c, j - i, left and (c == "*" or not right or punct(before)), right and (c == "*" or not left or punct(after)), j - i])
            out.append(raw[i:j])
            i = j
        elif c == "[" or (c == "!" and raw[i + 1 : i + 2] == "["):
            i += 1 + (c == "!")
            opened.append((len(out), len(runs), c == "!", i))
            out.append("![" if c == "!" else "[")
        elif c == "]" and opened:
            place, first, image, start = opened.pop()
            said = raw[start:i]
            m = _DEST.match(raw, i + 1)
            if not m:
                m = _LABEL.match(raw, i + 1)
                m = m if m and _label(m[1] or said) in labels else None
            if m or (raw[i + 1 : i + 2] != "[" and _label(said) in labels):
                _emphasis(out, runs, first)
                out[place] = ""
                if image:
                    out[place:] = [""] * (len(out) - place)
                else:
                    opened = [x for x in opened if x[2]]  # no links in links
                i = m.end() if m else i + 1
            else:
                out.append("]")
                i += 1
        else:
            m = re.compile(r"[^\\`<&*_\[\]!]+").match(raw, i)
            out.append(re.sub(r" *\n *", "\n", m[0]) if m else c)
            i = m.end() if m else i + 1
    _emphasis(out, runs, 0)
    return "".join(out)


def _emphasis(out: list[str], runs: list[list], first: int) -> None:
    """Pairs delimiter runs from the first on, and takes off what they use."""
    stack: list[int] = []
    for k in range(first, len(runs)):
        _, c, _, opens, closes, size = runs[k]
        if closes:
            for s in range(len(stack) - 1, max(-1, len(stack) - 1 - BACK), -1):
                o = runs[stack[s]]
                odd = (o[4] or opens) and (o[5] + size) % 3 == 0 and (o[5] % 3 or size % 3)
                if o[1] != c or odd:
                    continue
                while o[2] and runs[k][2]:
                    used = 2 if o[2] >= 2 and runs[k][2] >= 2 else 1
                    o[2] -= used
                    runs[k][2] -= used
                del stack[s + (o[2] > 0) :]
                if not runs[k][2]:
                    break
        if opens and runs[k][2]:
            stack.append(k)
    for place, c, left, *_ in runs[first:]:
        out[place] = c * left
    del runs[first:]


def _walk(found: list[Block], labels: set[str]) -> Iterator[tuple[str, int, str]]:
    for b in found:
        if b.kind in ("heading", "paragraph"):
            yield b.kind, b.level, inline_text(b.text, labels).strip()
        elif b.kind == "code":
            yield b.kind, 0, b.text.rstrip("\n")
        elif b.inner:
            yield from _walk(b.inner, labels)


def text(md: str | None) -> str:
    """Plain text: blocks in order, a blank line between; raw HTML, images and rules say nothing."""
    return "\n\n".join(t for *_, t in _walk(*blocks(md)) if t)


def sections(md: str | None) -> list[tuple[int, str, str]]:
    """(level, heading, text) for each heading; what is before the first has level 0, if it says anything."""
    out: list[tuple[int, str, list[str]]] = [(0, "", [])]
    for kind, level, said in _walk(*blocks(md)):
        if kind == "heading":
            out.append((level, " ".join(said.split()), []))
        elif said:
            out[-1][2].append(said)
    return [(level, title, "\n\n".join(body)) for level, title, body in out if title or body]
