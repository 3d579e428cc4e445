"""Reading a page's HTML as text blocks and the elements they stand in, in one pass and without a tree.

A slot is an element that holds text: the path of the elements around a block, each with its attributes, from
the body down (a cell of a table that lays out the whole page counts as an element). Pages that one template
made share their slots. Nothing here knows what any attribute value means, save those that mark a note.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<(?:(/?)(div|section|aside|nav|header|footer|main|article|table|td|th|tr|ul|ol|li|p|h[1-6]|pre|blockquote|strong|form|dl|dt|dd)\b([^>]*)"
    r"|(script|style|noscript|template|head|svg)\b[^>]*>(.*?)</\4\s*|(!--).*?--|(br)\s*/?|(/?a)\b[^>]*|/?[a-zA-Z][^>]*|![^>]*|\?[^>]*)>",
    re.S | re.I,
)
BOXES = frozenset(("div", "section", "aside", "nav", "header", "footer", "main", "article", "td", "th", "form", "blockquote"))
SPACE = re.compile(r"\s+")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:\-]+)", re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)

#: The usual class names of a note.
NOTE = re.compile(r"class=\"[^\"]*\b(?:note|tip|warning|caution|danger|info|important|hint|admonition)\b")


@dataclass(slots=True)
class Block:
    """kind: paragraph, list, table, code, note or heading; loose: how many of its words are in no link."""

    kind: str
    text: str
    links: int
    loose: int
    level: int = 0


@dataclass(slots=True)
class Container:
    """Blocks that follow each other in one element: its slot, and the numbers on the page and the slots of the elements it
    stands in, itself last."""

    slot: str
    inside: tuple[int, ...] = ()
    slots: tuple[str, ...] = ()
    blocks: list[Block] = field(default_factory=list)
    noscript: list[str] = field(default_factory=list)


def decoded(body: bytes, declared: str | None = None) -> str:
    """UTF-8 where the bytes are, else the charset that the page or its header declares, else Latin-1."""
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        found = CHARSET.search(body)
        for name in (found.group(1).decode("ascii") if found else None, declared, "cp1252"):
            if name and name.lower() not in ("utf-8", "utf8"):
                try:
                    return body.decode(name)
                except (UnicodeDecodeError, LookupError):
                    pass
        return body.decode("utf-8", "replace")


def _plain(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def title_of(page: str) -> str:
    found = TITLE.search(page)
    return _plain(found.group(1)) if found else ""


def containers(page: str) -> list[Container]:
    """The page's text in order, cut wherever an element begins or ends that may hold text of its own."""
    out: list[Container] = []
    here = Container("")
    boxes: list[tuple[str, str, tuple[int, ...], tuple[str, ...]]] = []
    opened = 0
    layout = 0
    text: list[str] = []
    items: list[str] = []
    cells: list[list[str]] = []
    kind, depth, links, linked, inside, level, attrs = "", 0, 0, 0, False, 0, ""

    def flush() -> None:
        nonlocal kind, links, linked, inside, text, items, cells, depth
        if kind == "list":
            items.append(_plain("".join(text)))
            said = "\n".join(x for x in items if x)
        elif kind == "table":
            said = "\n".join("\t".join(r) for r in cells if r)
        elif kind == "code":
            raw = "".join(text)
            said = (html.unescape(raw) if "&" in raw else raw).strip("\n")
        else:
            said = _plain("".join(text))
        if said:
            own = kind or ("note" if boxes and NOTE.search(attrs) else "paragraph")
            here.blocks.append(Block(own, said, links, max(0, len(said.split()) - linked), level))
        kind, links, linked, inside, text, items, cells, depth = "", 0, 0, False, [], [], [], 0

    def go_on() -> None:
        nonlocal here
        if here.blocks or here.noscript:
            out.append(here)
        here = Container(*boxes[-1][1:]) if boxes else Container("")

    # The text before each tag and the tag's groups, in turn, and the text after the last one.
    parts = TOKEN.split(page)
    for piece, closing, tag, given, skipped, content, _, br, link in zip(*(parts[i:-1:9] for i in range(9))):
        if piece:
            text.append(piece)
            if inside:
                linked += len(piece.split())
        if tag is None:
            if link:
                inside = link[0] != "/"
                links += inside
            elif br:
                text.append("\n" if kind == "code" else " ")
            elif skipped and skipped.lower() == "noscript":
                here.noscript.append(_plain(re.sub(r"<[^>]*>", " ", content)))
            continue
        tag = tag.lower()
        if kind == "code":
            if closing and tag == "pre":
                flush()
            continue
        if kind == "table":
            if tag in ("td", "th"):
                if closing:
                    if cells:
                        cells[-1].append(_plain("".join(text)))
                    text = []
                else:
                    text = []
            elif tag == "tr" and not closing:
                cells.append([])
            elif tag == "table":
                depth += -1 if closing else 1
                if depth <= 0:
                    flush()
            continue
        if kind == "list":
            if tag == "li":
                if not closing:
                    if text:
                        items.append(_plain("".join(text)))
                    text = []
                continue
            if tag in ("ul", "ol"):
                depth += -1 if closing else 1
                if depth <= 0:
                    flush()
                continue
            if tag not in BOXES:
                text.append(" ")
                continue
        if tag == "strong" and (kind or (text and _plain("".join(text)))):
            continue
        flush()
        if tag in BOXES:
            if closing:
                attrs = ""
                while boxes and boxes[-1][0] != tag and any(b[0] == tag for b in boxes):
                    boxes.pop()
                if boxes and boxes[-1][0] == tag:
                    boxes.pop()
            else:
                attrs = SPACE.sub(" ", given).replace("'", '"').strip()
                opened += 1
                _, path, around, paths = boxes[-1] if boxes else ("", "", (), ())
                path = f"{path}/{tag} {attrs}".rstrip()
                boxes.append((tag, path, (*around, opened), (*paths, path)))
            go_on()
        elif tag in ("p", "dt", "dd"):
            kind = "" if closing else "paragraph"
        elif tag in ("ul", "ol"):
            if not closing:
                kind, depth = "list", 1
        elif tag == "pre":
            if not closing:
                kind = "code"
        elif tag == "table":
            if closing:
                layout = max(0, layout - 1)
            elif not boxes:
                layout += 1
            else:
                kind, depth = "table", 1
        elif tag[0] == "h" and len(tag) == 2:
            if not closing:
                kind, level = "heading", int(tag[1])
                continue
        level = 0
    if parts[-1]:
        text.append(re.sub(r"<[^>]*$", "", parts[-1]))
    flush()
    go_on()
    return out


def elements_of(found: list[Container]) -> tuple[list[tuple[int, Block]], list[str], list[list[int]]]:
    """The page's blocks, each with the number of its element; the slots of the elements that hold blocks, themselves or
    within; and for each element those around it, itself included."""
    at: dict[tuple[int, ...], int] = {}
    slots: list[str] = []
    around: list[list[int]] = []
    blocks = []
    for c in found:
        if not c.blocks:
            continue
        for depth in range(0 if not c.inside else 1, len(c.inside) + 1):
            key = c.inside[:depth]
            if key not in at:
                at[key] = len(slots)
                slots.append(c.slots[depth - 1] if depth else "")
                around.append([*(around[at[key[:-1]]] if depth > 1 else []), at[key]])
        blocks += [(at[c.inside], b) for b in c.blocks]
    return blocks, slots, around
