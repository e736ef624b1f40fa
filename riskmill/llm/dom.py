"""A forgiving HTML reader: pages as flat tables of block elements and text runs.

Inline elements make no node; a text run is what stands between two block borders, its character references
decoded and its white space turned into single spaces. Unclosed paragraphs, list items, cells and pages
end where HTML says so; stray end tags are ignored. Reading is one pass with an explicit stack, so
depth and length are bounded by memory alone.
"""

from __future__ import annotations

import html as entities
import re

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("iframe noframes noscript script style svg template title xmp object audio video canvas math".split())
#: Elements in which no other element is looked for.
RAW = frozenset("iframe noframes noscript script style title xmp textarea".split())
#: A paragraph ends where one of these begins.
_ENDS_P = BLOCKS - {"body", "html", "button", "caption", "legend", "option", "optgroup", "select", "summary", "tbody", "td", "textarea", "tfoot", "th", "thead", "tr", "frameset"}
#: What ends an open element of the first kind, and where the search for it stops.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table")),
    "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "option": (("option",), ("select", "optgroup")),
    "optgroup": (("optgroup",), ("select",)),
    "p": (("p",), ("td", "th", "button", "caption", "table")),
}
_CELLS = frozenset(("td", "th", "caption"))
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
_TAG = re.compile(r"""([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style|data-keep)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Nodes:
    """Nodes of some pages, in page order: a parent comes before its children."""

    def __init__(self):
        self.page: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.names: list[tuple] = []
        self.text: list[str | None] = []
        self.links: list[int] = []
        self.inline: list[int] = []
        self.images: list[int] = []
        self.inputs: list[int] = []
        self.keep: list[bool] = []

    def add(self, page: int, parent: int, tag: str, names: tuple, text: str | None = None, links: int = 0, inline: int = 0, keep: bool = False) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.links.append(links)
        self.inline.append(inline)
        self.images.append(0)
        self.inputs.append(0)
        self.keep.append(keep)
        return len(self.page) - 1


def names_of(attributes: str) -> tuple[tuple, bool | None]:
    """The words of an element's class, id and role, and the mark of a training page if there is one."""
    found, mark = [], None
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-keep":
            mark = value == "1"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found.append("@hidden")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                found.append("@hidden")
        elif name != "aria-hidden":
            words = [w.lower() for w in _WORD.findall(value)]
            found += words + [f"{w[:4]}*" for w in words if len(w) > 4]
    return tuple(dict.fromkeys(found)), mark


def read(html: str, page: int, nodes: Nodes) -> None:
    """Append the nodes of one page; the first is its root."""
    root = nodes.add(page, -1, "#page", ())
    stack: list[tuple[int, str]] = [(root, "#page")]
    opened: dict[str, int] = {}
    run: list[str] = []
    state = [0, 0, 0]  # signs in links, inline tags, depth of links
    known: dict[str, tuple] = {}
    unclosed: set[str] = set()

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                top = stack[-1][0]
                nodes.add(page, top, "#text", (), text, min(state[0], len(text)), state[1], nodes.keep[top])
            run.clear()
        state[0] = state[1] = state[2] = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[1]] -= 1

    def end(kinds: tuple, stops: tuple) -> None:
        if any(opened.get(k) for k in kinds):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][1] in kinds:
                    return pop_to(depth)
                if stack[depth][1] in stops:
                    return None

    def say(raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        run.append(text)
        if state[2]:
            state[0] += len(text)

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        follow = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 2)
            at = size if stop < 0 else stop + 3
            continue
        if follow in ("!", "?") and follow:
            stop = html.find(">", lt)
            at = size if stop < 0 else stop + 1
            continue
        closing = follow == "/"
        found = _TAG.match(html, lt + 1 + closing)
        if found:
            name, attributes, at = found.group(1).lower(), found.group(2), found.end()
        else:
            start = _NAME.match(html, lt + 1 + closing)
            if not start:
                stop = html.find(">", lt) if closing else lt
                if not closing:
                    say("<")
                at = size if stop < 0 else stop + 1
                continue
            stop = html.find(">", lt)
            name, attributes, at = start.group().lower(), "", size if stop < 0 else stop + 1
        if closing:
            if name in BLOCKS or "-" in name or opened.get(name):
                flush()
                if opened.get(name):
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][1] == name:
                            pop_to(depth)
                            break
                        if stack[depth][1] in _CELLS and name not in _TABLE:
                            break
            elif name == "a":
                state[2] = 0
            elif name == "br":
                run.append(" ")
            continue
        if name in VOID:
            if name == "br":
                run.append(" ")
            elif name == "hr":
                flush()
                end(*_IMPLIED["p"])
            elif name in ("img", "source", "embed"):
                nodes.images[stack[-1][0]] += 1
            elif name == "input":
                nodes.inputs[stack[-1][0]] += 1
            continue
        if name in SILENT or name in RAW:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            stop = None if name in unclosed else re.compile(f"</{name}(?=[\\s/>])|</{name}$", re.I).search(html, at)
            if stop is None and name in ("object", "audio", "video", "canvas"):
                unclosed.add(name)
                continue  # what follows is the page's
            inner = html[at : stop.start() if stop else size]
            if stop is None:
                at = size
            else:
                close = html.find(">", stop.start())
                at = size if close < 0 else close + 1
            if name == "textarea":
                flush()
                nodes.inputs[stack[-1][0]] += 1
                nodes.add(page, stack[-1][0], "textarea", ())
                text = " ".join(entities.unescape(inner).split())
                if text:
                    nodes.add(page, len(nodes.page) - 1, "#text", (), text)
            continue
        if name not in BLOCKS and "-" not in name and not (name == "ins" and "class" in attributes):
            state[1] += 1
            if name == "a":
                state[2] = 1
            continue
        if name in ("html", "body") and opened.get(name):
            continue
        flush()
        if name in _ENDS_P:
            end(*_IMPLIED["p"])
        if name in _IMPLIED and name != "p":
            end(*_IMPLIED[name])
        made = known.get(attributes)
        if made is None:
            made = known[attributes] = names_of(attributes) if attributes else ((), None)
        parent = stack[-1][0]
        keep = nodes.keep[parent] if made[1] is None else made[1]
        node = nodes.add(page, parent, name, made[0], keep=keep)
        if name in ("button", "select"):
            nodes.inputs[parent] += 1
        if not attributes.endswith("/") or name in BLOCKS:  # a closed custom element holds nothing
            stack.append((node, name))
            opened[name] = opened.get(name, 0) + 1
    flush()
