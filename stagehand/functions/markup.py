"""A small tree of HTML and the part of CSS selectors that listings use. Standard library only."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style"))


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    inside: list[Node | str] = field(default_factory=list)

    def below(self) -> list[Node]:
        """All nodes inside, in page order."""
        out, todo = [], [n for n in reversed(self.inside) if not isinstance(n, str)]
        while todo:
            out.append(at := todo.pop())
            if at.inside:
                todo.extend([n for n in reversed(at.inside) if not isinstance(n, str)])
        return out

    def text(self, without: set[int] = frozenset()) -> str:
        """Pieces of text, trimmed and joined by a space; scripts, styles and nodes whose id() is in ``without`` say nothing."""
        out, todo = [], list(reversed(self.inside))
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                out.append(at.strip())
            elif at.tag not in SILENT and id(at) not in without:
                todo.extend(reversed(at.inside))
        return " ".join(x for x in out if x)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.inside.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:  # an end without a start is nothing
            self.at = node.parent

    def handle_data(self, data):
        self.at.inside.append(data)


#: A tag in plain writing, with the text behind it, and one of its attributes; what else begins with "<" is left to ``HTMLParser``.
PLAIN = re.compile(r"""(<(?:/([a-zA-Z][a-zA-Z0-9]*)[ \n]*|([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z_:@][a-zA-Z0-9_:.@-]*(?:="[^"<>]*"|='[^'<>]*'|=[a-zA-Z0-9_.#-]+)?)*)[ \n]*(/?))>([^<]*))""")
DOCTYPE = re.compile("(?i)<!doctype html>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][a-zA-Z0-9_:.@-]*)(?:="([^"]*)"|='([^']*)'|=([a-zA-Z0-9_.#-]+))?""")
#: Elements whose content ``HTMLParser`` reads by other rules.
OTHERWISE = frozenset("textarea xmp iframe noembed noframes noscript plaintext svg math".split())


def _plain(page: str) -> Node | None:
    """``tree`` of a page of plain tags and texts, a few times faster; None for other pages."""
    root = at = Node("", {})
    head = DOCTYPE.match(page)
    start = head.end() if head else 0
    first = page.find("<", start)
    found = PLAIN.findall(page, first) if first >= 0 else []
    if first < 0 or sum([len(t[0]) for t in found]) != len(page) - first:
        return None
    if first > start:
        at.inside.append(unescape(page[start:first]))
    closes = ""  # the tag that the text just read must end with
    for _, ended, began, said, single, data in found:
        if ended:
            ended = ended.lower()
            if closes and ended != closes:
                return None
            closes = ""
            node = at
            while node.parent is not None and node.tag != ended:
                node = node.parent
            if node.parent is not None:
                at = node.parent
        else:
            began = began.lower()
            if closes or began in OTHERWISE or (single and said and said[-1] not in "\"' \n"):
                return None
            attrs = {}
            if said:
                for name, *values in ATTRIBUTE.findall(said):
                    value = values[0] or values[1] or values[2]
                    attrs[name.lower()] = unescape(value) if "&" in value else value
            node = Node(began, attrs, at, [])
            at.inside.append(node)
            if not single:
                if began not in VOID:
                    at = node
                if began in SILENT or began == "title":
                    closes = began
        if data:
            at.inside.append(unescape(data) if "&" in data and closes not in SILENT else data)
    return None if closes else root


def tree(page: str) -> Node:
    """The root of a page. Open elements end with the one around them."""
    if (root := _plain(page)) is not None:
        return root
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return reader.root


#: A text between tags other than a heading's own, and the values of two attributes, in pages of a template; none holds a reference.
SAID = re.compile(r">(\s*[^\s<>&][^<>&]*)(?=<(?!/[hH][2-4])|\Z)")
GIVEN = re.compile(r"""([ \n](?:content|datetime)=)(?:"([^"<>&]+)"|'([^'<>&]+)')""")
#: Characters of no text, which no reference gives either: the places of texts and of attributes' values, and the end of a place's number.
TEXT_AT, ENDED, VALUE_AT = "\ufdd0", "\ufdd1", "\ufdd2"
PLACE = re.compile(f"{TEXT_AT}(\\d+){ENDED}")


def outline(page: str) -> tuple[str, list[str]] | None:
    """A page without its texts and values, and these in order; None for a page that has the characters of places."""
    if TEXT_AT in page or VALUE_AT in page:
        return None
    pieces = SAID.split(page)
    values = [v.strip() for v in pieces[1::2]]
    frame = f">{TEXT_AT}".join(pieces[::2])
    if " content=" in frame or " datetime=" in frame or "\n" in frame:
        pieces = GIVEN.split(frame)
        if len(pieces) > 1:
            values += [a or b for a, b in zip(pieces[2::4], pieces[3::4], strict=True)]
            frame = "".join([x for i in range(0, len(pieces) - 1, 4) for x in (pieces[i], pieces[i + 1], f'"{VALUE_AT}"')]) + pieces[-1]
    return frame, values


def framed(frame: str) -> Node | None:
    """The tree of an ``outline`` with a numbered ``PLACE`` for each of its values; None unless these are whole texts and values of plain markup, and none is in a heading of the copy."""
    texts, values = 0, frame.count(TEXT_AT)
    out = []
    for piece in re.split(f"([{TEXT_AT}{VALUE_AT}])", frame):
        if piece == TEXT_AT:
            piece, texts = f"{TEXT_AT}{texts}{ENDED}", texts + 1
        elif piece == VALUE_AT:
            piece, values = f"{TEXT_AT}{values}{ENDED}", values + 1
        out.append(piece)
    root = _plain("".join(out))
    if root is None:
        return None
    for n in (root, *root.below()):
        whole = all(PLACE.fullmatch(x.strip()) for x in n.inside if isinstance(x, str) and TEXT_AT in x)
        given = all(k in ("content", "datetime") and PLACE.fullmatch(v) for k, v in n.attrs.items() if TEXT_AT in v)
        if not (whole and given) or (n.tag in ("h2", "h3", "h4") and TEXT_AT in n.text()):
            return None
    return root


TOKEN = re.compile(r"""\s*([>,])\s*|(\s+)|([\w-]+|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")
PSEUDO = re.compile(r":([\w-]+)")
COMPARE = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith, "~=": lambda a, b: b in a.split()}


def _argument(text: str, at: int) -> tuple[str | None, int]:
    """What stands in the parentheses at ``at``, and where they end; None without any."""
    if text[at : at + 1] != "(":
        return None, at
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return text[at + 1 : i], i + 1
    raise ValueError(f"selector not closed: {text!r}")


def _place(node: Node, last: bool) -> int:
    """Which of its parent's children of its tag a node is, from 1, or from the last."""
    same = [n for n in node.parent.inside if isinstance(n, Node) and n.tag == node.tag] if node.parent else [node]
    at = next(i for i, n in enumerate(same) if n is node)
    return len(same) - at if last else at + 1


def _pseudo(name: str, argument: str | None):
    """A test of a node for a pseudo-class."""
    if name in ("first-of-type", "last-of-type") and argument is None:
        return lambda node: _place(node, name.startswith("last")) == 1
    if name in ("nth-of-type", "nth-last-of-type") and (argument or "").strip().isdigit():
        number = int(argument)
        return lambda node: _place(node, "last" in name) == number
    if name == "not" and argument:
        ways = compiled(argument)
        return lambda node: not any(_matches(node, w) for w in ways)
    if name == "has" and argument:
        ways = compiled(argument)
        return lambda node: any(_matches(n, w) for n in node.below() for w in ways)
    if name in ("-soup-contains", "contains") and argument:
        texts = [a or b for a, b in re.findall(r"\"([^\"]*)\"|'([^']*)'", argument)] or [argument.strip()]
        return lambda node: any(t in node.text() for t in texts)
    raise ValueError(f"pseudo-class not supported: {name}")


@lru_cache(1024)
def compiled(selector: str) -> list[list[tuple[str, list]]]:
    """Alternatives; each is steps (combinator, tests). Raises for what isn't supported."""
    out: list[list[tuple[str, list]]] = [[("", [])]]
    at, text = 0, selector.strip()
    while at < len(text):
        if m := PSEUDO.match(text, at):
            argument, at = _argument(text, m.end())
            out[-1][-1][1].append(("pseudo", _pseudo(m.group(1), argument), ""))
            continue
        m = TOKEN.match(text, at)
        if m is None or m.end() == at:
            raise ValueError(f"selector not supported: {selector!r}")
        at = m.end()
        mark, space, tag, cls, ident, name, op, *values = m.groups()
        if mark == ",":
            out.append([("", [])])
        elif mark or space:
            out[-1].append((mark or " ", []))
        else:
            value = next((v for v in values if v is not None), "")
            test = ("tag", tag.lower(), "") if tag else ("~=", "class", cls) if cls else ("=", "id", ident) if ident else (op or "has", name, value)
            out[-1][-1][1].append(test)
    return out


def _fits(node: Node, tests: list) -> bool:
    for kind, name, value in tests:
        if kind == "pseudo":
            if not name(node):
                return False
        elif kind == "tag":
            if name not in ("*", node.tag):
                return False
        elif name not in node.attrs or (kind != "has" and not COMPARE[kind](node.attrs[name], value)):
            return False
    return True


def _matches(node: Node, steps: list) -> bool:
    (how, tests), rest = steps[-1], steps[:-1]
    if not _fits(node, tests):
        return False
    up = node.parent
    while rest and up is not None and up.parent is not None:
        if _matches(up, rest):
            return True
        if how == ">":
            return False
        up = up.parent
    return not rest


def fitting(nodes: list[Node], selector: str) -> Iterator[Node]:
    """Those of some nodes that fit; none for a selector that isn't supported, so that it stops one venue and not the job."""
    try:
        ways = compiled(selector)
    except ValueError as e:
        logging.getLogger(__name__).warning("%s", e)
        return
    for n in nodes:
        for way in ways:
            if _fits(n, way[-1][1]) and (len(way) == 1 or _matches(n, way)):
                yield n
                break


def select(node: Node, selector: str) -> list[Node]:
    """Nodes inside that fit, in page order."""
    return list(fitting(node.below(), selector))


def first(node: Node, selector: str) -> Node | None:
    """The first node inside that fits."""
    return next(fitting(node.below(), selector), None)
