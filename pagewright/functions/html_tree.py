"""A small HTML tree, a subset of CSS selectors, and Markdown, on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCKS = frozenset("article blockquote div dl fieldset figure form h1 h2 h3 h4 h5 h6 hr main ol p pre section table ul".split())


class Node:
    """An element: its tag, attributes, parent, and children, which are nodes and strings."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        pending = [c for c in reversed(self.children) if isinstance(c, Node)]
        while pending:
            node = pending.pop()
            yield node
            pending.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def raw_text(self) -> str:
        out, pending = [], list(reversed(self.children))
        while pending:
            c = pending.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                pending.extend(reversed(c.children))
        return "".join(out)

    def text(self) -> str:
        """The strings below, each trimmed, end to end."""
        out, pending = [], list(reversed(self.children))
        while pending:
            c = pending.pop()
            if isinstance(c, str):
                out.append(c.strip())
            elif c.tag not in ("script", "style"):
                pending.extend(reversed(c.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        gone = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        node = self.at
        while node.parent is not None and node.tag not in BLOCKS - {"p"} and node.tag not in ("ul", "ol", "table", "dl", "select", "body"):
            if node.tag in gone:
                self.at = node.parent
                break
            node = node.parent
        child = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""")
_TESTS = {"=": lambda a, b: a == b, "~=": lambda a, b: b in a.split(), "^=": str.startswith, "$=": str.endswith, "*=": lambda a, b: b in a}


def _compound(node: Node, selector: str) -> bool:
    end = 0
    for m in _SIMPLE.finditer(selector):
        if m.start() != end:
            raise ValueError(f"not a selector: {selector}")
        end = m.end()
        tag, cls, ident, attr, test, value = m.groups()
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr and (attr not in node.attrs or test and not _TESTS[test](node.attrs[attr], value.strip("\"'"))):
            return False
    if end != len(selector) or not end:
        raise ValueError(f"not a selector: {selector}")
    return True


def _matches(node: Node | None, parts: list[tuple[str, str]], root: Node) -> bool:
    """parts: (combinator before it, compound), the last first."""
    if node is None or node is root or not _compound(node, parts[0][1]):
        return False
    if len(parts) == 1:
        return True
    if parts[0][0] == ">":
        return _matches(node.parent, parts[1:], root)
    up = node.parent
    while up is not None and up is not root:
        if _matches(up, parts[1:], root):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Elements below root that match: tag, .class, #id, [attr], [attr=value], descendants, children, commas."""
    chains = []
    for one in selector.split(","):
        tokens = re.findall(r"""(?:\[[^\]]*\]|[^\s>\[])+|>""", one)
        parts: list[tuple[str, str]] = []
        link = " "
        for t in tokens:
            if t == ">":
                link = ">"
            else:
                parts.insert(0, (link, t))
                link = " "
        if parts:
            chains.append(parts)
    return [n for n in root.walk() if any(_matches(n, parts, root) for parts in chains)]


def value_of(node: Node) -> str:
    """The content attribute if there is one, else the text."""
    return node.attrs.get("content") or node.text()


MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
PLAIN_BLOCKS = frozenset("p div section article main figure form dl dt dd body html".split())


def _shown(node: Node, inner: str, parts: list[tuple[Node, str]], cells: dict[int, str]) -> str:
    """A node as Markdown; inner: its children's Markdown end to end; parts: that of each child element, as inner text."""
    tag = node.tag
    if tag in MARKS:
        text = inner.strip()
        return f"{MARKS[tag]}{text}{MARKS[tag]}" if text else ""
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if tag in ("script", "style", "title", "head"):
        return ""
    if tag in ("ul", "ol"):
        items = [text for child, text in parts if child.tag == "li"]
        block = "\n".join(("* " if tag == "ul" else f"{i}. ") + re.sub(r"\s*\n\s*", "\n  ", text.strip()) for i, text in enumerate(items, 1))
    elif tag == "table":
        found = [[cells[id(c)].strip() for c in r.children if isinstance(c, Node)] for r in node.walk() if r.tag == "tr"]
        lines = ["| " + " | ".join(r) + " |" for r in found]
        block = "\n".join(lines[:1] + ["| " + " | ".join("---" for _ in found[0]) + " |"] * bool(found) + lines[1:])
    elif tag == "blockquote":
        block = "> " + re.sub(r"\n", "\n> ", inner.strip())
    elif tag == "pre":
        block = "```\n" + node.raw_text().strip("\n") + "\n```"
    elif tag == "hr":
        block = "---"
    elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        block = "#" * int(tag[1]) + " " + inner.strip()
    elif tag in PLAIN_BLOCKS:
        block = inner.strip()
    else:
        return "  \n" if tag == "br" else inner
    return "\n\n" + block + "\n\n"


def markdown(html: str | None) -> str:
    """Headings, paragraphs, lists, emphasis, code, quotes, rules, tables and images; links keep their text only. No recursion."""
    root = parse(html)
    cells: dict[int, str] = {}
    # (element, its children still to come, their Markdown so far, that of its child elements)
    open_: list[tuple[Node, list, list[str], list[tuple[Node, str]]]] = [(root, root.children[::-1], [], [])]
    while True:
        node, rest, out, parts = open_[-1]
        if rest:
            c = rest.pop()
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", c))
            else:
                open_.append((c, c.children[::-1], [], []))
            continue
        open_.pop()
        inner = "".join(out)
        if not open_:
            return re.sub(r"\n{3,}", "\n\n", inner).strip()
        if open_[-1][0].tag == "tr":
            cells[id(node)] = inner
        if open_[-1][0].tag in ("ul", "ol"):
            open_[-1][3].append((node, inner))
        open_[-1][2].append(_shown(node, inner, parts, cells))
