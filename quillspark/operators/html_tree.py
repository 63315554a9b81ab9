"""A small HTML tree for article pages: implied end tags, void and raw-text elements, entities.

Not done, unlike a browser: foster parenting and the reopening of formatting elements.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
#: Tags whose start closes an open tag, and the elements that such a search does not leave.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self):
        """This element and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Element)]

    def find(self, test) -> Element | None:
        return next((e for e in self.walk() if test(e)), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.open = [self.root]

    def _close(self, names: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in stop:
                return
            if self.open[i].name in names:
                del self.open[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"table", "button", "td", "th", "li", "div", "blockquote"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        kids = self.open[-1].children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse_tree(html: str) -> Element:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    if not any(isinstance(c, Element) and c.name == "body" for c in builder.root.children):
        body = Element("body", {})
        body.children = [c for c in builder.root.children if isinstance(c, str) or c.name != "head"]
        builder.root.children = [c for c in builder.root.children if not isinstance(c, str) and c.name == "head"] + [body]
    return builder.root
