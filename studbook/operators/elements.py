"""Elements of stored pages: one pass with a stack of open elements, and rows for those that a selector names.

The parser closes what HTML lets authors leave open (list items, table rows and cells, paragraphs, options), ignores stray end
tags, reads unquoted, repeated and valueless attributes, and decodes every entity. Script and style contents and comments are
no text. A page without any match gives no rows, nor does a null page. Parsing is per page in Arrow batches, after the pages
were dealt over all cores: a page is few bytes and much work, so a million of them can lie in one small file. Several searches
of the same pages read each page once. Plain markup is read by one pattern a tag; from the first other markup of a page on
the general parser goes on.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from html import unescape
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ..session import at_least_cores

# Elements without content, and what a start tag closes up to which ancestor.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "caption", "colgroup"}, {"table"}),
    "a": ({"a"}, {"td", "th", "table", "li"}),
}
OUT_ROWS, OUT_BYTES = 4_000, 4 << 20
SILENT = frozenset(("script", "style"))
PARAGRAPH_SCOPE = frozenset(("td", "th", "table", "li", "div", "button", "article", "section"))

# Markup that every version of the general parser reads alike: end tags, start tags, comments, the document type.
_NAME, _SPACE = r"[a-zA-Z][a-zA-Z0-9-]*", r"[ \t\n\r\f]"
_ATTRIBUTE = rf"""{_SPACE}+([a-zA-Z_][\w:.-]*)(?:=("[^"]*"|'[^']*'|[^\s"'=<>`](?:[^\s"'<>`]*[^\s"'<>`/])?(?=[ \t\n\r\f>]|\Z)))?"""
PLAIN = re.compile(rf"""([^<]*)<(?:/({_NAME}){_SPACE}*>|({_NAME})((?:{_ATTRIBUTE.replace("([", "(?:[").replace('("', '(?:"')})*){_SPACE}*(/?)>|!--(?!-?>)[^-]*(?:-[^-]+)*-->|!(?i:doctype)[^>]*>)""")
PLAIN_ATTRIBUTE = re.compile(_ATTRIBUTE)
# A reference without semicolon, whose reading in attributes differs between versions.
BARE_REFERENCE = re.compile(r"&(?!#?\w+;)")
# Elements that hold text only, up to an end tag that is plain too, and those left to the general parser.
TEXT_ONLY = {tag: re.compile(rf"([^<]*{more})</{tag}{_SPACE}*>", re.IGNORECASE)
             for tag, more in (("title", ""), ("textarea", ""), *[(tag, rf"(?:<(?!/\s*{tag}|!--)[^<]*)*") for tag in ("script", "style")])}
NOT_PLAIN = frozenset("iframe noembed noframes noscript plaintext xmp".split())

LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
ATTRIBUTES = T.MapType(T.StringType(), T.StringType())
CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("attributes", ATTRIBUTES), T.StructField("links", T.ArrayType(LINK)), T.StructField("images", T.ArrayType(ATTRIBUTES))])
FOUND = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("path", T.StringType()), *CELL.fields, T.StructField("cells", T.ArrayType(CELL)), T.StructField("parts", T.MapType(T.StringType(), CELL))])

OWN = frozenset(CELL.names)
ALL = frozenset(FOUND.names)


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    number: int
    last: int = 0
    texts: tuple[int, int] = (0, 0)
    children: list[Element] = field(default_factory=list)

    def path(self) -> str:
        names, at = [], self
        while at is not None and at.parent is not None:
            names.append(".".join([at.tag, *at.attributes.get("class", "").split()]))
            at = at.parent
        return "/".join(reversed(names))


class Page(HTMLParser):
    """All elements of a page in document order, with the texts between their tags."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None, -1)
        self.open, self.elements = [self.root], []
        self.counts: defaultdict[str, int] = defaultdict(int)
        self.texts: list[tuple[bool, str]] = []   # (inside a script or style, text)
        rest = html[self._plain(html):]
        if rest:
            self.feed(rest)
            self.close()
        while len(self.open) > 1:
            self._pop()

    def _plain(self, html: str) -> int:
        """Read plain markup up to the first other; where that begins, with the text before it."""
        at = 0
        while found := PLAIN.match(html, at):
            text, ended, begun, written, alone = found.groups()
            tag = (begun or "").lower()
            if tag and (tag in NOT_PLAIN or tag in TEXT_ONLY and (alone or not TEXT_ONLY[tag].match(html, found.end())) or "&" in written and BARE_REFERENCE.search(written)):
                return at
            if text:
                self.handle_data(unescape(text))
            at = found.end()
            if ended:
                if self.open[-1].tag == (tag := ended.lower()):
                    self._pop()
                else:
                    self.handle_endtag(tag)
            elif tag:
                attributes: dict[str, str] = {}
                if written:
                    for name, value in PLAIN_ATTRIBUTE.findall(written):
                        attributes.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
                self._begin(tag, attributes)
                if tag in SILENT:
                    held = TEXT_ONLY[tag].match(html, at)
                    if held[1]:
                        self.handle_data(held[1])
                    self.handle_endtag(tag)
                    at = held.end()
        return at

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def _pop(self) -> None:
        done = self.open.pop()
        self.counts[done.tag] -= 1
        done.last, done.texts = len(self.elements) - 1, (done.texts[0], len(self.texts))

    def _close(self, tags, scope) -> None:
        """Close up to the innermost open element of these tags, unless one of `scope` comes first."""
        for tag in tags:
            if self.counts[tag]:
                break
        else:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i].tag in scope:
                return

    def handle_starttag(self, tag, attrs):
        attributes: dict[str, str] = {}
        for name, value in attrs:
            attributes.setdefault(name, value or "")
        self._begin(tag, attributes)

    def _begin(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCK and self.counts["p"]:
            self._close(("p",), PARAGRAPH_SCOPE)
        made = Element(tag, attributes, self.open[-1], len(self.elements))
        made.last, made.texts = made.number, (len(self.texts), len(self.texts))
        self.open[-1].children.append(made)
        self.elements.append(made)
        if tag not in VOID:
            self.open.append(made)
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close({tag}, set() if tag in ("table", "body", "html") else {"table"})

    def handle_data(self, data):
        stripped = data.strip()
        if stripped:
            self.texts.append((self.open[-1].tag in SILENT, stripped))

    def text(self, element: Element) -> str:
        """Stripped pieces of the element and what it holds, one after the other."""
        return "".join(text for silent, text in self.texts[slice(*element.texts)] if not silent or element.tag in SILENT)

    def within(self, element: Element) -> list[Element]:
        return self.elements[element.number + 1: element.last + 1]


class Selector:
    """tag, .class, #id, [name], [name=value] and [name*=part], all of them optional and all to be met."""

    _PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:(\*?=)([^\]]*))?\]")

    def __init__(self, written: str):
        self.tag = re.match(r"[\w*-]*", written)[0].replace("*", "")
        self.classes, self.tests = set(), []
        for token, ident, name, operator, value in self._PART.findall(written[len(re.match(r"[\w*-]*", written)[0]):]):
            if token:
                self.classes.add(token)
            elif ident:
                self.tests.append(("id", "=", ident))
            else:
                self.tests.append((name, operator, value))

    def meets(self, element: Element) -> bool:
        if self.tag and element.tag != self.tag:
            return False
        if self.classes and not self.classes <= set(element.attributes.get("class", "").split()):
            return False
        for name, operator, value in self.tests:
            held = element.attributes.get(name)
            if held is None or operator == "=" and held != value or operator == "*=" and value not in held:
                return False
        return True


@lru_cache(maxsize=1024)
def selector(written: str) -> Selector:
    return Selector(written)


@dataclass(frozen=True)
class Search:
    """What to look for: every `each` inside the first `within` (after the first `after` whose text contains `saying`),
    but those of the class `skip` and rows with fewer than `cells` cells; positions count what is left.

    `parts` names things inside an element, the first of each selector; `a >> b@2` is the third b inside the first a, and a
    selector that begins with `+` is the next sibling of the element instead.
    """

    each: str
    within: str | None = None
    after: str | None = None
    saying: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    skip: str = ""
    cells: int = 0

    def matches(self, page: Page) -> Iterator[Element]:
        elements = page.elements
        if self.after:
            start = next((e for e in elements if selector(self.after).meets(e) and self.saying.lower() in page.text(e).lower()), None)
            elements = [] if start is None else elements[start.last + 1:]
        if self.within:
            scope = next((e for e in elements if selector(self.within).meets(e)), None)
            elements = [] if scope is None else page.within(scope)
        wanted = selector(self.each)
        return (e for e in elements if wanted.meets(e) and not (self.skip and self.skip in e.attributes.get("class", "").split()) and len(cells_of(page, e)) >= self.cells)

    def part(self, page: Page, element: Element, written: str) -> Element | None:
        if written.startswith("+"):
            siblings = element.parent.children
            at = next(i for i, e in enumerate(siblings) if e is element) + 1
            return siblings[at] if at < len(siblings) and selector(written[1:]).meets(siblings[at]) else None
        found: Element | None = element
        for step in written.split(" >> "):
            name, _, number = step.partition("@")
            matching = (e for e in page.within(found) if selector(name).meets(e))
            found = next(islice(matching, int(number or 0), None), None)
            if found is None:
                return None
        return found


def _cell(page: Page, element: Element) -> dict:
    links, images = [], []
    for e in (element, *page.within(element)):
        if e.tag == "a":
            if "href" in e.attributes:
                links.append({"href": e.attributes["href"], "text": page.text(e)})
        elif e.tag == "img":
            images.append(list(e.attributes.items()))
    return {"text": page.text(element), "attributes": list(element.attributes.items()), "links": links, "images": images}


def find_in(html: str, search: Search) -> list[dict]:
    """The matches of one page."""
    return _matches(Page(html), search, ALL)


def _matches(page: Page, search: Search, wanted: frozenset[str]) -> list[dict]:
    out = []
    for position, element in enumerate(search.matches(page)):
        row = {"position": position}
        if "path" in wanted:
            row["path"] = element.path()
        if wanted & OWN:
            row.update(_cell(page, element))
        if "cells" in wanted:
            row["cells"] = [_cell(page, c) for c in cells_of(page, element)]
        if "parts" in wanted:
            row["parts"] = [(name, _cell(page, found)) for name, written in search.parts if (found := search.part(page, element, written)) is not None]
        out.append(row)
    return out


def cells_of(page: Page, element: Element) -> list[Element]:
    """The cells of a table row without those of tables inside it."""
    return [c for c in page.within(element) if c.tag in ("td", "th") and _row_of(c) is element] if element.tag == "tr" else []


def _row_of(cell: Element) -> Element | None:
    at = cell.parent
    while at is not None and at.tag not in ("tr", "table"):
        at = at.parent
    return at


def _find(searches: dict[str, Search], kept: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = pa.schema(list(schema)[kept:])
    wanted = ALL & set(made.names)
    for batch in batches:
        owners, rows, size = [], [], 0

        def ready() -> pa.RecordBatch:
            own = batch.take(pa.array(owners))
            out = pa.RecordBatch.from_arrays([*own.columns[:kept], *pa.RecordBatch.from_pylist(rows, made).columns], schema=schema)
            owners.clear()
            rows.clear()
            return out

        for at, html in enumerate(batch.column(kept)):
            if html.is_valid:
                text = html.as_py()
                page = Page(text)
                for name, search in searches.items():
                    for found in _matches(page, search, wanted):
                        owners.append(at)
                        rows.append({"search": name, **found})
                size += len(text)
            if len(rows) >= OUT_ROWS or size >= OUT_BYTES and rows:
                yield ready()
                size = 0
        if rows:
            yield ready()


def _dealt(pages: DataFrame) -> DataFrame:
    """The pages over at least as many partitions as there are cores, by their content."""
    # Maps have no hash; rows that are equal in all else may lie together.
    hashed = [f.name for f in pages.schema.fields if not re.search(r"\b(map|variant)\b", f.dataType.simpleString())]
    return pages.repartition(at_least_cores(pages.sparkSession), *hashed)


def _parsed(pages: DataFrame, searches: dict[str, Search], html: str, named: list[T.StructField], columns: tuple[str, ...]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, *named, *[f for f in FOUND.fields if not columns or f.name in columns]])
    dealt = _dealt(pages.select(*[f.name for f in kept], html))
    return dealt.mapInArrow(partial(_find, searches, len(kept), to_arrow_schema(schema)), schema)


def find(pages: DataFrame, search: Search, html: str = "html", columns: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `pages` but `html`, and for each match: position, path, text, attributes, links, images, cells (of a row), parts.

    With `columns` only these of a match are made.
    """
    return _parsed(pages, {"": search}, html, [], columns)


def find_each(pages: DataFrame, searches: dict[str, Search], html: str = "html", columns: tuple[str, ...] = ()) -> DataFrame:
    """Like `find` for several searches, each page parsed once: a column `search` names the one that a match belongs to."""
    return _parsed(pages, searches, html, [T.StructField("search", T.StringType())], columns)
