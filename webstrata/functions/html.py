"""HTML as a column of nodes.

`html_nodes(html)` is the only Python step of page extraction: one Arrow batch in, one Arrow
batch of flat nodes out. All extraction rules are Column expressions over those nodes.

Elements are numbered in document order. `last` is the number of an element's last
descendant, so "inside" is a range test; `texts[first_text:end_text]` are its text pieces.
Unclosed elements nest until an enclosing element closes. Only links carry their xpath. `start`
and `end` are an element's place in the source, in characters; a page that cannot be parsed has
no nodes and says why in `error`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions.expr import SPACE, col, strip
from webstrata.functions.portions import portions

# Elements that never have content.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split())

# Elements whose text is tracked apart from the page text.
MARKED_TAGS = frozenset("script style template rt rp noscript iframe".split())

# Elements in which white space between tags is kept as it is.
VERBATIM_TAGS = frozenset(["pre", "textarea"])

# Text that never counts as the text of an enclosing element.
HIDDEN = ["comment", "script", "style", "template", "rt", "rp"]

_ELEMENT = pa.struct([
    ("id", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("first_text", pa.int32()), ("end_text", pa.int32()), ("xpath", pa.string()),
    ("start", pa.int32()), ("end", pa.int32()),
])
_TEXT = pa.struct([("text", pa.string()), ("within", pa.string())])
_NODES = pa.struct([("elements", pa.list_(_ELEMENT)), ("texts", pa.list_(_TEXT)), ("error", pa.string())])

NODES = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("first_text", T.IntegerType()),
        T.StructField("end_text", T.IntegerType()),
        T.StructField("xpath", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]))),
    T.StructField("texts", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("within", T.StringType()),
    ]))),
    T.StructField("error", T.StringType()),
])


class _NodeList(HTMLParser):
    """Collects elements and text pieces of one document, in time linear in its length."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.texts: list[dict] = []
        self.pending: list[str] = []
        # Open elements with the marked element they are in and whether white space counts there.
        self.open: list[tuple[dict, str, bool]] = []
        self.open_tags: Counter = Counter()
        # Per element, in order: its own text pieces and the numbers of its children.
        self.content: list[list] = []
        self.source = ""
        self.line_starts = [0]

    def parse(self, source: str) -> dict:
        self.source = source
        self.line_starts += [m.end() for m in re.finditer("\n", source)]
        self.feed(source)
        return self.finish()

    def place(self) -> int:
        """Where in the source the piece at hand begins."""
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def parse_marked_section(self, i, report=1) -> int:
        """A marked section is a comment up to the next >, or to the end of the page."""
        end = self.rawdata.find(">", i + 3)
        end = len(self.rawdata) if end < 0 else end
        self.handle_comment(self.rawdata[i + 2:end])
        return min(end + 1, len(self.rawdata))

    def add_text(self, text: str, within: str) -> None:
        self.texts.append({"text": text, "within": within})
        if self.open:
            self.content[self.open[-1][0]["id"]].append((text, within))

    def flush(self) -> None:
        text = "".join(self.pending)
        self.pending.clear()
        if text:
            within, verbatim = self.open[-1][1:] if self.open else ("", False)
            if not verbatim and not text.strip():
                text = "\n" if "\n" in text else " "
            self.add_text(text, within)

    def close_top(self, end: int) -> None:
        element, _, _ = self.open.pop()
        self.open_tags[element["tag"]] -= 1
        element["last"], element["end_text"], element["end"] = len(self.elements) - 1, len(self.texts), end

    def handle_starttag(self, tag, attrs) -> None:
        self.flush()
        parent, within, verbatim = self.open[-1] if self.open else ({"id": -1}, "", False)
        element = {"id": len(self.elements), "parent": parent["id"], "tag": tag,
                   "attrs": [(k, v or "") for k, v in dict(attrs).items()], "first_text": len(self.texts), "start": self.place()}
        if self.open:
            self.content[parent["id"]].append(element["id"])
        self.elements.append(element)
        self.content.append([])
        self.open.append((element, tag if tag in MARKED_TAGS else within, verbatim or tag in VERBATIM_TAGS))
        self.open_tags[tag] += 1
        if tag in VOID_TAGS:
            self.close_top(self.after_tag())

    def after_tag(self) -> int:
        """Where the start tag at hand ends."""
        return self.place() + len(self.get_starttag_text() or "")

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.close_tag(tag, self.after_tag())

    def handle_endtag(self, tag) -> None:
        self.close_tag(tag, self.source.find(">", self.place()) + 1 or len(self.source))

    def close_tag(self, tag: str, end: int) -> None:
        """Close the innermost element of this tag, which ends at `end`; those inside it end before."""
        self.flush()
        if self.open_tags[tag]:
            while self.open[-1][0]["tag"] != tag:
                self.close_top(self.place())
            self.close_top(end)

    def handle_data(self, data) -> None:
        self.pending.append(data)

    def handle_comment(self, data) -> None:
        self.flush()
        self.add_text(data, "comment")

    def finish(self) -> dict:
        self.close()
        self.flush()
        while self.open:
            self.close_top(len(self.source))
        self.add_link_paths()
        return {"elements": self.elements, "texts": self.texts, "error": None}

    def steps(self) -> list[str]:
        """Each element's step of a path: its tag, with a position if its parent has several of
        that tag. Equal twins share the position of the first one."""
        shapes: list[int] = [0] * len(self.elements)
        for e in reversed(self.elements):
            inner = tuple(shapes[c] if isinstance(c, int) else c for c in self.content[e["id"]])
            shapes[e["id"]] = hash((e["tag"], tuple(sorted(e["attrs"])), inner))
        siblings: dict[tuple, list[int]] = {}
        for e in self.elements:
            siblings.setdefault((e["parent"], e["tag"]), []).append(e["id"])
        steps = [e["tag"] for e in self.elements]
        for ids in siblings.values():
            if len(ids) > 1:
                first: dict[int, int] = {}
                for place, i in enumerate(ids, 1):
                    steps[i] += f"[{first.setdefault(shapes[i], place)}]"
        return steps

    def add_link_paths(self) -> None:
        steps = self.steps()
        for e in self.elements:
            if e["tag"] == "a":
                path, at = [], e
                while True:
                    path.append(steps[at["id"]])
                    if at["parent"] < 0:
                        break
                    at = self.elements[at["parent"]]
                e["xpath"] = "/[document]/" + "/".join(reversed(path))


def nodes_of(html: str) -> dict:
    """The nodes of a page. What the parser cannot take is told in `error` and ends no job."""
    try:
        return _NodeList().parse(html)
    except Exception as e:
        return {"elements": [], "texts": [], "error": f"{type(e).__name__}: {e}"}


def _parse_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A few pages at a time become nodes and leave the worker, however many pages a batch holds: nodes take many times
    the space of their page."""
    for html in batches:
        for at in portions(html):
            yield pa.array([None if h is None else nodes_of(h) for h in html[at].to_pylist()], type=_NODES)


# Non-deterministic only to the optimizer, which then evaluates it exactly once per row.
_parse = F.arrow_udf(_parse_batches, NODES).asNondeterministic()


def html_nodes(html: Column | str) -> Column:
    return _parse(col(html))


# ---- expressions over a nodes column ------------------------------------------------------

def elements(nodes: Column | str, *tags: str) -> Column:
    return F.filter(col(nodes)["elements"], lambda e: e["tag"].isin(*tags))


def attr(element: Column, name: str) -> Column:
    return F.element_at(element["attrs"], name)


def has_token(value: Column, token: str) -> Column:
    """`token` is one of the white-space separated words of an attribute."""
    return F.array_contains(F.split(value, f"{SPACE}+"), token)


def source_of(html: Column | str, element: Column) -> Column:
    """An element as it stands in the page."""
    return F.substr(col(html), element["start"] + 1, element["end"] - element["start"])


def inside(nodes: Column | str, element: Column) -> Column:
    """Descendants of `element`."""
    return F.slice(col(nodes)["elements"], element["id"] + 2, element["last"] - element["id"])


def _pieces(nodes: Column | str, element: Column) -> Column:
    count = element["end_text"] - element["first_text"]
    own = F.when(element["tag"].isin("script", "style", "template"), element["tag"]).otherwise(F.lit(""))
    return F.filter(
        F.slice(col(nodes)["texts"], element["first_text"] + 1, count),
        lambda t: (t["within"] == own) | ~t["within"].isin(HIDDEN))


def text_of(nodes: Column | str, element: Column) -> Column:
    """All text below an element, pieces joined without separator."""
    return F.array_join(F.transform(_pieces(nodes, element), lambda t: t["text"]), "")


def stripped_text_of(nodes: Column | str, element: Column) -> Column:
    """All text below an element, every piece stripped, joined without separator."""
    return F.array_join(F.transform(_pieces(nodes, element), lambda t: strip(t["text"])), "")


def document_text(nodes: Column | str, dropped: list[str], separator: str) -> Column:
    """Text of the whole document except pieces inside `dropped` elements."""
    kept = F.filter(col(nodes)["texts"], lambda t: ~t["within"].isin(HIDDEN + dropped))
    return F.array_join(F.transform(kept, lambda t: t["text"]), separator)
