"""One reading of a sitemap file: its entries and child sitemaps, up to where the file breaks off.

The reader takes events as they come, so what stands before a break is kept, and says what broke. Namespaces are not
resolved: a prefix that is never declared, as many files have, is no break.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions.portions import portions

_STRINGS = T.ArrayType(T.StringType())
FILE = T.StructType().add("children", _STRINGS).add("entries", T.ArrayType(
    T.StructType().add("loc", "string").add("priority", "string").add("lastmod", "string").add("hreflangs", _STRINGS).add("hrefs", _STRINGS))).add("error", "string")
_ENTRY = pa.struct([("loc", pa.string()), ("priority", pa.string()), ("lastmod", pa.string()),
                    ("hreflangs", pa.list_(pa.string())), ("hrefs", pa.list_(pa.string()))])
_FILE = pa.struct([("children", pa.list_(pa.string())), ("entries", pa.list_(_ENTRY)), ("error", pa.string())])
_FIELDS = ("loc", "priority", "lastmod")
#: Files that are Python objects at a time, and characters given to the reader at once.
FILES_AT_ONCE, CHARACTERS = 4, 1 << 20


class _Reader:
    def __init__(self) -> None:
        self.children: list[str | None] = []
        self.entries: list[dict] = []
        self.entry: dict | None = None
        self.kind = self.field = ""
        self.text: list[str] = []
        parser = self.parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.text.append

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        name = tag.rpartition(":")[2].lower()
        if name in ("url", "sitemap"):
            self.kind, self.entry = name, dict.fromkeys((*_FIELDS, "hreflangs", "hrefs"))
        elif self.entry is not None and name == "link":
            for key, value in (("hreflangs", attrs.get("hreflang")), ("hrefs", attrs.get("href"))):
                self.entry[key] = (self.entry[key] or []) + ([value] if value else [])
        elif self.entry is not None and name in _FIELDS and ":" not in tag:
            # `image:loc` and the like are not the page's.
            self.field = name
        self.text.clear()

    def end(self, tag: str) -> None:
        name = tag.rpartition(":")[2].lower()
        if self.entry is None:
            return
        if self.field and name == self.field:
            self.entry[name] = self.entry[name] or "".join(self.text)
            self.field = ""
        elif name == self.kind:
            if name == "sitemap":
                self.children.append(self.entry["loc"])
            else:
                self.entries.append(self.entry)
            self.entry = None


def read_file(xml: str) -> dict:
    """Children, entries and what broke the file, if anything did. An entry that is not complete does not count."""
    reader, error = _Reader(), None
    xml = xml.lstrip("﻿ \t\r\n")
    try:
        for start in range(0, len(xml), CHARACTERS):
            reader.parser.Parse(xml[start:start + CHARACTERS], False)
        reader.parser.Parse("", True)
    except (expat.ExpatError, ValueError) as e:
        error = str(e)
    return {"children": reader.children, "entries": reader.entries, "error": error}


def _read_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for xml in batches:
        for at in portions(xml, FILES_AT_ONCE):
            yield pa.array([None if x is None else read_file(x) for x in xml[at].to_pylist()], type=_FILE)


# Non-deterministic only to the optimizer, which then evaluates it exactly once per row.
_read = F.arrow_udf(_read_batches, FILE).asNondeterministic()


def sitemap_file(xml: Column) -> Column:
    """struct(children, entries, error) of a file."""
    return _read(xml)
