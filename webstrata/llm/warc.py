"""Derived WARC records: metadata and plain text of captured responses.

For every response the builder writes a metadata record and a conversion record. Both refer to the response by its
record id and keep its target and date; the metadata carry the status line and headers of the source, its digests and
the id of the conversion, so each derived record leads back to its source and to its sibling. Ids are name-based: the
same response always gives the same ids.

Files are gzip members, one per record, as archive readers expect; each task writes one file into the shared folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.frames import name
from webstrata.llm.shared_files import filesystem, written
from webstrata.session import cut, scratch_path

VERSION = "WARC/1.1"
#: The date of records whose response has none, and of the records that describe files.
NO_DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 1 << 20
# Elements whose content is no text, and elements that end a line.
_SILENT = ("script", "style", "noscript", "template", "svg", "head")
_LINES = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav "
                   "ol p pre section table td th tr ul body html".split())
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_TITLE = re.compile(r"<title[^>]*>([^<]*)", re.I)


def digest(data: bytes) -> str:
    """A digest as WARC headers state it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A name-based record id; the lengths keep the parts apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(f'{len(p)}:{p}' for p in parts))}>"


def plain_text(page: str) -> str:
    """The text of a page: tags, comments and silent elements removed, entities resolved, one line per block.

    Works in one sweep; what is not closed ends with the page.
    """
    lower, out, at, quoted = page.lower(), [], 0, True
    while True:
        tag = page.find("<", at)
        if tag < 0:
            out.append(page[at:])
            break
        out.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        found = _NAME.match(page, tag)
        if not found and not page.startswith(("<!", "<?"), tag):
            out.append("<")
            at = tag + 1
            continue
        whole = _TAG.match(page, tag) if quoted and found else None
        quoted = quoted and (whole is not None or not found)      # an open quote: from here on tags end at the next >
        end = whole.end() if whole else page.find(">", tag) + 1 or len(page)
        at = end
        if found:
            element = found[1].lower()
            if element in _LINES:
                out.append("\n")
            if element in _SILENT and page[tag + 1] != "/" and page[end - 2:end] != "/>":
                close = re.compile(f"</{element}[\\s>/]").search(lower, end)
                at = (page.find(">", close.start()) + 1 or len(page)) if close else len(page)
    text = html.unescape("".join(out))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def fields(pairs: list[tuple[str, str]]) -> bytes:
    """Named fields, one per line; line ends inside a value are folded to blanks, so a value cannot start a field."""
    return "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in pairs).encode("utf-8", "surrogatepass")


def record(kind: str, id_: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    head = fields([("WARC-Type", kind), ("WARC-Record-ID", id_), *headers, ("WARC-Block-Digest", digest(block)),
                   ("Content-Type", content_type), ("Content-Length", str(len(block)))])
    return VERSION.encode() + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def derive(source: dict) -> list[tuple[str, str, bytes]]:
    """(type, id, record) of the metadata and the conversion of one response.

    `source`: record_id, target_uri, date, status_line, headers (pairs) and body. A null body is empty, and a response
    without a date is dated NO_DATE, since every record must have one. The metadata name the conversion, and both refer
    to the response.
    """
    body, headers = source["body"] or "", source["headers"] or []
    payload = body.encode("utf-8", "surrogatepass")
    http = ((source["status_line"] or "") + "\r\n").encode() + fields(headers) + b"\r\n"
    refers, text = source["record_id"], plain_text(body).encode("utf-8", "surrogatepass")
    conversion, metadata = record_id(refers, "conversion"), record_id(refers, "metadata")
    shared = [("WARC-Target-URI", source["target_uri"] or ""), ("WARC-Date", source["date"] or NO_DATE), ("WARC-Refers-To", refers)]
    title = _TITLE.search(body)
    about = fields([("conversion", conversion), ("source-status", source["status_line"] or ""),
                    *((f"source-header-{k.lower()}", v) for k, v in headers),
                    ("source-payload-digest", digest(payload)), ("source-block-digest", digest(http + payload)),
                    ("source-length", str(len(payload))), ("title", " ".join(html.unescape(title[1]).split()) if title else ""),
                    ("text-digest", digest(text))])
    return [("metadata", metadata, record("metadata", metadata, shared, "application/warc-fields", about)),
            ("conversion", conversion, record("conversion", conversion, shared, "text/plain; charset=utf-8", text))]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; the block's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"no {VERSION} record: {lines[0][:40]!r}")
    headers = dict(line.partition(": ")[::2] for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if digest(block) != headers["WARC-Block-Digest"] or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"{headers.get('WARC-Record-ID')}: damaged record")
    return headers, block


def _named(metadata: bytes) -> str | None:
    """The conversion that a block of metadata names."""
    first = metadata.partition(b"\r\n")[0].decode("utf-8", "surrogatepass")
    return first.removeprefix("conversion: ") if first.startswith("conversion: ") else None


def responses(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = NO_DATE) -> DataFrame:
    """Pages without headers as responses: (record_id, target_uri, date, status_line, headers, body).

    A page's id and URL name its record, so rows that repeat both get one id. Null URLs and bodies are kept as empty.
    """
    @F.pandas_udf(T.StringType())
    def ident(keys: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([record_id(str(k), u or "") for k, u in zip(keys, urls)])

    body = F.coalesce(name(html_col), F.lit(""))
    headers = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")),
                      F.struct(F.lit("Content-Length").alias("name"), F.octet_length(body).cast("string").alias("value")))
    return pages.select(ident(name(key_col).cast("string"), name(url_col)).alias("record_id"), name(url_col).alias("target_uri"),
                        F.lit(date).alias("date"), F.lit("HTTP/1.1 200 OK").alias("status_line"), headers.alias("headers"), body.alias("body"))


def write_derived(sources: DataFrame, folder: str, date: str = NO_DATE) -> DataFrame:
    """Write both records of every response; one row per record: (path, offset, length, type, record_id, refers_to).

    Each file begins with a record that describes it, dated `date` and named by the file's whole path.
    A task's file takes its name only when it is complete; a repeated task replaces it. An empty table gives no files.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get(), 0
        path = f"{folder}/derived-{task.partitionId():06d}.warc.gz"
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        with written(path, task.taskAttemptId()) as stream:
            about = record("warcinfo", record_id(path, "warcinfo"), [("WARC-Date", date), ("WARC-Filename", path.rsplit("/", 1)[-1])],
                           "application/warc-fields", fields([("format", "derived records of responses")]))
            data = gzip.compress(about, mtime=0)
            stream.write(data)
            at += len(data)
            while batch is not None:
                rows = []
                for source in batch.to_pylist():
                    source["headers"] = [(h["name"], h["value"] or "") for h in source["headers"] or []]
                    for kind, id_, content in derive(source):
                        data = gzip.compress(content, compresslevel=5, mtime=0)
                        stream.write(data)
                        rows.append({"path": path, "offset": at, "length": len(data), "type": kind, "record_id": id_, "refers_to": source["record_id"]})
                        at += len(data)
                yield pa.RecordBatch.from_pylist(rows, schema=made)
                batch = next(batches, None)

    made = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()),
                      ("record_id", pa.string()), ("refers_to", pa.string())])
    return cut(sources.mapInArrow(write, "path string, offset long, length long, type string, record_id string, refers_to string"))


def read_derived(index: DataFrame) -> DataFrame:
    """Read the files named in the index from front to back: (type, record_id, refers_to, target_uri, date, conversion, block).

    `conversion` is the id of the conversion that metadata name.

    Every gzip member, header and block digest is checked. Files are streamed, so one of any size fits.
    """
    made = pa.schema([(c, pa.string()) for c in ("type", "record_id", "refers_to", "target_uri", "date", "conversion")] + [("block", pa.binary())])

    def members(path: str) -> Iterator[bytes]:
        files, place = filesystem(path)
        inflate, out = zlib.decompressobj(31), []
        with files.open_input_stream(place, compression=None) as stream:      # the members are told apart here
            while data := stream.read(READ_BYTES):
                while data:
                    out.append(inflate.decompress(data))
                    data = inflate.unused_data
                    if inflate.eof:
                        yield b"".join(out)
                        inflate, out = zlib.decompressobj(31), []
        if any(out):
            raise ValueError(f"{path}: cut off")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            rows, size = [], 0
            for member in members(path):
                headers, block = parse(member)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                rows.append((headers["WARC-Type"], headers["WARC-Record-ID"], headers["WARC-Refers-To"], headers["WARC-Target-URI"],
                             headers["WARC-Date"], _named(block) if headers["WARC-Type"] == "metadata" else None, block))
                size += len(block)
                if size > READ_BYTES * 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), made)], schema=made)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), made)], schema=made)

    paths = index.select("path").distinct()
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(read, "type string, record_id string, refers_to string, target_uri string, "
                                                                       "date string, conversion string, block binary")


def derivatives(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write the derived records of all pages and read them back: one row per record with lengths and digests.

    (type, record_id, refers_to, target_uri, date, conversion, n_bytes, block_sha256). Two rows per page; repeated
    pages give repeated rows, an empty table none.
    """
    index = write_derived(responses(pages, key_col, url_col, html_col), folder or scratch_path(pages.sparkSession, "warc"))
    return read_derived(index).select("type", "record_id", "refers_to", "target_uri", "date", "conversion",
                                      F.octet_length("block").cast("bigint").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))
