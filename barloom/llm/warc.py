"""WARC derivatives: metadata and plain-text conversion records from responses.

Both records refer to the response they come from (WARC-Refers-To), keep its target URI
and date, and carry digests: of their own block, and of the source's payload.  Record
ids are name-based UUIDs of the source id and the record type, so a repeated or resumed
run builds the same records.  Responses come from WARC files or from any table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table

RESPONSES = "source long, record_id string, target_uri string, date string, http_headers string, payload binary"
DERIVED = (
    "source long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, source_digest string, source_headers string, block string"
)

#: A comment, a tag (slash, name, attributes) or a declaration.  A tag ends before the next '<', so no part of a page is read twice.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>?|<[!?/][^<>]*>?", re.S)
_HIDDEN = {name: re.compile(rf"</{name}\b[^<>]*>?", re.I) for name in ("script", "style", "noscript", "template", "svg", "head")}
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_TITLE_END = re.compile(r"</title", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_SPACES = re.compile(r"[^\S\n]+")
_BREAKS = re.compile(r"[\r\n]")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(source_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source_id}#{kind}')}>"


def decode_body(headers: str, payload: bytes) -> str:
    """Text of a payload: charset of the header, then of the page's beginning, then UTF-8."""
    found = _CHARSET.search(headers.encode("utf-8", "replace")) or _CHARSET.search(payload[:2048])
    try:
        return payload.decode(found[1].decode("ascii"), "replace") if found else payload.decode("utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """Visible text, a line for each block; entities are resolved after tags are gone."""
    out, at = [], 0
    while found := _TAG.search(page, at):
        out.append(_BREAKS.sub(" ", page[at : found.start()]))
        at, name = found.end(), (found[2] or "").lower()
        if name in _HIDDEN and not found[1]:
            end = _HIDDEN[name].search(page, at)
            at = end.end() if end else len(page)
        out.append("\n" if name in _BLOCK else "" if name and name not in _HIDDEN else " ")
    out.append(_BREAKS.sub(" ", page[at:]))
    lines = (_SPACES.sub(" ", html.unescape(x)).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def page_facts(page: str, headers: str, payload: bytes) -> str:
    """The block of a metadata record: application/warc-fields."""
    title, lang, links = None, None, {}
    for found in _TAG.finditer(page):
        name = "" if found[1] else (found[2] or "").lower()
        if name == "title" and title is None:
            end = _TITLE_END.search(page, found.end())
            title = page[found.end() : end.start() if end else len(page)]
        elif name == "html" and lang is None and (said := _LANG.search(found[3])):
            lang = said[1].lower()
        elif name == "a" and (said := _HREF.search(found[3])):
            links[html.unescape(next(g for g in said.groups() if g is not None)).replace("\n", " ")] = None
    fields = [("title", _SPACES.sub(" ", _BREAKS.sub(" ", html.unescape(title or ""))).strip()), ("language", lang or "")]
    fields += [("source-payload-length", str(len(payload))), ("source-status", headers.split("\r\n", 1)[0])]
    fields += [("outlink", x) for x in links if x]
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v)


def derive(source, record_id, target_uri, date, headers, payload) -> list[dict]:
    """The metadata and conversion records of one response."""
    headers, payload = headers or "", payload or b""
    page = decode_body(headers, payload)
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", page_facts(page, headers, payload)), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        block = block.encode("utf-8", "replace").decode("utf-8")
        raw = block.encode("utf-8")
        out.append({
            "source": source, "record_type": kind, "record_id": derived_id(record_id or "", kind), "refers_to": record_id, "target_uri": target_uri, "date": date, "content_type": content_type,
            "content_length": len(raw), "block_digest": digest(raw), "source_digest": digest(payload), "source_headers": headers, "block": block,
        })
    return out


_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in DERIVED.split(", "))])


def _derive(batches):
    for batch in batches:
        out, size = [], 0
        for r in batch.to_pylist():
            made = derive(r["source"], r["record_id"], r["target_uri"], r["date"], r["http_headers"], r["payload"])
            out += made
            size += sum(len(x["block"]) for x in made)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two rows (metadata, conversion) per response, linked to it by refers_to.

    Needs the columns of RESPONSES; others are ignored.  A null payload or header counts
    as empty: the records then have empty or short blocks and their digests.  A null
    record id stays null in refers_to.  Repeated responses give repeated records with
    equal ids.
    """
    names = [x.split()[0] for x in RESPONSES.split(", ")]
    return responses.select(*names).mapInArrow(_derive, DERIVED)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Responses for a table of (page_id, url, html), all with one date."""
    name = F.sha1(F.concat_ws("\n", F.lit("response"), F.col("page_id").cast("string"), F.col("url")))
    cut = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col("page_id").cast("long").alias("source"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">")).alias("record_id"), F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n").alias("http_headers"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )


def record_bytes(r: dict) -> bytes:
    """A derived row as one gzip member of a WARC 1.1 file."""
    block = r["block"].encode("utf-8")
    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["refers_to"])]
    fields += [("WARC-Block-Digest", r["block_digest"]), ("WARC-Source-Payload-Digest", r["source_digest"]), ("Content-Type", r["content_type"]), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(head.encode("utf-8") + block + b"\r\n\r\n", mtime=0)


#: Begins each record; files are read record by record with it as line separator.
_MARK = b"WARC/1."


def parse_record(raw: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, where the block begins, where it ends) of a record without its first seven bytes, or None."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or raw[1:3] != b"\r\n":
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[3:end].decode("utf-8", "replace").split("\r\n"))}
    length = fields.get("content-length", "0")
    return fields, end + 4, end + 4 + (int(length) if length.isdigit() else 0)


def _responses(batches):
    """Parts of files, in order, to responses; a block that holds the mark itself is put together again."""
    state = {"file": None, "parts": [], "size": 0, "record": None}

    def finished():
        if state["record"] is None:
            return []
        fields, begin, end = state["record"]
        state["record"] = None
        if fields.get("warc-type") != "response":
            return []
        head, sep, body = _MARK.join(state["parts"])[begin:end].partition(b"\r\n\r\n")
        return [{"source": None, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "http_headers": (head + sep).decode("utf-8", "replace"), "payload": body}]

    def rows(batch):
        out, size = [], 0
        for file, part in zip(batch.column("file").to_pylist(), batch.column("part")):
            raw = part.as_py()
            if state["record"] and file == state["file"] and state["size"] < state["record"][2]:
                state["parts"].append(raw)
                state["size"] += len(_MARK) + len(raw)
                continue
            out += finished()
            state.update(file=file, parts=[raw], size=len(raw), record=parse_record(raw))
            size += len(raw)
            if size > 1 << 22:
                yield out
                out, size = [], 0
        yield out

    schema = pa.schema([("source", pa.int64()), *[(n, pa.string()) for n in ("record_id", "target_uri", "date", "http_headers")], ("payload", pa.binary())])
    for batch in batches:
        for out in rows(batch):
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    yield pa.RecordBatch.from_pylist(finished(), schema=schema)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses of WARC files, gzipped or not, read as a stream of records.

    A gzipped file is read by one task, as its members must be in order, but never held
    whole.  A plain file may be split between records; a block that holds the mark of a
    record across such a split ends there.
    """
    parts = spark.read.option("lineSep", _MARK.decode()).text(path).select(F.col("value").cast("binary").alias("part"), F.col("_metadata.file_path").alias("file"))
    return parts.mapInArrow(_responses, RESPONSES)


def with_record_bytes(derived: DataFrame) -> DataFrame:
    """Derived rows and their WARC records, to be written by any sink."""
    def run(batches):
        for batch in batches:
            yield batch.append_column("record", pa.array([record_bytes(r) for r in batch.to_pylist()], pa.binary()))

    return derived.mapInArrow(run, DERIVED + ", record binary")


def op6_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all ``pages``."""
    return build_derivatives(responses_of_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("source", "page_id")
