"""WARC derivatives: linked metadata and plain-text conversion records (operator 6).

A response record is read by its own headers: WARC headers, HTTP headers, then
the payload, whose digest is checked. Chunks are joined, gzip and deflate undone,
repeated headers all kept; an unknown coding is an error. Each gives a metadata record
(application/warc-fields: title, language, counts, outlinks and the source's
HTTP headers) and a conversion record (text/plain). Both name the response they
come from in WARC-Refers-To, keep its target, date and headers, and carry their
own block digest and the source's payload digest. Record ids are hashes of what
they name, so reruns agree. One pass over the records, no shuffle.

`responses` makes response records of a table of raw pages. Null html is an
empty payload, a null url an empty target. A record that does not parse, or
whose digest does not match, gives derivatives with `error` set and no text (and
no WARC-Refers-To where it names no id). Markup is read in linear time.
Repeated rows give equal records. An empty table gives no rows. Columns other
than the id, the url and the html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import importable

VERSION = b"WARC/1.1"
DATE = "2026-01-01T00:00:00Z"
# A page that decodes to more is reported as an error, so that a small record cannot fill a worker.
MAX_PAGE = 256 * 1024 * 1024
SCHEMA = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
          "content_length long, block_digest string, source_payload_digest string, source_status string, source_content_type string, "
          "content string, error string, record binary")

HIDDEN = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
HIDDEN_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
BREAKS = re.compile(r"<(?:/?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|blockquote|pre|title|body|main|aside)\b[^>]*|br\s*/?)>", re.I)
TAGS = re.compile(r"<[^>]*>")
SPACES = re.compile(r"[ \t\r\f\v]+")
TITLE, TITLE_END = re.compile(r"<title[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
LINKS = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
STARTS = {LANG: re.compile(r"<html\b", re.I), LINKS: re.compile(r"<a\b", re.I)}
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    raw = hashlib.sha1("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=raw[:16], version=5)}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in headers]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and headers in order, every occurrence (names lower-cased, folded lines joined)."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip().lower(), v.strip()))
    return first, out


def named(headers: list[tuple[str, str]], name: str) -> str:
    """First value of a name, empty without one."""
    return next((v for k, v in headers if k == name), "")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers (first of a name) and block; raises ValueError on anything malformed."""
    head, found, rest = record.partition(b"\r\n\r\n")
    first, pairs = headers_of(head)
    headers = dict(reversed(pairs))
    if not found or not first.startswith("WARC/"):
        raise ValueError("no WARC header")
    n = int(headers.get("content-length", "-1"))
    if not 0 <= n <= len(rest):
        raise ValueError("content length does not fit")
    return headers, rest[:n]


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    head, found, payload = block.partition(b"\r\n\r\n")
    first, headers = headers_of(head)
    if not found or not first.startswith("HTTP/"):
        raise ValueError("no HTTP header")
    return first, headers, payload


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; a body that is not chunked was stored without chunks and stays."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 1024)
        size = body[at:end].split(b";")[0].strip() if end > at else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n:at + n + 2] != b"\r\n":
            return body
        parts.append(body[at:at + n])
        at += n + 2


def inflated(data: bytes, coding: str, limit: int) -> bytes:
    """Undo one content coding; raises ValueError where that fails or gives more than `limit` bytes."""
    if coding in ("", "identity") or not data:
        return data
    if coding not in ("gzip", "x-gzip", "deflate"):
        raise ValueError(f"content coding {coding} is not known")
    if coding != "deflate" and data[:2] != b"\x1f\x8b":
        return data  # stored decoded, with the header kept
    out, size = [], 0
    # deflate comes with and without its wrapper
    bits = 31 if coding != "deflate" else 15 if (data[0] & 15) == 8 and int.from_bytes(data[:2], "big") % 31 == 0 else -15
    while data:
        z = zlib.decompressobj(bits)
        try:
            out.append(z.decompress(data, limit + 1 - size))
        except zlib.error:
            raise ValueError(f"content coding {coding} does not decode") from None
        size += len(out[-1])
        if size > limit:
            raise ValueError(f"payload decodes to more than {limit} bytes")
        if not z.eof:
            raise ValueError(f"content coding {coding} ends early")
        # further members of a gzip file; padding after the last one is left out
        data = z.unused_data if coding != "deflate" and z.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def page_text(payload: bytes, http: list[tuple[str, str]], limit: int = MAX_PAGE) -> str:
    """The page as text: content codings undone, last one first, then the charset."""
    codings = [c.strip().lower() for k, v in http if k == "content-encoding" for c in v.split(",")]
    for c in reversed(codings):
        payload = inflated(payload, c, limit)
    m = CHARSET.search(named(http, "content-type"))
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def visible(page: str) -> str:
    """Comments, scripts and the like as one space each. What is never closed stays; its end is looked for once only."""
    out, at, pos, open_ = [], 0, 0, set()
    while m := HIDDEN.search(page, pos):
        kind = (m[1] or "").lower()
        end = None if kind in open_ else HIDDEN_END[kind].search(page, m.end())
        if end:
            out += page[at:m.start()], " "
            at = pos = end.end()
        else:
            open_.add(kind)
            pos = m.end()
    return "".join(out) + page[at:]


def replaced(tags: re.Pattern, by: str, page: str) -> str:
    """Tags replaced; none ends behind the last `>`, so no search runs into the rest."""
    end = page.rfind(">") + 1
    return tags.sub(by, page[:end]) + page[end:]


def tags_like(pattern: re.Pattern, page: str):
    """Matches of a tag pattern. Where it does not fit, the search goes on behind that tag's end."""
    pos = 0
    while start := STARTS[pattern].search(page, pos):
        m, end = pattern.match(page, start.start()), page.find(">", start.end())
        if m:
            yield m
        elif end < 0:
            return
        pos = m.end() if m else end + 1


def plain_text(page: str) -> str:
    """Visible text of a page: no markup, scripts or styles; one line per block."""
    page = replaced(TAGS, "", replaced(BREAKS, "\n", visible(page).replace("\n", " ")))
    lines = (SPACES.sub(" ", html.unescape(x)).strip() for x in page.split("\n"))
    return "\n".join(x for x in lines if x)


def facts(page: str, target: str) -> list[tuple[str, str]]:
    """Title, language and outlinks in order of first appearance, made absolute."""
    clean = visible(page)
    out = []
    title = TITLE.search(clean, 0, clean.rfind(">") + 1)
    if title and (end := TITLE_END.search(clean, title.end())):
        out.append(("title", SPACES.sub(" ", html.unescape(replaced(TAGS, "", clean[title.end():end.start()])).replace("\n", " ")).strip()))
    if m := next(tags_like(LANG, clean), None):
        out.append(("language", m[1]))
    for link in dict.fromkeys(html.unescape(m[1] or m[2] or m[3] or "").strip() for m in tags_like(LINKS, clean)):
        try:
            out.append(("outlink", urljoin(target, link)))
        except ValueError:
            out.append(("outlink", link))
    return [(k, v.replace("\r", " ").replace("\n", " ")) for k, v in out]


def response(page_id, url: str | None, page: str | None) -> bytes:
    payload = (page or "").encode("utf-8", "surrogatepass")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return build([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, target, digest(payload))), ("WARC-Target-URI", target),
        ("WARC-Date", DATE), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block)


def derivatives(page_id, record: bytes | None) -> list[tuple]:
    """The metadata and the conversion row of one response record."""
    error, page, first, http, source = None, "", "", [], {}
    try:
        source, block = parse(record or b"")
        if source.get("warc-type") != "response":
            raise ValueError("not a response")
        first, http, payload = split_http(block)
        chunked = any(k == "transfer-encoding" and "chunked" in v.lower() for k, v in http)
        body = unchunked(payload) if chunked else payload
        # a payload digest is taken before or after the chunks are joined
        for name, forms in (("warc-block-digest", (block,)), ("warc-payload-digest", (payload, body))):
            if source.get(name, "").startswith("sha1:") and source[name] not in map(digest, forms):
                raise ValueError(f"{name} does not match")
        page = page_text(body, http)
    except ValueError as e:
        error = str(e)
    target, date, ref = source.get("warc-target-uri", ""), source.get("warc-date", DATE), source.get("warc-record-id", "")
    paid = source.get("warc-payload-digest", "")
    text = "" if error else plain_text(page)
    fields = [] if error else facts(page, target) + [(f"http-{k}", v) for k, v in http] + [("http-status", first), ("text-characters", str(len(text)))]
    if error:
        fields = [("error", error)]
    out = []
    for kind, mime, body in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", "text/plain; charset=utf-8", text)):
        block = body.encode("utf-8", "surrogatepass")
        rid = record_id(kind, ref, page_id, digest(block))
        refers = [(k, v) for k, v in (("WARC-Refers-To", ref), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)) if ref and v]
        raw = build([
            ("WARC-Type", kind), ("WARC-Record-ID", rid), *refers, ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)),
            ("WARC-Source-Payload-Digest", paid), ("WARC-Source-Content-Type", named(http, "content-type")),
            ("Content-Type", mime), ("Content-Length", str(len(block)))], block)
        out.append((page_id, kind, rid, ref, target, date, mime, len(block), digest(block), paid, first, named(http, "content-type"), body, error, raw))
    return out


def _responses(batches):
    for b in batches:
        rows = [response(*r) for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["page_id", "record"])


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): one response record per raw page."""
    importable(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_responses, "page_id long, record binary")


def _derive(batches):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
    for b in batches:
        for at in range(0, b.num_rows, 100):
            part = b.slice(at, 100)
            rows = [r for page_id, rec in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in derivatives(page_id, rec)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response record (page_id, record): its metadata and its conversion, with the record's bytes."""
    importable(records.sparkSession)
    return records.select("page_id", "record").mapInArrow(_derive, SCHEMA)
