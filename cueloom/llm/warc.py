"""WARC derivatives: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.html_blocks import read_blocks

#: Record of derivatives; content is the record's block, record the whole record as written to a file.
RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, headers string, content string"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_SKIPPED = {"head", "title", "noscript", "select", "textarea", "button"}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    """A stable identifier, the same on every run."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def plain_text(html: str | None) -> str:
    """Every visible block of a page on a line of its own."""
    return "\n".join(b.text for b in read_blocks(html) if not _SKIPPED & set(b.path))


def _headers(fields: list[tuple[str, object]]) -> str:
    clean = lambda v: " ".join(str(v).split())  # noqa: E731  a value with line ends can't forge a header
    return "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None)


def _derived(page_id, response_id: str, url: str | None, date: str | None, http: str | None, payload: str | None) -> list[tuple]:
    payload_bytes = (payload or "").encode("utf-8", "surrogatepass")
    source = digest((http or "").encode("utf-8", "surrogatepass") + payload_bytes)
    own = digest(payload_bytes)
    text = plain_text(payload)
    about = [("source-block-digest", source), ("source-payload-digest", own), ("source-payload-length", len(payload_bytes)), ("text-length", len(text))]
    about += [(f"source-header-{k.strip().lower()}", v.strip()) for k, _, v in (line.partition(":") for line in (http or "").splitlines()[1:]) if v]
    rows = []
    for kind, mime, content in (("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in about)), ("conversion", "text/plain; charset=utf-8", text)):
        block = content.encode("utf-8", "surrogatepass")
        name = record_id(kind, response_id)
        head = _headers([("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", response_id), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("Content-Type", mime), ("Content-Length", len(block))])
        rows.append((page_id, kind, name, response_id, url, own, digest(block), len(block), head, content))
    return rows


def derive(responses: DataFrame) -> DataFrame:
    """Two RECORD rows, metadata and conversion, for every row of
    `responses(page_id, response_id, url, warc_date, http_headers, payload)`.

    WARC-Refers-To is the response's identifier; source headers and digests go to the metadata
    record. Null payloads count as empty, null urls, dates and headers are left out. Rows with
    equal response_id give equal records. Narrow: one Arrow pass, no shuffle.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    none = lambda x: None if pd.isna(x) else x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                rows = [r for p, i, u, d, h, x in zip(*(part[c] for c in ("page_id", "response_id", "url", "warc_date", "http_headers", "payload"))) for r in _derived(none(p), i, u, d, h, x)]
                frame = pd.DataFrame(rows, columns=names)
                frame["page_id"] = pd.array([r[0] for r in rows], dtype="Int64")
                yield frame

    return responses.select("page_id", "response_id", "url", "warc_date", "http_headers", "payload").mapInPandas(run, RECORD)


def page_responses(pages: DataFrame, warc_date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """`pages(page_id, url, html)` as responses with a stable identifier and the headers of a plain reply."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    digits = F.sha2(F.concat_ws("\0", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha2(F.coalesce("html", F.lit("")), 256)), 256)
    part = lambda a, n: F.substring(digits, a, n)
    name = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        name.alias("response_id"),
        F.col("url").cast("string").alias("url"),
        F.lit(warc_date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n")).alias("http_headers"),
        F.col("html").cast("string").alias("payload"),
    )


def write_records(records: DataFrame, path: str) -> None:
    """Write records as text parts in WARC form (headers, blank line, block, two blank lines)."""
    whole = F.concat("headers", F.lit("\r\n"), "content", F.lit("\r\n\r\n"))
    records.select(whole.alias("value")).write.option("lineSep", "").text(path)
