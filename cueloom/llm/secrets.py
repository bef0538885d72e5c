"""Secret scans: base patterns, and candidates confirmed by decoding them and reading their structure."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import text_udf

#: Kinds in the order that breaks ties; the first three are base patterns.
KINDS = ("assign", "access", "hex", "token", "pem", "key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Base64 of an opening brace and white space or a quote.
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Line ends may be written as a backslash and a letter, as in strings of source code.
_GAP = r"(?:\s|\\[nr])"
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=]|{_GAP})+)-----END \1-----")
#: Where base64 of a sequence, or of a container with a name in front, can begin: also after a slash, dash or written line end.
START = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nr]))(?:M[A-P][A-Za-z0-9+/_-]{30}|AAAA[A-Za-z0-9+/_-]{28}|b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/_-]{12})")
_LETTER = re.compile(r"[A-Za-z0-9+/_-]")
_SPLIT = re.compile(rf"{_GAP}+")
#: Parts of runs, with line ends of both kinds between them.
_PART, _GAPS = re.compile(r"\\[nr]|([A-Za-z0-9+/_-]+)"), re.compile(rf"{_GAP}{{1,8}}")
_HEX_KEY = re.compile(r"(?<![0-9A-Za-z])0[xX](30[0-9A-Fa-f]{38,})(?![0-9A-Za-z])")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
#: First bytes of a binary key container, and the number of fields behind each key name of the length-prefixed public form.
OPENSSH = b"openssh-key-v1\0"
SSH_FIELDS = {b"ssh-rsa": 2, b"ssh-dss": 4, b"ssh-ed25519": 1, b"ecdsa-sha2-nistp256": 2, b"ecdsa-sha2-nistp384": 2, b"ecdsa-sha2-nistp521": 2}
#: Bytes that a field of a public key, and the private section of a container, have at most.
FIELD, SECTION = 1 << 16, 1 << 22


def _decode64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _nested(data: bytes, depth: int = 0) -> int | None:
    """How many values a tag-length-value encoding holds if all its lengths agree, else None."""
    at, values = 0, 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            n, at = int.from_bytes(data[at : at + wide], "big"), at + wide
            if n < 0x80:
                return None
        if at + n > len(data) or tag & 0x1F == 0x1F:
            return None
        values += 1
        if tag & 0x20:
            if depth == 12 or (inner := _nested(data[at : at + n], depth + 1)) is None:
                return None
            values += inner
        at += n
    return values


def _agrees(data: bytes, size: int, depth: int = 0) -> bool:
    """Whether the lengths in the first bytes of `size` bytes of nested values agree, as far as those bytes go."""
    at = 0
    while at + 6 <= len(data):
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4:
                return False
            n, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if at + n > size or depth > 12 or (tag & 0x20 and not _agrees(data[at : at + n], n, depth + 1)):
            return False
        at += n
    return True


class _Bytes:
    """The first bytes of something, as many as are asked for: `get(n)` gives n of them, or None where fewer are there."""

    def __init__(self, get):
        self.get = get

    def number(self, at: int) -> int | None:
        found = self.get(at + 4)
        return None if found is None else int.from_bytes(found[at:], "big")

    def field(self, at: int, most: int) -> bytes | None:
        """The field whose length is given at a place."""
        n = self.number(at)
        if n is None or n > most or (found := self.get(at + 4 + n)) is None:
            return None
        return found[at + 4 :]

    def public_key(self, at: int = 0) -> int | None:
        """Where the public key that begins at a place ends."""
        name = self.field(at, 19)
        if name not in SSH_FIELDS:
            return None
        at += 4 + len(name)
        for _ in range(SSH_FIELDS[name]):
            if not (value := self.field(at, FIELD)):
                return None
            at += 4 + len(value)
        return at

    def container(self) -> int | None:
        """Where the key container that begins here ends: names of cipher and derivation, its options, public keys and
        the private section, which has whole blocks and, if it isn't encrypted, begins with the same number twice."""
        at = len(OPENSSH)
        names = []
        for most in (64, 64, 1024):
            if (value := self.field(at, most)) is None:
                return None
            names.append(value)
            at += 4 + len(value)
        cipher, derivation, options = names
        plain = cipher == b"none"
        if plain != (derivation == b"none") or plain != (not options) or not cipher.isascii():
            return None
        if not plain and (derivation != b"bcrypt" or len(options) < 8 or int.from_bytes(options[:4], "big") != len(options) - 8):
            return None
        keys = self.number(at)
        if not keys or keys > 64:
            return None
        at += 4
        for _ in range(keys):
            n = self.number(at)
            if n is None or self.public_key(at + 4) != at + 4 + n:
                return None
            at += 4 + n
        section = self.field(at, SECTION)
        if not section or len(section) % 8 or (plain and section[:4] != section[4:8]):
            return None
        return at + 4 + len(section)


def is_key(data: bytes) -> bool:
    """Whether bytes are a key: a sequence whose nested lengths all agree, a key container, or a length-prefixed
    public key, without anything behind."""
    if len(data) >= 24 and data[0] == 0x30:
        return (b"\x02" in data[:8] or b"\x06" in data[:16]) and (_nested(data) or 0) >= 3
    first = _Bytes(lambda n: data[:n] if n <= len(data) else None)
    return (first.container() if data.startswith(OPENSSH) else first.public_key()) == len(data)


def _size(head: bytes) -> int:
    """Bytes of the value that begins with these bytes, by its declared length; 0 if it declares none."""
    n = head[1]
    if n < 0x80:
        return n + 2
    wide = n & 0x7F
    return 2 + wide + int.from_bytes(head[2 : 2 + wide], "big") if 1 <= wide <= 4 else 0


class _Runs:
    """The runs of base64 letters of a text, found once; lines of a wrapped run go on in the next line."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _PART.finditer(text) if m[1] is not None]
        self.starts = [s for s, _ in self.spans]

    def read(self, start: int, n: int) -> tuple[str, int] | None:
        """n letters from a place on, and where they end; None if the run has fewer."""
        if n > len(self.text) - start:
            return None
        k = bisect.bisect_right(self.starts, start) - 1
        parts, at = [], start
        while k >= 0:
            part = self.text[at : min(self.spans[k][1], at + n)]
            parts.append(part)
            n -= len(part)
            if n == 0:
                return "".join(parts), at + len(part)
            if not part or k + 1 == len(self.spans) or not _GAPS.fullmatch(self.text, self.spans[k][1], self.spans[k + 1][0]):
                return None
            k += 1
            at = self.spans[k][0]
        return None

    def first(self, start: int, n: int) -> bytes | None:
        """The first n bytes of what is encoded from a place on."""
        found = self.read(start, -(-n * 4 // 3))
        return None if found is None or (data := _decode64(found[0])) is None else data[:n]

    def key_from(self, start: int) -> int | None:
        """End of the key that begins here, wrapped in lines or not; None if there is none.

        All forms say how long they are, so just that much is read, and no more once its head is none of a key;
        what follows must not go on in the same run.
        """
        kind = self.text[start]
        if kind == "M":
            size = _size(self.first(start, 9) or b"\0\0")
            if size < 24 or (data := self.first(start, min(size, 3072))) is None:
                return None
            if data[0] != 0x30 or not (b"\x02" in data[:8] or b"\x06" in data[:16]) or not _agrees(data, size):
                return None
            if (data := self.first(start, size)) is None or not is_key(data):
                return None
        else:
            first = _Bytes(lambda n: self.first(start, n))
            size = first.container() if kind == "b" else first.public_key()
            if size is None:
                return None
        at = self.read(start, -(-size * 4 // 3))[1]
        while at < len(self.text) and self.text[at] == "=":
            at += 1
        return None if at < len(self.text) and self.text[at] not in "=\\" and _LETTER.match(self.text, at) else at


def is_signed_token(run: str) -> bool:
    """Whether a dotted run is a signed token: header and claims are JSON objects, the header names an algorithm."""
    head, claims, _ = run.split(".", 2)
    try:
        header, body = (json.loads(_decode64(x) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates whose decoded bytes have the structure of a secret."""
    found = {(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])}
    if "PRIVATE KEY-----" in text:
        found |= {(m.start(), 4, m.end()) for m in PEM.finditer(text) if (data := _decode64(_SPLIT.sub("", m[2]))) and is_key(data)}
    for m in RUN.finditer(text):
        run = m[0]
        if _HEX_RUN.fullmatch(run):
            data = bytes.fromhex(run) if len(run) % 2 == 0 else None
        else:
            data = _decode64(run)
        if data and is_key(data):
            found.add((m.start(), 5, m.end()))
    runs, around, furthest = None, sorted(found), -1
    k = 0
    for m in START.finditer(text):
        runs = runs or _Runs(text)
        start = m.start()
        while k < len(around) and around[k][0] <= start:
            furthest = max(furthest, around[k][2])
            k += 1
        if (end := runs.key_from(start)) and end > furthest:  # not inside of another span
            found.add((start, 5, end))
            furthest = end
    for m in _HEX_KEY.finditer(text):
        if len(m[1]) % 2 == 0 and is_key(bytes.fromhex(m[1])):
            found.add((m.start(1), 5, m.end()))
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_text(text: str | None) -> tuple:
    base = base_spans(text) if text else []
    spans = sorted(base + confirmed_spans(text)) if text else []
    count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return (*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [(KINDS[k], s, e) for s, k, e in spans])


def scan(docs: DataFrame) -> DataFrame:
    """Per row of `docs(doc_id, text)`: n_assign, n_access, n_hex, base_sha256, spans, and `found`, the
    spans as ARRAY<STRUCT<kind, start, end>> in code points.

    A null text counts as empty: no spans and the digest of an empty string. Rows keep null and
    repeated ids; other columns are left out. Narrow: one Arrow pass over the whole texts.
    """
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([(n, pa.int64() if n.startswith("n_") else pa.string()) for n in names] + [("found", pa.list_(span))])
    as_row = lambda found: dict(zip(names, found)) | {"found": [dict(zip(("kind", "start", "end"), x)) for x in found[-1]]}
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"
    scanned = text_udf(lambda texts: [as_row(scan_text(t)) for t in texts], schema, kind)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scanned(F.col("text").cast("string")).alias("_s")).select("doc_id", "_s.*")


def redact_text(text: str | None, mask: str = "[SECRET]") -> str | None:
    if not text:
        return text
    spans = sorted(base_spans(text) + confirmed_spans(text))
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every span in text replaced by `mask` (overlapping spans by one); n_chars follows where it is a column.

    Null and empty texts, null and repeated ids and all other columns stay as they are.
    """

    masked = text_udf(lambda texts: [redact_text(t, mask) for t in texts], "string", pa.string())
    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
