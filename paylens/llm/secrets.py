"""Secret scans with structural confirmation.

Three patterns give the base spans: assignments to a name of a secret, access
key ids, and runs of hexadecimal digits. Beyond them, runs of base64 or
hexadecimal digits are decoded, and reported only where their structure tells
what they are:

- ``jwt``: a signed token, three parts whose first is a JSON object with an
  algorithm, whose second is a JSON object, and whose signature is there (or
  the algorithm is none);
- ``key``: a private key, DER-encoded with nested lengths that fit to the byte
  (PKCS#1, DSA, PKCS#8 plain or encrypted, SEC1), or in the length-prefixed
  fields of an OpenSSH key; as a run of hexadecimal digits, anywhere in a run
  of base64 (OpenSSH keys: at its end), or in the lines of a PEM block, whose
  line ends may be escaped, and which may be in base64 as a whole. A PEM block
  whose header lines say that it is encrypted has to hold whole cipher blocks.

A token's header begins with its brace. Not reported are keys nested deeper
than MAX_DEPTH (a parameter of the module; no known form is), OpenSSH files of
more than MAX_KEYS keys, and base64 of fewer than 40 characters outside PEM
blocks, which holds no key of 30 bytes. Each row is scanned by itself and whole,
so repeated rows have equal spans and very long texts all of theirs; where spans
of several kinds begin at one place, they come in the order of the kinds, then
of their ends. A table without rows gives none.

Spans are in code points, end exclusive. Null is an empty text, without spans.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_rows, map_texts, prepare
from paylens.llm.decontaminate import merged

#: The kinds in order; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "key")
PLACEHOLDER = "[REDACTED]"
#: DER is nested no deeper than this in a key.
MAX_DEPTH = 32
#: Keys in one OpenSSH file.
MAX_KEYS = 1024

# The patterns of the base. Shorter matches are those that would be dropped.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_LEAST = 8
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: "e" and one of these is how an object's brace and a quote or white space begin in base64.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)*)-----END \1-----", re.S)
_ESCAPED_LINE_END = re.compile(r"\\+[nr]")
_PEM_HEADER = re.compile(r"(?m)^[A-Za-z0-9-]+:.*$")
_PEM_ENCRYPTED = re.compile(r"(?m)^Proc-Type: *4, *ENCRYPTED\s*$")
_PEM_CIPHER = re.compile(r"(?m)^DEK-Info: *[A-Z0-9-]+, *((?:[0-9A-Fa-f]{2})+)\s*$")


def decoded_base64(run: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not; None if it is none."""
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the DER elements that fill data from at to end exactly."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + width], "big")
            if size < 128:
                return None
            at += width
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _nested(data: bytes, tag: int, begin: int, end: int, depth: int = 0) -> bool:
    """Whether all constructed elements inside fill their lengths."""
    if not tag & 0x20:
        return True
    inner = _elements(data, begin, end) if depth < MAX_DEPTH else None
    return inner is not None and all(_nested(data, *e, depth + 1) for e in inner)


def is_der_key(data: bytes) -> bool:
    outer = _elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1 or not _nested(data, *outer[0]):
        return False
    parts = _elements(data, *outer[0][1:]) or []
    tags = [t for t, _, _ in parts]
    small = tags[:1] == [2] and data[parts[0][1] : parts[0][2]] in (b"\x00", b"\x01")
    if small and len(tags) >= 9 and set(tags[:9]) == {2}:
        return True  # PKCS#1
    if small and tags == [2] * 6:
        return True  # DSA
    if small and tags[1:3] == [0x30, 4]:
        return (_elements(data, *parts[1][1:]) or [(0,)])[0][0] == 6  # PKCS#8
    if small and tags[1:2] == [4] and parts[1][2] - parts[1][1] >= 16:
        return all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC1
    if tags == [0x30, 4]:
        kind = _elements(data, *parts[0][1:]) or []
        return len(kind) == 2 and kind[0][0] == 6 and kind[1][0] == 0x30  # encrypted PKCS#8
    return False


_OPENSSH = b"openssh-key-v1\x00"


#: Where a SEQUENCE, an OpenSSH key or a PEM block may begin in base64.
_BASE64_STARTS = re.compile(r"M(?=[A-P])|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi")


def is_openssh_key(data: bytes) -> bool:
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)

    def field(at: int) -> tuple[bytes | None, int]:
        size = int.from_bytes(data[at : at + 4], "big")
        end = at + 4 + size
        return (data[at + 4 : end], end) if at + 4 <= len(data) and end <= len(data) else (None, at)

    for _ in range(3):  # cipher, key derivation, its options
        value, at = field(at)
        if value is None:
            return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= MAX_KEYS:
        return False
    for _ in range(keys + 1):  # public keys, then the private part
        value, at = field(at)
        if value is None:
            return False
    return at == len(data)


def _der_end(head: bytes) -> int | None:
    """Where a SEQUENCE ends that may be a key, by its first bytes."""
    if len(head) < 9 or head[0] != 0x30:
        return None
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4 or head[1] == 0x80:
        return None
    begin = 2 + width
    if head[begin] not in (2, 0x30):
        return None
    return begin + (int.from_bytes(head[2:begin], "big") if width else head[1])


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_openssh_key(data))


def _object(part: str) -> dict | None:
    data = decoded_base64(part)
    if data is None:
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    head = _object(header)
    if head is None or not isinstance(head.get("alg"), str) or _object(payload) is None:
        return False
    return head["alg"].lower() == "none" or bool(signature and decoded_base64(signature))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(name in low for name in _ASSIGN_NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded structure is that of a token or key; within one that is reported, no other."""
    out: list[tuple[str, int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= c or a >= d for _, c, d in out)

    if "ey" in text or "ew" in text:
        out += [("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())]
    out += [("key", a, b) for a, b in _pem_spans(text)]
    for m in _BASE64_RUN.finditer(text):
        out += [("key", a, b) for x, y in _base64_spans(m[0]) if free(a := m.start() + x, b := m.start() + y)]
    for m in _HEX_RUN.finditer(text):
        if m[0][:2] in ("30", "6f", "6F") and is_key(bytes.fromhex(m[0])) and free(*m.span()):
            out.append(("key", *m.span()))
    return out


def _pem_spans(text: str) -> list[tuple[int, int]]:
    if "PRIVATE KEY-----" not in text:
        return []

    def holds_key(body: str) -> bool:
        lines = _ESCAPED_LINE_END.sub("\n", body)
        data = decoded_base64("".join(_PEM_HEADER.sub("", lines).split()))
        if not _PEM_ENCRYPTED.search(lines):
            return is_key(data)
        # Of an encrypted key only whole blocks can be told; a block is as long as the start value, which AES has 16 bytes of.
        start = _PEM_CIPHER.search(lines)
        return bool(start and data) and len(start[1]) in (16, 32) and len(data) % (len(start[1]) // 2) == 0

    return [m.span() for m in _PEM.finditer(text) if holds_key(m[2])]


def _base64_spans(run: str) -> list[tuple[int, int]]:
    """Keys that begin anywhere in a run of base64."""
    bare = run.rstrip("=")
    out, free_from = [], 0
    blocks: set[int] = set()
    decoded: dict[int, tuple[int, bytes]] = {}

    def rest(at: int) -> bytes:
        """What follows, decoded once for each place in four."""
        if at % 4 not in decoded:
            decoded[at % 4] = at, decoded_base64(bare[at : len(bare) - ((len(bare) - at) % 4 == 1)]) or b""
        first, data = decoded[at % 4]
        return data[(at - first) // 4 * 3 :]

    def add(at: int, size: int) -> None:
        nonlocal free_from
        free_from = at + (size * 4 + 2) // 3
        out.append((at, len(run) if free_from == len(bare) else free_from))

    for m in _BASE64_STARTS.finditer(bare):
        at = m.start()
        if at < free_from:
            continue
        if m[0] == "M":
            size = _der_end(decoded_base64(bare[at : at + 12]) or b"")
            end = at + ((size or 0) * 4 + 2) // 3
            if size and end <= len(bare) and is_der_key((decoded_base64(bare[at:end]) or b"")[:size]):
                add(at, size)
        elif m[0][0] == "b":
            data = rest(at)
            if is_openssh_key(data):
                add(at, len(data))
        elif at % 4 not in blocks:
            blocks.add(at % 4)
            data = rest(at)
            for a, b in _pem_spans(data.decode("latin-1")):
                # Blanks at the end belong to the block.
                add(at, len(data) if not data[b:].strip() else b)
                out[-1] = (at + a * 4 // 3, out[-1][1])
    return out


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed, then end."""
    found = base_spans(text) + confirmed_spans(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str) -> str:
    """The text with each stretch of spans replaced; again until nothing is found."""
    while True:
        spans = [(a, b) for _, a, b in spans_of(text)]
        if not spans:
            return text
        out, at = [], 0
        for a, b in merged(spans):
            out += [text[at:a], PLACEHOLDER]
            at = b
        text = "".join(out) + text[at:]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its spans as structs of kind, start and end."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            found = [spans_of(t or "") for t in batch.column(1).to_pylist()]
            yield {
                "doc_id": batch.column(0),
                "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found],
            }

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(chosen, "doc_id long, spans array<struct<kind:string,start:long,end:long>>", rows)


def without_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All documents, secrets replaced by a placeholder; ``length_col`` is set anew where a text changed."""
    prepare(docs.sparkSession)

    def change(texts: list) -> tuple[list, list]:
        return [t if t is None else redacted(t) for t in texts], [True] * len(texts)

    return map_texts(docs, text_col, change, length_col)


def digest(found: DataFrame) -> DataFrame:
    """What the query returns of ``secrets``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
