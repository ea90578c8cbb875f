"""Secret scans: patterns, and candidates confirmed by decoding and parsing their structure.

Long base64 (either alphabet) and hex runs (either case), runs wrapped over lines
and armoured blocks are reported only if they decode to a key: a DER sequence whose
nested lengths add up and whose parts are those of a private or public key, an
OpenSSH key whose length-prefixed fields fill it, or an armoured block whose headers
tell how it is encrypted.  Any three base64url parts are a signed token if the
first is a JSON object that names an algorithm and the second a JSON object.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldloom.llm.textbatch import byte_table, pieces, runs, text_values

BASE_KINDS = ("assign", "access", "hex")
#: In order of listing: the patterns' kinds, then the confirmed structures'.
KINDS = (*BASE_KINDS, "der_key", "ssh_key", "jwt")

#: Fixed patterns and least lengths.
_ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_KEYWORDS = re.compile(rb"(?i:passw|secret|token|api_?key)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_MIN_ASSIGNED, _MIN_ACCESS, _MIN_HEX = 12, 18, 16

_HEX = byte_table((0x30, 0x39), (0x61, 0x66))
_ANY_HEX = byte_table((0x30, 0x39), (0x41, 0x46), (0x61, 0x66))
_CODE = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x5F, 0x5F), (0x2E, 0x2E), (0x3D, 0x3D))
#: Shorter candidates can't hold a key or a signed token.
MIN_CODE = 40
_DOTTED = re.compile(rb"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)++")
#: Of a run of either alphabet the whole, else what is of one alphabet.
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{38,}+={0,2}")
_ONE_ALPHABET = re.compile(rb"[A-Za-z0-9+/]{38,}+={0,2}|[A-Za-z0-9_-]{38,}+={0,2}")
#: A break between lines, which JSON writes as a backslash and a letter.
_BREAK = rb"(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*)"
_BREAKS = re.compile(_BREAK)
#: Lines of base64, of which the first is long enough for a key's header.
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}+(?:" + _BREAK + rb"[A-Za-z0-9+/]++={0,2})++")
#: An armoured block: header lines, an empty line, base64 lines.
_BLOCK = re.compile(rb"-----BEGIN [A-Z0-9 ]*KEY-----" + _BREAK + rb"++((?:[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+" + _BREAK + rb"++)*+)((?:[A-Za-z0-9+/]++={0,2}" + _BREAK + rb"++)++)-----END [A-Z0-9 ]*KEY-----")
_ENCRYPTED, _CIPHER = re.compile(rb"Proc-Type:[ \t]*4,[ \t]*ENCRYPTED"), re.compile(rb"DEK-Info:[ \t]*[A-Za-z0-9-]+,[ \t]*((?:[0-9A-Fa-f]{2}){8,16})(?![0-9A-Fa-f])")


def decoded(candidate: bytes) -> bytes | None:
    """The bytes of a base64 (either alphabet, with or without padding) candidate, white space ignored."""
    plain = b"".join(candidate.split()).rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + b"=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes, deep: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER items that fill ``data`` exactly; constructed ones are checked inside, too."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or deep > 16:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + size], "big"), at + size
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        content, at = data[at : at + length], at + length
        if tag & 0x20 and der_items(content, deep + 1) is None:
            return None
        items.append((tag, content))
    return items


def is_der_key(data: bytes) -> bool:
    """A sequence that is laid out as an RSA or EC private key, PKCS 8, or a public key with its algorithm."""
    outer = der_items(data) if len(data) >= 24 and data[0] == 0x30 else None
    if outer is None or len(outer) != 1:
        return False
    parts = der_items(outer[0][1]) or []
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02]:
        if len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):  # version and eight numbers
            return True
        if tags[:3] == [0x02, 0x30, 0x04]:  # version, algorithm, wrapped key
            return [t for t, _ in der_items(parts[1][1]) or []][:1] == [0x06]
        return tags[1:2] == [0x04] and parts[0][1] == b"\x01"  # EC: version 1, octets
    if tags == [0x30, 0x03]:
        return [t for t, _ in der_items(parts[0][1]) or []][:1] == [0x06] and parts[1][1][:1] == b"\x00"
    return False


def is_ssh_key(data: bytes) -> bool:
    """The OpenSSH private key layout, or a public key: length-prefixed fields that fill the data."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at, fields = len(magic), []
        for n in range(3):
            size = int.from_bytes(data[at : at + 4], "big")
            if at + 4 + size > len(data):
                return False
            fields.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        for _ in range(keys + 1):
            size = int.from_bytes(data[at : at + 4], "big")
            if at + 4 + size > len(data):
                return False
            at += 4 + size
        return 1 <= keys <= 16 and at == len(data)
    at, n = 0, 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if size == 0 or at + 4 + size > len(data):
            return False
        if n == 0 and not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", data[4 : 4 + size]):
            return False
        at, n = at + 4 + size, n + 1
    return n >= 2 and at == len(data)


def _json_object(part: bytes) -> dict | None:
    plain = decoded(part)
    if not plain or plain.lstrip(b" \t\r\n")[:1] != b"{":
        return None
    try:
        found = json.loads(plain)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(candidate: bytes) -> bool:
    """Three parts: a JSON header with an algorithm, a JSON object, a signature (which may be empty only for "none")."""
    parts = candidate.split(b".")
    if len(parts) != 3:
        return False
    header = _json_object(parts[0])
    if header is None or not isinstance(header.get("alg"), str) or _json_object(parts[1]) is None:
        return False
    return decoded(parts[2]) is not None if parts[2] else header["alg"].lower() == "none"


def signed_tokens(run: bytes) -> list[tuple[int, int]]:
    """(start, end) of the leftmost tokens that don't overlap, of any three parts beside each other."""
    out = []
    for m in _DOTTED.finditer(run):
        parts = m[0].split(b".")
        at, i = m.start(), 0
        while i + 2 < len(parts):
            end = at + len(parts[i]) + len(parts[i + 1]) + len(parts[i + 2]) + 2
            if is_signed_token(run[at:end]):
                out.append((at, end))
                at, i = end + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1
    return out


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def _armoured(headers: bytes, body: bytes) -> str | None:
    """The kind of an armoured block: of what it holds, or of an encrypted key that names its cipher and whose blocks are whole."""
    data = decoded(_BREAKS.sub(b"", body))
    if kind := _key_kind(data):
        return kind
    cipher = _CIPHER.search(headers)
    if data and cipher and _ENCRYPTED.search(headers) and len(data) % (len(cipher[1]) // 2) == 0:
        return "der_key"
    return None


def _wrapped_key(block: bytes) -> tuple[str, int] | None:
    """(kind, end) of a key that begins a block of lines; lines after the length that a DER header tells aren't part of it."""
    plain = _BREAKS.sub(b"", block)
    if kind := _key_kind(decoded(plain)):
        return kind, len(block)
    head = decoded(plain[:8])
    if not head or head[0] != 0x30:
        return None
    size = 2 + head[1] if head[1] < 0x80 else 3 + head[2] if head[1] == 0x81 else 4 + int.from_bytes(head[2:4], "big") if head[1] == 0x82 else 0
    signs = -(-size // 3) * 4
    if not size or signs >= len(plain) or not (kind := _key_kind(decoded(plain[:signs]))):
        return None
    at, left = 0, signs
    for m in [*_BREAKS.finditer(block), None]:
        line = (m.start() if m else len(block)) - at
        if left <= line:
            # a key ends with its line
            return (kind, at + left) if left == line else None
        left, at = left - line, m.end() if m else len(block)
    return None


def confirmed(text: bytes, code_runs: list[tuple[int, int]], hex_runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of the candidates whose structure holds; those inside a confirmed block aren't listed again.

    ``hex_runs`` are of either case.
    """
    found: list[tuple[str, int, int]] = []
    if b"KEY-----" in text:
        for m in _BLOCK.finditer(text):
            if kind := _armoured(m[1], m[2]):
                found.append((kind, *m.span()))
    if code_runs:
        blocks = [x[1:] for x in found]
        for m in _WRAPPED.finditer(text):
            if _outside(blocks, m.start()) and (key := _wrapped_key(m[0])):
                found.append((key[0], m.start(), m.start() + key[1]))
    blocks = sorted(x[1:] for x in found)
    for a, b in code_runs:
        if not _outside(blocks, a):
            continue
        run = text[a:b]
        found += [("jwt", a + x, a + y) for x, y in signed_tokens(run)]
        for m in _BASE64.finditer(run):
            if kind := _key_kind(decoded(m[0])):
                found.append((kind, a + m.start(), a + m.end()))
                continue
            for n in _ONE_ALPHABET.finditer(m[0]):
                if len(n[0]) < len(m[0]) and (kind := _key_kind(decoded(n[0]))):
                    found.append((kind, a + m.start() + n.start(), a + m.start() + n.end()))
    for a, b in hex_runs:
        if b - a >= 2 * 24 and _outside(blocks, a):
            if kind := _key_kind(bytes.fromhex(text[a : a + (b - a) // 2 * 2].decode())):
                found.append((kind, a, a + (b - a) // 2 * 2))
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _outside(blocks: list[tuple[int, int]], place: int) -> bool:
    """Whether a place is in none of the blocks, which are in order and don't overlap."""
    k = bisect.bisect_right(blocks, (place, 1 << 62)) - 1
    return k < 0 or place >= blocks[k][1]


def base_spans(text: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of the plain patterns, each kind leftmost and without overlaps; ``hex_runs`` are the long ones."""
    found = [("hex", a, b) for a, b in hex_runs]
    if _KEYWORDS.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _MIN_ASSIGNED]
    if b"AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _MIN_ACCESS]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _long_runs(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """For each row its runs of at least ``least`` bytes of the table, relative to the row."""
    starts, ends, _ = runs(table[data], offsets)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    for r, a, b in zip(rows.tolist(), (starts - offsets[rows]).tolist(), (ends - offsets[rows]).tolist()):
        out[r].append((a, b))
    return out


def find_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """For each text its spans in code points, by start, then kind as listed."""
    hexes, any_hexes, codes = _long_runs(_HEX, data, offsets, _MIN_HEX), _long_runs(_ANY_HEX, data, offsets, 2 * 24), _long_runs(_CODE, data, offsets, MIN_CODE)
    raw, at = data.tobytes(), offsets.tolist()
    out = []
    for n, (a, b) in enumerate(zip(at, at[1:])):
        text = raw[a:b]
        found = base_spans(text, hexes[n])
        if codes[n] or b"KEY-----" in text:
            found = sorted(found + confirmed(text, codes[n], any_hexes[n]), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
        if found and not text.isascii():
            before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            found = [(k, int(before[s]), int(before[e])) for k, s, e in found]
        out.append(found)
    return out


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with an array column ``out`` of (kind, start, end) in code points, end exclusive, by start, then kind.

    A null text counts as empty.  Whole texts are read; repeated rows give
    repeated results.  A column already called ``out`` is replaced.
    """
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.ArrayType(_SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                found = find_spans(*text_values(batch.column(batch.schema.get_field_index(text))))
                column = pa.array([[dict(zip(("kind", "start", "end"), x)) for x in spans] for spans in found], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), column], [*keep, out])

    return docs.select(*keep).mapInArrow(run, schema)


def secret_report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the plain patterns, a digest of their spans, and all spans as text.

    A null text counts as empty and has no spans; null ids stay; repeated rows
    give repeated rows, an empty table an empty one; of spans with one start and
    kind the shorter comes first; whole texts are read, however long; other
    columns, whatever their names, aren't read.
    """
    found = scan_secrets(docs.select("doc_id", "text"))
    spans = F.col("secrets")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or union of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with all secrets in ``text`` replaced by their kinds, and ``n_chars`` (where there is such a column) set anew in those rows.

    A null text stays null; repeated rows are changed alike; an empty table gives
    an empty one; whole texts are read; all other columns stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                where = batch.schema.get_field_index(text)
                found = find_spans(*text_values(batch.column(where)))
                if any(found):
                    texts = batch.column(where).to_pylist()
                    new = [redacted(t, s) if s else t for t, s in zip(texts, found)]
                    batch = batch.set_column(where, text, pa.array(new, batch.column(where).type))
                    if (at := batch.schema.get_field_index(n_chars)) >= 0:
                        sizes = [len(t) if s else n for t, s, n in zip(new, found, batch.column(at).to_pylist())]
                        batch = batch.set_column(at, n_chars, pa.array(sizes, batch.column(at).type))
                yield batch

    return docs.mapInArrow(run, docs.schema)
