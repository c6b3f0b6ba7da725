"""Secret scanning: keyword prefilter, anchored expressions, checksum validation.

An Aho-Corasick automaton finds keywords; expressions are tried only where a
keyword begins.  Every match of a base kind begins with a keyword (or, for hex
runs, is found by one scan for long runs), so the prefilter loses none.  Kinds
with an embedded checksum count only if the checksum holds.

Rows are independent: one pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_columns

#: Kinds in the order in which spans that start together are listed; the first
#: three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Tokens with 30 random characters and a checksum of 6.
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Keyword to kind, in lower case.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}

_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
_UPPER = {ord(c): c.lower() for c in string.ascii_uppercase}


def checksum62(payload: str) -> str:
    """CRC-32 of the payload in base 62, six digits."""
    n, out = zlib.crc32(payload.encode("ascii")), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def valid_checksum(token: str) -> bool:
    """Whether the last six characters are the checksum of the 30 before them."""
    return checksum62(token[-36:-6]) == token[-6:]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


_found = _automaton()


def _folded(text: str) -> str:
    """The text with A-Z lower-cased and every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_UPPER)


def scan(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets, by start and then kind as listed."""
    out: list[tuple[int, str, int]] = []
    after = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in _found.iter(_folded(text)))
    for start, kind in hits:
        if start < after[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            ok = m and len(m[2]) >= ASSIGN_LEAST
        elif kind == "access":
            m = ACCESS.match(text, start)
            ok = m and m.end() - m.start() >= ACCESS_LEAST
        else:
            m = (GITHUB if kind == "github" else NPM).match(text, start)
            ok = m and valid_checksum(m[0])
        if m:
            after[kind] = m.end()  # a match too short to count still takes its characters
        if ok:
            out.append((start, kind, m.end()))
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Offsets are code points, ends exclusive.  A null or empty text has no
    spans; long texts are scanned whole.  Spans of different kinds may overlap;
    those of one kind never do.  Repeated rows and null ids are scanned like
    any other row; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = {k: [] for k in KINDS[:3]}, [], []
            for text in batch.column("text").to_pylist():
                found = scan(text or "")
                base = [x for x in found if x[1] in counts]
                for k in counts:
                    counts[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return text_columns(docs, id_col, text_col).mapInArrow(run, schema)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every secret, or run of overlapping ones, replaced."""
    out, at = [], 0
    for start, _, end in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
