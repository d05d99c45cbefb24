"""Secrets in texts: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton over all keywords reads the lower-cased bytes once;
a pattern is only tried at the place of a hit. Hex runs have no keyword: every
32nd byte is probed (a run of 32 covers one) and runs grow from the probes.
Tokens that embed a checksum (the base-62 CRC-32 at the end of ``ghp_`` and
``npm_`` style tokens) count only if it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, slices

# Kinds in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "github", "npm"]
BASE_KINDS = 3
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github",
    "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST = {"assign": 8, "access": 16, "hex": 32}
REPLACEMENT = "[secret]"


class Span(NamedTuple):
    start: int
    end: int
    kind: int


def _automaton():
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_HEX_RUN = re.compile(rb"[0-9a-f]+")


def checksum62(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body), []
    for _ in range(6):
        n, digit = divmod(n, 62)
        out.append(BASE62[digit])
    return bytes(reversed(out))


def _accept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= LEAST[kind]
    if kind == "access":
        return len(m[0]) >= LEAST[kind]
    return checksum62(m[1]) == m[2]


def _hex_runs(data: bytes):
    """Maximal runs of 32 or more lower-case hex digits."""
    a = np.frombuffer(data, np.uint8)
    n, step = len(a), LEAST["hex"]
    if n < step:
        return
    probe = np.arange(step - 1, n, step)
    probe = probe[_HEX[a[probe]]]
    for d in (8, 16):  # a run that holds the probe reaches 16 on one side
        left, right = np.maximum(probe - d, 0), np.minimum(probe + d, n - 1)
        probe = probe[_HEX[a[left]] | _HEX[a[right]]]
    done = 0
    for p in probe.tolist():
        if p < done:
            continue
        start = p
        while start > done and _HEX[data[start - 1]]:
            start -= 1
        done = _HEX_RUN.match(data, start).end()
        if done - start >= step:
            yield start, done


def find(text: str) -> list[Span]:
    """All spans of a text in code points, by start, then by kind as listed."""
    data = text.encode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for last, (kind, size) in _AUTOMATON.iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(last - size + 1)
    found = [(s, e, KINDS.index("hex")) for s, e in _hex_runs(data)]
    for kind, starts in hits.items():
        pattern, free = PATTERNS[kind], 0
        for at in sorted(starts):
            if at >= free and (m := pattern.match(data, at)):
                free = m.end()
                if _accept(kind, m):
                    found.append((at, free, KINDS.index(kind)))
    found.sort(key=lambda x: (x[0], x[2]))
    if len(data) == len(text):
        return [Span(*x) for x in found]
    place, before, chars = {}, 0, 0
    for at in sorted({x for s, e, _ in found for x in (s, e)}):
        chars += len(data[before:at].decode("utf-8", "surrogatepass"))
        place[at], before = chars, at
    return [Span(place[s], place[e], k) for s, e, k in found]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with the union of its spans replaced."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at:s.start], REPLACEMENT]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns the columns ``keep`` (all of ``docs`` unless given) and n_assign,
    n_access, n_hex, base_sha256, spans, n_secrets and redacted (the text
    with spans replaced; null text stays null); names that ``docs`` has are
    prefixed by underscores. Null text has no spans; rows are independent,
    so nothing is shuffled.
    """
    keep = docs.columns if keep is None else keep
    (body,) = fresh(docs, "_body")
    names = fresh(docs.select(*keep), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_secrets", "redacted")
    types = ["bigint", "bigint", "bigint", "string", "string", "bigint", "string"]
    src = docs.select(*keep, docs[text].alias(body))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
                       + [f"`{n}` {t}" for n, t in zip(names, types, strict=True)])

    def run(batches):
        for b in slices(batches):
            rows = []
            for t in b.column(b.num_columns - 1).to_pylist():
                spans = find(t or "")
                base = [s for s in spans if s.kind < BASE_KINDS]
                kinds = [s.kind for s in base]
                rows.append((*map(kinds.count, range(BASE_KINDS)), hashlib.sha256(listed(base).encode()).hexdigest(),
                             listed(spans), len(spans), None if t is None else redacted(t, spans)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            made = [pa.array(list(c), pa.int64() if t == "bigint" else pa.string())
                    for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*keep, *names])

    return src.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, and ``size`` (if there is such a column) following it."""
    from pyspark.sql import functions as F
    found = scan(docs, text)
    new = found.columns[-1]
    count = found.columns[-2]
    out = {c: F.col(c) for c in docs.columns}
    out[text] = F.col(new)
    if size in docs.columns:
        kind = docs.schema[size].dataType
        out[size] = F.when(F.col(count) > 0, F.length(new).cast(kind)).otherwise(F.col(size))
    return found.select(*[v.alias(c) for c, v in out.items()])
