"""Secret scan: fixed patterns and dictionary-primed zstandard novelty.

A candidate is a run of key-like characters shortly after a sensitive word. Its marginal
cost is what it adds to the compressed size of the code around it, by a compressor primed with
common identifiers: names and repeated values cost little, random keys about their own length.

One pass over the documents without a shuffle. Defined cases: a null or empty text has no spans;
repeated rows give equal rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Words by which a sensitive context is known.
SENSITIVE = re.compile(rb"passw|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|credential|bearer|signature")
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
#: Characters of a candidate at least.
LEAST = 16
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")
# Identifiers that code often has; they prime the compressor.
IDENTIFIERS = """access_key access_token account api_key api_secret application authorization bearer certificate
client_id client_secret config connection_string credentials database default description development document
endpoint environment example hostname identifier localhost password postgresql private_key production public_key
redirect_uri refresh_token repository request response secret_access_key session_id signature staging subscription
test_user token_type undefined username version webhook ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz
0123456789 xxxxxxxxxxxxxxxx 0000000000000000 your_api_key_here changeme placeholder"""
#: Bytes after a sensitive word in which candidates start, and bytes of code around them.
REACH, AROUND = 64, 512
#: Marginal compressed bytes per byte of an incompressible candidate.
NOVEL = 0.75

_HEX = np.zeros(256, dtype=bool)
_HEX[48:58] = _HEX[97:103] = True


class Novelty:
    """Marginal compressed size of a string after its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 9) -> None:
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False)

    def marginal(self, around: bytes, candidate: bytes) -> int:
        return len(self.codec.compress(around + candidate)) - len(self.codec.compress(around))


def _hex_runs(raw: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    starts, ends, first = tx.spans(raw, at, _HEX)
    long = np.flatnonzero(ends - starts >= MIN_HEX)
    out: dict[int, list[tuple[int, int]]] = {}
    for i, d in zip(long.tolist(), (np.searchsorted(first, long, "right") - 1).tolist(), strict=True):
        out.setdefault(d, []).append((int(starts[i] - at[d]), int(ends[i] - at[d])))
    return out


def _novel(text: bytes, low: bytes, novelty: Novelty, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Incompressible candidates in a sensitive context that no base span has.

    Sensitive words and runs of key-like characters are each found in one pass. A run is a candidate if a
    word ends shortly before it; if it is none or has nothing new, then what follows the last word within it.
    """
    words = [m.end() for m in SENSITIVE.finditer(low)]
    if not words:
        return []
    known = _merged(known)
    known_ends = [hi for _, hi in known]
    out: list[tuple[int, int]] = []
    for run in RUN.finditer(text, max(0, words[0] - 1)):
        lo, hi = run.span()
        before, within = bisect_right(words, lo), bisect_right(words, hi - LEAST)
        starts = [lo] if before and words[before - 1] >= lo - REACH else []
        starts += [words[within - 1]] if within > before else []
        for at in starts:
            base, value = bisect_right(known_ends, at), text[at:hi]
            if base < len(known) and known[base][0] < hi or not (_DIGIT.search(value) and _LETTER.search(value)):
                continue
            if novelty.marginal(text[max(0, at - AROUND) : at] + text[hi : hi + AROUND], value) >= NOVEL * len(value):
                out.append((at, hi))
                break
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def find(text: bytes, hexes: list[tuple[int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, in bytes and in order."""
    low = text.lower()
    out = [(lo, 2, hi) for lo, hi in hexes]
    if any(w in low for w in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(lo, 3, hi) for lo, hi in _novel(text, low, novelty, [(lo, hi) for lo, _, hi in out])]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for batch in batches:
        raw, at = tx.utf8(batch.column("text"))
        found: list[list[tuple[int, int, int]]] = []
        for lo, hi in tx.slices(at):
            part, own = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            hexes, whole = _hex_runs(part, own), part.tobytes()
            for i in range(hi - lo):
                spans = find(whole[own[i] : own[i + 1]], hexes.get(i, []), novelty)
                if spans:
                    points = tx.code_points(part[own[i] : own[i + 1]])
                    spans = [(int(points[a]), kind, int(points[b])) for a, kind, b in spans]
                found.append(spans)
        said = [[f"{KINDS[k]}:{a}:{b}" for a, k, b in spans] for spans in found]
        counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in found], pa.int64()) for kind in range(3)]
        base = [",".join(s for s, (_, k, _) in zip(x, spans, strict=True) if k < 3) for x, spans in zip(said, found, strict=True)]
        columns = [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([",".join(x) for x in said], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, their digest, and all spans in code points."""
    tx.small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
