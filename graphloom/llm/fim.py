"""Fill-in-the-middle transformation by repeated-capture matching.

A text is units: leading white space and a run of other characters, or white space at the end. One
full match of ``(unit)*`` keeps every repetition of its group, so the ends of the group are all unit
boundaries at once: their number is n, and the two cuts are looked up among them. A match holds about
100 bytes a unit; texts of more than ``PART`` code points are matched in parts that end where a unit
does, which gives the same boundaries in bounded memory.

Where to cut, whether to cut and the order of the parts come from a hash of a seed and the id, so a
run on other partitions or a retried task gives the same rows.

Defined cases: a null text is an empty one; an empty text and one that holds a marker stay plain; a
null id hashes as an empty one; rows that repeat an id share its draws; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import text as tx

SPACE = r"\x20\x09-\x0D"
UNITS = regex.compile(rf"([{SPACE}]*[^{SPACE}]+|[{SPACE}]+)*")
#: A unit ends between a character that is not white space and one that is.
BOUNDARY = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and percent of these with the suffix first.
CUT_PERCENT, SPM_PERCENT = 50, 80
SEED = 42
#: Code points that one match covers, about.
PART = 1 << 18
#: Code points of the texts that one batch of results holds, about; a longer text is a batch of its own.
BATCH = 1 << 22


def unit_ends(text: str, part: int = PART) -> np.ndarray:
    """Where each unit ends, in code points."""
    ends, at = [], 0
    while at < len(text):
        edge = BOUNDARY.search(text, at + part) if at + part < len(text) else None
        upto = edge.start() if edge else len(text)
        ends.append(np.array(UNITS.fullmatch(text, at, upto).ends(1), dtype=np.int64))
        at = upto
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str | None, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    text = text or ""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= cut_percent:
        return n, "plain", None, None, text
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_percent:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text again, from an output and its form alone."""
    if form == "plain":
        return output
    outer, inner = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, middle = output.removeprefix(outer).split(MIDDLE)
    first, second = head.split(inner)
    return second + middle + first if form == "spm" else first + middle + second


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _run(settings: tuple[int, int, int]):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k).cast(pa.string()) if k == pa.large_string() else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):  # one text at a time is a Python string
                doc_id = doc_id.as_py()
                rows.append((doc_id, *transform(doc_id, text.as_py(), *settings)))
                size += len(rows[-1][-1])
                if size > BATCH:
                    yield flush(rows)
                    rows, size = [], 0
            yield flush(rows)
        tx.release()

    return run


def fill_in_middle(docs: DataFrame, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document; no shuffle."""
    tx.small_batches(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_run((cut_percent, spm_percent, seed)), SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """The same with digests of the output and of the text restored from it instead of the output."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *columns, output in zip(*batch.columns, strict=True):
                doc_id, n, form, prefix, middle = (c.as_py() for c in columns)
                output = output.as_py()
                rows.append((doc_id, n, form, prefix, middle, *(hashlib.sha256(t.encode()).hexdigest() for t in (output, restore(output, form)))))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return fill_in_middle(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
