"""Token counts by section (operator 5).

A document is encoded once, whole; the character spans of its tokens are
joined to the spans of its sections by position (both sorted), so no section
is encoded alone and the counts add up to the document's. A section is a line
with its line break; the last may lack one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Encoder, worker_encoder
from .textbuf import Slice, text_batches


def token_spans(enc: Encoder, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character start and end of every token within the slice, and each row's
    first token. A token that holds part of a character spans it whole."""
    ids, first = enc.encode(s)
    _, ends = enc.token_bytes(ids)
    char = np.cumsum((s.data & 0xC0) != 0x80)
    return char[ends[:-1]] - 1, char[ends[1:] - 1], first


def section_spans(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Character starts of the sections of a slice with the end of all, and
    each row's first section. An empty row has one section of no characters."""
    char = np.r_[0, np.cumsum((s.data & 0xC0) != 0x80)]
    brk = np.flatnonzero(s.data == 10) + 1
    brk = brk[~np.isin(brk, s.offsets)]
    both = np.concatenate([s.offsets[:-1], brk])
    by = np.argsort(both, kind="stable")
    start = both[by]
    row_first = np.flatnonzero(by < len(s))
    return char[np.r_[start, len(s.data)]], np.r_[row_first, len(start)]


def allocate(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The section that gets each token [a, b): the one with most of its
    characters; of equal ones the first."""
    lo = np.searchsorted(bounds[:-1], a, "right") - 1
    hi = np.searchsorted(bounds[:-1], b - 1, "right") - 1
    best = lo.copy()
    cross = np.flatnonzero(hi > lo)
    most = np.minimum(b[cross], bounds[lo[cross] + 1]) - a[cross]
    k = 1
    while len(cross):
        own = lo[cross] + k
        got = np.minimum(b[cross], bounds[own + 1]) - np.maximum(a[cross], bounds[own])
        better = got > most
        best[cross[better]] = own[better]
        most = np.maximum(most, got)
        more = hi[cross] > own
        cross, most, k = cross[more], most[more], k + 1
    return best


def section_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document and section: doc_id, section (from 0), char_start, char_end,
    n_tokens, n_crossing (tokens it holds that reach into other sections).

    A null or empty text has one section of no characters and no tokens. Rows
    are independent (repeated and null doc_ids stay); columns other than doc_id
    and text are ignored; an empty table gives no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = worker_encoder(path)
        for batch, s in text_batches(batches):
            a, b, _ = token_spans(enc, s)
            bounds, first = section_spans(s)
            n = len(bounds) - 1
            got = allocate(a, b, bounds)
            crossing = (a < bounds[got]) | (b > bounds[got + 1])
            row = np.repeat(np.arange(len(s)), np.diff(first))
            base = bounds[first[:-1]][row]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row + s.start)), pa.array((np.arange(n) - first[:-1][row]).astype(np.int32)),
                 pa.array(bounds[:-1] - base), pa.array(bounds[1:] - base), pa.array(np.bincount(got, minlength=n)),
                 pa.array(np.bincount(got[crossing], minlength=n))],
                names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, section int, char_start long, char_end long, n_tokens long, n_crossing long")
