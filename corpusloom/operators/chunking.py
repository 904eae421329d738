"""Content-defined chunks of texts, and fingerprints of texts and files.

A cut is where a shift-and-add hash of the last characters vanishes, moved to a structural boundary nearby. As the
hash looks back over a fixed number of characters only, all candidates of a document are found in one vectorised pass;
the walk from cut to cut then only searches a sorted list. Null and empty texts have no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.cut import code_points, rolling_hits

#: Where texts divide, the strongest first, and how far from a cut that is looked for.
BOUNDARIES = [re.compile(p) for p in (r"\n#{1,6}\s", r"\n\n", r"\ndef ", r"\nclass ", r"\nfunction ", r"\n\}\n", r"\n---+\n", r"\n")]
TOLERANCE = 128
FULL_HASH_UP_TO = 10 * 1024 * 1024
HEAD = 4096


def snapped(text: str, cut: int) -> int:
    """End of the first match, near the cut, of the strongest boundary that occurs there; the cut itself if none does."""
    low = max(0, cut - TOLERANCE)
    near = text[low : cut + TOLERANCE]
    for boundary in BOUNDARIES:
        if m := boundary.search(near):
            return low + m.end()
    return cut


def chunk_spans(text: str | None, least: int = 256, most: int = 4096, target: int = 1024) -> list[tuple[int, int]]:
    """(offset, length) of the chunks of a text, in code points. Needs ``least`` of at least the hash's width."""
    if not text:
        return []
    hits, spans, at = None, [], 0
    while len(text) - at > most:
        if hits is None:
            hits = rolling_hits(code_points(text), max(1, target.bit_length() - 1))
        k = int(np.searchsorted(hits, at + least))
        raw = int(hits[k]) + 1 if k < len(hits) and hits[k] < at + most else at + most
        cut = max(min(snapped(text, raw), at + most), at + least)
        spans.append((at, cut - at))
        at = cut
    return [*spans, (at, len(text) - at)] if at < len(text) else spans


def chunks(documents: DataFrame, key: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """(key, sequence, byte_offset, byte_length, fingerprint, content) of every chunk of every document."""
    kind = documents.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seq, offset, length, print_, content = [], [], [], [], [], []
            for row, t in enumerate(batch["_text"].to_pylist()):
                for k, (a, n) in enumerate(chunk_spans(t, **sizes)):
                    piece = t[a : a + n]
                    rows.append(row), seq.append(k), offset.append(a), length.append(n), content.append(piece), print_.append(xxhash.xxh64_hexdigest(piece))
            keys = batch["_key"].take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(print_, pa.string()), pa.array(content, pa.string())],
                [key, "sequence", "byte_offset", "byte_length", "fingerprint", "content"],
            )

    packed = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return packed.mapInArrow(cut, f"{key} {kind}, sequence long, byte_offset long, byte_length long, fingerprint string, content string")


def fingerprint(data: bytes | None) -> str | None:
    """xxh64 of the bytes; beyond 10 MiB of head, tail and length."""
    if data is None:
        return None
    if len(data) <= FULL_HASH_UP_TO:
        return xxhash.xxh64_hexdigest(data)
    return partial_fingerprint(data)


def partial_fingerprint(data: bytes) -> str:
    tail = data[-HEAD:] if len(data) > HEAD else b""
    return xxhash.xxh64_hexdigest(data[:HEAD] + tail + len(data).to_bytes(8, "little"))


def fingerprints(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, fingerprint, partial, head_hash) of a string or binary column; nulls give nulls."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch["_data"].to_pylist()
            columns = [[f(d) if d is not None else None for d in data] for f in (fingerprint, partial_fingerprint, lambda d: xxhash.xxh64_hexdigest(d[:HEAD]))]
            yield pa.RecordBatch.from_arrays([batch["_key"], *(pa.array(c, pa.string()) for c in columns)], [key, "fingerprint", "partial", "head_hash"])

    packed = rows.select(F.col(key).alias("_key"), F.col(content).cast("binary").alias("_data"))
    return packed.mapInArrow(run, f"{key} {kind}, fingerprint string, partial string, head_hash string")


def fold_to_long(value: int) -> int:
    """An integer of any width as a signed 64-bit one: unchanged in range, else the XOR of its 64-bit limbs."""
    if -(1 << 63) <= value < 1 << 63:
        return value
    folded, rest = 0, value if value >= 0 else value % (1 << value.bit_length() + 1)
    while rest:
        folded, rest = folded ^ (rest & ((1 << 64) - 1)), rest >> 64
    return folded - (1 << 64) if folded >= 1 << 63 else folded
