"""Encoding a corpus with a public byte-level BPE tokenizer, each distinct content-defined piece once.

Texts are cut by a rolling hash, so passages that documents share become equal pieces. Each distinct piece is encoded
once; documents are put together from the pieces' ids. A cut may fall inside a word, so every join is repaired: the
stretch around it is encoded again, from the last point before it to the first point after it at which the
pre-tokenizer splits in any context. From such a point on ids depend on the text to its right alone, so
left and right agree exactly with encoding the whole text.

Null and empty texts give an empty list. A row that comes twice gives one row; one doc_id with two texts gives a row
for each. Blank and very long texts are encoded like any other.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.cut import cut_positions

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern of this family of tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of these characters only, in the syntax of the standard library's faster matcher.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ‐-”…¿¡]*")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+").findall
#: Mean, least and largest length of a piece are about 2^BITS + LEAST, LEAST and MOST characters.
BITS, LEAST, MOST = 10, 256, 16384
CACHED_WORDS = 500_000


class Encoder(dict):
    """Ids of pre-tokens, kept as packed bytes, and of whole texts."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bytes_of = [b""] * self.size
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        #: Ids that begin with a blank and something visible, and ids that end in something visible: between
        #: one of the second and one of the first the pre-tokenizer splits in any context.
        self.opens = [len(x) > 1 and x[0] == 32 and 33 <= x[1] <= 126 for x in self.bytes_of]
        self.closes = [len(x) > 0 and 33 <= x[-1] <= 126 for x in self.bytes_of]

    def __missing__(self, word: str) -> bytes:
        ids = np.asarray(self.coder.encode_ordinary(word), dtype=self.type).tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, PLAIN_SPLIT(text)))
        return np.asarray(self.coder.encode_ordinary(text), dtype=self.type).tobytes()

    def join(self, pieces: list[bytes]) -> np.ndarray:
        """Ids of the text whose consecutive pieces have the given ids."""
        whole = np.frombuffer(pieces[0], dtype=self.type)
        done = []
        for piece in pieces[1:]:
            left, right = whole.tolist() if len(whole) < 64 else whole[-64:].tolist(), None
            shift = len(whole) - len(left)
            at = self._last_split(left)
            if at is None and shift:
                left, shift = whole.tolist(), 0
                at = self._last_split(left)
            if at is None and done:  # no split in all of it: take up what was put aside
                whole = np.concatenate([*done, whole])
                done, left, shift = [], whole.tolist(), 0
                at = self._last_split(left)
            at = at or 0
            right = np.frombuffer(piece, dtype=self.type)
            head = right[:64].tolist()
            to = self._first_split(head)
            if to is None:
                head = right.tolist()
                to = self._first_split(head)
            to = len(head) if to is None else to
            text = b"".join([self.bytes_of[i] for i in left[at:]] + [self.bytes_of[i] for i in head[:to]]).decode()
            again = np.frombuffer(self.encode(text), dtype=self.type)
            done.append(whole[: shift + at])
            whole = np.concatenate([again, right[to:]])
        return np.concatenate([*done, whole]) if done else whole

    def _last_split(self, ids: list[int]) -> int | None:
        for i in range(len(ids) - 1, 0, -1):
            if self.opens[ids[i]] and self.closes[ids[i - 1]]:
                return i
        return None

    def _first_split(self, ids: list[int]) -> int | None:
        for i in range(1, len(ids)):
            if self.opens[ids[i]] and self.closes[ids[i - 1]]:
                return i
        return None


@lru_cache(4)
def _encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def _pieces(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, seqs, hashes, texts, own = [], [], [], [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                if not text:
                    if not with_text:
                        docs.append(row), own.append(0), seqs.append(0), hashes.append(None)
                    continue
                if not with_text:
                    whole = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                at = 0
                for k, end in enumerate(cut_positions(text, bits=BITS, least=LEAST, most=MOST)):
                    piece = text[at:end]
                    at = end
                    hashes.append(xxhash.xxh3_128_digest(piece))
                    if with_text:
                        texts.append(piece)
                    else:
                        docs.append(row), own.append(whole), seqs.append(k)
            if with_text:  # a batch names each of its pieces once
                first = {h: t for h, t in zip(hashes, texts)}
                yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), pa.array(list(first.values()), pa.string())], ["piece", "text"])
            else:
                ids = batch["doc_id"].take(pa.array(docs, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int64()), pa.array(seqs, pa.int32()), pa.array(hashes, pa.binary())], ["doc_id", "own", "seq", "piece"])

    return cut


def encode_corpus(documents: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of a table with columns doc_id and text, without special tokens.

    ``vocabulary``: a file of ranks, read on the driver and broadcast (its size doesn't depend on the corpus).
    """
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["piece"], pa.array(ids, pa.binary())], ["piece", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            parts = batch["parts"]
            flat = parts.flatten()
            seq, ids = flat.field("seq").to_pylist(), flat.field("ids").to_pylist()
            at, out = 0, []
            for n in pc.list_value_length(parts).to_pylist():
                pieces = [x for _, x in sorted({s: x for s, x in zip(seq[at : at + n], ids[at : at + n]) if x is not None}.items())]
                at += n
                out.append(encoder.join(pieces).astype("<i4") if pieces else np.zeros(0, "<i4"))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype("<i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, "<i4")))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "ids"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    distinct = docs.select("text").mapInArrow(_pieces(True), "piece binary, text string").groupBy("piece").agg(F.first("text").alias("text"))
    encoded = distinct.mapInArrow(encode, "piece binary, ids binary")
    uses = docs.mapInArrow(_pieces(False), "doc_id long, own long, seq int, piece binary")
    parts = uses.join(encoded, "piece", "left").groupBy("doc_id", "own").agg(F.collect_list(F.struct("seq", "ids")).alias("parts"))
    return parts.select("doc_id", "parts").mapInArrow(assemble, "doc_id long, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the public 50k byte-level tokenizer, without special tokens: (doc_id, ids)."""
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
