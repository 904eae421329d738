"""Evaluation items that leak into corpus documents, whole or in part.

Texts become sequences of folded words, each a 64-bit number. Every window of a document and of an item walks through the
CGK random embedding, which maps edit distance to Hamming distance: at each step it writes the word under its pointer, and a
random bit of that word says whether the pointer moves on. Sampled positions of the walk form a bucket key; several
independent walks and samples per window size are the repetitions that bring recall to its target. Windows that meet
an item's window in a bucket point to the item, and an exact alignment of its words with the document's decides.

Buckets alone don't give every pair, so runs of unaltered words do: if a document holds h words of an item in two
stretches, with a altered, then h / (a + 2) of them at least follow each other unaltered in both. The least such run that
an item's length allows is its seed length, and an item any of whose seeds a document holds is aligned with the whole
document, unless too few of its words occur there at all.

Documents are cut up and hashed once, however many items there are. The keys of up to ``block`` items are broadcast and looked up
in place, without a shuffle; those of more are a table, which the documents' keys are joined with after a filter of bounded
size has taken out nearly all that no item has, and only documents with a candidate are read again for the alignment. Both ways
give the same rows. An alignment takes bounded memory: of a document too long for one, only what lies around
two or more words in a row of the item is aligned, in pieces if need be.

Null, empty and blank texts hold nothing. An item of fewer than five words is only found whole. Rows that
come twice give one row in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.words import words
from corpusloom.functions.workspace import materialise

#: Window size in words, sampled positions of its walk, and repetitions.
SCHEMES = ((5, 9, 2), (10, 5, 6))
#: Words of a window that no item knows, at most, for each size.
STRANGERS = {5: 0, 10: 2}
#: Items whose keys are broadcast; those of more are joined. Bits of the filter that is broadcast then (16 MB).
BLOCK, FILTER_BITS = 4000, 1 << 27
#: Shortest item that is found in part, cells of an alignment at most.
IN_PART, ALIGNED = SCHEMES[0][0], 1 << 24
#: Share of an item's words that must be held, share of a stretch's words that may be altered.
HELD, ALTERED = 0.5, 0.1
MISMATCH = 2


def needed(n: int) -> tuple[int, int]:
    """Words of an item of ``n`` that a document holds at least where it leaks it, and how many of them in a row."""
    ways = [(t - int(ALTERED * t + 0.5), int(ALTERED * t + 0.5)) for t in range(-int(-HELD * n // 1), n + 1)]
    return min(held for held, _ in ways), min(-(-held // (altered + 2)) for held, altered in ways)


@lru_cache(1 << 18)
def _number(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1


def encoded(text: str | None) -> np.ndarray:
    """The numbers of a text's words; 0 is none of them."""
    found = words(text)
    return np.fromiter(map(_number, found), np.uint64, len(found))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def run_keys(text: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, a key of every run of so many words) for each length up to ``longest``."""
    key = np.zeros(len(text) + 1, np.uint64)
    for length in range(1, min(longest, len(text)) + 1):
        key = _mixed(key[:-1] * np.uint64(31) ^ text[length - 1 :])
        yield length, key ^ np.uint64(length)


class Walks:
    """Random bits and sampled positions of all repetitions."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.parts = []
        for size, sampled, repetitions in SCHEMES:
            for _ in range(repetitions):
                at = np.sort(rng.choice(2 * size, sampled, replace=False))
                factors = rng.integers(1, 2**63, sampled, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                self.parts.append((size, {int(p): f for p, f in zip(at, factors)}, *rng.integers(0, 2**63, 2, dtype=np.uint64)))

    def keys(self, size: int, windows: np.ndarray) -> Iterator[np.ndarray]:
        """A bucket key of every window (rows of word numbers) for each repetition of this window size."""
        return self.keys_at(size, windows.astype(np.uint64).ravel(), np.arange(len(windows)) * size)

    def keys_at(self, size: int, text: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The same for the windows that begin at some places of a text."""
        words_, end = np.append(text, np.uint64(0)), at + size
        none = len(text)
        for own, sampled, bits, salt in self.parts:
            if own != size:
                continue
            moves = _mixed(words_ + bits)  # the bit of each step says whether the pointer moves on from a word
            place, key = at.copy(), np.full(len(at), salt)
            for step in range(max(sampled) + 1):
                inside = np.where(place < end, place, none)
                if step in sampled:
                    key = _mixed(key ^ (words_[inside] + np.uint64(1)) * sampled[step])
                place += (moves[inside] >> np.uint64(step) & np.uint64(1)).astype(np.int64)
                np.minimum(place, end, out=place)
            yield key


def document_keys(text: np.ndarray, seeds: frozenset[int], walks: Walks) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(places, keys, whether of windows) of a text in which words that no item has are 0."""
    known = np.concatenate([[0], np.cumsum(text > 0)])
    for size, *_ in SCHEMES:
        at = np.flatnonzero(known[size:] - known[:-size] >= size - STRANGERS[size]) if len(text) >= size else np.zeros(0, np.int64)
        if len(at):
            for key in walks.keys_at(size, text, at):
                yield at, key, True
    for length, key in run_keys(text, max(seeds, default=0)):
        if length not in seeds:
            continue
        at = np.flatnonzero(known[length:] - known[:-length] == length)
        if len(at):
            yield at, key[at], False


def item_keys(item: np.ndarray, walks: Walks) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(places, keys, whether of windows) of an item: its windows, and its seeds (all of it if it is short)."""
    n = len(item)
    if n >= IN_PART:
        for size, *_ in SCHEMES:
            if n >= size:
                at = np.arange(n - size + 1)
                for key in walks.keys_at(size, item, at):
                    yield at, key, True
    longest = needed(n)[1] if n >= IN_PART else n
    for length, key in run_keys(item, longest):
        if length == longest:
            yield np.arange(len(key)), key, False


class Items:
    """Items with an index of their keys, looked up in place."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, texts = [i for i, _ in rows], [encoded(t) for _, t in rows]
        self.words, self.walks = texts, Walks()
        self.known = np.unique(np.concatenate([np.zeros(1, np.uint64), *texts]))
        keys, item, at, window = [], [], [], []
        for k, text in enumerate(texts):
            for places, key, of_window in item_keys(text, self.walks) if len(text) else ():
                keys.append(key), item.append(np.full(len(key), k, np.int32)), at.append(places), window.append(np.full(len(key), of_window))
        self.seeds = frozenset(needed(len(t))[1] if len(t) >= IN_PART else len(t) for t in texts)
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (item, np.int32), (at, np.int64), (window, bool))]
        order = np.argsort(joined[0], kind="stable")
        self.keys, self.item, self.at, self.window = (x[order] for x in joined)

    def candidates(self, text: np.ndarray) -> dict[int, tuple[int, int] | None]:
        """Items that meet the text in some key, with where windows that meet say it begins (first, last)."""
        out: dict[int, tuple[int, int] | None] = {}
        for places, key, of_window in document_keys(text, self.seeds, self.walks) if len(self.keys) else ():
            lo = np.searchsorted(self.keys, key, "left")
            met = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == key)
            if not len(met):
                continue
            places, lo = places[met], lo[met]
            n = np.searchsorted(self.keys, key[met], "right") - lo
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            begins = np.repeat(places, n) - self.at[entry]
            for k, start, window in zip(self.item[entry].tolist(), begins.tolist(), self.window[entry].tolist()):
                before = out.get(k)
                if window and of_window:
                    out[k] = (min(before[0], start), max(before[1], start)) if before else (start, start)
                else:
                    out.setdefault(k, None)
        return out


def aligned(item: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """The word pairs (item position, text position) of the best local alignment, in order."""
    n, m = len(item), len(text)
    if not n or not m:
        return []
    score = np.zeros((n + 1, m + 1), np.int32)
    ramp = MISMATCH * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.maximum(score[i - 1] - MISMATCH, 0)
        row[1:] = np.maximum(row[1:], score[i - 1, :-1] + np.where(text == item[i - 1], 1, -MISMATCH))
        score[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = (int(x) for x in np.unravel_index(np.argmax(score), score.shape))
    pairs = []
    while score[i, j] > 0:
        if text[j - 1] == item[i - 1] and score[i, j] == score[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif score[i, j] == score[i - 1, j - 1] - MISMATCH:
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - MISMATCH:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def alterations(pairs: list[tuple[int, int]]) -> list[int]:
    """Altered words between consecutive pairs of an alignment."""
    return [max(k - i, m - j) - 1 for (i, j), (k, m) in zip(pairs, pairs[1:])]


def holds(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether ``text`` holds enough of the item's words, in order, in one or two stretches with few altered."""
    def enough(held: int, altered: int) -> bool:
        return held + altered >= HELD * len(item) and altered <= ALTERED * (held + altered) + 0.5

    pairs = aligned(item, text)
    if not pairs:
        return False
    gaps = alterations(pairs)
    if enough(len(pairs), sum(gaps)) or gaps and enough(len(pairs), sum(gaps) - max(gaps)):
        return True  # one stretch, or two that lie so close that the alignment spans the gap
    (a, c), (b, d) = pairs[0], pairs[-1]
    for other in (aligned(item[:a], text[:c]), aligned(item[b + 1 :], text[d + 1 :])):
        if len(other) >= 3 and enough(len(pairs) + len(other), sum(gaps) + sum(alterations(other))):
            return True
    return False


def around(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of a long text, what lies within an item's length of two words in a row of the item; zeros stand for what is left out."""
    pair = lambda x: _mixed(x[:-1] * np.uint64(31) ^ x[1:])
    at = np.flatnonzero(np.isin(pair(text), pair(item)))
    if not len(at):
        return text[:0]
    n = len(item)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, np.maximum(at - n, 0), 1)
    np.add.at(edge, np.minimum(at + n + 2, len(text)), -1)
    kept = np.cumsum(edge)[:-1] > 0
    begins = np.flatnonzero(kept & ~np.concatenate([[False], kept[:-1]]))
    return np.insert(text[kept], np.repeat((np.cumsum(kept) - 1)[begins], n), np.uint64(0))


def leaked(item: np.ndarray, text: np.ndarray, begins: tuple[int, int] | None) -> bool:
    """Whether a text holds an item that meets it in a key; ``begins``: see :meth:`Items.candidates`."""
    n = len(item)
    if n < IN_PART:
        return len(text) >= n and bool((np.lib.stride_tricks.sliding_window_view(text, n) == item).all(1).any())
    present = np.isin(item, text)
    if present.sum() < needed(n)[0]:
        return False
    if begins:  # what lies around the windows that meet, where stray words mislead an alignment less
        near = text[max(0, begins[0] - n // 4) : begins[1] + n + n // 4]
        if n * len(near) <= ALIGNED and holds(item, near):
            return True
    if n * len(text) <= ALIGNED:
        return holds(item, text)
    text, step = around(item, text), max(4 * n, ALIGNED // n)
    return any(holds(item, text[a : a + step]) for a in range(0, len(text), step - 2 * n))


def _known_only(text: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(known[np.minimum(np.searchsorted(known, text), len(known) - 1)] == text, text, np.uint64(0))


def find_leaks(documents: DataFrame, items: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id): the documents that hold at least half of an item's words in one or two stretches.

    ``documents``: (doc_id, text); ``items``: (item_id, text). Up to ``block`` items are broadcast with their keys.
    """
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return (_in_place if known.count() <= block else _by_join)(docs, known)


def _in_place(docs: DataFrame, known: DataFrame) -> DataFrame:
    table = known.orderBy("item_id", "text").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist())))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Items(shared.value)
        for batch in batches:
            docs, out = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                coded = _known_only(encoded(text), held.known)
                for k, begins in held.candidates(coded).items():
                    if leaked(held.words[k], coded, begins):
                        docs.append(doc), out.append(held.ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.int64())], ["doc_id", "item_id"])

    return docs.mapInArrow(search, "doc_id long, item_id long").distinct()


def _by_join(docs: DataFrame, known: DataFrame) -> DataFrame:
    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks()
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                coded = encoded(text)
                for kind, part in [(1 if w else 0, (k, p)) for p, k, w in item_keys(coded, walks)] + [(2, (np.unique(coded), np.zeros(len(np.unique(coded)), np.int64)))] if len(coded) else []:
                    key, at = part
                    for column, values in zip(out, (key.view(np.int64), np.full(len(key), item), at, np.full(len(key), kind), np.full(len(key), needed(len(coded))[1] if len(coded) >= IN_PART else len(coded)))):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "item", "at", "kind", "seed"])

    items = materialise(known.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text"), "items")
    rows = materialise(items.select("item", "text").mapInArrow(item_rows, "key long, item long, at long, kind long, seed long"), "keys")
    keys = rows.where("kind < 2")
    vocabulary = np.sort(np.append(rows.where("kind = 2").select("key").distinct().toArrow()["key"].to_numpy().view(np.uint64), np.uint64(0)))  # bounded: the items' words, 8 bytes each
    bits = keys.select(F.pmod("key", F.lit(FILTER_BITS)).alias("b")).selectExpr("b div 64 as w", "shiftleft(1L, cast(b % 64 as int)) as m")
    words_of_bits = bits.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    filter_ = np.zeros(FILTER_BITS // 64, np.uint64)
    filter_[words_of_bits["w"].to_numpy()] = words_of_bits["m"].to_numpy().view(np.uint64)
    seeds = frozenset(r[0] for r in rows.select("seed").distinct().collect())  # a few lengths
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, filter_, seeds))

    def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, filter_, seeds = shared.value
        walks = Walks()
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                for places, key, of_window in document_keys(_known_only(encoded(text), vocabulary), seeds, walks):
                    bit = np.mod(key.view(np.int64), FILTER_BITS).astype(np.uint64)
                    maybe = (filter_[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) > 0
                    for column, values in zip(out, (key[maybe].view(np.int64), np.full(maybe.sum(), doc), places[maybe], np.full(maybe.sum(), int(of_window)))):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "doc_id", "place", "kind"])

    hits = docs.mapInArrow(document_rows, "key long, doc_id long, place long, kind long").join(keys.select("key", "kind", "item", "at"), ["key", "kind"])
    begin = F.when(F.col("kind") == 1, F.col("place") - F.col("at"))
    met = materialise(hits.groupBy("doc_id", "item").agg(F.min(begin).alias("first"), F.max(begin).alias("last")), "met")
    pairs = docs.join(met, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item").select("doc_id", "text", "item_id", "item_text", "first", "last")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [batch[c].to_pylist() for c in ("text", "item_text", "first", "last")]
            keep = []
            for text, item_text, first, last in zip(*told):
                item = encoded(item_text)
                keep.append(leaked(item, _known_only(encoded(text), np.unique(np.append(item, np.uint64(0)))), None if first is None else (first, last)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].filter(mask), batch["item_id"].filter(mask)], ["doc_id", "item_id"])

    return pairs.mapInArrow(verify, "doc_id long, item_id long").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items they leak: (doc_id, item_id)."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))
