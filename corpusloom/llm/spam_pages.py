"""Pages of stuffed keywords, link lists or tags instead of sentences.

A text is cut into lines, and lines into sentences where they end like one. Each piece is reduced to a shape: how many
words it has, whether it begins with a capital and ends like a sentence, its separators, its links, how much of it
reads on as texts of the corpus do, and how much of it are words that the page keeps coming back to. Nothing is listed by
language. What reads on is counted over the whole corpus first: two words follow each other like in a sentence if that
pair is common and makes up a good part of all uses of the rarer of them ("the lantern", "of the"), which keywords put next to
each other aren't. A piece whose words the corpus hardly knows (a language it has little of) isn't judged by that.

Which shapes are sentences is learned, too. Some are certain: what consists of links or separators, or doesn't read on at
all, is no sentence, nor are words that the page keeps coming back to where they don't read on; what reads on, with few separators and without the page's returning words, is one. Every other shape is
what it goes with: the share of non-sentence text among the certain text of the pages that have it, in rounds until no
shape changes its kind. A page is flagged if most of its text lies in shapes that are not sentences and a few such shapes
make up nearly all of that, as a generator's or a list's do; a page of many different fragments is not.

Pieces that a page repeats three times or more (a refrain, a form's line) are no sign of stuffing by themselves. Tags and JSON syntax are
taken off first; link targets count as links, not as words. Null, empty and blank texts are never flagged. Rows that
come twice give one row; whole texts are read, of any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.workspace import materialise

IDEOGRAPH = "぀-ヿ㐀-鿿"
LINK = re.compile(r"(?:https?://|www\.)\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+/\S*", re.IGNORECASE)
ANCHOR = re.compile(r"<a\b[^<>]*?href\s*=\s*[\"']?([^\"' >]*)[^<>]*>", re.IGNORECASE)
BLOCK_TAG = re.compile(r"</?(?:p|div|li|ul|ol|br|h\d|tr|td|th|table|body|html|section|article)\b[^<>]*>", re.IGNORECASE)
TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
JSON_KEY = re.compile(r"[\[{,]*\s*[{,]?\s*\"[A-Za-z_]{1,20}\"\s*:\s*\"(?:user|assistant|system|human|tool)?")
#: A speaker at the head of a line belongs to the transcript, not to what was said.
SPEAKER = re.compile(r"(?:^\W{0,4}(?:[\w-]{1,36}[,;\t])?|\*\*)(?:user|assistant|human|system|tool|q|a)(?:\W{0,2}:|[,;\t])\W{0,4}", re.IGNORECASE | re.MULTILINE)
LINE_OF_SPEAKER = re.compile(r"\n(?=\W{0,4}(?:[\w-]{1,36}[,;\t])?(?:user|assistant|human|system|tool|q|a)(?:\W{0,2}:|[,;\t]))", re.IGNORECASE)
SEPARATORS = re.compile(r"[,;|/•·#+»›]|\s[-–—]\s")
#: What a character can be, one bit each: part of a word, a word of its own, blank, the end of a line, a stop before a blank, one anywhere,
#: what closes the first and the second, a separator, a dash (a separator between blanks), the end of a sentence, what closes it.
LETTER, SINGLE, BLANK, BREAK, STOP, STOP_ANYWHERE, CLOSES, CLOSES_ANYWHERE, APART, DASH, END, CLOSES_END, UPPER, UNKNOWN = (1 << i for i in range(14))
KINDS = [rf"[^\W\d_{IDEOGRAPH}]", rf"[{IDEOGRAPH}]", r"\s", r"[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]", "[.!?…؟।]", "[。！？]", "[\"'”»)\\]]", "[」』”]", "[,;|/•·#+»›]", "[-–—]", "[.!?…:؟।。！？]", "[\"'”»)\\]}」』]"]
KINDS = [re.compile(k) for k in KINDS]
#: Share of the pages that a common pair of words is on, and of the pages of the rarer word that it is on; share of the pages that a word
#: the corpus knows is on, and that one is on which no page is about. They bound the tables: no more than 1 / share times a page's words.
PAIR, COHERENT, KNOWN, EVERYWHERE = 3e-4, 0.2, 1e-3, 0.1
#: A page count below which a pair and a known word are an accident.
PAIR_LEAST, KNOWN_LEAST = 3, 4
#: A word is one the page comes back to if it makes up this share of its distinct pieces' words, and this many.
RETURNING, RETURNING_LEAST = 0.03, 4
#: A piece is a refrain from so many times on; it is judged by its pairs of words only if it has so many words, so many of them known.
REFRAIN, JUDGED_FROM, JUDGED = 3, 4, 0.5
#: A shape is no sentence if the text it goes with is to this share; rounds of learning at most.
GOES_WITH, ROUNDS = 0.6, 4
#: A page is flagged from this share of non-sentence matter, of which this share lies in this many shapes.
MOST, FEW, NEARLY_ALL = 0.5, 8, 0.75


def unmarked(text: str) -> str:
    """A text without markup, escapes and speakers."""
    if "\\" in text:
        text = ESCAPE.sub(lambda m: chr(int(m[1], 16)), text).replace("\\n", "\n").replace("\\r", "\n")
    if text.lstrip()[:1] in "[{":
        text = JSON_KEY.sub("\n", text)
    if "<" in text:
        text = TAG.sub(" ", BLOCK_TAG.sub("\n", ANCHOR.sub(r" \1 ", text)))
    # The search for heads of lines is quick, and most texts have no speaker.
    return SPEAKER.sub("\n", text) if "**" in text or SPEAKER.match(text) or LINE_OF_SPEAKER.search(text) else text


_kinds = np.full(0x110000, UNKNOWN, np.uint16)


def kinds_of(code: np.ndarray) -> np.ndarray:
    """The bits of each character; a character is looked at when it first comes."""
    kind = _kinds[code]
    new = code[kind == UNKNOWN]
    if len(new):
        for c in np.unique(new).tolist():
            _kinds[c] = sum(1 << i for i, k in enumerate(KINDS) if k.match(chr(c))) + chr(c).isupper() * UPPER
        kind = _kinds[code]
    return kind


def having(kind: np.ndarray, bits: int) -> np.ndarray:
    """Where characters have one of the bits."""
    return np.flatnonzero((kind & np.uint16(bits)) != 0)


def runs(kind: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of characters with one of the bits begins, and where it is over."""
    on = having(kind, bits)
    new = np.flatnonzero(np.diff(on, prepend=-2) != 1)
    return on[new], on[np.append(new[1:], len(on)) - 1] + 1 if len(on) else on


def past(at: np.ndarray, begin: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The first positions outside the runs, from each position on."""
    if not len(begin):
        return at
    run = np.maximum(np.searchsorted(begin, at, "right") - 1, 0)
    return np.where((at >= begin[run]) & (at < over[run]), over[run], at)


def parts_of(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines, and the sentences within lines, of a text begin and end, without blanks around them. The text ends with a break."""
    begin, over = (np.concatenate(x) for x in zip(runs(kind, STOP), runs(kind, STOP_ANYWHERE)))
    order = np.argsort(begin)
    begin, over = begin[order], over[order]
    anywhere = (kind[begin] & STOP_ANYWHERE) > 0
    end = np.where(anywhere, past(over, *runs(kind, CLOSES_ANYWHERE)), past(over, *runs(kind, CLOSES)))
    # A piece has a character before its stop; a stop that is one character at its head is that character.
    one = over - begin == 1
    ends = (anywhere | ((kind[end] & BLANK) > 0)) & ~(one & ((begin == 0) | ((kind[begin - 1] & BREAK) > 0)))
    for i in (np.flatnonzero(one[1:] & (begin[1:] == end[:-1])) + 1).tolist():
        ends[i] &= not ends[i - 1]
    cuts = np.sort(np.concatenate([[0], having(kind, BREAK), end[ends]]))
    begin, over = runs(kind, BLANK)
    start, end = past(cuts[:-1], begin, over), cuts[1:]
    start, end = start[start < end], end[start < end]
    run = np.searchsorted(over, end)
    run = np.minimum(run, len(begin) - 1)
    return start, np.where(begin[run] < end, begin[run], end)


def inside(at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the sorted positions each piece has."""
    return np.searchsorted(at, end) - np.searchsorted(at, start)


def dashes(kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many dashes between blanks each piece has; a blank belongs to one dash."""
    at = having(kind[1:-1], DASH) + 1
    at = at[(kind[at - 1] & kind[at + 1] & BLANK) > 0]
    if not len(at):
        return np.zeros(len(start), np.int64)
    piece = np.maximum(np.searchsorted(start, at, "right") - 1, 0)
    at = at[(at > start[piece]) & (at + 1 < end[piece])]
    n = np.arange(len(at))
    return inside(at[(n - np.maximum.accumulate(np.where(np.diff(at, prepend=-3) != 2, n, 0))) % 2 == 0], start, end)


@lru_cache(64)
def _factors(n: int) -> np.ndarray:
    """``n`` fixed random factors."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text in lower case begins, and its number: the sum of its characters, each by the factor of its place."""
    kind = kinds_of(code)
    at = having(kind, LETTER | SINGLE)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    single = (kind[at] & SINGLE) > 0
    new = np.diff(at, prepend=-2) != 1
    new |= single
    new[1:] |= single[:-1]
    first = np.flatnonzero(new)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    number = np.add.reduceat(_factors(1 << int(length.max() - 1).bit_length())[place] * code[at], first)
    return at[first], (number ^ (number >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def paired(words: np.ndarray) -> np.ndarray:
    """A number for each word with the next."""
    mixed = (words[:-1] ^ (words[:-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    return mixed ^ (mixed >> np.uint64(29))


CUT = "doc_id long, words array<long>, length array<int>, form array<int>, size array<int>, text array<long>"
HEADS, ENDS = "aA", "_."
#: So many characters are cut up at once (more in a line that is longer).
TOGETHER = 1 << 18


def cut_up(texts: list[str]) -> tuple[np.ndarray, ...]:
    """The words of unmarked texts as numbers, how many words and pieces each text has, and the length, form (capital, end, separators
    and links), visible characters and text (a hash) of each piece."""
    whole = "\n".join([t.replace("\0", " ") for t in texts] + [""])
    raw = whole.encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(raw, np.uint32)
    kind = kinds_of(code)
    start, end = parts_of(kind)
    gaps = inside(having(kind, APART), start, end) + dashes(kind, start, end)
    links, spoken = np.zeros(len(start), np.int64), code
    may = inside(np.flatnonzero(code == ord("/")), start, end) > 0
    if "www." in whole:
        may |= inside(np.array([m.start() for m in re.finditer(r"www\.", whole)]), start, end) > 0
    for i in np.flatnonzero(may).tolist():
        part = whole[start[i] : end[i]]
        found = [m.span() for m in LINK.finditer(part)]
        if found:
            links[i], gaps[i] = len(found), len(SEPARATORS.findall(LINK.sub("", part)))
            spoken = code.copy() if spoken is code else spoken
            for a, b in found:
                spoken[start[i] + a : start[i] + b] = ord(" ")
    lower = (whole if spoken is code else spoken.tobytes().decode("utf-32-le", "surrogatepass")).lower()
    # The capital dotted i is the one letter that becomes two characters.
    longer = np.flatnonzero(spoken == 0x130) if len(lower) > len(code) else np.zeros(0, np.int64)
    at, words = numbered(np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32))
    n = inside(at, start + np.searchsorted(longer, start), end + np.searchsorted(longer, end))
    apart = np.where((gaps == 0) | (gaps < 3) & (n >= 4), 0, np.where(3 * gaps <= n, 1, 2))
    linked = np.where(links == 0, 0, np.where(n >= 8 * links, 1, 2))
    ended, closes = np.zeros(len(start), bool), np.ones(len(start), bool)
    for back in range(1, 5):
        last = kind[np.maximum(end - back, start)]
        ended |= closes & (end - back >= start) & ((last & END) > 0)
        closes &= (last & CLOSES_END) > 0
    form = ((((kind[start] & UPPER) > 0) * 2 + ended) * 3 + apart) * 3 + linked
    size = end - start - inside(np.flatnonzero(code == ord(" ")), start, end)
    view = memoryview(raw)
    key = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip((start * 4).tolist(), (end * 4).tolist())), np.uint64, len(start))
    page = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    return words, np.bincount(page, n, len(texts)).astype(np.int64), np.bincount(page, minlength=len(texts)), n, form, size, key


def at_lines(text: str) -> Iterator[str]:
    """A long text in slices that end with a line, as bounded memory needs it."""
    at = 0
    while len(text) - at > TOGETHER:
        to = text.rfind("\n", at, at + TOGETHER) + 1 or text.find("\n", at + TOGETHER) + 1 or len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's words as numbers, and the length, form, visible characters and text (a hash) of its pieces."""
    for batch in batches:
        done, texts, held, pages = [cut_up([])], [], 0, []
        for page, text in enumerate(batch["text"]):
            for part in at_lines(unmarked(text.as_py())):
                texts.append(part)
                pages.append(page)
                held += len(part)
                if held >= TOGETHER:
                    done.append(cut_up(texts))
                    texts, held = [], 0
        done.append(cut_up(texts))
        word, words, parts, length, form, size, key = (np.concatenate(x) for x in zip(*done))
        to = lambda n: pa.array(np.append(0, np.cumsum(np.bincount(pages, n, len(batch)))).astype(np.int32))
        words_to, parts_to = to(words), to(parts)
        listed = [pa.ListArray.from_arrays(parts_to, pa.array(x.astype(np.int32))) for x in (length, form, size)]
        columns = [batch["doc_id"], pa.ListArray.from_arrays(words_to, pa.array(word.view(np.int64))), *listed, pa.ListArray.from_arrays(parts_to, pa.array(key.view(np.int64)))]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CUT.split(", ")])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists and where each list begins and the last ends."""
    to = column.offsets.to_numpy()
    return column.values.to_numpy()[to[0] : to[-1]], to - to[0]


def _with(numbers_: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for each value in its group."""
    return (numbers_ ^ (numbers_ >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)


def _usage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, pages): on how many pages a word (a) and a pair of words (a, b) are, pieces seen before in the batch left out; the
    number of pages in a row of nulls."""
    for batch in batches:
        (word, _), (length, to), (key, _) = (_flat(batch[c]) for c in ("words", "length", "text"))
        page = np.repeat(np.arange(len(to) - 1), np.diff(to))
        new = np.zeros(len(key), bool)
        new[np.unique(key, return_index=True)[1]] = True
        kept, piece = np.repeat(new, length), np.repeat(np.arange(len(key)), length)
        word, piece = word[kept].view(np.uint64), piece[kept]
        if not len(word):
            continue
        of = page[piece]
        _, once = np.unique(_with(word, of), return_index=True)
        single, times = np.unique(word[once], return_counts=True)
        at = np.flatnonzero(piece[1:] == piece[:-1])
        both = paired(word)[at]
        _, once = np.unique(_with(both, of[at]), return_index=True)
        _, first, n = np.unique(both[once], return_index=True, return_counts=True)
        at = at[once[first]]
        rows = len(at) + len(single) + 1
        one = pa.array(np.concatenate([word[at], single, [np.uint64(0)]]).view(np.int64), mask=np.arange(rows) == rows - 1)
        two = pa.array(np.concatenate([word[at + 1], np.zeros(len(single) + 1, np.uint64)]).view(np.int64), mask=np.arange(rows) >= len(at))
        yield pa.RecordBatch.from_arrays([one, two, pa.array(np.concatenate([n, times, [len(np.unique(of))]]).astype(np.int64))], ["a", "b", "pages"])


class Usage:
    """What the corpus tells of words, as sorted arrays of numbers: coherent pairs, known words, words that are everywhere."""

    def __init__(self, pairs=(), known=(), everywhere=()):
        self.pairs, self.known, self.everywhere = (np.sort(np.array(x, np.uint64)) for x in (pairs, known, everywhere))

    @staticmethod
    def holds(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(values), bool)
        return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def corpus_usage(cut: DataFrame) -> Usage:
    """Counted over all pages, cut up; only what is common enough to be bounded (see PAIR, KNOWN) comes to the driver."""
    counted = cut.select("words", "length", "text").mapInArrow(_usage, "a long, b long, pages long").groupBy("a", "b").agg(F.sum("pages").alias("pages"))
    counted = materialise(counted, "usage")
    total = counted.where("a is null").agg(F.sum("pages")).first()[0] or 0
    words = counted.where("a is not null and b is null").where(F.col("pages") >= max(KNOWN_LEAST, min(KNOWN, PAIR) * total)).select("a", "pages")
    common = counted.where("b is not null").where(F.col("pages") >= max(PAIR_LEAST, PAIR * total))
    rarer = common.join(words.select("a", F.col("pages").alias("n")), "a").join(words.select(F.col("a").alias("b"), F.col("pages").alias("m")), "b")
    coherent = rarer.where(F.col("pages") >= COHERENT * F.least("n", "m")).select("a", "b").toArrow()
    known = words.where(F.col("pages") >= max(KNOWN_LEAST, KNOWN * total)).select("a", "pages").toArrow()
    a, b = (coherent[c].to_numpy().view(np.uint64) for c in ("a", "b"))
    number, pages = known["a"].to_numpy().view(np.uint64), known["pages"].to_numpy()
    return Usage(paired(np.stack([a, b], axis=1).ravel())[::2] if len(a) else (), number, number[pages >= EVERYWHERE * total])


#: What the signs of a shape stand for: words, capital, end, separators, links, reading on, returning words, refrain.
SIGNS = ["".join(x) for x in product("0123", HEADS, ENDS, "012", "012", "0123x", "012", "-r")]


def shapes_of(batch: pa.RecordBatch, usage: "Usage") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, shape, size): the visible characters of each page of a batch in each shape, pages and shapes as numbers."""
    (word, _), (length, to), (form, _), (size, _), (key, _) = (_flat(batch[c]) for c in ("words", "length", "form", "size", "text"))
    word, key, length = word.view(np.uint64), key.view(np.uint64), length.astype(np.int64)
    page = np.repeat(np.arange(len(to) - 1), np.diff(to))
    ends = np.cumsum(length)
    starts, piece = ends - length, np.repeat(np.arange(len(length)), length)
    of = page[piece]

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, values.dtype if values.dtype == np.uint64 else np.int64), np.cumsum(values)])
        return total[ends] - total[starts]

    telling = ~Usage.holds(usage.everywhere, word)
    on = np.zeros(len(word), bool)
    if len(word) > 1:
        on[:-1] = Usage.holds(usage.pairs, paired(word)) & (piece[1:] == piece[:-1])
    share = sums(on) / np.maximum(length - 1, 1)
    order = (np.arange(len(word)) - starts[piece]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    _, same, times = np.unique(_with(sums((word ^ (word >> np.uint64(33))) * order), page), return_inverse=True, return_counts=True)
    new = np.zeros(len(key), bool)
    new[np.unique(_with(key, page), return_index=True)[1]] = True
    counted = telling & np.repeat(new, length)
    _, which = np.unique(_with(word, of), return_inverse=True)
    count = np.bincount(which, counted)[which]
    least = np.maximum(RETURNING_LEAST, RETURNING * np.bincount(of, counted, len(to) - 1)) if len(word) else np.zeros(len(to) - 1)
    back = sums(telling & (count >= least[of])) / np.maximum(sums(telling), 1)
    judged = (length >= JUDGED_FROM) & (sums(Usage.holds(usage.known, word)) >= JUDGED * length)
    reads = np.where(judged, np.digitize(share, (0.1, 0.25, 0.4)), 4)
    again = (times[same] >= REFRAIN) & (length > 0) & (form % 3 == 0)
    shape = (((np.digitize(length, (1, 4, 12)) * 36 + form) * 5 + reads) * 3 + np.digitize(back, (0.45, 0.7))) * 2 + again
    pair, at = np.unique(page * len(SIGNS) + shape, return_inverse=True)
    return pair // len(SIGNS), pair % len(SIGNS), np.bincount(at, size, len(pair)).astype(np.int64)


def shapes(text: str, usage: "Usage") -> dict[str, int]:
    """Visible characters of a text in each shape."""
    cut = next(_cut(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text])], ["doc_id", "text"])])))
    _, shape, size = shapes_of(cut, usage)
    return {SIGNS[s]: int(n) for s, n in zip(shape, size)}


def certain(shape: str) -> str | None:
    """n or s for a shape that is certainly no sentence or one; None for one that has to be learned."""
    many, head, end, apart, linked, reads, back, again = shape
    if many == "0" or linked == "2" or apart == "2" or many in "23" and reads == "0":
        return "n"
    if back in "12" and (many in "23" and (reads in "x01" or end + back + reads == "_22") or many == "1" and head + end + again == "a_-"):
        return "n"
    return "s" if again == "r" or many in "23" and reads == "3" and back == "0" else None


def page_shapes(cut: DataFrame, usage: Usage) -> DataFrame:
    """(doc_id, shapes): the visible characters of every page, cut up, in each shape."""
    shared = cut.sparkSession.sparkContext.broadcast(usage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(SIGNS, object)
        for batch in batches:
            page, shape, size = shapes_of(batch, shared.value)
            to = pa.array(np.searchsorted(page, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(to, pa.array(names[shape], pa.string())), pa.ListArray.from_arrays(to, pa.array(size))], ["doc_id", "shape", "size"])

    arrays = cut.mapInArrow(run, "doc_id long, shape array<string>, size array<long>")
    return arrays.select("doc_id", F.arrays_zip("shape", "size").alias("shapes"))


def learned_kinds(pages: DataFrame) -> dict[str, str]:
    """n or s for every shape that occurs. The number of shapes is bounded by their signs (a few thousand)."""
    kinds = {r[0]: certain(r[0]) for r in pages.select(F.explode("shapes.shape")).distinct().collect()}
    open_ = [s for s, k in kinds.items() if k is None]
    for _ in range(ROUNDS if open_ else 0):
        now = dict(kinds)

        def company(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad, all_ = Counter(), Counter()
                for found in batch["shapes"].to_pylist():
                    sizes = {x["shape"]: x["size"] for x in found}
                    no, yes = (sum(v for s, v in sizes.items() if now.get(s) == k) for k in "ns")
                    for s, v in sizes.items():
                        if certain(s) is None:
                            n, y = no - v * (now.get(s) == "n"), yes - v * (now.get(s) == "s")
                            if n + y:
                                bad[s] += v * n / (n + y)
                                all_[s] += v
                yield pa.RecordBatch.from_arrays([pa.array(list(all_), pa.string()), pa.array([bad[s] for s in all_], pa.float64()), pa.array(list(all_.values()), pa.float64())], ["shape", "bad", "total"])

        told = pages.select("shapes").mapInArrow(company, "shape string, bad double, total double").groupBy("shape").agg((F.sum("bad") / F.sum("total")).alias("share")).collect()
        share = {r["shape"]: r["share"] for r in told}
        kinds |= {s: "n" if share.get(s, 0.0) >= GOES_WITH else "s" for s in open_}
        if kinds == now:
            break
    return kinds


def spam_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, share): pages dominated by few shapes that are not sentences, and the share of such matter."""
    docs = documents.where("doc_id is not null and text rlike '[^ \\\\t\\\\r\\\\n]'").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = materialise(docs.mapInArrow(_cut, CUT), "cut")
    pages = materialise(page_shapes(cut, corpus_usage(cut)), "shapes")
    none = [s for s, k in learned_kinds(pages).items() if k == "n"]

    def total(shapes):
        return F.aggregate(shapes, F.lit(0).cast("long"), lambda a, x: a + x["size"])
    bad = F.filter("shapes", lambda x: x["shape"].isin(none)) if none else F.slice("shapes", 1, 0)
    top = F.slice(F.reverse(F.array_sort(F.transform(bad, lambda x: F.struct(x["size"].alias("size"), x["shape"].alias("shape"))))), 1, FEW)
    shares = pages.select("doc_id", (total(bad) / F.greatest(total(F.col("shapes")), F.lit(1))).alias("share"), (total(top) / F.greatest(total(bad), F.lit(1))).alias("few"))
    return shares.where((F.col("share") >= MOST) & (F.col("few") >= NEARLY_ALL)).groupBy("doc_id").agg(F.max("share").alias("share"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly stuffed keywords, links or tags: (doc_id)."""
    return spam_pages(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id")
