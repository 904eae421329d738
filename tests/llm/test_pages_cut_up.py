"""Problem 8's pages are cut up on arrays, as if piece by piece, and cheaply."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa

from corpusloom.llm import spam_pages as S

SENTENCE = re.compile(r".+?(?:[.!?…؟।]+[\"'”»)\]]*(?=\s|$)|[。！？]+[」』”]*|$)", re.DOTALL)
WORD = re.compile(rf"[^\W\d_{S.IDEOGRAPH}]+|[{S.IDEOGRAPH}]")
SENTENCE_END = re.compile(r"[.!?…:؟।。！？][\"'”»)\]}」』]*$")


def cut(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    return next(S._cut(iter([batch])))


def one_by_one(text):
    """(words, form, size) of each piece."""
    found = []
    for p in (s for line in S.SPEAKER.sub("\n", text).splitlines() for m in SENTENCE.finditer(line) if (s := m[0].strip())):
        words = WORD.findall(S.LINK.sub(" ", p).lower())
        n, links, gaps = len(words), len(S.LINK.findall(p)), len(S.SEPARATORS.findall(S.LINK.sub("", p)))
        apart = 0 if gaps == 0 or gaps < 3 and n >= 4 else 1 if gaps <= n / 3 else 2
        linked = 0 if not links else 1 if n >= 8 * links else 2
        found.append((words, ((p[0].isupper() * 2 + bool(SENTENCE_END.search(p[-4:]))) * 3 + apart) * 3 + linked, len(p) - p.count(" ")))
    return found


BITS = [*".!…؟。！\"'”»)]」』 \t\n\x1c\x85\x0b -,;|·#_é😀", "  ", "\r\n", " - ", " – ", " - - - ", "a", "Ab", "İz", "ΟΔΟΣ", "ß", "漢字", "かな", "한국", "word", "WORD", "http://x.test/a?b", "www.x.de", "x.test/ab/c", "/", "12", "user: ", "**Assistant:** ", "Q, ", "\nuser:\nhuman:\n", "I. "]


def test_like_one_by_one():
    rng = random.Random(8)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice("。」.!\" a\n") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    got = cut(texts)
    expected = [one_by_one(t) for t in texts]
    assert got["length"].to_pylist() == [[len(p[0]) for p in x] for x in expected]
    assert got["form"].to_pylist() == [[p[1] for p in x] for x in expected]
    assert got["size"].to_pylist() == [[p[2] for p in x] for x in expected]
    numbers = set(zip((w for x in expected for p in x for w in p[0]), got["words"].values.to_pylist(), strict=True))
    assert len(numbers) == len({w for w, _ in numbers}) == len({n for _, n in numbers})


def test_long_pages_are_cut_up_in_slices(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(BITS) for _ in range(n)) for n in (3000, 5, 900, 1)] + ["", "a" * 500, "\n" * 500]
    whole = cut(texts)
    monkeypatch.setattr(S, "TOGETHER", 50)
    assert cut(texts).equals(whole) and cut([]).num_rows == 0


def test_half_an_emoji_and_zero_characters():
    got = cut(['{"role": "user", "content": "fine \\ud83d\\ude00 here"}', "one\0two. Three", "\0", "plain"])
    assert got["length"].to_pylist() == [[0, 2], [2, 1], [], [1]]


def test_cutting_costs_little():
    rng = random.Random(1)
    words = "the lantern of a bridge was seldom lit before harbour and river, but nobody asked".split()
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(14)).capitalize() + "." for _ in range(20)) for _ in range(1000)]

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: cut(texts)) < 2.5 * least(lambda: [re.findall(r"[^\W\d_]+", t) for t in texts])
