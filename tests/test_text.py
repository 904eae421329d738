from __future__ import annotations

import random
import sqlite3

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.stem import stem
from corpusloom.functions.words import words
from corpusloom.operators import chunking, search
from corpusloom.sources import markup


def sequential(text, least=256, most=4096, bits=10):
    """Cuts found one character at a time."""
    out, pos = [], 0
    while pos < len(text):
        if len(text) - pos <= most:
            out.append((pos, len(text) - pos))
            break
        h, raw = 0, min(pos + most, len(text))
        for i in range(pos, raw):
            h = ((h << 1) + ord(text[i])) % 2**64
            if i >= pos + least and h % 2**bits == 0:
                raw = i + 1
                break
        cut = max(min(chunking.snapped(text, raw), pos + most), pos + least)
        out.append((pos, cut - pos))
        pos = cut
    return out


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 15000))
def test_chunks_equal_the_sequential_definition(seed, n):
    rng = random.Random(seed)
    text = "".join(rng.choice("abcdefgh \n#é{}-") for _ in range(n))
    spans = chunking.chunk_spans(text)
    assert spans == sequential(text)
    assert "".join(text[a : a + k] for a, k in spans) == text


def test_chunk_table(spark):
    rows = spark.createDataFrame([(1, "x" * 5000), (2, None), (3, ""), (4, "short")], "doc_id long, text string")
    made = chunking.chunks(rows).collect()
    assert {r["doc_id"] for r in made} == {1, 4}
    assert all(xxhash.xxh64_hexdigest(r["content"]) == r["fingerprint"] for r in made)


def test_fingerprints():
    big = b"x" * (chunking.FULL_HASH_UP_TO + 1)
    assert chunking.fingerprint(b"hello") == "26c7827d889f6da3"
    assert chunking.fingerprint(big) == chunking.partial_fingerprint(big) != xxhash.xxh64_hexdigest(big)
    assert chunking.fold_to_long(42) == 42 and -(2**63) <= chunking.fold_to_long(2**120 + 42) < 2**63


FTS_TEXTS = ["The quick brown foxes are jumping over lazy dogs", "Relational databases relate relations", "Café au lait, e-mail and foo.bar", "", "connected connections connecting happily", "dogs dogs dog hopping hoped sized agreed"]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(FTS_TEXTS)))
    return con


@pytest.mark.parametrize("query", ["dog", "relation", "connect", "cafe", "foo.bar", "hop", "size agree", "jump lazy", "e-mail"])
def test_bm25_equals_a_full_text_engine(spark, fts, query):
    docs = spark.createDataFrame(list(enumerate(FTS_TEXTS)), "doc_id long, text string")
    phrases = search.query_phrases(query, stemmed=True)
    postings, lengths = search.index(search.stemmed_tokens(docs, "doc_id", "text"), "doc_id")
    ours = {r[0]: round(r[1], 9) for r in search.search(postings, lengths, "doc_id", phrases).collect()}
    match = " AND ".join('"' + "".join(c for c in t if c not in search.META) + '"' for t in query.split())
    assert ours == {r[0]: round(r[1], 9) for r in fts.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", [match])}


def test_empty_queries_and_snippets(spark):
    assert search.query_phrases('  "()" ') == []
    assert search.snippet("The lantern is gone", [["lantern"]]) == "The [lantern] is gone"
    assert search.snippet(None, [["x"]]) == "" and search.snippet("w " * 50 + "lanterns", search.query_phrases("lantern", True)).endswith("[lanterns]")


def test_stems():
    pairs = "caresses:caress ponies:poni agreed:agre plastered:plaster motoring:motor hopping:hop happy:happi relational:relat conditional:condit electriciti:electr adoption:adopt controll:control rate:rate sky:sky"
    assert all(stem(a) == b for a, b in (p.split(":") for p in pairs.split()))


def test_words():
    assert words("<p>Café́ &amp; T​ea</p>\\nmoth-\neaten **X**") == ["cafe", "tea", "motheaten", "x"]
    assert words(None) == [] and words("  \n") == [] and words("ＡＢ１") == ["ab1"]


def test_markup(spark):
    row = spark.range(1).select(markup.strip_html(F.lit("<html><style>x</style><div>a<br/>b</div><script>y</script><b>c</b></html>")).alias("t"), markup.decoded(F.lit(bytearray(b"caf\xe9"))).alias("d"), markup.question_count(F.lit("**Q:** a **Question:** b")).alias("q"))
    assert tuple(row.first()) == ("a\nb\nc", "café", 2)
