from __future__ import annotations

from corpusloom.llm import leakage as L

ITEM = [f"word{chr(97 + i)}" for i in range(24)]


def strangers(n: int, tag: str) -> list[str]:
    return [f"{tag}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)]


def found(spark, item, text):
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    documents = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    return L.find_leaks(documents, items).count()


def test_half_an_item_in_short_pieces(spark):
    """Words 1-3, one altered, 5-7 and far away 13-17: half the item, of which five words in a row are only a fifth."""
    text = strangers(60, "x") + ITEM[0:3] + ["other"] + ITEM[4:7] + strangers(90, "y") + ITEM[12:17] + strangers(60, "z")
    assert found(spark, ITEM, text) == 1
    assert found(spark, ITEM, strangers(60, "x") + ITEM[0:3] + strangers(90, "y") + ITEM[12:17]) == 0


def test_pieces_of_four_words(spark):
    text = strangers(60, "x") + ITEM[0:4] + ["other"] + ITEM[5:9] + strangers(90, "y") + ITEM[12:16] + strangers(60, "z")
    assert found(spark, ITEM, text) == 1


def test_half_of_a_short_item(spark):
    assert found(spark, ITEM[:8], strangers(20, "x") + ITEM[2:6] + strangers(20, "y")) == 1
    assert found(spark, ITEM[:8], strangers(20, "x") + ITEM[2:5] + strangers(20, "y")) == 0


def test_needed_words_and_runs():
    assert L.needed(24) == (11, 4) and L.needed(8) == (4, 2)


def test_recall_of_the_walks_alone():
    """Windows of ten words with one altered in each item's half: how many items the walks meet without any other key."""
    import random

    import numpy as np

    rng, met, near = random.Random(5), 0, 200
    for _ in range(near):
        item = np.array([rng.randrange(1, 1 << 60) for _ in range(40)], np.uint64)
        half = item[8:30].copy()
        half[[5, 16]] = rng.randrange(1 << 60)
        walks = L.Walks()
        windows = lambda x: x[np.arange(len(x) - 9)[:, None] + np.arange(10)]
        met += any(np.isin(a, b).any() for a, b in zip(walks.keys(10, windows(item)), walks.keys(10, windows(half))))
    assert met / near >= 0.9


def test_very_long_documents_take_bounded_memory(monkeypatch):
    import numpy as np

    monkeypatch.setattr(L, "ALIGNED", 24 * 200)
    item = np.arange(1, 25, dtype=np.uint64)
    noise = np.arange(1000, 9000, dtype=np.uint64)
    text = np.concatenate([noise, item[:8], noise, item[13:19], noise])
    assert L.leaked(item, text, None) and L.leaked(item, text, (0, 16000))
    assert not L.leaked(item, np.concatenate([noise, item[:4], noise, item[20:], noise]), None)


def test_any_number_of_items_scans_documents_once(spark):
    items = spark.createDataFrame([(i, " ".join(strangers(12, f"i{i}"))) for i in range(30)], "item_id long, text string")
    documents = spark.createDataFrame([(i, " ".join(strangers(20, "x") + strangers(12, f"i{i}") + strangers(20, "y"))) for i in range(30)], "doc_id long, text string")
    for block in (100, 3):
        got = {tuple(r) for r in L.find_leaks(documents, items, block=block).collect()}
        assert {(i, i) for i in range(30)} <= got and len(got) == 30
    assert L.find_leaks(documents, items, block=100)._jdf.queryExecution().toString().count("MapInArrow") > 0
