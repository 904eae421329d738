"""Operators that search: nearest vectors, history dedup, name variants, leaked items."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.llm import history_dedup as H
from corpusloom.llm import leakage as L
from corpusloom.llm import name_rules as R
from corpusloom.llm import name_variants as V
from corpusloom.llm import neighbours as N


def true_pairs(ids, x, k=5):
    out = set()
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        limit = np.sort(d)[min(k, len(x) - 1) - 1]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in np.flatnonzero(d <= limit)}
    return out


def clustered(n, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 20), dim)) * 0.2
    return (centres[rng.integers(len(centres), size=n)] + rng.standard_normal((n, dim)) * 0.02).astype(np.float32)


@pytest.mark.parametrize("cell", [256, 100_000])
def test_nearest_vectors_recall(spark, cell):
    x = clustered(3000)
    ids = [f"v{i:05}" for i in range(len(x))]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x)], "id string, embedding array<float>")
    pairs, members = N.nearest_vectors(df, cell=cell)
    got = {tuple(sorted(r)) for r in pairs.select("id", "neighbour").collect()}
    true = true_pairs(ids, x.astype(np.float64))
    assert len(got & true) / len(true) >= 0.97 and members.count() == 0
    d = {(r["id"], r["neighbour"]): r["distance"] for r in pairs.limit(50).collect()}
    assert all(abs(v - ((x[int(a[1:])].astype(np.float64) - x[int(b[1:])]) ** 2).sum()) < 1e-9 for (a, b), v in d.items())


def test_nearest_vectors_odd_rows(spark, tmp_path):
    x = clustered(40, 1).tolist()
    rows = [(f"a{i}", v, "t") for i, v in enumerate(x)]
    rows += [("a0", x[0], "again"), ("copy0", x[0], "t"), ("copy1", x[0], "t"), ("null", None, "t"), ("short", [1.0], "t"), ("nan", [float("nan")] * 64, "t"), ("inf", [float("inf")] * 64, "t"), ("zero", [0.0] * 64, "t"), (None, x[1], "t"), ("hole", [None] + x[1][1:], "t")]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, neighbour string")
    df.write.parquet(f"{tmp_path}/chunk_vectors.parquet")
    got = {tuple(r) for r in N.p1_found(spark, str(tmp_path)).collect()}
    named = {i for p in got for i in p}
    assert named <= {f"a{i}" for i in range(40)} | {"copy0", "copy1"}
    assert {("a0", "copy0"), ("a0", "copy1")} <= got and all(a < b for a, b in got)
    assert true_pairs([f"a{i}" for i in range(40)], np.array(x, np.float32).astype(np.float64)) <= got
    assert N.nearest_vectors(df.limit(0))[0].count() == 0
    assert N.nearest_vectors(df.where("id = 'a1'"))[0].count() == 0


def test_many_neighbours_and_many_ties(spark):
    x = clustered(3000, 3)
    ids = [f"v{i:05}" for i in range(len(x))]
    rows = [(i, r.tolist()) for i, r in zip(ids, x)]
    far = np.zeros(64)
    far[0] = 50.0
    rows += [("centre", far.tolist())]
    for i in range(30):  # all as far from the centre, and from nothing else as near
        at = far.copy()
        at[1 + i] = 1.0
        rows.append((f"t{i:02}", at.tolist()))
    pairs, _ = N.nearest_vectors(spark.createDataFrame(rows, "id string, embedding array<float>"), k=20, cell=1000)
    got = {tuple(sorted(r)) for r in pairs.select("id", "neighbour").collect()}
    true = true_pairs(ids, x.astype(np.float64), 20)
    assert len(got & true) / len(true) >= 0.95
    assert {("centre", f"t{i:02}") for i in range(30)} <= got
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShufflePartitionIdPassThrough") == 1 or plan.lower().count("exchange") <= 2


def test_a_surname_that_many_bear_and_many_ask_for(spark):
    rng = random.Random(6)
    given = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)).capitalize() for _ in range(3000)]
    names = [(f"{g} Smith", 1, 1, 0) for g in given] + [(f"{chr(97 + i % 26).upper()}. Smith{' ' * (i // 26)}", 1, 1, 0) for i in range(5000)] + [("Zachary Kowalczyk", 1, 1, 0), ("Z. Kowalczyk", 1, 1, 0)]
    df = spark.createDataFrame(names, "name string, mentions long, named long, concept long")
    got = {r["name"]: r["entity"] for r in V.link_variants(df).collect()}
    assert got["Z. Kowalczyk"] == got["Zachary Kowalczyk"] and "G. Smith" not in got


def sentence(rng, words):
    return " ".join(rng.choice(words) for _ in range(rng.randint(7, 12))).capitalize() + "."


def test_history_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    texts = [" ".join(sentence(rng, words) for _ in range(8)) for _ in range(150)]
    for i in range(150):
        s = texts[rng.randrange(len(texts))].split(". ")
        rng.shuffle(s)
        t = [w for w in " ".join(s).split() if rng.random() > rng.choice([0.0, 0.1, 0.2])]
        texts.append(rng.choice([str.upper, str, lambda x: f"<p>{x}</p>"])(" ".join(t) + rng.choice(["", " extra words", " café"])))
    rows = list(enumerate(texts, 1))
    sets = {i: set(H.coordinates(t).tolist()) for i, t in rows}
    expected = {}
    for i, _ in rows[150:]:
        near = [j for j in range(1, i) if len(sets[i] & sets[j]) >= 0.75 * max(len(sets[i]), len(sets[j]))]
        if near:
            expected[i] = near[0]
    df = lambda r: spark.createDataFrame(r, "rowid long, text string")
    cells = H.VectorCells(spark).load(df(rows[:150]))
    got = {}
    for part in (rows[150:200], rows[200:201], rows[201:]):
        got |= {r["new_rowid"]: r["kept_rowid"] for r in cells.accept(df(part)).collect()}
    assert got == expected == {r["new_rowid"]: r["kept_rowid"] for r in cells.links.collect()}
    again = df([(1001, texts[3]), (1002, texts[200]), (1003, "nothing like it at all here now"), (None, "x"), (1004, None)])
    kept = {r["new_rowid"]: r["kept_rowid"] for r in cells.accept(again).collect()}
    assert kept == {1001: 4, 1002: expected.get(201, 201)}


def test_one_text_with_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(H, "WINDOW", 2)
    monkeypatch.setattr(H, "TAKEN", 1)
    rng = random.Random(1)
    base = [f"word{i}" for i in range(40)]
    other = [f"word{i}" for i in range(12)] + [f"else{i}" for i in range(28)]  # shares too little with the crowd
    crowd = [(i, " ".join(w for w in base if rng.random() > 0.05) + f" mark{i % 7}") for i in range(1, 120)]
    rows = crowd + [(200, " ".join(other)), (201, " ".join(other[:-3])), (202, None), (203, "  "), (201, " ".join(other[:-3]))]
    batch = spark.createDataFrame(rows, "rowid long, text string")
    got = {r["new_rowid"]: r["kept_rowid"] for r in H.VectorCells(spark).accept(batch).collect()}
    assert got[201] == 200 and 200 not in got and {202, 203} & set(got) == set()
    assert all(got[i] == 1 for i in range(2, 120))
    assert H.VectorCells(spark).accept(batch.limit(0)).count() == 0


EDITS = {
    "replaced by known words": lambda ws, rng: [rng.choice(ws) if rng.random() < 0.15 else w for w in ws],
    "replaced by new words": lambda ws, rng: [f"new{rng.random()}" if rng.random() < 0.2 else w for w in ws],
    "a quarter left out": lambda ws, rng: [w for i, w in enumerate(ws) if i % 4],
    "a quarter appended, all new": lambda ws, rng: ws + [f"new{rng.random()}" for _ in range(len(ws) // 3)],
    "rarest words left out": lambda ws, rng: sorted(ws, key=lambda w: -int(w[1:]))[len(ws) // 5 :],
}


@pytest.mark.parametrize("edit", EDITS)
def test_cells_meet_whatever_is_edited(edit):
    rng = random.Random(edit)
    zipf = [f"w{int(rng.paretovariate(0.6)) % 20000}" for _ in range(200_000)]
    texts = [[rng.choice(zipf) for _ in range(80)] for _ in range(400)]
    counts = np.full(H.COUNTERS, 0.5)
    for _ in range(10):
        for ws in texts:
            np.add.at(counts, H.coordinates(" ".join(ws)) % H.COUNTERS, 1)
    rare, best = np.log(4000 / counts), np.log(1 / H.TELLING)
    weights = np.maximum(np.minimum(rare, 2 * best - rare), H.LEAST_WEIGHT).astype(np.float32)
    cells = lambda c: H.cells_of(c, np.array([0]), weights[c % H.COUNTERS])
    near = met = 0
    for ws in texts:
        a, b = H.coordinates(" ".join(ws)), H.coordinates(" ".join(EDITS[edit](ws, rng)))
        if len(np.intersect1d(a, b)) >= H.SHARED * max(len(a), len(b)):
            near, met = near + 1, met + bool((cells(a) == cells(b)).any())
        apart = sum(int(np.bitwise_count(x ^ y)[0]) for x, y in zip(H.sketches(a, np.array([0])), H.sketches(b, np.array([0]))))
        assert apart <= len(np.setxor1d(a, b))
    assert near > 20 and met / near >= 0.9


def test_a_small_batch_reads_its_own_cells_only(spark):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(50_000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(1, 4001)]
    cells = H.VectorCells(spark).load(spark.createDataFrame(rows, "rowid long, text string"))
    one = H.vectorise(spark.createDataFrame([(9001, rows[5][1] + " more")], "rowid long, text string"))
    read = cells._only(cells.cells, "cell", cells._members(one), H.CELLS)
    assert "PushedFilters: [Or(" in read._jdf.queryExecution().toString() and 1 <= read.count() < 2000 < cells.cells.count() == 80_000
    assert [tuple(r) for r in cells.accept(spark.createDataFrame([(9001, rows[5][1] + " more")], "rowid long, text string")).collect()] == [(6, 9001)]


def test_few_unrelated_texts_are_reranked(spark):
    rng = random.Random(7)
    frames = [[f"f{rng.randrange(300)}" for _ in range(7)] for _ in range(40)]
    text = lambda: " ".join(" ".join(rng.choice(frames) + [f"n{rng.randrange(600)}" for _ in range(5)]) for _ in range(7))
    rows = [(i, text()) for i in range(1, 4001)]
    rows += [(4000 + i, rows[i][1] + " one more") for i in range(5)]
    cells, pairs = H.VectorCells(spark).load(spark.createDataFrame(rows[:3000], "rowid long, text string")), []
    rerank = cells._rerank
    cells._rerank = lambda candidates, *rest: pairs.append(candidates.count()) or rerank(candidates, *rest)
    got = cells.accept(spark.createDataFrame(rows[3000:], "rowid long, text string"))
    assert sorted(map(tuple, got.collect())) == [(i + 1, 4000 + i) for i in range(5)] and sum(pairs) <= 30  # 193 by sketches of 128 bits


def test_coordinates_of_many_texts_are_those_of_each():
    texts = ["a a b a", None, "", "Ça va? ça VA, ça", "b", " - ", "<b>one</b> two two"]
    flat, sizes = H.coordinates_of(texts)
    assert sizes.tolist() == [len(H.coordinates(t)) for t in texts] == [4, 0, 0, 5, 1, 0, 3]
    assert flat.tolist() == [c for t in texts for c in H.coordinates(t).tolist()]


def test_name_rules():
    assert R.typing_errors("abcd", "abdc") == 1 and R.typing_errors("abcd", "axxd") == 2 and R.typing_errors("abcd", "wxyz") == 3
    full = lambda n: R.rewrite(n)[1]
    assert full("Dr. William K. Tedrabe") == full("TEDRABE, Bill") == full(" bill  tedrabe") == full("Tedrabe William") == ["tedrabe", "william"]
    assert full("Mike Tedrabe") == full("Michael Tedrabe") and full("Sam Tedrabe") == full("Samuel Tedrabe") and full("Manolo Tedrabe") == full("Manuel Tedrabe")
    assert full("Xyzzy Glass Mfg. Pty Ltd") == full("Xyzzy Glass Manufacturing")
    assert full("Günther Abc") == full("Guenther Abc") and full("The Xyzzy Cold Storage G.m.b.H.") == full("Xyzzy-Cold Storage Ltd") == full("Xyzzy Cold Storage")
    assert R.rewrite("J. Tedrabe")[2] == ["i:j|tedrabe"] and R.rewrite("Xyzzy Institute (SC)")[2] == ["a:institute:cs|xyzzy"]
    assert R.rewrite("") == R.rewrite(" ?! ") == ("", [], [])


def names_table(spark, names):
    entity = "array<struct<name:string,entity_type:string,description:string>>"
    relation = "array<struct<source:string,target:string,description:string,weight:double>>"
    rows = [("c", [(n, t, "")], None) for n, t in names] + [("c", None, [("Larry Negodru", "Nowhere Known", "", 1.0), (None, None, None, None)]), ("c", [], []), ("c", [(None, None, None)], [])]
    return spark.createDataFrame(rows, f"chunk_id string, entities {entity}, relations {relation}")


def test_name_variants(spark):
    same = [
        ["Lawrence Negodru", "Larry Negodru", "NEGODRU, Lawrence", "lawrence.negodru", "lnegodru", "Dr L. Negodru", "Lawrence Ngeodru", "Lawrence B. Negodru"],
        ["Søren Brefastadil", "S. Brefastadil", "Soren Brefastadil"], ["Jörg Brefastadil", "J Brefastadil", "Joerg Brefastadil"],
        ["Zubrigus Institute of Textile Chemistry", "Zubrigus Inst. Textile Chemistry", "Institute of Textile Chemistry, Zubrigus", "Zubrigus Institute (TC)", "Zubrigus Institute of Tetxile Chemistry"],
        ["Bokivako Bridge Maintenance GmbH", "The Bokivako Bridge Maintenance G.m.b.H."], ["Bokivako Seed Genetics GmbH"], ["University of Nutibra", "Univ. of Nutibra", "Nutibra University"],
    ]
    rows = [(n, "Person") for g in same for n in g] + [("Brefastadil", "Person"), ("Weary Attic", "Concept"), ("weary attic", "CON"), ("Lawrence Negodru", None), ("", "Person"), ("x" * 3000, "Person")]
    got = {tuple(r) for r in V.variant_pairs(V.mentions(names_table(spark, rows))).collect()}
    expected = {(a, b) for g in same for a in g for b in g if a < b}
    assert got == expected
    assert V.variant_pairs(V.mentions(names_table(spark, []).limit(0))).count() == 0


def test_slips_of_given_names_that_recur(spark):
    rng = random.Random(5)
    surnames = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(6)).capitalize() for _ in range(60)]
    rows = [(f"{g} {s}", 9, 9, 0) for s in surnames for g in ("Joseph", "Johannes")] + [(f"Joseh {s}", 1, 1, 0) for s in surnames[:5]] + [(f"J. {s}", 1, 1, 0) for s in surnames[:5]]
    rows += [(f"Lottie {surnames[0]}", 1, 1, 0), (f"Charlotte {surnames[0]}", 1, 1, 0)]
    got = {r["name"]: r["entity"] for r in V.link_variants(spark.createDataFrame(rows, "name string, mentions long, named long, concept long")).collect()}
    assert all(got[f"Joseh {s}"] == got[f"Joseph {s}"] != got[f"Johannes {s}"] for s in surnames[:5])
    assert got[f"Lottie {surnames[0]}"] == got[f"Charlotte {surnames[0]}"]
    same = R.same_but_for_typing
    assert same(["joseh", "x"], ["joseph", "x"], [40, 1], [900, 1], 3) == 1 and same(["maria", "x"], ["marie", "x"], [300, 1], [900, 1], 3) == 3
    assert same(["jsoeh", "x"], ["joseph", "x"], [3, 1], [900, 1], 3) == 2 and same(["jsoeh", "x"], ["joseph", "x"], [100, 1], [900, 1], 3) == 3


@pytest.fixture(scope="module")
def items():
    rng = random.Random(7)
    words = [f"rare{i}" for i in range(900)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([18, 40, 90])))) for i in range(20)]


def test_leaks(spark, items):
    filler = " ".join(f"plain{i}" for i in range(50))
    w = {i: t.split() for i, t in items}
    half = lambda i: len(w[i]) // 2 + 1
    altered = w[3][:]
    for k in range(5, len(altered), 12):
        altered[k] = "changed"
    docs = [
        (1, f"{filler} {items[0][1].upper()} {filler}", {0}), (2, f"<p>{' '.join(w[1][: half(1)])}</p>", {1}), (3, f"{filler} {' '.join(w[2][: len(w[2]) // 3])} {filler} {' '.join(w[2][-len(w[2]) // 3 :])}", {2}),
        (4, " ".join(altered), {3}), (5, " ".join(w[4][: len(w[4]) // 3]), set()), (6, " ".join(reversed(w[5])), set()), (7, filler, set()), (8, None, set()), (9, "", set()),
        (10, "\n".join(f"**{x}** &amp;" for x in w[6]), {6}), (11, items[7][1] + " " + items[8][1], {7, 8}), (12, " ".join(x for x in w[9][::3]), set()),
    ]
    df = spark.createDataFrame([(d, t, 0) for d, t, _ in docs] + [(1, docs[0][1], 0)], "doc_id long, text string, item_id int")
    known = spark.createDataFrame([*items, items[0], (98, None), (99, ""), (100, "   ")], "item_id long, text string")
    expected = {(d, i) for d, _, s in docs for i in s}
    for block in (4000, 5):
        assert {tuple(r) for r in L.find_leaks(df, known, block=block).collect()} == expected
    assert L.find_leaks(df.limit(0), known).count() == 0 and L.find_leaks(df, known.limit(0)).count() == 0


def test_walks_tolerate_altered_words():
    rng = np.random.default_rng(0)
    windows = rng.integers(1, 500, (400, 10)).astype(np.int32)
    changed = windows.copy()
    changed[np.arange(400), rng.integers(0, 10, 400)] = 500
    walks = L.Walks()
    met = np.zeros(400, bool)
    for a, b in zip(walks.keys(10, windows), walks.keys(10, changed)):
        met |= a == b
    assert met.mean() > 0.9
