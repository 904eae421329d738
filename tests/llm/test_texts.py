"""Operators on texts: conversations, encoding, spam pages."""

from __future__ import annotations

import random

import pytest

from corpusloom.llm import conversations as C
from corpusloom.llm import spam_pages as S
from corpusloom.llm import tokenize as K

NODE = "file_id string, conv_id string, node_id string, parent string, role string, parts array<string>, turn string"


def chain(conv, roles, root=None, text="t"):
    out, parent = [], root
    for i, r in enumerate(roles):
        out.append(("f", conv, f"{conv}{i}", parent, r, [None, text] if r != "blank" else [" \t\n"], "x"))
        parent = f"{conv}{i}"
    return out


@pytest.mark.parametrize("limit", [5000, 2])
def test_trees(spark, limit):
    rows = chain("a", [None, "USER ", "assistant", "tool", "user", "Assistant"]) + chain("b", ["assistant", "user"]) + chain("c", ["user", "assistant"], "gone") + chain("d", ["user", "blank"]) + chain("e", ["user", "assistant"])
    rows += [("f", "a", "branch", "a1", "assistant", ["other"], "x"), ("f", "l", "l1", "l2", "user", ["x"], "x"), ("f", "l", "l2", "l1", "assistant", ["x"], "x"), ("f", None, "n", None, "user", ["x"], "x"), ("f", "a", None, None, "user", ["x"], "x")]
    rows += rows[:3]
    heads = [("a", "a5"), ("b", "b1"), ("c", "c1"), ("d", "d1"), ("e", None), ("l", "l1"), ("a", "a5"), ("zz", "q"), (None, "q")]
    nodes, current = spark.createDataFrame(rows, NODE), spark.createDataFrame(heads, "conv_id string, current_node string")
    got = sorted(tuple(r) for r in C.tree_conversations(nodes, current, limit=limit).collect())
    assert got == [("a", 0, "a1"), ("a", 1, "a2"), ("a", 2, "a4"), ("a", 3, "a5")]
    assert C.tree_conversations(nodes.limit(0), current.limit(0)).count() == 0


MESSAGE = "conversation_uuid string, uuid string, sender string, role string, text string, content array<string>, msg_index long, created_at string, client_tz string, locale string, conv_id int"


@pytest.mark.parametrize("limit", [5000, 2])
def test_flat(spark, limit):
    m = lambda c, u, s, i, text="t", role=None, at=None, content=None: (c, u, s, role, text, content, i, at, None, None, 0)
    rows = [m("a", "a0", "Human", 0), m("a", "a1", None, 1, role="assistant", text="", content=["x", None]), m("a", "a1", None, 1, role="assistant", text="", content=["x", None])]
    rows += [m("b", "b0", "human", 0), m("b", "b1", "assistant", 2)]  # a position is missing
    rows += [m("c", "c0", "human", 0), m("c", "c1", "", 1)]  # nobody said it
    rows += [m("d", "d1", "assistant", None, at="2024-01-01T00:00:02Z"), m("d", "d0", "human", None, at="2024-01-01 00:00:01"), m("d", "d2", "human", None, text=" ", at="2024-01-01T00:00:03Z")]
    rows += [m("e", "e0", "human", 0), m("e", "e1", "human", 1), m("e", "e2", "assistant", 2), m("g", "g0", "human", None, at="?"), m("g", "g1", "assistant", None, at="2024-01-01"), m(None, "x", "human", 0), m("h", "h0", "human", 0, text=None)]
    df = spark.createDataFrame(rows, MESSAGE)
    got = sorted(tuple(r) for r in C.flat_conversations(df, limit=limit).collect())
    assert got == [("a", 0, "a0"), ("a", 1, "a1"), ("d", 0, "d0"), ("d", 1, "d1")]
    assert C.flat_conversations(df.limit(0)).count() == 0


ODD = ["", None, " ", "don't re've  x'll 你好 世界 \U0001f469‍\U0001f52c  x   ", "a" * 40000, "é　 a   b c\n\nd e  f" * 400, "word " * 9000, "<|endoftext|> x", "\x1c\x1dx\x85y"]


def test_encoding_equals_whole_texts(spark):
    with open(K.VOCABULARY, "rb") as f:
        encoder = K._encoder(f.read())
    rng = random.Random(0)
    letters = "abc de fgh ij'k l.m\n12 é"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6000))) for _ in range(30)]
    texts += [texts[-1][:3000] + texts[-2], texts[-1]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "again")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in K.encode_corpus(df).collect()}
    assert K.encode_corpus(df).count() == len(texts) and K.encode_corpus(df.limit(0)).count() == 0
    for i, t in enumerate(texts):
        assert got[i] == (encoder.coder.encode_ordinary(t) if t else []), i


def test_joins_at_any_place():
    with open(K.VOCABULARY, "rb") as f:
        encoder = K._encoder(f.read())
    rng = random.Random(3)
    for text in [t for t in ODD if t] * 3:
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(9))})
        pieces = [encoder.encode(text[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert encoder.join(pieces).tolist() == encoder.coder.encode_ordinary(text)


PROSE = "When Ada arrived in the harbour, the lantern had already been repaired. Nobody asked why the keeper was so late that evening. We counted forty boats before the rain came down again."
SPAM = {
    "tags": "Tags: " + ", ".join(["OUTLET", "lamp deal", "cheap lamp", "lamp", "FREE", "lamp shop"] * 9),
    "links": "\n".join(f"- [lamp {i}](https://x{i}.test/a/b?id={i})" for i in range(20)),
    "hashtags": " ".join(f"#{w}" for w in ["lamp", "deal", "shop", "new"] * 12),
    "sentences": " ".join(["Lamp deal cheap with lamp rated.", "Rated lamp for deal perfume.", "Deal rated on lamp shoes.", "Lamp at deal lamp mattress."] * 9),
    "stock": "\n".join(f"SKU {1000 + i} lamp deal {['red', 'XL', 'S'][i % 3]} {i}.99" for i in range(25)),
    "html": "<ul>" + "".join(f'<li><a href="https://x{i}.test/p">lamp deal shop</a></li>' for i in range(20)) + "</ul>",
    "chat": "**User:** lamp deal\n\n**Assistant:** " + "\n".join(f"lamp {x} deal" for x in "shop new free best fast price near offer sale store top".split()) + "\n" + "deal lamp\n" * 9,
    "mixed": PROSE[:72] + "\n\n" + "; ".join(["lamp deal shop", "deal lamp", "lamp", "cheap lamp"] * 15),
}
FINE = {
    "prose": PROSE, "sources": PROSE * 4 + "\n\nSources:\n1. https://a.test/x\n2. https://b.test/y", "tagged": PROSE * 3 + "\n\n#lamp #harbour", "checklist": "\n".join(f"- [x] {s}." for s in (PROSE * 3).split(". ")),
    "glossary": "\n".join(f"**Term{i}** – {s}." for i, s in enumerate((PROSE * 3).split(". "))), "refrain": "\n".join([PROSE, "The lantern burns."] * 12), "transcript": "\n".join(f"{9 + i}:00 {s}." for i, s in enumerate((PROSE * 3).split(". "))),
    "json": '[{"role": "user", "content": "' + PROSE + '"}, {"role": "assistant", "content": "' + PROSE + '"}]', "short": "Thanks for the lamp.",
}


def test_spam_pages(spark, sf_dir):
    texts = {**SPAM, **FINE, "blank": " \n\t", "empty": "", "null": None}
    names = list(texts)
    df = spark.createDataFrame([(i, texts[n], "s") for i, n in enumerate(names)] + [(0, texts[names[0]], "s")], "doc_id long, text string, shape string")
    background = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet").selectExpr("-1 - doc_id as doc_id", "text", "source as shape")
    got = [r["doc_id"] for r in S.spam_pages(df.unionByName(background)).collect() if r["doc_id"] >= 0]
    assert sorted(names[i] for i in got) == sorted(SPAM) and len(got) == len(set(got))
    assert S.spam_pages(df.limit(0)).count() == 0


FOREIGN = {
    "ru": "Сегодня утром мы долго гуляли по набережной. Потом пошёл сильный дождь, и нам пришлось вернуться домой. Вечером сестра приготовила ужин, а брат читал вслух старую книгу. Завтра мы снова пойдём к реке.",
    "zh": "今天早上我们在河边散步了很久。后来下起了大雨，我们只好回家。晚上妹妹做了晚饭，弟弟大声读了一本旧书。明天我们还要再去河边。",
    "tr": "Bu sabah sahilde uzun süre yürüdük. Sonra şiddetli yağmur başladı ve eve dönmek zorunda kaldık. Akşam kız kardeşim yemek yaptı, erkek kardeşim eski bir kitabı yüksek sesle okudu. Yarın tekrar nehre gideceğiz.",
    "pl": "Dziś rano długo spacerowaliśmy po nabrzeżu. Potem zaczął padać deszcz i musieliśmy wrócić do domu. Wieczorem siostra ugotowała kolację, a brat czytał na głos starą książkę. Jutro znowu pójdziemy nad rzekę.",
    "pt": "Hoje de manhã passeamos muito tempo pelo cais. Depois começou a chover e tivemos de voltar para casa. À noite a irmã fez o jantar e o irmão leu em voz alta um livro antigo. Amanhã voltaremos ao rio.",
    "it": "Stamattina abbiamo passeggiato a lungo sul molo. Poi è cominciato a piovere e siamo dovuti tornare a casa. La sera mia sorella ha preparato la cena e mio fratello ha letto ad alta voce un vecchio libro. Domani torneremo al fiume.",
}


def test_prose_of_languages_the_corpus_hardly_has(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(-1 - i, t * 3) for i, t in enumerate(FOREIGN.values())]
    stuffed = [(-100 - i, " ".join(random.Random(i).choice("lantern cheap bridge buy harbour price deal".split()) for _ in range(150))) for i in range(3)]
    got = {r["doc_id"] for r in S.spam_pages(docs.unionByName(spark.createDataFrame(extra + stuffed, docs.schema))).collect()}
    assert not got & {i for i, _ in extra} and {i for i, _ in stuffed} <= got
    assert not S.spam_pages(spark.createDataFrame(extra, docs.schema)).count()


def test_few_shapes_decide(spark, monkeypatch):
    rng = random.Random(2)
    odd = []
    for n in (0, 2, 6, 20):
        for end in (".", ""):
            for links in (1, 2):
                for head in ("Aa", "bb"):
                    odd.append(" ".join([head] * (n > 0) + [f"q{rng.random()}" for _ in range(n)] + [f"https://{rng.random()}.test/x"] * (links * (1 + n // 3))) + end)
    page = [(1, "\n".join(line for o in odd for line in [o] * (3000 // (len(o) + 1)))), (2, "\n".join(f"lamp {i} https://a{i}.test/x" for i in range(40)))]
    df = spark.createDataFrame(page, "doc_id long, text string")
    assert [r["doc_id"] for r in S.spam_pages(df).collect()] == [2]
    monkeypatch.setattr(S, "NEARLY_ALL", 0.0)
    assert sorted(r["doc_id"] for r in S.spam_pages(df).collect()) == [1, 2]


def test_registered_queries_run(spark, sf_dir):
    from corpusloom.llm.registry import llm_queries

    columns = {"p1_found": {"id_a", "id_b"}, "p2_found": {"kept_rowid", "new_rowid"}, "p3_found": {"platform", "conv_id", "turn", "msg_id"}, "p5_found": {"name_a", "name_b"}, "p6_ids": {"doc_id", "ids"}, "p7_found": {"doc_id", "item_id"}, "p8_found": {"doc_id"}}
    for name, query in llm_queries().items():
        df = query(spark, sf_dir)
        assert set(df.columns) == columns.get(name, set(df.columns))
        assert df.count() > 0, name
