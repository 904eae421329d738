"""Keyword search: an inverted index as tables, conjunctive phrases, BM25, snippets.

``postings`` has a row per term and document with its positions, ``lengths`` one per document. Build them once with
:class:`Index`: it is written sorted by term and extended batch by batch, and a query reads the row groups of its own terms
only (the filter on terms reaches the scan). Terms are runs of letters and digits of any script, without case and accents.
Null texts count as empty; empty documents count in the number of documents and the average length.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.stem import stem
from corpusloom.functions.workspace import path_exists

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
META = '"():*+-^~'
TOKEN = re.compile(r"[^\W_]+")


def query_phrases(query: str, stemmed: bool = False) -> list[list[str]]:
    """The phrases of a free-form query, all of which must occur: meta characters are deleted inside terms, and a term that then
    holds several tokens is a phrase of adjacent ones."""
    cleaned = ["".join(c for c in term if c not in META) for term in query.split()]
    return [p for term in cleaned if (p := [stem(t) if stemmed else t for t in plain_tokens(term)])]


def plain_tokens(text: str) -> list[str]:
    folded = unicodedata.normalize("NFKD", text)
    return TOKEN.findall("".join(c for c in folded if not unicodedata.combining(c)).lower())


def _unaccented() -> tuple[str, str]:
    """The precomposed letters of two code points or fewer bytes of Latin, Greek and Cyrillic script, and what is left of each without its marks."""
    pairs = {}
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


def folded_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without accents, by built-in expressions alone."""
    plain = F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), *_unaccented())), r"\p{M}+", "")
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def stemmed_tokens(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens) with case and accents folded and words stemmed."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [[stem(t) for t in plain_tokens(x or "")] for x in batch["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_key"], pa.array(tokens, pa.list_(pa.string()))], [key, "tokens"])

    return documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"{key} {kind}, tokens array<string>")


def index(tokens: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a table (key, tokens)."""
    exploded = tokens.select(key, F.posexplode("tokens").alias("pos", "term"))
    postings = exploded.groupBy(key, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return postings, tokens.select(key, F.size("tokens").alias("dl"))


class Index:
    """An index on disk: ``postings`` sorted by term, ``lengths`` and ``totals`` (documents, tokens), a folder a batch.

    Batches hold different documents. A search reads all batches; ``compacted`` merges them into one.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint"):
        self.spark, self.path, self.key, self.kind = spark, path, key, kind

    def _read(self, name: str, schema: str) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", f"term string, {self.key} {self.kind}, tf long, positions array<int>")

    @property
    def lengths(self) -> DataFrame:
        return self._read("lengths", f"{self.key} {self.kind}, dl int")

    @property
    def totals(self) -> DataFrame:
        """(n, avgdl) of all documents, from one row a batch."""
        return self._read("totals", "n long, tokens long").agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))

    def add(self, tokens: DataFrame) -> "Index":
        """Append the documents of a table (key, tokens)."""
        part = uuid.uuid4().hex
        postings, _ = index(tokens, self.key)
        ordered = postings.select("term", self.key, "tf", "positions").repartitionByRange("term").sortWithinPartitions("term", self.key)
        ordered.write.parquet(f"{self.path}/postings/{part}")
        lengths = tokens.select(self.key, F.size("tokens").alias("dl"))
        lengths.write.parquet(f"{self.path}/lengths/{part}")
        written = self.spark.read.schema(lengths.schema).parquet(f"{self.path}/lengths/{part}")
        written.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens")).write.parquet(f"{self.path}/totals/{part}")
        return self

    def compacted(self, path: str) -> "Index":
        """A copy with all batches as one."""
        one = Index(self.spark, path, self.key, self.kind)
        self.postings.repartitionByRange("term").sortWithinPartitions("term", self.key).write.parquet(f"{path}/postings/all")
        self.lengths.write.parquet(f"{path}/lengths/all")
        self._read("totals", "n long, tokens long").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/totals/all")
        return one

    def search(self, phrases: list[list[str]]) -> DataFrame:
        """(key, score), see :func:`search`."""
        return search(self.postings, self.lengths, self.key, phrases, self.totals)


def _shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def phrase_hits(postings: DataFrame, key: str, phrase: list[str]) -> DataFrame:
    """(key, tf): the documents that hold the tokens of a phrase next to each other, and how often."""
    found = postings.where(F.col("term") == phrase[0]).select(key, "tf", F.col("positions").alias("_at"))
    for step, term in enumerate(phrase[1:], 1):
        then = postings.where(F.col("term") == term).select(key, _shifted("positions", step).alias("_then"))
        found = found.join(then, key).select(key, F.array_intersect("_at", "_then").alias("_at")).where(F.size("_at") > 0)
        found = found.select(key, F.size("_at").cast("long").alias("tf"), "_at")
    return found.select(key, "tf")


def search(postings: DataFrame, lengths: DataFrame, key: str, phrases: list[list[str]], totals: DataFrame | None = None) -> DataFrame:
    """(key, score): documents that hold every phrase, by BM25 as full-text engines write it: negative, the least is best."""
    if not phrases:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    stats = totals if totals is not None else lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = postings.where(F.col("term").isin(*{t for p in phrases for t in p}))
    hits = None
    for i, phrase in enumerate(phrases):
        one = phrase_hits(wanted, key, phrase).withColumn("phrase", F.lit(i))
        hits = one if hits is None else hits.unionByName(one)
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(df), "phrase").join(lengths, key).crossJoin(F.broadcast(stats))  # one row of statistics, one per phrase
    return scored.groupBy(key).agg(F.count("*").alias("_n"), (-F.sum(part)).alias("score")).where(F.col("_n") == len(phrases)).select(key, "score")


def snippet(text: str | None, phrases: list[list[str]], words: int = 20, stemmed: bool = True) -> str:
    """A stretch of at most ``words`` words with the query's words in brackets, where most different ones occur first."""
    if not text:
        return ""
    wanted = {t for p in phrases for t in p}
    spans = [(m.start(), m.end(), (stem if stemmed else str)("".join(plain_tokens(m[0])))) for m in TOKEN.finditer(text)]
    if not spans:
        return text
    best = max(range(len(spans)), key=lambda i: (len({t for *_, t in spans[i : i + words]} & wanted), -i))
    best = max(0, min(best, len(spans) - words))
    out, at = [], spans[best][0] if best else 0
    shown = spans[best : best + words]
    for start, end, token in shown:
        out.append(text[at:start] + (f"[{text[start:end]}]" if token in wanted else text[start:end]))
        at = end
    cut = best + words < len(spans)
    return ("…" if best else "") + "".join(out) + ("…" if cut else text[at:])


def with_snippets(hits: DataFrame, documents: DataFrame, key: str, text: str, phrases: list[list[str]]) -> DataFrame:
    """Hits joined with their document's snippet."""
    @F.pandas_udf("string")
    def cut(texts):
        return texts.map(lambda t: snippet(t, phrases))

    return hits.join(documents.select(key, F.col(text).alias("_text")), key).withColumn("snippet", cut("_text")).drop("_text")
