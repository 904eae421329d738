"""Variant spellings of the names of persons and organisations.

Each distinct string is rewritten into canonical forms by rules for titles, case, accents, transliteration, nicknames,
initials, legal forms, abbreviations and token order (:mod:`name_rules`). Forms are exploded and equi-joined:

1. Strings with the same canonical tokens are one full name.
2. Full names that share a deletion form differ by typing errors; the one with less support becomes a slip of the
   one with more, unless each is made of established words.
3. Strings that say less than a full name (an initial, a bare surname, an ambiguous nickname, an abbreviation, an
   acronym) carry keys that full names carry as well. A key is worth the more the fewer full names it leads to: it is
   followed only where the nearest match is a single one, so relatives and namesakes stay apart. Strings that lead to no full
   name are linked among themselves by equal keys.

Null names and strings without letters are left out; strings whose mentions are mostly typed as concepts are no case; a
null or unknown type says nothing. Rows that come twice change only the support.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.workspace import materialise
from corpusloom.llm.name_rules import deletions, full_keys, near_forms, rewrite, same_but_for_typing, typing_errors

#: A word in so many full names is a word of its own.
ESTABLISHED = 3
STRINGS = pa.list_(pa.string())


def mentions(extractions: DataFrame) -> DataFrame:
    """(name, mentions, named, concept) of every distinct string in entities and relations."""
    kind = F.lower(F.substring(F.btrim("x.entity_type"), 1, 3))
    entities = extractions.select(F.explode("entities").alias("x")).select(F.col("x.name").alias("name"), kind.isin("per", "org").alias("named"), kind.isin("con").alias("concept"))
    ends = extractions.select(F.explode("relations").alias("x")).select(F.explode(F.array("x.source", "x.target")).alias("name"), F.lit(None).cast("boolean").alias("named"), F.lit(None).cast("boolean").alias("concept"))
    return entities.unionByName(ends).where("name is not null").groupBy("name").agg(
        F.count("*").alias("mentions"), F.count_if("named").alias("named"), F.count_if("concept").alias("concept")
    )


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, tokens, keys = zip(*(rewrite(n) for n in batch["name"].to_pylist())) if len(batch) else ((), (), ())
        columns = [batch[c] for c in ("name", "mentions", "named", "concept")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(kinds, pa.string()), pa.array(tokens, STRINGS), pa.array(keys, STRINGS)], ["name", "mentions", "named", "concept", "kind", "tokens", "keys"]
        )


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _exploded(source: str, forms):
    """Rows (form, owner, ...) of the forms that a function makes of each row's list."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_form, out_owner, out_key = [], [], []
            for owner, items in zip(batch["owner"].to_pylist(), batch[source].to_pylist()):
                for form, key in forms(items):
                    out_form.append(_hash(form)), out_owner.append(owner), out_key.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out_form, pa.int64()), pa.array(out_owner, pa.string()), pa.array(out_key, pa.string())], ["form", "owner", "key"])

    return explode


def _key_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, key): the deletion forms of keys ``prefix|token``."""
    for batch in batches:
        forms, keys = [], []
        for key in batch["key"].to_pylist():
            prefix, _, token = key.rpartition("|")
            for v in deletions(token, 1 if len(token) > 4 else 0):
                forms.append(_hash(f"{prefix}|{v}")), keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.int64()), pa.array(keys, pa.string())], ["form", "key"])


def _full_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owners, keys = [], []
        for owner, tokens in zip(batch["owner"].to_pylist(), batch["tokens"].to_pylist()):
            for key in set(full_keys(tokens)):
                owners.append(owner), keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(keys, pa.string())], ["owner", "key"])


def _slips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("tokens", "tokens2", "seen", "seen2")]
        cost = [same_but_for_typing(a, b, x, y, ESTABLISHED) for a, b, x, y in zip(*columns)]
        yield pa.RecordBatch.from_arrays([batch["owner"], batch["owner2"], pa.array(cost, pa.int32())], ["owner", "hub", "cost"])


def _key_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cost = [typing_errors(a.rpartition("|")[2], b.rpartition("|")[2]) if a.rpartition("|")[0] == b.rpartition("|")[0] else 3 for a, b in zip(batch["key"].to_pylist(), batch["key2"].to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("key", "names", "hub")), pa.array(cost, pa.int32())], ["key", "names", "hub", "cost"])


def link_variants(names: DataFrame) -> DataFrame:
    """(name, entity) of the strings of a table of mentions that name a person or organisation together with others."""
    parsed = materialise(names.mapInArrow(_rewritten, "name string, mentions long, named long, concept long, kind string, tokens array<string>, keys array<string>"), "parsed")
    strings = parsed.where("kind = 'full'").withColumn("owner", F.array_join("tokens", " "))
    full = strings.groupBy("owner").agg(F.first("tokens").alias("tokens"), F.count("*").alias("spellings"), F.sum("mentions").alias("mentions"))
    seen = full.select("owner", F.posexplode("tokens").alias("at", "token"))
    seen = seen.join(seen.groupBy("token").agg(F.count("*").cast("int").alias("n")), "token").groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("seen"))
    full = materialise(full.join(seen, "owner"), "full")

    # Typing errors: pairs that share a deletion form, the weaker first.
    forms = full.select("owner", "tokens").mapInArrow(_exploded("tokens", lambda t: ((f, "") for f in near_forms(t))), "form long, owner string, key string").select("form", "owner")
    forms = materialise(forms, "forms")
    pairs = forms.join(forms.withColumnRenamed("owner", "owner2"), "form").where("owner < owner2").select("owner", "owner2").distinct()
    second = full.select(*(F.col(c).alias(f"{c}2") for c in full.columns))
    pairs = pairs.join(full, "owner").join(second, "owner2")
    costs = pairs.mapInArrow(_slips, "owner string, hub string, cost int").where("cost < 3")
    both = costs.unionByName(costs.select(F.col("hub").alias("owner"), F.col("owner").alias("hub"), "cost"))
    support = full.select("owner", F.struct("spellings", "mentions", "owner").alias("support"), "spellings")
    both = both.join(support, "owner").join(support.select(F.col("owner").alias("hub"), F.col("support").alias("hub_support")), "hub")
    parents = materialise(both.where("support < hub_support").groupBy("owner").agg(F.min_by("hub", F.struct("cost", F.negative("hub_support.spellings"), F.negative("hub_support.mentions"), "hub")).alias("hub")), "parents")
    roots = parents
    while True:  # slips of slips: follow to the strongest, in rounds that double the distance
        above = roots.select(F.col("owner").alias("hub"), F.col("hub").alias("above"))
        if roots.join(above, "hub", "left_semi").isEmpty():
            break
        roots = materialise(roots.join(above, "hub", "left").select("owner", F.coalesce("above", "hub").alias("hub")), "roots")
    entities = full.join(roots, "owner", "left").select("owner", F.coalesce("hub", "owner").alias("entity"), "tokens")
    members = strings.select("name", "owner").join(entities.select("owner", "entity"), "owner").select("name", "entity")

    # Strings that say less: the single nearest full name under any of their keys. Keys are counted before anything is joined, so
    # that a surname which many bear and many ask for is one row on either side.
    weak = parsed.where("kind = 'weak'").select(F.col("name").alias("owner"), "keys")
    asking = weak.select("owner", F.explode(F.array_distinct("keys")).alias("key"))
    hubs = entities.where("owner = entity").select("owner", "tokens").mapInArrow(_full_keys, "owner string, key string")
    offered = materialise(hubs.groupBy("key").agg(F.count("*").alias("names"), F.min("owner").alias("hub")), "offered")
    asked = asking.select("key").distinct().mapInArrow(_key_forms, "form long, key string")
    told = offered.select("key").mapInArrow(_key_forms, "form long, key string").withColumnRenamed("key", "key2")
    met = asked.join(told, "form").select("key", "key2").distinct().join(offered.withColumnRenamed("key", "key2"), "key2")
    led = materialise(met.select("key", "key2", "names", "hub").mapInArrow(_key_errors, "key string, names long, hub string, cost int").where("cost < 2"), "led")
    worth = led.groupBy("key", "cost").agg(F.max("names").alias("names"), F.min("hub").alias("hub"), F.max("hub").alias("other"))
    own = asking.join(worth, "key").groupBy("owner", "cost").agg(F.max("names").alias("names"), F.min("hub").alias("hub"), F.max("other").alias("other"))
    nearest = own.groupBy("owner").agg(F.min_by(F.struct("names", "hub", "other"), "cost").alias("x"))
    attached = nearest.where("x.names = 1 and x.hub = x.other").select(F.col("owner").alias("name"), F.col("x.hub").alias("entity"))
    lone = weak.join(nearest.select("owner"), "owner", "left_anti").select(F.col("owner").alias("name"), F.concat(F.lit("?"), F.element_at("keys", 1)).alias("entity"))
    return materialise(members.unionByName(attached).unionByName(lone), "linked")


def variant_pairs(names: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different strings for one entity that isn't a concept. ``names``: see mentions()."""
    linked = link_variants(names).join(names.select("name", "named", "concept"), "name")
    sound = linked.groupBy("entity").agg(F.sum("named").alias("named"), F.sum("concept").alias("concept"), F.count("*").alias("n")).where("n > 1 and (named > concept or named + concept = 0)")
    linked = linked.select("name", "entity").join(sound.select("entity"), "entity")
    other = linked.select("entity", F.col("name").alias("name_b"))
    return linked.withColumnRenamed("name", "name_a").join(other, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different stored strings (name_a < name_b) that name the same person or organisation."""
    return variant_pairs(materialise(mentions(spark.read.parquet(f"{sf_dir}/extractions.parquet")), "names"))
