"""Substring search on grams, and functions of the caller."""

import random

import pytest
from pyspark.sql import functions as F

from memlens import fixed_values as V
from memlens.functions import user as U
from memlens.operators import evidence as E
from memlens.operators import grams as G
from memlens.operators import retrieval as R


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contained_words(spark, seed):
    """Few letters, so that grams are common and overlap themselves; signs outside ASCII and beyond 16 bits."""
    rng = random.Random(seed)
    letters = ["ab", "abé", "a😀b "][seed - 1]
    text = lambda n: "".join(rng.choices(letters, k=n))
    texts = [(i, text(rng.randrange(60))) for i in range(60)] + [(99, "a" * 200)]
    words = sorted({text(rng.randrange(1, 14)) for _ in range(150)} | {"a" * 9, "aaaab"})
    found = G.contained(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(texts, "item_id long, hay string"), "item_id", "hay")
    assert sorted((r.word, r.item_id) for r in found.collect()) == sorted((w, i) for w in words for i, t in texts if len(w) >= G.GRAM and w in t)


def test_places_of_short_and_long_texts(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "abcd"), (5, "xy" * 20_000)], "id long, t string")
    got = {r.id: r.n for r in rows.select("id", F.size(G.gram_places(F.col("t"))).alias("n")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 39_997} or got == {1: 0, 2: 0, 3: -1, 4: 1, 5: 39_997}


def test_arguments_that_share_characters_with_memory(spark):
    calls = spark.createDataFrame([(1, "edit SRC/parser.py now"), (1, "short"), (2, "nothing alike"), (3, None)], "query_id long, arg_summary string")
    recalled = spark.createDataFrame([(1, 10, "see src/parser", "ok"), (1, 11, "src/pa", None), (1, 12, "src/p", "arser"), (2, 10, "see src/parser", "ok"), (3, 10, "x", "y")],
                                     "query_id long, item_id long, unlock string, verification string")
    assert sorted((r.query_id, r.item_id) for r in E.args_match_memory(calls, recalled).collect()) == [(1, 10), (1, 11)]


def test_functions_of_the_caller_and_their_errors(spark):
    def length(text):
        return str(len(text)) if text else None

    def fails(text):
        if "bad" in text:
            raise ValueError("no " + text)
        return text[:2].upper()

    df = spark.createDataFrame([(1, "good one"), (2, "bad one"), (3, None), (4, "")], "id long, text string").withColumn("extra", F.lit("kept"))
    got = {r.id: (r.extra, r.custom, r.custom_errors) for r in U.user_features(df, "text", {"n": length, "head": fails}).collect()}
    assert got == {1: ("kept", {"n": "8", "head": "go"}, {}), 2: ("kept", {"n": "7"}, {"head": "ValueError: no bad one"}), 3: ("kept", {}, {}), 4: ("kept", {}, {})}


def test_custom_features_weigh_in_structural_similarity(spark):
    none = (None, "py", None, None, [])
    rows = [(none, none, {"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": ""}), (none, none, None, None), (none, none, {"a": "1"}, None)]
    kind = "struct<error_type:string,language:string,framework:string,file_extension:string,keywords:array<string>>"
    df = spark.createDataFrame(rows, f"qf {kind}, tf {kind}, x map<string,string>, y map<string,string>")
    weights = {**V.STRUCTURAL_WEIGHTS, "b": 6.0}
    got = [r.s for r in df.select(R.structural(weights=weights, custom=(F.col("x"), F.col("y"))).alias("s")).collect()]
    assert got == pytest.approx([(2 + 2) / (2 + 2 + 6), 1.0, 2 / 4])
