"""Substring search on positional grams.

A text is its runs of ``n`` characters with their places: rows (id, gram, place), grams as 64-bit hashes, no text beside
them.  A needle of at least ``n`` characters is tiled by grams; its rarest tile in the texts proposes places, and the other tiles
must stand at their distances from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlens.functions import text as T

GRAM = 4


def gram_places(text: Column, n: int = GRAM) -> Column:
    """Array of struct(gram, place) over all places of a text, from 1; linear in its length."""
    count = F.length(text) - (n - 1)
    at = lambda chars: F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(F.xxhash64(F.array_join(F.slice(chars, i, F.lit(n)), "")).alias("gram"), i.alias("place")))
    none = F.array().cast("array<struct<gram:bigint,place:int>>")
    return F.when(count >= 1, T.let(F.split(text, ""), at)).otherwise(none)


def index(texts: DataFrame, key: str, text: str, wanted: DataFrame | None = None, n: int = GRAM) -> DataFrame:
    """(key, gram, place) of every text, or of the grams in ``wanted(gram)`` only."""
    rows = texts.select(key, F.explode(gram_places(F.col(text), n)).alias("g")).select(key, "g.gram", "g.place")
    return rows if wanted is None else rows.join(wanted.select("gram").distinct(), "gram", "left_semi").select(key, "gram", "place")


def contained(needles: DataFrame, texts: DataFrame, key: str, text: str, n: int = GRAM) -> DataFrame:
    """(word, key) for every distinct ``needles(word)`` of at least ``n`` characters that a text contains.

    Only the needle's rarest tile opens candidates, so a needle full of common grams costs as much as its rarest one.
    """
    words = needles.select("word").where(F.length("word") >= n).distinct()
    last = F.length("word") - n
    offsets = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.floor(last / n).cast("int")), lambda i: i * n), F.array(last)))
    tiles = words.select("word", F.size(offsets).alias("tiles"), F.explode(offsets).alias("offset")).withColumn("gram", F.xxhash64(F.substring("word", F.col("offset") + 1, F.lit(n))))
    rows = index(texts, key, text, tiles, n)
    rarity = rows.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = tiles.join(rarity, "gram").groupBy("word", "tiles").agg(F.min(F.struct("df", "offset", "gram")).alias("best"), F.count("*").alias("known"))
    start = ranked.where("known = tiles").select("word", "tiles", F.col("best.gram").alias("gram"), F.col("best.offset").alias("from"))
    opened = start.join(rows, "gram").select("word", "tiles", "from", key, (F.col("place") - F.col("from")).alias("at")).where("at >= 1")
    rest = opened.join(tiles.drop("tiles"), "word").where("offset <> from").select("word", "tiles", key, "at", "gram", (F.col("at") + F.col("offset")).alias("place"))
    full = rest.join(rows, [key, "gram", "place"]).groupBy("word", "tiles", key, "at").agg(F.count("*").alias("met")).where("met = tiles - 1")
    return full.select("word", key).unionByName(opened.where("tiles = 1").select("word", key)).distinct()
