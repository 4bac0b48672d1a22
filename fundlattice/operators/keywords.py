"""JOIN-11, SRC-10, SRC-17: names that contain one of many keywords, found by an index of short strings instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct strings of `size` characters in text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda k: F.substring(text, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def keyword_matches(names: DataFrame, keywords: DataFrame, name_col: str = "name", keyword_col: str = "keyword", size: int = GRAM) -> DataFrame:
    """Every (name, keyword) where the name contains the keyword, with the columns of both; case matters.

    A name that contains a keyword contains all its grams, so each keyword stands under that of its grams which the fewest
    names have, names under all of theirs, and both meet in an equi-join that `contains` confirms. Names and grams are counted once; hot grams
    have no keywords but those made of nothing rarer. A keyword shorter than a gram is its own gram. Null and empty keywords match nothing.
    """
    texts = names.select(name_col).where(F.col(name_col).isNotNull()).distinct()
    words = keywords.select(keyword_col).where(F.length(keyword_col) > 0).distinct()
    least = words.agg(F.least(F.min(F.length(keyword_col)), F.lit(size))).first()[0]
    if least is None:
        return names.limit(0).crossJoin(keywords.limit(0))
    of_names = texts.select(name_col, F.explode(F.array_union(grams(F.col(name_col), size), F.flatten(F.array(*[grams(F.col(name_col), k) for k in range(least, size)], F.array().cast("array<string>"))))).alias("_gram"))
    counts = of_names.groupBy("_gram").count()
    of_words = words.select(keyword_col, F.explode(F.when(F.length(keyword_col) < size, F.array(keyword_col)).otherwise(grams(F.col(keyword_col), size))).alias("_gram"))
    sized = of_words.join(counts, "_gram", "left").groupBy(keyword_col).agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "_gram")).alias("_rarest"))
    chosen = sized.where(F.col("_rarest.count") > 0).select(keyword_col, F.col("_rarest._gram").alias("_gram"))
    found = of_names.join(chosen, "_gram").where(F.contains(name_col, keyword_col)).select(name_col, keyword_col)
    return names.join(found, name_col).join(keywords, keyword_col)


def first_match(names: DataFrame, keywords: DataFrame, name_col: str = "name", keyword_col: str = "keyword", order_col: str = "ord", size: int = GRAM) -> DataFrame:
    """names with the keyword of the smallest order (ties: the first of the alphabet) that each contains, or null."""
    texts = names.select(name_col).distinct()
    found = keyword_matches(texts, keywords.select(keyword_col, order_col), name_col, keyword_col, size).groupBy(name_col).agg(F.min(F.struct(order_col, keyword_col)).alias("_first"))
    return names.join(found.select(name_col, F.col("_first")[keyword_col].alias(keyword_col)), name_col, "left")
