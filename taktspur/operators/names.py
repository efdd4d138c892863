"""Names that hold a keyword of a question, for a whole table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import keywords
from ..session import materialized
from .joins import SHARES, lookup


def trigrams(text: Column) -> Column:
    """Distinct stretches of three characters; a shorter text is its own."""
    last = F.greatest(F.char_length(text) - 2, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(3))))


def names_with_words(words: DataFrame, names: DataFrame, word: str, name: str) -> DataFrame:
    """All pairs of a word and a row of ``names`` whose lower-cased name holds it.

    ``words`` has one row per word, lower-cased, of three characters at least; a shorter one is an error.
    A name that holds a word holds all its trigrams. So each
    word asks for the rarest of its trigrams only, which an equi-join with the index of the names
    answers, and the proposals are then tested. Names of a trigram are dealt into parts.
    """
    low = F.lower(name)
    index = materialized(names.where(F.col(name).isNotNull())
                         .select("*", low.alias("_low"), F.explode(trigrams(low)).alias("_gram")))
    often = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    long_enough = F.when(F.char_length(word) >= 3, F.col(word)).otherwise(F.raise_error(F.lit("a word of under three characters")))
    asked = words.select(long_enough.alias(word)).select(word, F.explode(trigrams(F.col(word))).alias("_gram"))
    rarest = (lookup(asked, often, ["_gram"]).groupBy(word)
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("r"))
              .where("r.n > 0").select(word, F.col("r.gram").alias("_gram")))
    parts = rarest.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    proposed = index.withColumn("_share", F.pmod(F.hash(name), F.lit(SHARES))).join(parts, ["_gram", "_share"])
    return proposed.where(F.contains("_low", F.col(word))).select(word, *names.columns)


def match_questions(questions: DataFrame, names: DataFrame, by: list[str], question: str = "question",
                    name: str = "haltestellen_name", rows: str = "n", k: int = 8) -> DataFrame:
    """Per question the k names with most ``rows`` that hold one of its keywords; ties go to the smaller name.

    Gives ``by``, the columns of ``names``, and ``rank``. ``names`` has one row per name. No more than k
    names per word go on, as no others can be among the k of a question, so the join with the
    questions grows with these alone, however often a word is asked or held.
    """
    asked = questions.select(*by, F.explode(F.array_distinct(keywords(question))).alias("_word"))
    found = names_with_words(asked.select("_word").distinct(), names, "_word", name)
    best = Window.partitionBy("_word").orderBy(F.desc(rows), name)
    held = (found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
            .groupBy("_word").agg(F.collect_list(F.struct(*names.columns)).alias("_names")))
    hits = (lookup(asked, held, ["_word"]).select(*by, F.explode("_names").alias("_name"))
            .select(*by, "_name.*").dropDuplicates([*by, name]))
    order = Window.partitionBy(*by).orderBy(F.desc(rows), name)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
