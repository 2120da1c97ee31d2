"""Sentiment of ticket texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions import lexicon, roles
from ebbline.operators.phrases import means_by_table, stage

#: A lexicon of at most so many bytes goes to every task.
BROADCAST_BYTES = 16 << 20
WORD = r"[\p{L}']+"


def _lookup(weights: Mapping[str, float], word: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for word_, weight in weights.items() for x in (word_, float(weight))])
    return F.coalesce(F.try_element_at(table, word), F.lit(default))


def text_sentiment(
    df: DataFrame,
    text: str = "ticket_text",
    output: str = roles.SENTIMENT_COL,
    *,
    polarity: Mapping[str, float] = lexicon.POLARITY,
    intensifiers: Mapping[str, float] = lexicon.INTENSIFIERS,
    negators: Sequence[str] = lexicon.NEGATORS,
) -> DataFrame:
    """Add the mean polarity of the lexicon words of each text, 0 without any.

    A word counts polarity × (weight of an intensifier before it) × -0.5 after
    a negator (directly, or before the intensifier), limited to [-1, 1].  The
    score is a function of the row alone: no join, no shuffle, whole texts.
    """
    words = df.withColumn("_words", F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))
    known = list(polarity)
    positions = F.filter(
        F.transform("_words", lambda word, i: F.when(word.isin(known), i)), lambda i: i.isNotNull()
    )
    hits = words.withColumn("_hits", positions)
    all_words = F.col("_words")

    def word_at(i: Column) -> Column:
        return F.coalesce(F.get(all_words, i), F.lit(""))

    def score(i: Column) -> Column:
        before, second = word_at(i - 1), word_at(i - 2)
        intensified = before.isin(list(intensifiers))
        negated = before.isin(list(negators)) | (intensified & second.isin(list(negators)))
        value = (
            _lookup(polarity, word_at(i), 0.0) * _lookup(intensifiers, before, 1.0)
            * F.when(negated, F.lit(lexicon.NEGATION)).otherwise(F.lit(1.0))
        )
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))

    total = F.aggregate("_hits", F.lit(0.0), lambda acc, i: acc + score(i))
    mean = F.when(F.size("_hits") > 0, total / F.size("_hits")).otherwise(F.lit(0.0))
    return hits.withColumn(output, F.when(F.col(text).isNull(), F.lit(0.0)).otherwise(mean)).drop("_words", "_hits")


def words_of(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def text_sentiment_by_table(
    df: DataFrame,
    entries: DataFrame,
    text: str = "ticket_text",
    output: str = roles.SENTIMENT_COL,
    *,
    intensifiers: Mapping[str, float] = lexicon.INTENSIFIERS,
    negators: Sequence[str] = lexicon.NEGATORS,
) -> DataFrame:
    """As ``text_sentiment``, with a lexicon that is a table (entry, weight) of any size, whose entries may be of several words.

    An entry inside a longer one that is found there does not count.  Entries are compared word by word in lower case; of
    equal ones the greatest weight counts.  An intensifier or negator acts on the entry that follows it.

    Of a table that is measured to be small, which is broadcast, words are exploded with their places and joined to it, and
    only entries that are found are shuffled, once, by their text.  For a larger one the phrases of blocks of texts are looked
    up, each once a block (``phrases``), and no row for each word is shuffled or sorted.
    """
    listed = entries.select(words_of(F.col("entry")).alias("words"), F.col("weight").cast("double").alias("weight")).where(F.size("words") > 0)
    listed = listed.groupBy(F.array_join("words", " ").alias("entry"), F.size("words").alias("n")).agg(F.max("weight").alias("weight"))
    listed = stage(listed, "lexicon")
    size = listed.agg(F.collect_set("n").alias("lengths"), F.sum(F.octet_length("entry") + 40).alias("bytes")).first()
    longest = max(size["lengths"], default=1)

    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    words = rows.select("_row", words_of(F.col(text)).alias("words"))
    if (size["bytes"] or 0) > BROADCAST_BYTES:
        known = listed.withColumn("weight", F.coalesce("weight", F.lit(float("nan"))))  # as greatest and least take null
        means = means_by_table(words, known, size["bytes"], sorted(size["lengths"]), intensifiers, negators, lexicon.NEGATION)
        return rows.join(means, "_row", "left").withColumn(output, F.coalesce("_mean", F.lit(0.0))).drop("_row", "_mean")

    def phrases(at: Column) -> Column:
        """The phrases of a text that begin at a place; each word is read by its place, and none brings the whole text along."""
        before, second = (F.coalesce(F.get("words", at - k), F.lit("")) for k in (1, 2))
        intensified = before.isin(list(intensifiers))
        factor = _lookup(intensifiers, before, 1.0) * F.when(before.isin(list(negators)) | (intensified & second.isin(list(negators))), F.lit(lexicon.NEGATION)).otherwise(F.lit(1.0))
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - at)), lambda n: F.struct(
            at.alias("at"), factor.alias("factor"), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get("words", at + k)), " ").alias("entry"),
        ))

    tried = words.select("_row", F.inline(F.flatten(F.transform("words", lambda _, at: phrases(at)))))
    found = tried.join(F.broadcast(listed), "entry").select("_row", "at", (F.col("at") + F.col("n")).alias("end"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("weight") * F.col("factor"))).alias("score"))
    earlier = Window.partitionBy("_row").orderBy("at", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = found.withColumn("covered", F.max("end").over(earlier)).where("covered IS NULL OR covered < end")
    means = outer.groupBy("_row").agg(F.avg("score").alias("_mean"))
    return rows.join(means, "_row", "left").withColumn(output, F.coalesce("_mean", F.lit(0.0))).drop("_row", "_mean")


def sentiment_summary(
    df: DataFrame, score: str = roles.SENTIMENT_COL, target: str = roles.TARGET_COL
) -> DataFrame:
    """Shares of negative, neutral and positive texts in percent, means overall and by label."""
    value, label = F.col(score), F.col(target)
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("texts"),
        (F.count_if(value < -0.1) * 100 / rows).alias("negative_pct"),
        (F.count_if((value >= -0.1) & (value <= 0.1)) * 100 / rows).alias("neutral_pct"),
        (F.count_if(value > 0.1) * 100 / rows).alias("positive_pct"),
        F.avg(value).alias("mean_polarity"),
        F.avg(F.when(label == "Yes", value)).alias("churned_mean"),
        F.avg(F.when(label == "No", value)).alias("retained_mean"),
    )
