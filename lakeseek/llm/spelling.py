"""Spelling variant grouping by pivotal grams.

A word's bigrams are put in one order for all words, rarest first. Its gram prefix is the first three of them (one
edit changes at most two bigrams, so of three one is left), and its pivots are two bigrams of the prefix that
share no letter, of least total count, found by dynamic programming. One edit can't reach both pivots. Of two words
one edit apart, take the one whose prefix ends earlier in the order: one of its pivots is also in the other's prefix.

Position limits make the lists short: with one edit in all, a pivot that it left alone stands at the same place
and all letters before it are the same too, or it stands at the same distance from the end and all letters behind
it are the same. So pivots and prefixes meet by an equi-join on (letters up to and with the gram, length), or (gram
and the letters behind it, length). Which candidates are one edit apart is then settled by edit distance.

Forms are followed to their root by pointer doubling; a form occurs five times as often as its word, so paths are
short whatever the table's size.

Defined cases: null and empty texts, and those without letters, give no words; a null id is written ``null`` in the
checksum; repeated rows count again; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm.common import bounded_batches, read_table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_LETTERS = "[^a-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: One occurrence in so many loses a letter.
DROPPED = 199
GRAM, EDITS = 2, 1


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run: the maximal runs of letters of at least LEAST_LETTERS, A-Z lower-cased, repeats included."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # outer: else the optimiser infers a filter on the list's size, and splits every text twice
    found = docs.select("doc_id", F.explode_outer(F.split(text, NOT_LETTERS)).alias("run"))
    return found.where(F.length("run") >= LEAST_LETTERS)


def dropped_letters(found: DataFrame, one_in: int = DROPPED) -> Column:
    """The run, or, where its checksum with the document's id is a multiple of ``one_in``, the run without one letter."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))


def counted(words: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough; counts are summed before the shuffle."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def gram_order(vocabulary: DataFrame) -> dict[str, int]:
    """Place of each bigram in the common order, rarest first.

    There are at most 90 squared bigrams of the letters a word may have, so the table is small whatever the corpus.
    """
    grams = vocabulary.select(F.explode_outer(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(GRAM)))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count("*").alias("c")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["c"], r["gram"])))}


def pivots(spots: list[int], cost: list[int], need: int = EDITS + 1) -> list[int]:
    """``need`` of the rising positions ``spots``, no two grams overlapping, of least total cost.

    best[j] holds the least (cost, positions) of j grams among those up to here; ``ended`` the same among
    those that end before this gram begins.
    """
    best: list[tuple[int, tuple[int, ...]] | None] = [(0, ())] + [None] * need
    waiting: list[tuple[int, list]] = []
    ended = list(best)
    for at, c in zip(spots, cost):
        while waiting and waiting[0][0] + GRAM <= at:
            ended = waiting.pop(0)[1]
        for j in range(need, 0, -1):
            if ended[j - 1] is not None:
                new = (ended[j - 1][0] + c, (*ended[j - 1][1], at))
                if best[j] is None or new < best[j]:
                    best[j] = new
        waiting.append((at, list(best)))
    return list(best[need][1])


def signatures(vocabulary: DataFrame, order: dict[str, int], letters: int = LEAST_LETTERS) -> DataFrame:
    """word, n, pivot, last, side, part, length: twelve rows for a word's pivots, two for each gram of its prefix.

    ``length`` is that of the word looked for, ``last`` the place of the prefix's last gram in the order. A prefix holds
    all repeats of its last gram, since only the gram's place in the order says whether it is in.
    """
    sent = vocabulary.sparkSession.sparkContext.broadcast(order)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = sent.value
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"]):
                ranks = [place[word[i : i + GRAM]] for i in range(len(word) - 1)]
                by_rank = sorted(range(len(ranks)), key=lambda i: (ranks[i], i))
                prefix = sorted(by_rank[: GRAM * EDITS + 1])
                last = ranks[by_rank[GRAM * EDITS]]
                for i in pivots(prefix, [ranks[i] for i in prefix]):
                    for length in range(max(letters, len(word) - EDITS), len(word) + EDITS + 1):
                        rows.append((word, n, True, last, "l", word[: i + GRAM], length))
                        rows.append((word, n, True, last, "r", word[i:], length))
                for i, r in enumerate(ranks):
                    if r <= last:
                        rows.append((word, n, False, last, "l", word[: i + GRAM], len(word)))
                        rows.append((word, n, False, last, "r", word[i:], len(word)))
            yield pd.DataFrame(rows, columns=["word", "n", "pivot", "last", "side", "part", "length"])

    return vocabulary.select("word", "n").mapInPandas(of, "word string, n long, pivot boolean, last int, side string, part string, length int")


def near_pairs(vocabulary: DataFrame, letters: int = LEAST_LETTERS) -> DataFrame:
    """a, n_a, b, n_b (a < b) of all words of ``vocabulary`` (word, n) that one inserted, deleted or replaced letter sets apart."""
    signed = signatures(vocabulary, gram_order(vocabulary), letters).withColumn("key", F.xxhash64("side", "part", "length"))
    signed = written(signed.select("key", "pivot", "last", "word", "n"))
    s, r = signed.where("pivot").alias("s"), signed.where("not pivot").alias("r")
    met = s.join(r, (F.col("s.key") == F.col("r.key")) & (F.col("s.last") <= F.col("r.last")) & (F.col("s.word") != F.col("r.word")))
    near = met.where(F.levenshtein("s.word", "r.word", EDITS) == EDITS)
    first = F.col("s.word") < F.col("r.word")
    return near.select(*[F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(name) for x, y, c, name in (("s", "r", "word", "a"), ("s", "r", "n", "n_a"), ("r", "s", "word", "b"), ("r", "s", "n", "n_b"))]).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form (word, form, n): each round doubles the steps that a pointer takes.

    n grows RATIO-fold with each step, so the rounds needed follow from the greatest n.
    """
    at = forms.select("word", F.col("form").alias("root"))
    steps, reach = 1, forms.agg(F.max("form_n")).first()[0] or 1
    while RATIO**steps <= reach:
        at = written(at)
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        steps *= 2
    return at


def grouped(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocabulary`` (word, n)."""
    pairs = near_pairs(vocabulary)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    # the smallest near word of the greatest n: a word has few near words, and they are reduced before the shuffle
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("b"))
    best = written(best.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.o")).alias("near_n")))
    fits = F.col("near_n") >= ratio * F.col("n")
    told = written(vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")))
    found = roots(told.where("form is not null"))
    return told.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    found = runs(docs)
    return grouped(written(counted(found.select(dropped_letters(found).alias("word")))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return variants(read_table(spark, sf_dir, "documents"))
