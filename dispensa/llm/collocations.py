"""Phrase collocations by set-oriented relational mining, SETM (operator 12).

The occurrence relation of length k, (row, at, id), says which frequent phrase of k words begins at a
position of a row; positions jump at the ends of pieces, so that adjacent ones are always of one piece. It is
persisted as a table bucketed by row and sorted by row and position. Two occurrences of length k at adjacent positions are one of
length k + 1: a merge join of the relation with itself, which shuffles nothing as rows stay in their bucket. Groups of (left id, right id)
are counted, and a semi-join keeps the occurrences of frequent groups, which get ids of their own, before the next length.
Only words that are frequent enter the first relation, since no phrase is more frequent than its parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import parts
from .state import delete, materialise, shared_dir

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = ".,;:!?\n\x0b\x0c\r"  # a piece ends at each of these
FEW = 200_000  # frequent groups (of about 80 bytes) that are broadcast; rows of others are joined by shuffle
SALTS = 16  # parts that a language's candidates are dealt to for its best


def tokens(text: Column) -> Column:
    """Words and, as ``\\n``, ends of pieces; some are empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), CAPITALS + ENDS + "\t", SMALL + "\n" * len(ENDS) + " ")
    return F.split(F.replace(plain, F.lit("\n"), F.lit(" \n ")), " +")


def is_word(word: str) -> Column:
    return ~F.col(word).isin("", "\n")


def small(table: DataFrame, few: int) -> DataFrame:
    """table, to be broadcast if it is counted to have at most ``few`` rows."""
    return F.broadcast(table) if table.limit(few + 1).count() <= few else table


class Relations:
    """The persisted occurrence relations of a run: tables in the shared folder, bucketed by row, sorted by row and position."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def store(self, rows: DataFrame) -> DataFrame:
        name = f"occurrences_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        self.names.append((name, path))
        rows.write.bucketBy(self.buckets, "row").sortBy("row", "at").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name, path in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)


@contextmanager
def bucketed_joins(spark: SparkSession) -> Iterator[None]:
    """Let a join on row and position use tables that are bucketed by row alone."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequent_words(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, n): words found ``least`` times or more in their language, and for word null what all others come to."""
    words = docs.select("lang", F.explode(tokens(F.col("text"))).alias("word")).where(is_word("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return counts.groupBy("lang", F.when(F.col("n") >= least, F.col("word")).alias("word")).agg(F.sum("n").alias("n"))


def keep_frequent(rows: DataFrame, frequent: DataFrame, keys: list[str], buckets: int, few: int = FEW) -> DataFrame:
    """(row, at, id) for the rows whose keys are those of a group of frequent(keys, id, a).

    The ``few`` most frequent groups are broadcast, and their rows stay where they are. Only where there are more groups are the other
    rows shuffled to them, and back to their bucket; none of these groups is hot.
    """
    groups = frequent.select(*keys, "id", "a")
    if groups.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(groups), keys).select("row", "at", "id")
    common = materialise(groups.orderBy(F.desc("a"), "id").limit(few))
    near = rows.join(F.broadcast(common), keys).select("row", "at", "id")
    rest = rows.join(F.broadcast(common), keys, "left_anti").hint("merge").join(groups.join(F.broadcast(common.select("id")), "id", "left_anti"), keys)
    return near.unionByName(rest.select("row", "at", "id").repartition(buckets, "row"))


def longer(occurrences: DataFrame) -> DataFrame:
    """(row, at, left, right): occurrences at adjacent positions of a row, by a merge join."""
    a = occurrences.select("row", "at", F.col("id").alias("left"))
    b = occurrences.select("row", (F.col("at") - 1).alias("at"), F.col("id").alias("right"))
    return a.hint("merge").join(b, ["row", "at"])


def grown(pairs: DataFrame, shorter: DataFrame, least: int) -> DataFrame:
    """Frequent groups of pairs: (id, lang, words, a, before, after, left, right); before and after: counts of both parts of each cut."""
    counts = pairs.groupBy("left", "right").agg(F.count("*").alias("a")).where(F.col("a") >= least)
    one = shorter.select(F.col("id").alias("left"), "lang", F.col("words").alias("lw"), F.col("a").alias("la"), F.col("before").alias("lb"))
    two = shorter.select(F.col("id").alias("right"), F.col("words").alias("rw"), F.col("a").alias("ra"), F.col("after").alias("rb"))
    both = materialise(counts).join(one, "left").join(two, "right")
    words = F.concat("lw", F.slice("rw", -1, 1))
    found = both.select("lang", words.alias("words"), "a", F.concat("lb", F.array("la")).alias("before"), F.concat(F.array("ra"), "rb").alias("after"), "left", "right")
    return materialise(found.withColumn("id", F.monotonically_increasing_id()))  # written once, so ids stay


def swallowed(phrases: DataFrame, percent: int) -> DataFrame:
    """Ids of the phrases, one word shorter, that are inside one of these and hardly ever outside.

    It is enough to look one word further: whatever is between a phrase and a longer one is at least as frequent as the longer one.
    """
    inside = lambda part, count: phrases.where(100 * F.col("a") >= percent * count).select(F.col(part).alias("id"))
    return inside("left", F.element_at("before", -1)).union(inside("right", F.col("after")[0])).distinct()


SCORE = """array_min(transform(before, (l, i) -> named_struct('score', (1000BD * cast(a AS decimal(19, 0)) * cast(n AS decimal(19, 0)))
    div (cast(l AS decimal(19, 0)) * cast(after[i] AS decimal(19, 0))), 'k', i, 'l', l, 'r', after[i])))"""


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, percent: int = 100, top: int = 2000, lang: str = "lang", text: str = "text", few: int = FEW) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``most_words`` words by score.

    Texts with A-Z lower-cased are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these into words ``[^\\x20\\x09]+``. In a language (null: ``und``) n counts all
    words, a the occurrences of a phrase within pieces, overlaps included; phrases found fewer than ``least`` times are no
    candidates. Cutting a phrase in two parts found l and r times scores floor(1000 * a * n / (l * r)) in exact
    arithmetic; its lowest cut counts, of equal ones the first. A candidate inside a longer one with 100 * a of
    the longer at least ``percent`` * a is left out. Order: score descending, a descending, phrase by its bytes. Null and empty texts have no words; repeated
    rows count each; other columns are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted = materialise(frequent_words(own, least))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    none = F.array().cast("array<bigint>")
    phrases = materialise(counted.where("word is not null").select("lang", "word", F.array("word").alias("words"), F.col("n").alias("a"), none.alias("before"), none.alias("after")).withColumn("id", F.monotonically_increasing_id()))
    relations = Relations(spark, parts(own))
    try:
        with bucketed_joins(spark):
            # Texts are dealt to buckets before they are taken apart: the only time that occurrences are moved.
            rows = own.withColumn("row", F.monotonically_increasing_id()).repartition(relations.buckets, "row")
            words = rows.select("row", "lang", F.posexplode(tokens(F.col("text"))).alias("at", "word")).where(is_word("word"))
            occurrences = relations.store(keep_frequent(words, phrases, ["lang", "word"], relations.buckets, few))
            levels = []
            for k in range(2, most_words + 1):
                pairs = longer(occurrences)
                phrases = grown(pairs, phrases, least)
                levels.append(phrases)
                if not phrases.limit(1).count():
                    break
                if k < most_words:
                    occurrences = relations.store(keep_frequent(pairs, phrases, ["left", "right"], relations.buckets, few))
    finally:
        relations.drop()
    kept = [x.join(swallowed(y, percent), "id", "left_anti") for x, y in zip(levels, levels[1:], strict=False)] + levels[-1:]
    found = kept[0].select("lang", "words", "a", "before", "after")
    for x in kept[1:]:
        found = found.unionByName(x.select(found.columns))
    best = found.join(small(totals, few), "lang").withColumn("cut", F.expr(SCORE)).select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    done = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return done.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
