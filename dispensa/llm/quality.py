"""Quality rules with adaptive thresholds (operator 7): DataFrame functions only.

Ratios of each document are put into quantile sketches per language, source and salt; sketches
merge to language and source, to language, and to the whole corpus. Fences around the middle half of
a group replace fixed cutoffs: a group's fences are drawn towards its language's, and these towards
the whole corpus's, the more the fewer values they come from. A join with the fences filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import materialise, without

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SKETCH_K = 400  # sketch size: a rank error of about half a percent, however many rows
SALTS = 16
PRIOR = 100  # values of a group at which its own fences weigh as much as its parent's
GROUPS_BROADCAST = 100_000  # fences of more groups (of about 200 bytes) are joined by shuffle
TIMES = 4.0  # interquartile ranges that a value may lie outside the middle half
# Ratio: (whether a low value fails too, whether only documents above 0 are compared). Few clean texts repeat a
# line or a window; those that do are held against each other, or any repetition at all would lie outside.
RATIOS = {"mean_word": (True, False), "symbol_ratio": (False, False), "dup_line_ratio": (False, True), "repeat_ratio": (False, True)}


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array, first occurrences included."""

    def covered(tri: Column) -> Column:
        pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            near = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.array_compact(F.transform(s, lambda e, j: F.when(near(e, j - 1) | near(e, j + 1), e["i"]))))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return _bind(_bind(pairs, places), total)

    windows = _bind(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    return _bind(windows, lambda tri: F.when(F.size(F.array_distinct(tri)) < F.size(tri), covered(tri)).otherwise(F.lit(0).cast("long")))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One narrow row per document: counts and base verdict. Null texts have no words; null languages and sources are groups of their own."""
    value = F.coalesce(F.col(text), F.lit(""))
    solid = F.translate(value, BLANKS, "")
    words = F.array_remove(F.split(F.translate(value, BLANKS, " " * len(BLANKS)), " "), "")
    lines = F.filter(F.split(value, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), words.alias("words"), lines.alias("lines"), F.length(solid).cast("long").alias("word_chars"), (F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    found = base.select("doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), F.size("lines").alias("n_lines"))
    return found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratios(rows: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.withColumns({"mean_word": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words")})


def fences(rows: DataFrame) -> DataFrame:
    """(level, lang, source, and for each ratio the values seen, its low and high fence) from documents that pass the base rules.

    Sketches are merged upwards: 2 language and source, 1 language, 0 all. A hot source is spread over SALTS.
    """
    seen = {r: F.when(F.col(r) > 0, F.col(r)) if some else F.col(r) for r, (_, some) in RATIOS.items()}
    sketches = rows.where("not base_failed").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).groupBy("lang", "source", "salt").agg(*[F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(r) for r, v in seen.items()])
    merge = [F.kll_merge_agg_double(F.col(r), F.lit(SKETCH_K)).alias(r) for r in RATIOS]
    fine = sketches.groupBy("lang", "source").agg(*merge)
    by_lang = fine.groupBy("lang").agg(*merge)
    none = F.lit(None).cast("string")
    levels = [fine.withColumn("level", F.lit(2)), by_lang.withColumns({"level": F.lit(1), "source": none}), by_lang.groupBy().agg(*merge).withColumns({"level": F.lit(0), "lang": none, "source": none})]
    out = reduce(DataFrame.unionByName, levels)
    columns = []
    for r, (both, _) in RATIOS.items():
        n = F.coalesce(F.kll_sketch_get_n_double(F.col(r)), F.lit(0))
        low, high = (F.when(n > 0, F.kll_sketch_get_quantile_double(F.col(r), F.lit(q))) for q in (0.25, 0.75))
        columns += [n.alias(f"{r}_n"), (low - TIMES * (high - low) if both else F.lit(None).cast("double")).alias(f"{r}_low"), (high + TIMES * (high - low)).alias(f"{r}_high")]
    return out.select("level", "lang", "source", *columns)


def _drawn(own: str, parent: str | None) -> Column:
    """The fences of the struct ``own``, each drawn towards that of the struct ``parent``, which holds where ``own`` has none."""
    out = []
    for r in RATIOS:
        for side in ("low", "high"):
            here = F.col(f"{own}.{r}_{side}")
            if parent:
                there, n = F.col(f"{parent}.{r}_{side}"), F.col(f"{own}.{r}_n")
                here = F.coalesce(here + (there - here) * (PRIOR / (n + PRIOR)), here, there)
            out.append(here.alias(f"{r}_{side}"))
    return F.struct(*out)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A document is kept unless it fails the base rules or one of its ratios lies outside the fences of
    its language and source. Values on a fence pass, and so does any value where no document gives a fence. Repeated rows
    count each; an empty table gives none. Sketches choose at random what they keep of groups of more than about SKETCH_K
    documents, so a document whose ratio lies within half a percent of ranks of a fence may be judged otherwise in another run.
    """
    rows = _ratios(materialise(measures(docs, doc_id, text, lang, source)))
    limits = materialise(fences(rows))
    # One row of fences for each language and source.
    names = [c for c in limits.columns if c not in ("level", "lang", "source")]
    pairs = rows.select("lang", "source").distinct()
    packed = {k: limits.where(F.col("level") == k).select("lang", "source", F.struct(*names).alias(f"f{k}")) for k in (0, 1, 2)}
    fine = pairs.alias("p").join(packed[2].alias("a"), F.col("p.lang").eqNullSafe(F.col("a.lang")) & F.col("p.source").eqNullSafe(F.col("a.source")), "left").select("p.*", "f2")
    wide = fine.alias("p").join(packed[1].alias("b"), F.col("p.lang").eqNullSafe(F.col("b.lang")), "left").select("p.*", "f2", "f1")
    top = wide.join(packed[0].select("f0"), F.lit(True), "left")  # one row of fences for the whole corpus
    drawn = top.withColumn("f1", _drawn("f1", "f0")).withColumn("f", _drawn("f2", "f1"))
    chosen = materialise(drawn.select("lang", "source", "f"))
    small = chosen.limit(GROUPS_BROADCAST + 1).count() <= GROUPS_BROADCAST
    chosen = F.broadcast(chosen) if small else chosen
    joined = rows.alias("r").join(chosen.alias("c"), F.col("r.lang").eqNullSafe(F.col("c.lang")) & F.col("r.source").eqNullSafe(F.col("c.source")), "left").select("r.*", "f")
    inside = reduce(lambda a, b: a & b, [F.coalesce(F.col(r) <= F.col(f"f.{r}_high"), F.lit(True)) & F.coalesce(F.col(r) >= F.col(f"f.{r}_low"), F.lit(True)) for r in RATIOS])
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs, all columns, that ``judge`` keeps (rows that share a doc_id stay if one of them is kept)."""
    verdicts = judge(docs, doc_id, text, lang, source).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return without(docs, verdicts.where("not kept"), doc_id)
