"""Links between entities: lookups, array foreign keys, cascades of ranked matches, pairs, graph edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import clean_generic, fold_accents, norm_label


def join_medicine(market: DataFrame, medicines: DataFrame) -> DataFrame:
    return market.join(medicines, market["medicine_ref"] == medicines["medicine_id"], "left")


def join_array_fk(df: DataFrame, key: str, refs: str, dim: DataFrame, dim_key: str, value: str, out: str) -> DataFrame:
    """(key, out): values of the references in array order; those that lead nowhere are left out, rows without any get an empty array."""
    items = df.select(key, F.posexplode(refs).alias("__pos", "__ref"))
    hits = items.join(dim.select(F.col(dim_key).alias("__ref"), F.col(value).alias("__v")), "__ref")
    got = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__v"))), lambda x: x["__v"]).alias(out))
    return df.select(key).join(got, key, "left").withColumn(out, F.coalesce(out, F.array()))


def search_semijoin(market: DataFrame, direct: Column, medicines: DataFrame, by_name: Column, substances: DataFrame, by_label: Column) -> DataFrame:
    """Products that match themselves, or whose medicine does, or one of whose medicine's substances does."""
    by_substance = medicines.select("medicine_id", F.explode("refs").alias("substance_id")).join(substances.where(by_label).select("substance_id"), "substance_id", "left_semi")
    keys = medicines.where(by_name).select("medicine_id").union(by_substance.select("medicine_id")).distinct().withColumn("__hit", F.lit(True))
    return market.join(keys, market["medicine_ref"] == keys["medicine_id"], "left").where(direct | F.col("__hit").isNotNull()).drop("medicine_id", "__hit")


def filter_by_substance(market: DataFrame, medicines: DataFrame, substances: DataFrame, test: Column) -> DataFrame:
    """Products with a substance that meets the test; no substance, no rows."""
    keys = medicines.select("medicine_id", F.explode("refs").alias("substance_id")).join(substances.where(test), "substance_id", "left_semi")
    return market.join(keys, market["medicine_ref"] == keys["medicine_id"], "left_semi")


def enrich_lookup(df: DataFrame, ref: DataFrame, key: str, ref_key: str, flag: str) -> DataFrame:
    """Add the columns of a code list and whether there was an entry; Spark chooses the join by the list's size."""
    marked = ref.withColumn(flag, F.lit(True))
    return df.join(marked, df[key] == marked[ref_key], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def enrich_grouped(df: DataFrame, key: str, ref: DataFrame, ref_key: str, order: list[Column], fields: list[str], out: str) -> DataFrame:
    """Add the ordered list of a key's records; null where it has none."""
    rows = F.struct(*[c.alias(f"__o{k}") for k, c in enumerate(order)], *fields)
    lists = ref.groupBy(F.col(ref_key).alias("__key")).agg(F.transform(F.array_sort(F.collect_list(rows)), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))
    return df.join(lists, df[key] == lists["__key"], "left").drop("__key")


def rewrite_fk(df: DataFrame, column: str, ids: DataFrame, old: str, new: str) -> DataFrame:
    """Replace a reference through an id map; unmatched ones become null, ``matched`` says which."""
    m = ids.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(m, df[column] == m["__old"], "left").withColumns({column: F.col("__new"), "matched": F.col("__old").isNotNull()}).drop("__old", "__new")


def rewrite_array_fk(df: DataFrame, key: str, refs: str, ids: DataFrame, old: str, new: str) -> DataFrame:
    """(key, refs, missing): references through an id map, in order, each once; the number that led nowhere."""
    items = df.select(key, F.posexplode_outer(refs).alias("__pos", "__ref")).join(ids.select(F.col(old).alias("__ref"), F.col(new).alias("__new")), "__ref", "left")
    pairs = F.collect_list(F.when(F.col("__new").isNotNull(), F.struct("__pos", "__new")))
    return items.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(pairs), lambda x: x["__new"])).alias(refs), F.count_if(F.col("__ref").isNotNull() & F.col("__new").isNull()).alias("missing"))


def ranked_match(left: DataFrame, key: str, steps: list[tuple[Column, DataFrame, bool]]) -> DataFrame:
    """(key, match, step): a cascade of equi-joins; the first step that finds something wins, then the smallest id.

    A step is (value on the left, or an array of values, candidates(value, id), whether it counts only if there is
    exactly one candidate). All steps are one union of equi-joins, so nothing is looked up row by row.
    """
    found = []
    for k, (value, candidates, unique) in enumerate(steps):
        c = candidates.where(F.col("value").isNotNull()).select("value", "id").distinct()
        c = c.groupBy("value").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        c = (c.where("n = 1") if unique else c).select(F.col("value").alias("__v"), "id")
        keyed = left.select(key, value.alias("__w"))
        if isinstance(keyed.schema["__w"].dataType, ArrayType):
            keyed = keyed.select(key, F.explode("__w").alias("__w"))
        keyed = keyed.where("__w is not null")
        found.append(keyed.join(c, keyed["__w"] == c["__v"]).select(key, F.lit(k).alias("step"), "id"))
    best = reduce(DataFrame.union, found).groupBy(key).agg(F.min(F.struct("step", "id")).alias("__b"))
    return left.select(key).join(best, key, "left").select(key, F.col("__b.id").alias("match"), F.col("__b.step").alias("step"))


def resolve_names(items: DataFrame, dim: DataFrame) -> DataFrame:
    """(item, match, step) for items(item, generic, brand) in dim(id, key, inns): the generic name among the inns, as the key, its first word likewise, then the brand likewise if only one row has it."""
    keys = dim.select(F.upper("key").alias("value"), "id")
    inns = dim.select(F.explode("inns").alias("value"), "id").withColumn("value", F.upper("value"))
    generic, brand = (F.nullif(clean_generic(F.col(c)), F.lit("")) for c in ("generic", "brand"))
    head = F.when(F.contains(generic, F.lit(" ")), F.split(generic, " ")[0])
    return ranked_match(items, "item", [(value, names, value is brand) for value in (generic, head, brand) for names in (inns, keys)])


def match_identity(items: DataFrame, dim: DataFrame) -> DataFrame:
    """(item, match, step) for items(item, inchi, cas, unii, label, synonyms) in dim(id, inchis, cas, unii, synonyms, label).

    Steps: structure key; registry number, synonyms included; ingredient code, also as the synonym
    ``UNII-code``; label or one of the first 50 synonyms, normalised, as the label.
    """
    said = dim.select(F.explode("synonyms").alias("value"), "id")
    of = lambda c: dim.select(F.col(c).alias("value"), "id")
    codes = said.where(F.startswith("value", F.lit("UNII-"))).withColumn("value", F.substring("value", 6, 1_000))
    names = F.transform(F.concat(F.array("label"), F.slice(F.coalesce("synonyms", F.array()), 1, 50)), norm_label)
    labels = dim.select(norm_label(F.col("label")).alias("value"), "id")
    return ranked_match(items, "item", [(F.col("inchi"), dim.select(F.explode("inchis").alias("value"), "id"), False), (F.col("cas"), of("cas").union(said), False), (F.col("unii"), of("unii").union(codes), False), (F.filter(names, lambda x: x != ""), labels, False)])


GRAM = 3  # characters of the grams that contains joins meet by
SALTS = 16  # parts that the names of a gram are dealt to


def gram_pairs(parts: DataFrame, names: DataFrame) -> DataFrame:
    """(value, name, id): each of parts(value) with the names(name, id) that contain it, for values of GRAM characters or more.

    An equi-join: a value meets the names that hold the one of its grams that fewest names hold, then the rest is compared. Names
    are dealt to SALTS parts, so that a gram that many of them hold is not one task's. Rows of grams are many times their names, which
    Spark's estimate leaves out, so it is told not to broadcast them.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda k: F.substring(c, k, F.lit(GRAM))))
    held = names.where(F.length("name") >= GRAM).select("name", "id", F.pmod(F.xxhash64("name", "id"), F.lit(SALTS)).cast("int").alias("__s"), F.explode(grams(F.col("name"))).alias("__g"))
    asked = parts.where(F.length("value") >= GRAM).select("value").distinct().select("value", F.explode(grams(F.col("value"))).alias("__g"))
    counts = held.groupBy("__g").agg(F.count("*").alias("__n"))
    rarest = asked.hint("merge").join(counts, "__g", "left").groupBy("value").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__g")).alias("__r"))
    copies = rarest.where("__r.n > 0").select("value", F.col("__r.__g").alias("__g"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    return copies.hint("merge").join(held, ["__g", "__s"]).where(F.contains("name", F.col("value"))).select("value", "name", "id")


def contained(parts: DataFrame, names: DataFrame) -> DataFrame:
    """(value, id): the smallest id of names(name, id) that contain each of parts(value), values of GRAM characters or more."""
    whole = names.groupBy("name").agg(F.min("id").alias("id"))
    return gram_pairs(parts, whole).groupBy("value").agg(F.min("id").alias("id"))


def _first_hit(asked: DataFrame, hits: DataFrame, rank: list[str]) -> DataFrame:
    """(item, match, step): the least hit(value, step, id) of what each item asks for, by rank, step and id."""
    best = asked.join(hits, "value").groupBy("item").agg(F.min(F.struct(*rank, "step", "id")).alias("__b"))
    return best.select("item", F.col("__b.id").alias("match"), F.col("__b.step").alias("step"))


def resolve_substance(items: DataFrame, substances: DataFrame, medicines: DataFrame) -> DataFrame:
    """(item, match, path, step) for items(item, medicine_id, medicine_ref, label).

    Names are tried in order of path: 0 medicine_id; of the medicines(medicine_ref, inns, labels, refs) that
    medicine_ref leads to 1 the inns, 2 the substance labels, 3 the refs, which are ids themselves; 4 the item's own label. A
    name finds substances(id, label, legacy, synonyms) by 0 label, 1 legacy label, 2 synonym, 3 the 7-character prefix of its
    longest word (6 letters or more, accents folded) anywhere in a label; the smallest id wins. Case is ignored.
    """
    low = lambda c: F.lower(F.col(c))
    linked = items.select("item", "medicine_ref").join(medicines, "medicine_ref")
    of = lambda df, path, value: df.select("item", F.lit(path).alias("path"), F.lit(0).alias("pos"), F.col(value).alias("value"))
    each = lambda path, value: linked.select("item", F.lit(path).alias("path"), F.posexplode(value).alias("pos", "value"))
    asked = of(items, 0, "medicine_id").union(each(1, "inns")).union(each(2, "labels")).union(of(items, 4, "label")).withColumn("value", low("value")).where("value <> ''")
    names = asked.select("value").distinct()
    labels = substances.select(low("label").alias("value"), "id")
    legacy = substances.select(low("legacy").alias("value"), "id")
    synonyms = substances.select(F.explode(F.transform("synonyms", F.lower)).alias("value"), "id")
    exact = ranked_match(names, "value", [(F.col("value"), df, False) for df in (labels, legacy, synonyms)]).where("match is not null")
    words = F.split(F.regexp_replace(F.regexp_replace("value", r"[^a-zA-ZÀ-ÿ\s]", ""), r"\s+", " "), " ")
    longest = F.aggregate(words, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    cut = names.join(exact, "value", "left_anti").select("value", F.when(F.length(longest) >= 6, F.substring(fold_accents(longest), 1, 7)).alias("__p")).where("__p is not null")
    anywhere = cut.join(contained(cut.select(F.col("__p").alias("value")), labels.withColumnRenamed("value", "name")).withColumnRenamed("value", "__p"), "__p")
    hits = exact.select("value", "step", F.col("match").alias("id")).union(anywhere.select("value", F.lit(3), "id"))
    named = asked.join(hits, "value").select("item", "path", "pos", "step", "id")
    refs = each(3, "refs").withColumnRenamed("value", "id").join(substances.select("id"), "id", "left_semi").select("item", "path", "pos", F.lit(0).alias("step"), "id")
    best = named.union(refs).groupBy("item").agg(F.min(F.struct("path", "pos", "step", "id")).alias("__b"))
    return items.select("item").join(best, "item", "left").select("item", F.col("__b.id").alias("match"), F.col("__b.path").alias("path"), F.col("__b.step").alias("step"))


def resolve_pgx(items: DataFrame, kb: DataFrame, relations: DataFrame) -> DataFrame:
    """(item, match, step) for items(item, names) in the knowledge base kb(id, name, synonyms) with relations(drug_name, id).

    An item's names of three characters or more are tried single words first, then longest, then in order of spelling; each by 0
    the exact name, 1 a name that contains it, 2 a synonym that contains it, 3 the drug of a relation of that name. Of one
    step's hits the smallest id wins. Case is ignored.
    """
    asked = items.select("item", F.explode("names").alias("value")).withColumn("value", F.lower("value")).where("length(value) >= 3").distinct()
    asked = asked.withColumns({"several": F.col("value").rlike("[ -]"), "short": -F.length("value"), "spelled": F.col("value")})
    names = asked.select("value").distinct()
    named = kb.select(F.lower("name").alias("value"), "id")
    synonyms = kb.select(F.explode(F.transform("synonyms", F.lower)).alias("name"), "id")
    known = relations.select(F.lower("drug_name").alias("value"), "id").join(kb.select("id"), "id", "left_semi").select("value", "id")
    exact = ranked_match(names, "value", [(F.col("value"), named, False)]).where("match is not null").select("value", "step", F.col("match").alias("id"))
    rest = names.join(exact, "value", "left_anti")
    inside = contained(rest, named.withColumnRenamed("value", "name")).select("value", F.lit(1).alias("step"), "id")
    alias = contained(rest, synonyms).select("value", F.lit(2).alias("step"), "id")
    related = rest.join(known, "value").groupBy("value").agg(F.min("id").alias("id")).select("value", F.lit(3).alias("step"), "id")
    found = _first_hit(asked, exact.union(inside).union(alias).union(related), ["several", "short", "spelled"])
    return items.select("item").join(found, "item", "left")


def inside_match(left: DataFrame, key: str, value: str, dim: DataFrame) -> DataFrame:
    """(key, match): exact name, else the smallest id among dim(name, id) whose name is inside the value; an empty name is inside none.

    Each value and each name is matched once, however many rows have it. Names shorter than GRAM meet the values' substrings of their length.
    """
    whole = dim.where("id is not null").groupBy(F.col("name").alias("value")).agg(F.min("id").alias("id"))
    texts = left.select(F.col(value).alias("name")).where("name is not null").distinct()
    rest = texts.join(whole.select(F.col("value").alias("name")), "name", "left_anti")
    long = gram_pairs(whole.select("value"), rest.select("name", F.col("name").alias("id"))).select("name", "value")
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - (n - 1)), lambda k: F.substring(F.col("name"), k, F.lit(n)))
    short = [rest.where(F.length("name") >= n).select("name", F.explode(F.array_distinct(pieces(n))).alias("value")) for n in range(1, GRAM)]
    hits = reduce(DataFrame.union, [long, *short]).hint("merge").join(whole, "value").groupBy(F.col("name").alias("value")).agg(F.min("id").alias("id"))
    return ranked_match(left, key, [(F.col(value), whole, False), (F.col(value), hits, False)]).select(key, "match")


def prefix_match(left: DataFrame, key: str, value: str, dim: DataFrame, least: int = 3) -> DataFrame:
    """(key, match): exact name, else the smallest id among names that the value is a prefix of; values of ``least`` characters or more.

    Prefixes are an equi-join too: names are cut to the lengths that values have, and a cut keeps the smallest id of its names. So
    a value meets one cut, however many names begin with it.
    """
    whole = dim.where("id is not null").groupBy(F.col("name").alias("value")).agg(F.min("id").alias("id"))
    lengths = left.where(F.length(value) >= least).agg(F.collect_set(F.length(value)).alias("__n"))
    cuts = whole.crossJoin(lengths).select(F.explode(F.transform(F.filter("__n", lambda n: n <= F.length("value")), lambda n: F.substring(F.col("value"), F.lit(1), n))).alias("value"), "id")
    first = cuts.groupBy("value").agg(F.min("id").alias("id"))
    return ranked_match(left, key, [(F.col(value), whole, False), (F.col(value), first, False)]).select(key, "match")


def pair_interactions(baskets: DataFrame, edges: DataFrame) -> DataFrame:
    """(basket, a, b, description): one row for each unordered pair with an edge, a < b; the edge from a to b is preferred, then the smallest text."""
    a, b = baskets.select("basket", F.col("item").alias("a")).distinct(), baskets.select("basket", F.col("item").alias("b")).distinct()
    pairs = a.join(b, "basket").where("a < b")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("way"), "description").where("a < b").union(edges.select(F.col("dst"), F.col("src"), F.lit(1), "description").where("dst < src"))
    best = both.groupBy("a", "b").agg(F.min(F.struct("way", "description")).alias("e"))
    return pairs.join(best, ["a", "b"]).select("basket", "a", "b", F.col("e.description").alias("description"))


def shared_attribute_pairs(items: DataFrame) -> DataFrame:
    """From (basket, item, attribute): (basket, a, b, common) for the pairs of a basket with a common attribute, common sorted."""
    x = items.distinct()
    a, b = x.select("basket", "attribute", F.col("item").alias("a")), x.select("basket", "attribute", F.col("item").alias("b"))
    return a.join(b, ["basket", "attribute"]).where("a < b").groupBy("basket", "a", "b").agg(F.array_sort(F.collect_set("attribute")).alias("common"))


def orphans(child: DataFrame, ref: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set and leads nowhere."""
    return child.where(F.col(ref).isNotNull()).join(parent.select(F.col(key).alias("__k")), F.col(ref) == F.col("__k"), "left_anti")


def array_orphans(child: DataFrame, key: str, refs: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys of rows any of whose references leads nowhere."""
    items = child.select(key, F.explode(refs).alias("__r"))
    return orphans(items, "__r", parent, parent_key).select(key).distinct()


def merge_history(target: DataFrame, key: str, legacy: DataFrame, legacy_key: str, order: list[str], fields: list[str]) -> DataFrame:
    """target with ``history``: the legacy records of its key in order, each once; nothing where it has none."""
    rows = legacy.select(F.col(legacy_key).alias("__key"), *order, F.struct(*fields).alias("__r")).distinct()
    lists = rows.groupBy("__key").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(*order, "__r"))), lambda x: x["__r"])).alias("history"))
    return target.join(lists, target[key] == lists["__key"], "left").drop("__key")


def find_or_create(target: DataFrame, incoming: DataFrame, key: str, members: str) -> DataFrame:
    """target with the members of incoming rows of the same key added to its sets, and new keys added."""
    new = incoming.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(members))).alias("__m"))
    both = target.join(new, key, "full_outer")
    return both.select(key, F.array_sort(F.array_union(F.coalesce(members, F.array()), F.coalesce("__m", F.array()))).alias(members))


def membership_flags(df: DataFrame, column: str, names: DataFrame, name: str, flag: str) -> DataFrame:
    known = names.select(F.upper(F.trim(name)).alias("__n")).where("__n <> ''").distinct()
    return df.join(known, F.upper(F.trim(df[column])) == known["__n"], "left").withColumn(flag, F.col("__n").isNotNull()).drop("__n")


def graph_nodes(frames: list[DataFrame]) -> DataFrame:
    """Nodes (label, key, name) merged by key; the first name that is there, by value, is kept."""
    return reduce(DataFrame.union, frames).groupBy("label", "key").agg(F.min("name").alias("name"))


def graph_edges(kind: str, rows: DataFrame, src: str, dst: str, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """Distinct edges whose ends are both nodes. Nodes grow with the data, so none are broadcast, small as Spark may estimate their keys."""
    e = rows.select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    sources, targets = (df.select(F.col("key").alias(c)).hint("merge") for df, c in ((src_nodes, "src"), (dst_nodes, "dst")))
    return e.join(sources, "src", "left_semi").join(targets, "dst", "left_semi").select("kind", "src", "dst")
