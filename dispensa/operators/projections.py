"""Projections: fallback chains, keys, tags, record builders, section trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coalesce_chain(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def first_nonempty_list(*columns: Column) -> Column:
    """The first list that has an entry that is not blank; blanks are left out."""
    solid = [F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")) for c in columns]
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in solid])


def make_key(*parts: Column) -> Column:
    """Parts joined by bars; null if one is missing or blank."""
    whole = [F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts]
    ok = whole[0].isNotNull()
    for p in whole[1:]:
        ok = ok & p.isNotNull()
    return F.when(ok, F.concat_ws("|", *whole))


def split_key(key: Column, i: int) -> Column:
    return F.get(F.split(key, r"\|"), F.lit(i))


def present_tags(**members: Column) -> Column:
    """Names of the members that are not null, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in members.items()])))


def normal_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), " ", "_")


def joint_id(names: Column) -> Column:
    """One id for several ingredients, whatever their order."""
    return F.concat(F.lit("medicine:"), F.array_join(F.array_sort(F.transform(names, normal_id)), "+"))


# The ids and the schema version of stored records.
SUBSTANCE, MEDICINE, MARKET, VERSION = "inn:", "medicine:", "market:", 3


def _record_id(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.lower(F.trim(name)))


def _strings(c: Column | None) -> Column:
    none = F.array().cast("array<string>")
    return none if c is None else F.coalesce(c, none)


def build_substance(name: Column, codes: Column | None = None, concept: Column | None = None, sources: Column | None = None) -> Column:
    """Record of a substance as a struct; a concept that was not looked up says so."""
    unchecked = F.struct(F.lit(None).cast("string").alias("rxcui"), F.lit("not_checked").alias("status"))
    return F.struct(_record_id(SUBSTANCE, name).alias("id"), name.alias("inn"), F.lower(F.trim(name)).alias("inn_normalized"), _strings(codes).alias("atc_codes"), (unchecked if concept is None else F.coalesce(concept, unchecked)).alias("rxnorm"), _strings(sources).alias("sources"), F.lit(VERSION).alias("schema_version"))


def build_medicine(name: Column, forms: Column | None = None, strengths: Column | None = None) -> Column:
    """Record of a medicine as a struct, linked to its substance; it has no markets yet."""
    return F.struct(_record_id(MEDICINE, name).alias("id"), name.alias("inn"), _record_id(SUBSTANCE, name).alias("substance_id"), _strings(forms).alias("forms"), _strings(strengths).alias("strengths"), _strings(None).alias("markets"), F.lit(VERSION).alias("schema_version"))


def build_market(name: Column, brand: Column, country: Column, authority: Column, laboratory: Column | None = None, **parts: Column) -> Column:
    """Record of a marketed product as a struct, linked to its medicine; ``parts`` are further members (presentation, documents, source)."""
    key = F.concat(F.lit(MARKET), F.lower(country), F.lit(":"), F.regexp_replace(F.lower(brand), " ", "_"))
    lab = F.lit(None).cast("string") if laboratory is None else laboratory
    return F.struct(key.alias("id"), _record_id(MEDICINE, name).alias("medicine_id"), brand.alias("brand_name"), lab.alias("laboratory"), country.alias("country"), authority.alias("authority"), *[c.alias(n) for n, c in parts.items()], F.lit(VERSION).alias("schema_version"))


def text_items(lines: Column) -> Column:
    """Content structs of plain texts; blank ones go."""
    return F.transform(F.filter(lines, lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.struct(F.trim(x).alias("text")))


def normalise_sections(sections: Column, text=lambda x: x["text"], items: tuple[str, ...] = ("content", "content")) -> Column:
    """Sections of any schema as (title, content, subsections) down to as many levels as ``items`` has names.

    ``items`` names the list of a section's texts at each level, ``text`` takes the text out of an entry (the entry
    itself, where entries are strings). Null sections and entries with a blank text go; a null title is empty, a missing list too.
    """

    def one(s: Column, names: tuple[str, ...]) -> Column:
        solid = F.filter(s[names[0]], lambda x: F.coalesce(F.trim(text(x)) != "", F.lit(False)))
        content = F.coalesce(F.transform(solid, lambda x: F.struct(text(x).alias("text"))), F.array().cast("array<struct<text:string>>"))
        members = [F.coalesce(F.trim(s["title"]), F.lit("")).alias("title"), content.alias("content")]
        if names[1:]:
            below = normalise_sections(s["subsections"], text, names[1:])
            members.append(F.coalesce(below, F.array()).alias("subsections"))
        return F.struct(*members)

    return F.transform(F.filter(sections, lambda s: s.isNotNull()), lambda s: one(s, items))


def priority_cols(df: DataFrame, text: str, home: str, title: str, country: str, doc: str) -> DataFrame:
    """priority (home with document, home, document, other), leads_with_letter, starts_with_query."""
    rank = F.when((F.col(country) == home) & F.col(doc), 1).when(F.col(country) == home, 2).when(F.col(doc), 3).otherwise(4)
    return df.withColumns(
        {
            "priority": rank,
            "leads_with_letter": F.coalesce(F.col(title).rlike("^[A-Za-zÀ-ÿ]"), F.lit(False)),
            "starts_with_query": F.coalesce(F.startswith(F.lower(F.col(title)), F.lit(text.lower())), F.lit(False)),
        }
    )


def observed_fields(df: DataFrame, json: str) -> DataFrame:
    """Field names seen in a column of JSON objects, with their counts."""
    return df.select(F.explode(F.map_keys(F.from_json(json, "map<string,string>"))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def identity_projection(df: DataFrame, key: str, label: str, synonyms: str, history: str, most: int = 5) -> DataFrame:
    """External identity with capped lists, null where there is none; the first entry of a history."""
    identity = F.when(F.col(label).isNotNull(), F.struct(F.col(label).alias("label"), F.slice(synonyms, 1, most).alias("synonyms")))
    return df.select(key, identity.alias("identity"), F.get(history, F.lit(0)).alias("first_seen"))


def assign_surrogates(df: DataFrame, key: str) -> DataFrame:
    """A deterministic new id for each row: 60 bits of the key's SHA-256, the same on every run, so ids need no global order; old key kept as ``legacy``."""
    return df.withColumn("legacy", F.col(key)).withColumn("id", F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("long"))


def result_row(df: DataFrame, key: str, own: Column, linked: Column, placeholder: str) -> DataFrame:
    """Labels of a search hit: its own, else those linked, else the placeholder; the first four, the first fifty, and their number."""
    labels = F.array_distinct(F.coalesce(F.when(F.size(own) > 0, own), F.when(F.size(linked) > 0, linked), F.array(F.lit(placeholder))))
    out = df.select(key, labels.alias("__l"))
    return out.select(key, F.slice("__l", 1, 4).alias("shown"), F.slice("__l", 1, 50).alias("all"), F.size("__l").alias("n_labels"))
