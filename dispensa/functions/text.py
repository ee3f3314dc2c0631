"""Text expressions as Columns: cleaning, names, addresses, excerpts, scores, classes. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks, and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Dosage units, form words and words of salts and hydrates that names are cleaned of.
UNITS = "mg|g|mcg|µg|ml|l|ui|iu|%"
FORMS = "comprimé|gélule|solution|injectable|poudre|suspension|sirop|crème|pommade|gel"
CHEMICAL = "monohydrate|dihydrate|trihydrate|chlorhydrate|sulfate|phosphate|citrate|succinate|fumarate|malate|tartrate|lactate|gluconate|carbonate|nitrate"
GENERIC_UNITS, PRODUCT_UNITS = r"mg|mcg|g|ml|iu|units|u\.i\.", "mg|g|ml|%|ui|µg"
SALTS = "acetate|chlorhydrate|citrate|fumarate|hydrochloride|maleate|mesilate|nitrate|phosphate|potassium|sodium|succinate|sulfate|tartrate"
# The keyword ladder of risk classes, worst first.
RISKS = {
    "danger": (
        "contre-indiqué", "contre-indiquée", "contre-indiquées", "contre-indiqués", "ne doit pas être utilisé", "ne doit pas être administré", "ne pas utiliser",
        "formellement contre-indiqué", "est interdit", "interdite pendant la grossesse", "est contre-indiqué pendant", "usage est contre-indiqué",
    ),
    "deconseille": (
        "déconseillé", "est déconseillée", "ne doit être envisagé", "ne doit être utilisé que si", "ne doit pas être prescrit", "éviter", "doit être évité", "ne pas allaiter", "n'est pas recommandé",
    ),
    "precaution": (
        "précaution", "prudence", "si nécessaire", "après évaluation du rapport bénéfice", "bénéfice/risque", "sous surveillance", "avis médical", "données limitées", "données insuffisantes",
        "pas de données adéquates", "par mesure de précaution",
    ),
    "ok": (
        "peut être utilisé", "peut être poursuivi", "compatible avec", "sans risque", "peut être administré", "peut être pris", "n'a pas montré de risque", "absence de risque",
    ),
}
LEVELS = (*RISKS, "unknown")


def norm_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_label(c: Column) -> Column:
    return F.upper(F.trim(c))


def norm_search(c: Column) -> Column:
    return F.lower(norm_space(c))


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, FOLDED)


def first_word(c: Column) -> Column:
    return F.nullif(F.split(F.trim(c), " ")[0], F.lit(""))


def clean_generic(c: Column) -> Column:
    """Upper case without dosages; of punctuation only hyphens stay."""
    no_dose = F.regexp_replace(F.upper(norm_space(c)), rf"(?iU)\b\d+(\.\d+)?\s*({GENERIC_UNITS})\b", "")
    return norm_space(F.regexp_replace(no_dose, r"[^A-Z0-9\s-]", " "))


def clean_product(c: Column) -> Column:
    """Lower case without dosages, words of form and of salt or hydrate, commas, hyphens and the word "pour"."""
    no_dose = F.regexp_replace(F.lower(F.trim(c)), rf"(?U)\d+\s*({PRODUCT_UNITS})\b", "")
    no_words = F.regexp_replace(no_dose, rf"(?U)\b({FORMS}|{CHEMICAL})\b", "")
    return norm_space(F.regexp_replace(F.regexp_replace(no_words, "[,-]", " "), r"(?U)\bpour\b", " "))


def name_variants(c: Column) -> Column:
    """Candidate names in order: as given, without brackets and dosage, the head before a separator, ASCII only."""
    raw = norm_space(c)
    bare = norm_space(F.regexp_replace(F.regexp_replace(raw, r"\([^)]*\)", " "), rf"(?i)[0-9]+([.,][0-9]+)?\s*({UNITS})($|\s)", " "))
    head = F.trim(F.split(raw, r"\s+[-–/]\s+|[,;]", 2)[0])
    plain = norm_space(F.regexp_replace(raw, r"[^A-Za-z0-9 -]", " "))
    return F.array_distinct(F.filter(F.array(raw, bare, head, plain), lambda x: x != ""))


def salt_variants(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The name, and for "salt of drug" also "drug salt" and "drug"; then names with a known part replaced."""
    raw = norm_space(c)
    pattern = rf"(?i)^({SALTS})\s+(?:d['’]?\s*|de\s+|of\s+)(.+)$"
    salt, drug = (F.regexp_extract(raw, pattern, k) for k in (1, 2))
    hit = drug != ""
    base = [raw, F.when(hit, F.concat_ws(" ", drug, salt)), F.when(hit, drug)]
    base += [F.when(F.contains(F.lower(raw), F.lit(k.lower())), F.lit(v)) for k, v in (synonyms or {}).items()]
    return F.array_distinct(F.array_compact(F.array(*base)))


def strip_chem_prefix(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, r"\*", ""), r"(?i)^\s*((l|d|dl)-|17\s*[βb]-?\s*)", "")))


def brand_like(words: Column, most: int = 50) -> Column:
    """Upper-case names of 2 to 30 letters (hyphens allowed, no digits), folded, each once."""
    good = F.filter(F.transform(words, lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ-]{1,29}$"))
    return F.slice(F.array_distinct(F.transform(good, lambda x: F.upper(fold_accents(x)))), 1, most)


def strip_tags(c: Column) -> Column:
    """Text of markup: breaks and paragraph ends become newlines, tags go, common entities are read, blank lines go."""
    broken = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n")
    plain = F.regexp_replace(broken, r"<[^>]*>", "")
    read = reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")), plain)
    return F.array_join(F.filter(F.transform(F.split(read, "\n"), lambda x: norm_space(x)), lambda x: x != ""), "\n")


def title_head(c: Column) -> Column:
    """A title before its dosage, comma, bracket or dash; null if fewer than two characters are left."""
    head = F.trim(F.split(c, r"\s+[0-9]|,|\(|\s[-–]\s", 2)[0])
    return F.when(F.length(head) >= 2, head)


def url_source(c: Column, domains: dict[str, str], other: str = "other") -> Column:
    host = F.coalesce(F.lower(F.try_parse_url(c, F.lit("HOST"))), F.lit(""))
    return reduce(lambda acc, kv: F.when(F.contains(host, F.lit(kv[0])), F.lit(kv[1])).otherwise(acc), reversed(list(domains.items())), F.lit(other))


def url_filename(c: Column) -> Column:
    """The last part of the path with anything unusual replaced."""
    last = F.regexp_extract(F.split(F.split(c, "#")[0], r"\?")[0], r"([^/]*)/?$", 1)
    return F.regexp_replace(last, r"[^A-Za-z0-9._-]", "_")


def url_id(c: Column, prior: Column | None = None) -> Column:
    """A prior id, else the number of the query, else that of the path."""
    query = F.regexp_extract(c, r"[?&][A-Za-z_]+=([0-9]+)", 1)
    path = F.regexp_extract(F.split(c, r"\?")[0], r"([0-9]+)", 1)
    found = F.coalesce(F.nullif(query, F.lit("")), F.nullif(path, F.lit("")))
    return found if prior is None else F.coalesce(prior, found)


def longest_word(c: Column) -> Column:
    """The first of the longest words."""
    return F.aggregate(F.split(c, " "), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


def longest_word_prefix(c: Column, n: int = 7, least: int = 6) -> Column:
    word = longest_word(c)
    return F.when(F.length(word) >= least, F.substring(word, 1, n))


def count_term(c: Column, term: str) -> Column:
    """Occurrences that do not overlap, ignoring case."""
    low = F.lower(c)
    return F.coalesce(((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / F.lit(len(term))).cast("int"), F.lit(0))


def excerpt(c: Column, term: str, around: int = 60, most: int = 150) -> Column:
    """Text around the first hit, with dots where it was cut; without a hit the first hundred characters.

    It runs from the last full stop before the hit (else the last question mark) through the first one
    behind it (else up to a ``!`` or ``?``); if that is longer than ``most``, ``around`` characters each way.
    """
    n, size = len(term), F.length(c)
    p = F.locate(term.lower(), F.lower(c)) - 1  # characters before the hit
    before, rest = F.substring(c, F.lit(1), p), F.substring(c, p + 1, size)
    last = lambda s: F.when(F.locate(s, F.reverse(before)) > 0, p - F.locate(s, F.reverse(before))).otherwise(F.lit(0))
    start = F.when(last(".") > 0, last(".")).otherwise(last("?"))
    found = lambda s: F.locate(s, rest)
    end = F.when(found(".") > 0, p + found(".")).when(found("!") > 0, p + found("!") - 1).when(found("?") > 0, p + found("?") - 1).otherwise(size)
    long = end - start > most
    lo, hi = F.when(long, F.greatest(F.lit(0), p - around)).otherwise(start), F.when(long, F.least(size, p + n + around)).otherwise(end)
    dots = lambda test: F.when(test, F.lit("...")).otherwise(F.lit(""))
    cut = F.concat(dots(lo > 0), F.substring(c, lo + 1, hi - lo), dots(hi < size))
    return F.when(p >= 0, cut).otherwise(F.concat(F.substring(c, 1, 100), F.lit("...")))


def relevance(title: Column, substances: Column, form: Column, dosage: Column, content: Column, terms: list[str], section_titles: Column | None = None) -> Column:
    """Weighted hits of all terms: title 10 (15 more if equal), substances 8 (10 more if equal), form 5, dosage 5, section titles 2, content 1; plus the number of hits."""
    parts = []
    for term in terms:
        low = term.lower()
        for c, weight, bonus in ((title, 10, 15), (form, 5, 0), (dosage, 5, 0), (content, 1, 0)):
            n = count_term(c, term)
            parts.append(n * (weight + 1) + (F.when(F.lower(c) == low, bonus).otherwise(0) if bonus else F.lit(0)))
        parts.append(_substance_score(substances, term))
        if section_titles is not None:
            parts.append(count_term(F.array_join(section_titles, "\n"), term) * 3)
    return reduce(lambda a, b: a + b, parts)


def _substance_score(substances: Column, term: str) -> Column:
    per = F.transform(F.coalesce(substances, F.array().cast("array<string>")), lambda s: count_term(s, term) * 9 + F.when(F.lower(s) == term.lower(), 10).otherwise(0))
    return F.aggregate(per, F.lit(0), lambda a, x: a + x)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(c)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in words]), F.lit(False))


def risk_class(c: Column) -> Column:
    """The first rung of the ladder that the text names; blank or neutral texts are unknown."""
    out = F.lit("unknown")
    for level, words in reversed(RISKS.items()):
        out = F.when(contains_any(c, words), F.lit(level)).otherwise(out)
    return out


def worst_level(a: Column, b: Column) -> Column:
    order = F.array(*[F.lit(x) for x in LEVELS])
    return F.get(order, F.least(F.array_position(order, a), F.array_position(order, b)).cast("int") - 1)


def extract_codes(items: Column) -> Column:
    """The last code (a letter and at least two digits) of each item, else the item; items that say "not concerned" are left out; each once."""
    kept = F.filter(items, lambda x: ~F.contains(F.lower(x), F.lit("non concern")))
    code = lambda x: F.try_element_at(F.regexp_extract_all(x, F.lit(r"([A-Z][0-9]{2,4})"), F.lit(1)), F.lit(-1))
    return F.array_distinct(F.transform(kept, lambda x: F.coalesce(code(x), F.trim(x))))


def parse_composition(c: Column) -> Column:
    """struct<substance, dosage> of a line with leader dots."""
    pattern = r"^(.+?)\s*\.{3,}\s*([0-9].*)$"
    return F.struct(F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit("")).alias("substance"), F.nullif(F.trim(F.regexp_extract(c, pattern, 2)), F.lit("")).alias("dosage"))


def extract_update_date(c: Column, marker: str) -> Column:
    """dd/mm/yyyy after a marker, or null."""
    return F.nullif(F.regexp_extract(c, marker + r"\s*:?\s*([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), F.lit(""))


def md_to_html(c: Column) -> Column:
    """Headings, bold and line breaks of light markdown."""
    heads = F.regexp_replace(c, r"(?m)^#{1,3}\s*(.+)$", "<h3>$1</h3>")
    bold = F.regexp_replace(heads, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    return F.replace(bold, F.lit("\n"), F.lit("<br>"))


def fingerprint(kind: str, *columns: Column) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256)}[kind](joined)
