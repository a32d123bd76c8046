"""Column functions for catalogue rules: models, accessories, types, makers, units, themes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed as X
from .dates import banded
from .text import clean_str, first_group


def _none() -> Column:
    return F.array().cast("array<string>")


def model_tokens(c: Column) -> Column:
    """Distinct model codes of a text, in order; stop codes and listing ids are left out."""
    stop = F.array(*map(F.lit, X.MODEL_STOP))
    found = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(X.MODEL), 1)
    return F.array_distinct(F.filter(found, lambda t: ~F.array_contains(stop, t) & ~t.rlike(X.LISTING_ID)))


def part_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(X.PART), 1))


def core_model(c: Column) -> Column:
    """The letters and digits that lead a model code, or all of it."""
    return F.coalesce(first_group(c, X.MODEL_CORE), c)


def is_accessory_title(title: Column) -> Column:
    """Whether a title names a part: a strong phrase anywhere, or a part word before any unit noun, with a code, or at the end."""
    t = F.coalesce(title, F.lit(""))
    part = F.regexp_instr(t, F.lit(f"(?i){X.PART_WORDS}"))
    unit = F.regexp_instr(t, F.lit(X.UNIT_NOUNS))
    at_end = t.rlike(rf"(?i)(?:{X.PART_WORDS})[\s,\-#]*[A-Z0-9]*\d[A-Z0-9]*\s*$")
    return t.rlike(X.PART_ANYWHERE) | ((part > 0) & (at_end | t.rlike(X.PART_CODE) | (unit == 0) | (part < unit)))


def _first_type(c: Column, table: list[tuple[str, str]], other: Column) -> Column:
    return reduce(lambda out, row: F.when(c.rlike(row[0]), row[1]).otherwise(out), reversed(table), other)


def product_type(categories: Column, title: Column) -> Column:
    """struct(type, source) by bundle, accessory, category and title rules, in this order."""
    t, low = F.coalesce(title, F.lit("")), F.lower(F.coalesce(title, F.lit("")))
    last = F.when(F.size(categories) > 0, F.element_at(categories, -1))
    of = lambda kind, source: F.struct(kind.alias("type"), F.lit(source).alias("source"))
    none = F.lit(None).cast("string")
    by_category = F.when(last.isNotNull(), _first_type(last, X.CATEGORY_TYPES, none))
    by_title = _first_type(low, X.TITLE_TYPES, none)
    accessory = is_accessory_title(title) | F.coalesce(~low.rlike(X.UNIT_NOUNS) & last.rlike(X.CATEGORY_OF_PARTS), F.lit(False))
    return (
        F.when(t.rlike(X.BUNDLE), of(F.lit("bundle"), "title '+' joins two products"))
        .when(accessory, of(F.lit("accessory/part"), "title/category accessory rule"))
        .when(by_category.isNotNull(), of(by_category, "category"))
        .when(by_title.isNotNull(), of(by_title, "title"))
        .otherwise(of(F.lit("unclassified"), "none"))
    )


def model_parts(item_model: Column, title: Column, is_accessory: Column) -> dict[str, Column]:
    """What :func:`choose_model` decides on. Put these in columns of their own first: they are costly and used many times."""
    t = F.coalesce(clean_str(title), F.lit(""))
    at = F.regexp_instr(t, F.lit(X.COMPATIBLE))
    phrase = F.length(F.regexp_extract(t, X.COMPATIBLE, 0))
    tail = F.when(at > 0, t.substr(at + phrase, F.length(t))).otherwise("")
    details = clean_str(item_model)
    stop = F.array(*map(F.lit, X.MODEL_STOP))
    named = F.transform(F.regexp_extract_all(F.upper(t), F.lit(X.MODEL_NAMED), 0), lambda m: F.regexp_extract(m, r"([A-Z]{1,4}\d{2,5}[A-Z0-9]{0,6})\)?$", 1))
    return {
        "_compatible": F.when(is_accessory | (at > 0), model_tokens(tail)).otherwise(_none()),
        "_part": F.try_element_at(F.concat(part_tokens(item_model), part_tokens(title)), F.lit(1)),
        "_named": F.filter(named, lambda m: ~F.array_contains(stop, m)),
        "_own": F.when(details.isNotNull(), model_tokens(F.regexp_replace(details, X.MODEL_NOISE, " "))).otherwise(_none()),
        "_has_details": details.isNotNull(),
        "_bracket": F.regexp_extract_all(F.upper(t), F.lit(X.MODEL_IN_BRACKETS), 1),
        "_before": model_tokens(F.when(at > 0, t.substr(F.lit(1), at - 1)).otherwise(t)),
        "_all": model_tokens(t),
        "_is_part": is_accessory,
    }


def choose_model() -> Column:
    """struct(model_no, source, confidence, compatible, part_no, candidates) from the columns of :func:`model_parts`: details, then brackets, then the title before any "for" phrase."""
    fits, part, named, own, accessory = F.col("_compatible"), F.col("_part"), F.col("_named"), F.col("_own"), F.col("_is_part")
    bracket, before = F.array_except("_bracket", fits), F.array_except("_before", fits)
    cores = lambda a: F.transform(a, core_model)
    none = F.lit(None).cast("string")
    first = lambda a: F.try_element_at(a, F.lit(1))

    def out(model: Column, source: str, confidence: str, compatible: Column, candidates: Column) -> Column:
        return F.struct(model.alias("model_no"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), compatible.alias("compatible"), part.alias("part_no"), candidates.alias("candidates"))

    or_own = F.when(F.size(fits) > 0, fits)
    return (
        F.when((F.size(named) > 0) & (F.size(own) > 0) & ~accessory & ~F.arrays_overlap(cores(named), cores(own)), out(first(named), "title_explicit_over_details", "high", fits, F.concat(named, own)))
        .when(F.size(own) == 1, out(first(own), "details", "high", fits, own))
        .when(F.size(own) > 1, out(none, "details_ambiguous", "none", or_own.otherwise(own), own))
        .when(F.col("_has_details") & part.isNotNull() & accessory, out(none, "details_part_only", "none", fits, _none()))
        .when(accessory, out(none, "accessory_no_model", "none", or_own.otherwise(F.col("_all")), _none()))
        .when(F.size(bracket) > 0, out(first(bracket), "title_bracket", "high", fits, bracket))
        .when(F.size(before) == 1, out(first(before), "title", "medium", fits, before))
        .when(F.size(before) > 1, out(first(before), "title_first_of_many", "low", fits, before))
        .otherwise(out(none, "none", "none", fits, _none()))
    )


def maker(title: Column, is_accessory: Column) -> Column:
    """sharkninja, third_party_compatible, unrelated or unverified, by evidence in the title."""
    t = F.coalesce(title, F.lit(""))
    head = F.split(t, X.COMPATIBLE, 2)[0]
    third = is_accessory & t.rlike(X.THIRD_PARTY) & ~t.rlike(X.GENUINE) & ~head.rlike(X.OWN_BRAND)
    return F.when(t.rlike(X.UNRELATED), "unrelated").when(third, "third_party_compatible").when(t.rlike(X.OWN_BRAND) | t.rlike(X.OWN_LINE), "sharkninja").otherwise("unverified")


def capacity_qt(details: Column, title: Column) -> Column:
    """struct(value, source): quarts from the details, else from the title."""
    of = lambda c: F.coalesce(*(F.round(first_group(c, p).try_cast("double") * f, 2) for p, f in X.CAPACITY_UNITS))
    return F.struct(F.coalesce(of(details), of(title)).alias("value"), F.when(of(details).isNotNull(), "details").when(of(title).isNotNull(), "title").alias("source"))


def wattage_w(details: Column, title: Column) -> Column:
    """struct(value, source): watts; a bare number counts in the details only."""
    own = F.coalesce(first_group(details, X.WATTS), first_group(details, X.WATTS_ALONE)).try_cast("double")
    other = first_group(title, X.WATTS).try_cast("double")
    return F.struct(F.coalesce(own, other).alias("value"), F.when(own.isNotNull(), "details").when(other.isNotNull(), "title").alias("source"))


def theme_flags(text: Column) -> list[Column]:
    """A boolean a theme over the lower-cased text; null texts have none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return [low.rlike(p).alias(k) for k, p in X.THEMES.items()]


def fail_months(text: Column) -> Column:
    """Months until failure that the text states first; null without."""
    n, unit = F.lower(first_group(text, X.STATED_TIME, 1)), F.lower(first_group(text, X.STATED_TIME, 2))
    words = F.create_map(*(F.lit(x) for kv in X.NUMBER_WORDS.items() for x in kv))
    a_unit = F.create_map(*(F.lit(x) for kv in X.MONTHS_A_UNIT.items() for x in kv))
    return F.coalesce(n.try_cast("double"), words[n].cast("double")) * a_unit[unit]


def fail_band(months: Column) -> Column:
    return F.when(months <= X.LATEST_FAILURE, banded(months, X.FAIL_BANDS))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 if either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def model_relation(a: Column, b: Column) -> Column:
    """missing, equal, prefix, contains or conflict."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    missing = F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe("")
    return (
        F.when(missing, "missing").when(a == b, "equal").when((F.length(short) >= 4) & long.startswith(short), "prefix")
        .when((F.length(short) >= 5) & long.contains(short) & short.rlike(r"\d{3}"), "contains").otherwise("conflict")
    )


def price_similarity(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))


def pair_features(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """What the score of two records comes from: jac, relation, strict, cross, apart, price (null if unknown) and same.

    Records may bring ``tokens`` and ``numbers`` of their titles, found once a record and not once a pair.
    """
    from .text import title_numbers, title_tokens

    no = F.lit(False)
    tokens = [x["tokens"] if "tokens" in x else title_tokens(x["title_norm"]) for x in (a, b)]
    na, nb = (x["numbers"] if "numbers" in x else title_numbers(x["title_norm"]) for x in (a, b))
    ta, tb = (F.coalesce(x["title_model_tokens"], _none()) for x in (a, b))
    strict = F.coalesce(F.array_contains(tb, a["model_no"]), no) | F.coalesce(F.array_contains(ta, b["model_no"]), no)
    return {
        "jac": jaccard(*tokens),
        "relation": model_relation(a["model_no"], b["model_no"]),
        "strict": strict,
        "cross": (strict | F.arrays_overlap(ta, tb)).cast("double"),
        "apart": ((F.size(na) > 0) & (F.size(nb) > 0) & ~F.arrays_overlap(na, nb)).cast("double"),
        "price": price_similarity(a["price"], b["price"]),
        "same": F.coalesce((a["brand"] == b["brand"]) & (a["brand"] != ""), no).cast("double"),
    }


def score_features(f: dict[str, Column], w: dict[str, float | Column] | None = None) -> Column:
    """struct(score, reason) of features.

    Models that agree decide; models in conflict decide unless one stands in the
    other's title; else a weighted mean of what is known, less for numbers that differ.
    """
    w = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in (w or X.PAIR_WEIGHTS).items()}
    relation, strict, price = f["relation"], f["strict"], f["price"]
    total = w["jac"] + w["cross"] + w["brand"] + F.when(price.isNotNull(), w["price"]).otherwise(0.0)
    blended = (w["jac"] * f["jac"] + w["cross"] * f["cross"] + w["brand"] * f["same"] + F.coalesce(w["price"] * price, F.lit(0.0))) / total - w["num"] * f["apart"]
    agree = relation.isin("equal", "prefix", "contains")
    score = F.when(agree, 1.0).when(relation == "conflict", F.when(strict, 0.9).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), blended))
    reason = F.when(agree, F.concat(F.lit("model_"), relation)).when(relation == "conflict", F.when(strict, "model_in_other_title").otherwise("model_conflict")).otherwise("blended")
    return F.struct(score.alias("score"), reason.alias("reason"))


def score_pair(a: dict[str, Column], b: dict[str, Column], w: dict[str, float | Column] | None = None) -> Column:
    """struct(score, reason) of two records with title_norm, model_no, title_model_tokens, price and brand."""
    return score_features(pair_features(a, b), w)


def display_type(c: Column) -> Column:
    """A product type as readers see it: vacuums by their kind first; empty if null."""
    rest = F.replace(F.replace(F.substr(c, F.lit(8)), F.lit("-"), F.lit(" ")), F.lit("/"), F.lit(" or "))
    return F.when(c.startswith("vacuum-"), F.when(rest == "other", "vacuum").otherwise(F.concat(rest, F.lit(" vacuum")))).when(c.isin(*X.TYPE_LABELS), F.replace(c, F.lit("/"), F.lit(" or "))).otherwise(F.coalesce(c, F.lit("")))


def complaint_headline(label: Column, own: Column, peers: Column) -> Column:
    """The leading complaint against its peers' rate; without a positive share there is none."""
    ratio = own / F.nullif(peers, F.lit(0.0))
    leads = F.concat(label, F.lit(" leads complaints"))
    times = F.concat(leads, F.lit(", "), F.format_number(ratio, 1), F.lit("x the peer rate"))
    beside = F.when(ratio >= 1.3, times).when(ratio <= 0.77, F.concat(leads, F.lit(", below the peer rate"))).when(ratio.isNotNull(), F.concat(leads, F.lit(", close to the peer rate")))
    return F.when(own > 0, F.coalesce(beside, leads)).otherwise("Owners report a spread of complaints, none dominant")
