"""Attributes of item names as claimed spans.

Every extractor claims spans of the name: where it starts and ends, of which kind, with which priority. One schedule keeps
claims that don't overlap: by priority, then the longer, then the earlier, so the order in which extractors are listed changes nothing.
What no claim covers is the base name. Ingredients and makers come from dictionaries through joins: an alias meets names by its
first word and is verified where that word stands, so the cost follows the words and not words times aliases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import ladder
from provisio.sources import stored

# Units as they are written and as they are told, marks of companies, notes and ingredients.
NUMBER = r"\d+(?:[.,]\d+)*"
MASS, VOLUME = "mcg|ug|mg|kg|g|iu", "ml|cc|l"
UNITS = {"ml": "mL", "cc": "mL", "l": "L", "iu": "IU", "ug": "mcg"}
PACKS = {"ea": "EA", "pcs": "EA", "tab": "TABLET", "cap": "CAPSULE", "sheet": "SHEET", "roll": "ROLL", "box": "BOX", "bottle": "BOTTLE", "sachet": "SACHET", "tube": "TUBE", "vial": "VIAL", "bag": "BAG", "pack": "PACK"}
PACK = "|".join(PACKS)
GAUGES = "1[4-9]|2[0-9]|3[0-4]"
COMPANY = r"(?i)\b(?:co\.,?\s*ltd|ltd|inc|corp|gmbh|pharma?|laborator(?:y|ies))\b"
CORPORATE = r"(?i),?\s*\b(?:co\.,?\s*ltd\.?|ltd\.?|inc\.?|corp\.?|gmbh)"
NOTE = r"(?i)\b(?:with|without|for|free|note|new|old|use)\b"
INGREDIENT_LIKE = r"(?i)(?:acid|ine|ate|ide|sodium|potassium|calcium)$"
CLAIMS = "array<struct<priority:int,shorter:int,start:int,end:int,kind:string,value:string,source:string,score:int>>"
# What a name is about decides how its measures are read.
MEDICATION, TOPICAL, NEEDLE, SUPPLY = "medication", "topical", "needle", "supply"


def number(c: Column) -> Column:
    """A number without thousands commas and trailing zeros."""
    c = F.replace(c, F.lit(","), F.lit(""))
    return F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def unit(c: Column) -> Column:
    low = F.lower(c)
    return ladder([(low == k, v) for k, v in (UNITS | PACKS).items()], low)


def measure(c: Column) -> Column:
    """'1,000 ml' as 1000mL."""
    return F.concat(number(F.regexp_extract(c, NUMBER, 0)), unit(F.regexp_extract(c, "([A-Za-z]+)$", 1)))


def ratio(c: Column) -> Column:
    """'3 g/500ml' as 3g/500mL, '0.90 %' as 0.9%."""
    top, bottom = F.trim(F.split_part(c, F.lit("/"), F.lit(1))), F.trim(F.split_part(c, F.lit("/"), F.lit(2)))
    return F.when(c.endswith("%"), F.concat(number(F.regexp_extract(c, NUMBER, 0)), F.lit("%"))).otherwise(F.concat(measure(top), F.lit("/"), measure(bottom)))


def dimension(c: Column) -> Column:
    """'10cm*5 cm' as 10cm x 5cm."""
    parts = F.transform(F.split(c, r"[xX*×]"), lambda p: F.concat(number(F.regexp_extract(p, NUMBER, 0)), F.lower(F.regexp_extract(p, "([A-Za-z]*)\\s*$", 1))))
    return F.array_join(parts, " x ")


def claimed(text: Column, pattern: str, kind: Column | str, priority: int, value: Callable[[Column], Column] = F.trim, inner: str | None = None, source: str = "literal", score: Callable[[Column, Column], Column] | None = None, when: Column | None = None, whole: bool = False) -> Column:
    """Every match of a pattern as a claim. inner: the part of a match that is claimed; value: what it says, or with whole what the match says; score (of start and end): how likely it is the one meant."""
    pattern = f"(?i){pattern}"
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(x))

    def claim(raw: Column, i: Column) -> Column:
        own = F.regexp_extract(raw, f"(?i){inner}", 0) if inner else raw
        at = length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(hits, F.lit(1), i)) + F.instr(raw, own) - 1
        # bound once, as the places of a claim are read many times
        return F.transform(F.array(at), lambda start: span(priority, start, start + F.length(own), kind, value(raw if whole else own), source, score(start, start + F.length(own)) if score else F.lit(0)))[0]

    found = F.transform(hits, claim)
    return found if when is None else F.when(when, found).otherwise(F.slice(found, 1, 0))


def span(priority: int, start: Column, end: Column, kind: Column | str, value: Column, source: Column | str, score: Column | None = None) -> Column:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    score = F.lit(0) if score is None else score
    return F.struct(F.lit(priority).alias("priority"), (start - end).cast("int").alias("shorter"), start.cast("int").alias("start"), end.cast("int").alias("end"), lit(kind).alias("kind"), value.alias("value"), lit(source).alias("source"), score.cast("int").alias("score"))


def scheduled(all_claims: Column) -> Column:
    """The claims that stand, by start: each in order of priority, length and start, unless it meets one that stands."""
    kept = F.aggregate(F.array_sort(all_claims), F.array().cast(CLAIMS), lambda s, c: F.when(F.exists(s, lambda k: (c["start"] < k["end"]) & (k["start"] < c["end"])), s).otherwise(F.array_append(s, c)))
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])


def brackets(text: Column) -> Column:
    """Outermost bracketed parts, however deep: array of (start, end, inside). A closing bracket of the other shape doesn't count."""
    marks = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.struct(i.alias("at"), F.substring(text, i, F.lit(1)).alias("sign")))
    marks = F.filter(marks, lambda m: m["sign"].isin("(", ")", "[", "]"))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(s: Column, m: Column) -> Column:
        last = F.right(s["open"], F.lit(1))
        closes = ((m["sign"] == ")") & (last == "(")) | ((m["sign"] == "]") & (last == "["))
        rest = F.left(s["open"], F.length(s["open"]) - 1)
        state = lambda o, at, found: F.struct(o.alias("open"), at.alias("at"), found.alias("found"))
        done = F.array_append(s["found"], F.struct((s["at"] - 1).cast("int").alias("start"), m["at"].cast("int").alias("end")))
        return (
            F.when(m["sign"].isin("(", "["), state(F.concat(s["open"], m["sign"]), F.when(s["open"] == "", m["at"]).otherwise(s["at"]), s["found"]))
            .when(closes, state(rest, s["at"], F.when(rest == "", done).otherwise(s["found"])))
            .otherwise(s)
        )

    found = F.aggregate(F.when(F.length(text) > 0, marks).otherwise(F.slice(marks, 1, 0)), start, step)["found"]
    return F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substring(text, p["start"] + 2, p["end"] - p["start"] - 2).alias("inside")))


def measured(name: Column, context: Column) -> Column:
    """Claims on everything that is written as a number with a unit."""
    needle, drug, topical = context == NEEDLE, context.isin(MEDICATION, TOPICAL), context == TOPICAL
    per, end_of = rf"{NUMBER}\s*(?:{MASS}|{VOLUME})\s*/\s*(?:{PACK})\b", lambda c: F.regexp_extract(c, "([A-Za-z]+)$", 1)
    counted = rf"{NUMBER}\s*\(\s*\d+\s*\)\s*(?:{VOLUME})\s*/\s*(?:{PACK})\b"  # 500(1)ml/bottle
    before = lambda start, n: F.substring(name, F.greatest(start - n + 1, F.lit(1)), F.least(F.lit(n), start))
    after = lambda end: F.substring(name, end + 1, F.length(name))
    score = lambda start, end: F.lit(20) + F.when(before(start, 3).contains("-"), 80).otherwise(0) + F.when(F.trim(F.regexp_replace(after(end), r"[)\]_/.-]+", "")) == "", 60).otherwise(0) - F.when(before(start, 3).contains("/"), 15).otherwise(0)
    mass = F.when(drug, F.lit("strength")).otherwise(F.lit("net_weight"))
    return F.flatten(
        F.array(
            claimed(name, rf"{NUMBER}\s*(?:{MASS})\s*/\s*{NUMBER}\s*(?:{MASS}|{VOLUME}|{PACK})\b", "concentration", 10, ratio),
            claimed(name, rf"{NUMBER}\s*%", "concentration", 10, ratio),
            claimed(name, rf"{NUMBER}\s*(?:{MASS})\s*/\s*(?:{PACK})\b", "net_weight", 15, measure, rf"^{NUMBER}\s*(?:{MASS})"),
            claimed(name, rf"{NUMBER}\s*(?:{VOLUME})\s*/\s*(?:{PACK})\b", "capacity", 15, measure, rf"^{NUMBER}\s*(?:{VOLUME})"),
            claimed(name, counted, "capacity", 14, lambda c: F.concat(number(F.regexp_extract(c, NUMBER, 0)), unit(F.regexp_extract(c, r"\)\s*([A-Za-z]+)", 1))), rf"^{NUMBER}\s*\(\s*\d+\s*\)\s*[a-z]+", whole=True),
            claimed(name, counted, "pack", 14, lambda c: F.concat(F.regexp_extract(c, r"\(\s*(\d+)", 1), F.lit(" "), unit(end_of(c))), r"/\s*[a-z]+$", "counted_volume", lambda s, e: F.lit(120), whole=True),
            claimed(name, per, "pack", 16, lambda c: F.concat(F.lit("1 "), unit(end_of(c))), r"/\s*[A-Za-z]+$", "per_package", lambda s, e: F.lit(110)),
            claimed(name, rf"\b(?:{GAUGES})\s*g(?:x|\b)", "gauge", 20, lambda c: F.concat(F.regexp_extract(c, r"\d+", 0), F.lit("G")), when=needle),
            claimed(name, r"\b\d+\s*fr\b", "gauge", 20, lambda c: F.concat(F.regexp_extract(c, r"\d+", 0), F.lit("Fr"))),
            claimed(name, rf"{NUMBER}\s*(?:cm|mm|m)?\s*[x*×]\s*{NUMBER}\s*(?:cm|mm|m)\b(?:\s*[x*×]\s*{NUMBER}\s*(?:cm|mm|m)\b)?", "dimension", 30, dimension),
            claimed(name, rf"{NUMBER}\s*(?:mm|inch)\b", "needle_length", 40, measure, when=needle),
            claimed(name, rf"{NUMBER}\s*(?:{VOLUME})\b", "capacity", 50, measure),
            claimed(name, rf"-\s*{NUMBER}\s*(?:mg|g)\s*(?:\(\s*\d+\s*ea\s*\))?\s*$", "net_weight", 55, measure, rf"{NUMBER}\s*(?:mg|g)", when=topical),
            claimed(name, rf"{NUMBER}\s*(?:{MASS})\b", mass, 60, measure),
            claimed(name, rf"\d+\s*(?:{PACK})\b", "pack", 70, lambda c: F.concat(F.regexp_extract(c, r"\d+", 0), F.lit(" "), unit(end_of(c))), None, "literal", score),
        )
    )


def first_word(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"([\p{L}\p{N}]+)", 1)


def dictionary_claims(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """names (name), dictionary (alias, canonical): (name, found): claims on whole words that are an alias, in any case; longer ones first. The smallest canonical counts of one alias."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    met = names.select("name", F.explode(words).alias("word"))
    known = dictionary.where(first_word(F.col("alias")) != "").groupBy(F.lower(F.trim("alias")).alias("alias")).agg(F.min("canonical").alias("canonical")).withColumn("word", first_word(F.col("alias")))
    j = met.join(known, "word").where(F.contains(F.lower("name"), F.col("alias")))
    # every place where the alias stands with no letter or digit beside it
    low, size = F.lower("name"), F.length("alias")
    beside = lambda at: F.substring(low, at, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    places = F.filter(F.sequence(F.lit(1), F.length("name") - size + 1), lambda i: (F.substring(low, i, size) == F.col("alias")) & ~((i > 1) & beside(F.greatest(i - 1, F.lit(1)))) & ~beside(i + size))
    found = j.select("name", F.transform(places, lambda i: span(80, i - 1, i - 1 + size, "ingredient", F.col("canonical"), "dictionary")).alias("f"))
    return found.groupBy("name").agg(F.flatten(F.collect_list("f")).alias("found"))


def company(inside: Column) -> Column:
    """A company's name without its legal form, single-spaced."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(inside, CORPORATE, ""), r"[()\[\]]", " "), r"\s+", " ")), r"[-_/.,\s]+$", "")


def maker_claims(names: DataFrame, makers: DataFrame) -> DataFrame:
    """names (name), makers (maker): (name, makers): bracketed parts that are a known maker, by equality of the name without its legal form in lower case."""
    parts = names.select("name", F.explode(brackets(F.col("name"))).alias("p")).select("name", "p", F.lower(company(F.col("p.inside"))).alias("key"))
    known = makers.select(F.lower(company(F.col("maker"))).alias("key")).where("key <> ''").distinct()
    found = parts.join(known, "key").select("name", span(90, F.col("p.start"), F.col("p.end"), "manufacturer", company(F.col("p.inside")), "dictionary", F.lit(1)).alias("m"))
    return found.groupBy("name").agg(F.collect_list("m").alias("makers"))


def parsed(names: DataFrame, dictionary: DataFrame, makers: DataFrame) -> DataFrame:
    """names (name, context), distinct; dictionary (alias, canonical); makers (maker). Attributes of each name, what is left, and how far it can be matched. Null names go, a null context is none."""
    names = names.where("name is not null").select("name", F.coalesce("context", F.lit("")).alias("context"))
    ingredient, maker = dictionary_claims(names.where(F.col("context").isin(MEDICATION, TOPICAL)), dictionary), maker_claims(names, makers)
    empty = F.array().cast(CLAIMS)
    rows = names.join(ingredient, "name", "left").join(maker, "name", "left").withColumns({"found": F.coalesce("found", empty), "makers": F.coalesce("makers", empty), "parts": brackets(F.col("name"))})
    drug = F.col("context").isin(MEDICATION, TOPICAL)
    within = lambda c: F.exists("parts", lambda p: (p["start"] < c["start"]) & (c["end"] < p["end"]))
    # an ingredient that the name brackets is meant, so those outside brackets are part of the product's name
    rows = rows.withColumn("found", F.when(F.exists("found", within), F.filter("found", within)).otherwise(F.col("found")))
    bare = lambda p: ~p["inside"].rlike(r"\d") & (F.trim(p["inside"]) != "") & ~p["inside"].rlike(NOTE)
    of_marks = F.transform(F.filter("parts", lambda p: bare(p) & p["inside"].rlike(COMPANY)), lambda p: span(91, p["start"], p["end"], "manufacturer", company(p["inside"]), "company_mark", F.lit(0)))
    unmapped = F.transform(F.filter("parts", lambda p: bare(p) & ~p["inside"].rlike(COMPANY) & F.trim(p["inside"]).rlike(INGREDIENT_LIKE)), lambda p: span(100, p["start"], p["end"], "ingredient", F.concat(F.lit("UNMAPPED::"), F.upper(F.regexp_replace(p["inside"], r"\s+", ""))), "unmapped"))
    rows = rows.withColumn("tokens", scheduled(F.concat(measured(F.col("name"), F.col("context")), "found", "makers", of_marks, F.when(drug, unmapped).otherwise(empty))))
    return stored(rows.select("name", "context", "parts", "tokens"), "name-claims").select("name", "context", "tokens", *told())


def told() -> list[Column]:
    """Columns from the tokens that stand."""
    t = F.col("tokens")
    of = lambda kind: F.filter(t, lambda c: c["kind"] == kind)
    values = lambda xs: F.array_distinct(F.transform(xs, lambda c: c["value"]))
    joined = lambda kind: F.array_join(values(of(kind)), ";")
    first, last = (lambda kind: F.coalesce(F.get(values(of(kind)), F.lit(0)), F.lit(""))), (lambda kind: F.coalesce(F.try_element_at(values(of(kind)), F.lit(-1)), F.lit("")))
    drug = F.col("context").isin(MEDICATION, TOPICAL)
    tops = F.transform(F.filter(of("concentration"), lambda c: c["value"].contains("/")), lambda c: F.split_part(c["value"], F.lit("/"), F.lit(1)))
    strengths = F.array_join(F.array_distinct(F.concat(F.when(drug, tops).otherwise(F.slice(tops, 1, 0)), values(of("strength")))), ";")
    best = F.array_max(F.transform(of("pack"), lambda c: F.struct(c["score"].alias("score"), c["start"].alias("start"), c["value"].alias("value"))))["value"]
    capacity, role = last("capacity"), ladder([(F.col("context") == NEEDLE, "instrument_capacity"), (drug, "container_volume")], "package_capacity")
    # what no claim covers, but for ingredients outside brackets, which are part of the product's name; a bracket around a claim goes with it
    masks = F.filter(t, lambda c: (c["kind"] != "ingredient") | F.exists("parts", lambda p: (p["start"] <= c["start"]) & (c["end"] <= p["end"])))
    blank = lambda s, a, b: F.concat(F.left(s, a), F.repeat(F.lit(" "), b - a), F.substring(s, b + 1, F.length(s)))
    base = F.aggregate(masks, F.col("name"), lambda s, c: blank(s, c["start"], c["end"]))
    met = lambda p: F.exists(t, lambda c: (p["start"] < c["end"]) & (c["start"] < p["end"]))
    free = F.filter("parts", lambda p: ~met(p) & (F.trim(p["inside"]) != ""))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[\s_\-/,:;*×()\[\]{}]+", " "), r"[ .]+$", ""))
    base = F.when(clean(base) != "", clean(base)).otherwise(F.col("name"))
    noted = lambda p: p["inside"].rlike(NOTE)
    unresolved = F.filter(free, lambda p: ~noted(p))
    source = F.array_join(F.array_distinct(F.transform(of("ingredient"), lambda c: c["source"])), ";")
    reasons = [(F.col("context") == "", "unclassified_item_group"), (drug & (F.size(of("ingredient")) == 0), "medication_ingredient_unresolved"), (F.exists(of("ingredient"), lambda c: c["source"] == "unmapped"), "ingredient_requires_verification"), (F.size(unresolved) > 0, "unresolved_parenthetical_tokens")]
    why = F.array_join(F.filter(F.array(*(F.when(c, F.lit(v)) for c, v in reasons)), lambda x: x.isNotNull()), ";")
    verified = F.exists(t, lambda c: c["source"] == "dictionary")
    confidence = 0.55 + F.when(F.col("context") != "", 0.1).otherwise(0.0) + F.when(F.size(t) > 0, 0.1).otherwise(0.0) + F.when(verified, 0.15).otherwise(0.0) - F.least(F.lit(0.2), F.size(unresolved) * 0.05)
    inside = lambda xs: F.array_join(F.transform(xs, lambda p: F.trim(p["inside"])), ";")
    quantity, pack_unit = F.coalesce(F.split_part(best, F.lit(" "), F.lit(1)), F.lit("")), F.coalesce(F.split_part(best, F.lit(" "), F.lit(2)), F.lit(""))
    key = [F.col("context"), capacity, first("gauge"), first("needle_length"), first("dimension"), quantity, pack_unit]
    return [
        base.alias("base_name"), joined("concentration").alias("concentrations"), strengths.alias("active_strengths"), joined("net_weight").alias("net_weight"), capacity.alias("capacity"), F.when(capacity != "", role).otherwise("").alias("capacity_role"),
        first("gauge").alias("gauge"), first("needle_length").alias("needle_length"), joined("dimension").alias("dimensions"), quantity.alias("pack_quantity"), pack_unit.alias("pack_unit"), joined("ingredient").alias("ingredients"), source.alias("ingredient_source"),
        F.coalesce(F.get(F.transform(of("manufacturer"), lambda c: c["value"]), F.lit(0)), F.lit("")).alias("manufacturer"), inside(F.filter(free, noted)).alias("notes"), inside(unresolved).alias("unresolved"), why.alias("reasons"), F.round(confidence, 3).alias("confidence"),
        F.when(verified & (F.size(unresolved) == 0), "verified").when(why != "", "needs_match").otherwise("parsed").alias("status"), F.array_join(F.array(*(F.when(c != "", c).otherwise("-") for c in key)), "|").alias("variant_key"),
    ]
