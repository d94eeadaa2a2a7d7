"""Rule cascades over item and ingredient names, attribute dictionaries and mapping contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import blank_to_null, flags, ladder
from provisio.operators.items import _nfkc, first_rule, strengths

# Patterns in order; the first that matches counts. Names are those of the given parts with made endings.
OPERATIONAL = [("promo|gift", "promo"), ("rental|lease", "rental"), ("waste", "waste"), ("fuel|diesel", "fuel")]
GROUPS = [("waste|container", "SUPPLY"), ("tablet|capsule|injection|cream|syrup|mg\\b", "DRUG"), ("gauze|needle|syringe", "DEVICE")]
FAMILIES = [("container|waste", "CONTAINER"), ("gauze", "GAUZE"), ("syringe", "SYRINGE"), ("needle", "NEEDLE")]
FORMS = {"DRUG": [("tablet", "TABLET"), ("capsule", "CAPSULE"), ("injection", "INJECTION"), ("cream|ointment", "EXTERNAL"), ("syrup", "SYRUP")], "DEVICE": [("gauze", "SHEET"), ("needle|syringe", "NEEDLE")]}
WASTE = [("bag", "BAG"), ("cardboard", "CARDBOARD"), ("rigid|drum", "RIGID")]
MATERIALS = {"WASTE_BAG": ("POLYETHYLENE", "subtype"), "WASTE_CARDBOARD": ("PAPERBOARD", "subtype"), "WASTE_RIGID": ("POLYPROPYLENE", "review")}
OFFICIAL = [("needle.*adult", "STD-NEEDLE-ADULT"), ("needle.*child", "STD-NEEDLE-CHILD"), ("needle", "STD-NEEDLE"), ("gauze.*sterile", "STD-GAUZE-STERILE"), ("gauze", "STD-GAUZE"), ("waste.*(rigid|drum)", "STD-WASTE-RIGID"), ("waste", "STD-WASTE"), ("syringe", "STD-SYRINGE")]
SUFFIXES = {"tablet": "정", "capsule": "캡슐", "cream": "크림", "syrup": "시럽"}
# Attributes in the order in which they are taken from a name; what one has taken, the next doesn't see.
ATTRIBUTES = [
    ("ingredient", r"\([^()]*\)"), ("concentration", r"\d+(\.\d+)?\s*mg/\d+(\.\d+)?\s*ml\b"), ("dimension", r"\d+\s*[x×]\s*\d+\s*cm\b"), ("gauge", r"\b\d+\s*g\b"), ("strength", r"\d+(\.\d+)?\s*(mg|mcg|iu|%)"),
    ("capacity", r"(<=|>)?\s*\d[\d,]*(\.\d+)?\s*m?l\b"), ("pack", r"\bx?\d+ea\b"), ("manufacturer", r"\b[a-z]+\s+(co\.,?\s*ltd\.?|inc\.?)"),
]


def rules_sql(column: str, rules: Sequence[tuple[str, str]], default: str) -> str:
    """The same first-match cascade as SQL."""
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{v}'" for p, v in rules) + f" ELSE '{default}' END"


def operational(df: DataFrame, name: str) -> DataFrame:
    """operational_class, and item_group, which goods for promotion and rented assets override."""
    kind, group = first_rule(F.col(name), OPERATIONAL, "none"), first_rule(F.col(name), GROUPS, "OTHER")
    return df.withColumns({"operational_class": kind, "item_group": ladder([(kind == "promo", "NON_MEDICAL"), (kind == "rental", "ASSET")], group)})


def dosage_form(df: DataFrame, name: str, group: str) -> DataFrame:
    """dosage_form by the patterns of the row's group; waste_subtype where exactly one kind of container is named."""
    form = ladder([(F.col(group) == g, first_rule(F.col(name), rules, "")) for g, rules in FORMS.items()], "")
    hits = flags([(F.col(name).rlike(f"(?i){p}"), v) for p, v in WASTE])
    sub = F.when(F.col(name).rlike("(?i)waste") & (F.size(hits) == 1), F.concat(F.lit("WASTE_"), hits[0])).otherwise(F.lit(""))
    return df.withColumns({"dosage_form": form, "waste_subtype": sub})


def material_of(df: DataFrame, subtype: str) -> DataFrame:
    """material and evidence that a container's subtype tells."""
    at = lambda k: ladder([(F.col(subtype) == s, v[k]) for s, v in MATERIALS.items()], "")
    return df.withColumns({"material": at(0), "evidence": at(1)})


def family_specification(df: DataFrame, name: str, family: str) -> DataFrame:
    """specification in the family's terms: sign and volume, width x height, or gauge with its age group; strengths that are no gauge."""
    t = F.regexp_replace(F.lower(name), r"(\d),(\d{3})", "$1$2")
    volume, sign = F.regexp_extract(t, r"(\d+(\.\d+)?)\s*(m?l)\b", 1), F.regexp_extract(t, r"(<=|>)\s*\d", 1)
    unit = F.regexp_extract(t, r"(\d+(\.\d+)?)\s*(m?l)\b", 3)
    container = F.when(volume != "", F.concat(ladder([(sign == "<=", "LE_"), (sign == ">", "GT_")], ""), volume, F.upper(unit)))
    size = F.regexp_extract(t, r"(\d+)\s*[x×]\s*(\d+)", 1)
    gauze = F.when(size != "", F.concat(size, F.lit("X"), F.regexp_extract(t, r"(\d+)\s*[x×]\s*(\d+)", 2)))
    gauge = F.regexp_extract(t, r"\b(\d+)\s*g\b", 1)
    needle = F.when(gauge != "", F.concat(gauge, F.lit("G"), ladder([(t.contains("adult"), "_ADULT"), (t.contains("child"), "_CHILD")], "")))
    spec = ladder([(F.col(family) == "CONTAINER", container), (F.col(family) == "GAUZE", gauze), (F.col(family).isin("NEEDLE", "SYRINGE"), needle)], None)
    return df.withColumns({"specification": F.coalesce(spec, F.lit("")), "strengths": strengths(F.col(name))})


def attributes(df: DataFrame, name: str) -> DataFrame:
    """Attributes taken one after another from distinct names, without overlap; leftover words; and how ready the name is for use."""
    out = df.withColumn("__rest", F.col(name))
    for a, p in ATTRIBUTES:
        out = out.withColumns({a: F.trim(F.regexp_extract("__rest", f"(?i){p}", 0)), "__rest": F.regexp_replace("__rest", f"(?i){p}", " ")})
    out = out.withColumn("leftover", F.trim(F.regexp_replace("__rest", r"\s+", " "))).drop("__rest")
    filled = sum(((F.col(a) != "").cast("int") for a, _ in ATTRIBUTES), F.lit(0))
    return out.withColumns({"attribute_count": filled, "readiness": ladder([(F.col("leftover") == "", "NO_NAME"), (filled == 0, "NAME_ONLY"), (filled >= 2, "READY")], "PARTIAL")})


def official(df: DataFrame, name: str, codes: str, prefixes: Sequence[str]) -> DataFrame:
    """standard_item by explicit rules, the dosage suffix, the first code with a known prefix, and the ingredient that stands in brackets."""
    known = F.filter(F.split(F.col(codes), ";"), lambda c: sum((c.startswith(p).cast("int") for p in prefixes), F.lit(0)) > 0)
    return df.withColumns({
        "standard_item": first_rule(F.col(name), OFFICIAL, ""), "dosage_suffix": ladder([(F.lower(name).contains(k), v) for k, v in SUFFIXES.items()], ""),
        "national_code": F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("")), "literal_ingredient": F.trim(F.regexp_extract(name, r"\(([^()]*)\)", 1)),
    })


def base_name(c: Column) -> Column:
    """A dictionary name without brackets, endings of companies and signs."""
    out = F.regexp_replace(F.lower(c), r"\([^()]*\)", " ")
    out = F.regexp_replace(out, r"\b(co\.,?\s*ltd\.?|inc\.?|corp\.?)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9 ]", " "), r"\s+", " "))


def dictionary(df: DataFrame, alias: str, ident: str, status: str) -> DataFrame:
    """Approved rows as (alias, ident) with canonical aliases; an alias of several idents is no key."""
    rows = df.where(F.lower(status) == "approved").select(base_name(F.col(alias)).alias("alias"), F.col(ident).alias("ident")).where("alias <> ''")
    return rows.groupBy("alias").agg(F.min("ident").alias("ident"), F.max("ident").alias("__most"), F.count("*").alias("rows")).where(F.col("ident") == F.col("__most")).drop("__most")


def ingredient(df: DataFrame, name: str) -> DataFrame:
    """A trailing strength in brackets apart from the name, and the name's code: upper-case ASCII, other signs as _, N_ before a digit."""
    bare = F.trim(F.regexp_replace(name, r"\s*\([^()]*\)\s*$", ""))
    ascii_ = F.regexp_replace(_nfkc("NFKD")(bare), r"[^\x00-\x7F]", "")
    code = F.regexp_replace(F.upper(F.regexp_replace(ascii_, r"[^A-Za-z0-9]+", "_")), "^_+|_+$", "")
    return df.withColumns({"ingredient": bare, "strength": F.regexp_extract(name, r"\(([^()]*[0-9][^()]*)\)\s*$", 1), "meta_code": F.when(code.rlike("^[0-9]"), F.concat(F.lit("N_"), code)).otherwise(code)})


def checked(df: DataFrame, key: Sequence[str], rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """df with problems: the names of the broken rules, and duplicate_key where the key isn't unique."""
    n = df.groupBy(*key).agg(F.count("*").alias("__n"))
    j = df.join(n, list(key), "left")
    return j.withColumn("problems", F.array_join(flags([*((F.coalesce(c, F.lit(True)), r) for c, r in rules), (F.col("__n") > 1, "duplicate_key")]), ";")).drop("__n")


def approved_load(df: DataFrame, status: str, key: Sequence[str], rules: Sequence[tuple[Column, str]], strict: bool = True) -> DataFrame:
    """Approved rows of a mapping. rules name what is wrong with a row; a null counts as wrong. Strict loads fail on the first such row, others leave it out."""
    rows = checked(df.where(F.lower(F.trim(status)) == "approved"), key, rules)
    if strict and (bad := rows.where("problems <> ''").select(*key, "problems").head(1)):
        raise ValueError(f"mapping row {bad[0].asDict()}")
    return rows.where("problems = ''").drop("problems")


def weight_rules(**bounds: tuple[float, float, bool]) -> list[tuple[Column, str]]:
    """Rules for numbers within (low, high]; True lets the low bound in."""
    out = []
    for c, (low, high, closed) in bounds.items():
        out.append((~((F.col(c) >= low if closed else F.col(c) > low) & (F.col(c) <= high)), f"{c}_range"))
    return out


def output_contract(outputs: dict[str, DataFrame], ident: str, codes: str, glossary: DataFrame, code: str, sentinel: str) -> DataFrame:
    """One row: what a set of outputs over the same ids may not have. The first output leads."""
    names = list(outputs)
    lead = outputs[names[0]]
    found = lead.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct(ident)).alias("duplicate_ids"), F.count_if(blank_to_null(F.col(ident).cast("string")).isNull()).alias("blank_ids"), F.count_if(F.col(codes) == sentinel).alias("sentinels"))
    used = lead.select(F.explode(F.split(codes, ";")).alias("__c")).where("trim(__c) <> ''").distinct()
    unknown = used.join(glossary.select(F.col(code).alias("__c")).distinct(), "__c", "left_anti").agg(F.count("*").alias("unknown_codes"))
    out = found.join(F.broadcast(unknown), F.lit(True))
    for n in names[1:]:
        a, c = lead.select(ident).distinct(), outputs[n].select(ident).distinct()
        diff = a.join(c, ident, "left_anti").agg(F.count("*").alias(f"missing_in_{n}")).join(F.broadcast(c.join(a, ident, "left_anti").agg(F.count("*").alias(f"only_in_{n}"))), F.lit(True))
        out = out.join(F.broadcast(diff), F.lit(True))
    wrong = [c for c in out.columns if c != "rows"]
    return out.withColumn("status", F.when(sum((F.col(c) for c in wrong), F.lit(0)) == 0, "PASS").otherwise("FAIL"))
