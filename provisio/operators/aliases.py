"""Alias records: everything that an item's raw name tells, in one select over distinct names.

Rules are rows: a wrapper or tag is a pattern, a family a pattern with its subtype, group and unit, and a step of the group classifier says which patterns
a name must have and lack and how its code begins, with its method and confidence. The first row that fits counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import flags, ladder
from provisio.operators.items import clean_name, strengths

# Fixed values. Operational tags in order, each with its pattern.
TAGS = (
    ("promo", r"\bpromo(?:tion(?:al)?)?\b|\bgift\b"), ("visit", r"\bvisit(?:ing)?\b"), ("rehab", r"\brehab\b"), ("free", r"\bfree\b"), ("paid", r"\bpaid\b"), ("uncovered", r"\buncovered\b"),
    ("courier", r"\bcourier\b"), ("rental", r"\brent(?:al|ed)?\b"), ("main", r"\bmain office\b"), ("branch", r"\bbranch\b"), ("internal", r"\binternal\b"),
)
_TAG = "|".join(f"(?:{p})" for _, p in TAGS)
WRAPPERS = (
    r"^\s*(?:\d+(?:-\d+)?|[a-h])\s*[.):_]\s*", rf"^\s*[\[(]\s*[*]?\s*(?:{_TAG})[^\])]*[\])]\s*[-_:]?\s*", rf"\s*[\[(]\s*[*]?\s*(?:{_TAG})[^\])]*[\])]\s*$", rf"[\s_-]+(?:{_TAG})\s*$",
)


class Family(NamedTuple):
    pattern: str
    family: str
    name: str
    group: str
    unit: str
    subtypes: tuple[tuple[str, str], ...] = ()
    specification: str = ""  # the pattern whose match is the specification
    material: str = ""


FAMILIES = (
    Family(r"\bsyringe", "DISPOSABLE_SYRINGE", "Disposable syringe", "MED_SUPPLY", "EA", ((r"\d\s*g\b", "WITH_NEEDLE"), ("", "USAGE_BASED")), r"\d+(?:\.\d+)?\s*(?:ml|cc)", "PP;PE"),
    Family(r"\bneedle|\blancet", "INJECTION_NEEDLE", "Injection needle", "MED_SUPPLY", "EA", ((r"\blancet", "LANCET"), (r"\bbutterfly", "BUTTERFLY"), ("", "NEEDLE")), r"\d+\s*g\b", "STEEL"),
    Family(r"\bgauze", "MEDICAL_GAUZE", "Medical gauze", "MED_SUPPLY", "SHEET", ((r"\bsterile", "STERILE"), ("", "PLAIN")), r"\d+\s*(?:cm)?\s*[x*]\s*\d+", "COTTON"),
    Family(r"\bwaste (?:bag|box|drum)", "MEDICAL_WASTE_CONTAINER", "Medical waste container", "MED_SUPPLY", "EA", ((r"\bbag", "PE_BAG"), (r"\bdrum", "RIGID_DRUM"), (r"\bbox", "CARDBOARD_BOX")), r"\d+\s*l\b", ""),
    Family(r"\bglove", "GLOVE", "Glove", "MED_SUPPLY", "PAIR", ((r"\blatex", "LATEX"), ("", "NITRILE")), "", "LATEX"),
)


class Step(NamedTuple):
    """A name with `has` and without `lacks`, whose code begins with `code` and not with `not_code`; "" asks nothing. None as group: the family's."""

    group: str | None
    method: str
    confidence: float
    has: str = ""
    lacks: str = ""
    code: str = ""
    not_code: str = ""


STEPS = (
    Step("FUEL", "pattern:fuel", 0.98, r"\bdiesel\b|\bfuel\b|\bgasoline\b"), Step("WASTE", "pattern:waste", 0.95, r"\bwaste disposal\b|\bwaste fee\b"), Step(None, "family", 0.95), Step("DISINFECT", "pattern:disinfect", 0.92, r"\bdisinfect|\bethanol\b"),
    Step("LAB_REAGENT", "pattern:lab_reagent", 0.90, r"\breagent\b|\bassay\b"), Step("LAB_REAGENT", "pattern:culture_media", 0.90, r"\bculture\b|\bmedia\b", r"\bbadge\b"), Step("MED_SUPPLY", "pattern:medical_supply", 0.88, r"\bbandage\b|\bmask\b|\bcatheter\b", r"\btoy\b|\boffice\b"),
    Step("KM_EXTRACT", "pattern:km_extract", 0.90, r"\bextract\b|\bgranule", code="^(?:oom|omd|o)"), Step("KM_HERB", "pattern:km_herb", 0.88, r"\bherb\b|\broot\b", r"\bgarden\b"), Step("SUPPLEMENT", "pattern:supplement", 0.90, r"\bvitamin\b|\bomega\b"),
    Step("MED_INJECT", "dosage_form:injection", 0.86, r"\binjection\b|\bampoule\b"), Step("MED_TOPICAL", "dosage_form:topical", 0.86, r"\bcream\b|\bointment\b|\bgel\b", r"\bshaving\b|\bice\b"), Step("MED_ORAL", "dosage_form:oral", 0.86, r"\btablet\b|\bcapsule\b|\bsyrup\b", r"\bholder\b", not_code="^use"),
    Step("MED_ORAL", "dosage_form:oral", 0.86, r"\btablet\b|\bcapsule\b|\bsyrup\b", r"\bholder\b|\bcase\b|\bpc\b", code="^use"), Step("MED_INJECT", "dosage_form:injection_suffix", 0.82, r"\binj\.?$", not_code="^use"), Step("UNCLASSIFIED", "code_hint:unresolved", 0.20, code="^(?:oom|omd|o)"),
)
NOTHING = Step("UNCLASSIFIED", "no_rule", 0.0)
RENTAL_ASSET = r"\b(?:wheelchair|bed|frame|walker)\b"
FORECASTABLE = {"MED_ORAL": "t", "MED_INJECT": "t", "MED_TOPICAL": "t", "MED_SUPPLY": "t", "LAB_REAGENT": "t", "DISINFECT": "t", "KM_EXTRACT": "t", "KM_HERB": "t", "SUPPLEMENT": "t", "FUEL": "f", "WASTE": "f", "PROMO": "f", "RENTAL": "f", "UNCLASSIFIED": "f"}
FORMS = {"MED_ORAL": ((r"\btablet\b", "tablet"), (r"\bcapsule\b", "capsule"), (r"\bsyrup\b", "syrup")), "MED_INJECT": (("", "injection"),), "MED_TOPICAL": ((r"\bcream\b", "cream"), (r"\bointment\b", "ointment"), (r"\bgel\b", "gel"))}
PACK = r"(\d+)\s*(ea|tab|tablets|cap|box|bottle|vial|sheet|pair)\b"


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i){pattern}") if pattern else F.lit(True)


def stripped(c: Column, wrappers: Sequence[str] = WRAPPERS) -> Column:
    """c without wrappers, however many lie around each other. Each round takes at most one of each kind; rounds go on while the text changes, and each that does shortens it, so its length bounds them. What would leave nothing leaves c."""

    def round_of(text: Column) -> Column:
        for w in wrappers:
            text = F.regexp_replace(text, f"(?i){w}", "")
        return text

    start = F.struct(c.alias("text"), F.lit(False).alias("done"))
    fold = F.aggregate(F.sequence(F.lit(0), F.length(c)), start, lambda s, _: F.when(s["done"], s).otherwise(F.transform(F.array(round_of(s["text"])), lambda t: F.struct(t.alias("text"), (t == s["text"]).alias("done")))[0]))
    bare = F.regexp_replace(fold["text"], r"^[ \-_:./]+|[ \-_:./]+$", "")
    return F.when(bare != "", bare).otherwise(c)


def tags(c: Column) -> Column:
    """Every operational tag that a name has, in the order of the rules."""
    return flags([(matches(c, p), t) for t, p in TAGS])


def family_of(c: Column, value) -> Column:
    """value (of a Family, to a column) for the first family whose pattern matches."""
    return ladder([(matches(c, f.pattern), value(f)) for f in FAMILIES], "")


def classified(c: Column, code: Column) -> Column:
    """struct(group, method, confidence) of the first step that fits."""
    group, family = family_of(c, lambda f: f.group), family_of(c, lambda f: f.family)
    told = lambda s: F.struct(*((group if s.group is None else F.lit(s.group)).alias("group"), (F.concat(F.lit("family:"), family) if s.group is None else F.lit(s.method)).alias("method"), F.lit(s.confidence).alias("confidence")))

    def fits(s: Step) -> Column:
        if s.group is None:
            return family != ""
        ok = matches(c, s.has) & matches(code, s.code)
        ok = ok & ~matches(c, s.lacks) if s.lacks else ok
        return ok & ~matches(code, s.not_code) if s.not_code else ok

    return ladder([(fits(s), told(s)) for s in STEPS], told(NOTHING))


def records(names: DataFrame, normal_form: str | None = "NFKC") -> DataFrame:
    """names (raw, code), distinct: a record each. A family whose group isn't the classifier's doesn't count. Null names are blank names."""
    cleaned = names.withColumn("cleaned_name", clean_name(F.col("raw"), normal_form)).withColumn("__code", F.coalesce(F.trim("code"), F.lit("")))
    bare = cleaned.withColumns({"product_name": stripped(F.col("cleaned_name")), "__tags": tags(F.col("cleaned_name"))})
    p = F.col("product_name")
    rows = bare.withColumn("__c", classified(p, F.col("__code")))
    known = family_of(p, lambda f: f.group) == F.col("__c.group")
    of = lambda value: F.when(known, family_of(p, value)).otherwise("")
    promo, rental = matches(F.col("raw"), TAGS[0][1]), matches(F.col("raw"), TAGS[7][1])
    klass = F.when(promo, "PROMOTIONAL_USE").when(rental, "RENTAL_PROGRAM").otherwise("GENERAL")
    asset = ~promo & rental & matches(F.col("raw"), RENTAL_ASSET)
    by_class = lambda on_promo, on_asset, other: F.when(promo, on_promo).when(asset, on_asset).otherwise(other)
    group = by_class("PROMO", "RENTAL", F.col("__c.group"))
    look = lambda c, values: ladder([(c == k, v) for k, v in values.items()], "")
    form = ladder([(F.col("__c.group") == g, ladder([(matches(p, w), v) for w, v in rules], "")) for g, rules in FORMS.items()], "")
    packs = F.regexp_extract_all(F.lower(p), F.lit(PACK), F.lit(0))
    pack = F.coalesce(F.try_element_at(packs, F.lit(-1)), F.lit(""))
    details = F.filter(F.transform(F.regexp_extract_all(p, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(f"(?i){_TAG}"))
    specification = of(lambda f: F.upper(F.regexp_replace(F.regexp_extract(p, f"(?i){f.specification}", 0), r"\s+", "")) if f.specification else F.lit(""))
    subtype = of(lambda f: ladder([(matches(p, w), v) for w, v in f.subtypes], ""))
    family = of(lambda f: F.lit(f.family))
    return rows.select(
        "raw", "code", "cleaned_name", "product_name", F.array_join("__tags", ";").alias("operational_tags"), klass.alias("operational_class"), family.alias("family_id"), of(lambda f: F.lit(f.name)).alias("family_name"), subtype.alias("subtype_id"), of(lambda f: F.lit(f.unit)).alias("standard_unit"),
        F.col("__c.group").alias("intrinsic_group"), group.alias("group_id"), look(F.col("__c.group"), FORECASTABLE).alias("forecastable_default"), look(group, FORECASTABLE).alias("forecastable"), by_class("operational:promo", "operational:rental_asset", F.col("__c.method")).alias("classification_method"),
        by_class(0.99, 0.98, F.col("__c.confidence")).alias("classification_confidence"), form.alias("dosage_form"), strengths(p).alias("strengths"), F.regexp_extract(pack, PACK, 1).alias("pack_quantity"), F.regexp_extract(pack, PACK, 2).alias("pack_unit"), specification.alias("specification"),
        of(lambda f: F.lit(f.material)).alias("material"), F.array_join(details, ";").alias("details"), F.when(family != "", "family_candidate").when(F.col("__c.group") != "UNCLASSIFIED", "group_candidate").otherwise("unresolved").alias("status"),
    )
