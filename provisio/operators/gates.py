"""Gates before loads: named rules over records, header contracts by file, counted rejects, prepared signals."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import flags, ladder
from provisio.sources.publish import Files

# ---- records

# Fixed values. A record's rules: name, and the condition that breaks it, in SQL that both engines run; a null condition breaks nothing.
RECORD_RULES = (
    ("missing_institution", "coalesce(trim(institution_id), '') = ''"), ("missing_item_code", "coalesce(trim(item_code), '') = ''"), ("missing_raw_name", "coalesce(trim(raw_name), '') = ''"), ("missing_product_name", "coalesce(trim(product_name), '') = ''"),
    ("key_differs", "local_item_key <> institution_id || '::' || item_code"), ("name_not_clean", "cleaned_name <> trim(cleaned_name)"), ("unknown_group", "group_id not in ('MED', 'SUPPLY', 'OTHER', 'PROMO')"), ("unknown_forecast_flag", "forecastable not in ('t', 'f')"),
    ("promo_is_forecast", "group_id = 'PROMO' and forecastable = 't'"), ("family_without_name", "family_id <> '' and coalesce(family_name, '') = ''"), ("name_without_family", "coalesce(family_id, '') = '' and family_name <> ''"), ("subtype_without_family", "coalesce(family_id, '') = '' and subtype_id <> ''"),
    ("specification_without_family", "coalesce(family_id, '') = '' and specification <> ''"), ("confidence_range", "confidence < 0 or confidence > 1"), ("no_occurrence", "occurrences < 1"), ("usage_not_finite", "usage is null or abs(usage) > 1e15"),
    ("dates_reversed", "first_seen > last_seen"), ("status_differs", "(status = 'family') <> (coalesce(family_id, '') <> '')"),
)


def gated(records: DataFrame, key: str, rules: Sequence[tuple[str, str]] = RECORD_RULES, strict: bool = True, examples: int = 100) -> tuple[DataFrame, DataFrame]:
    """(records that break no rule, errors: rule, n, and the smallest keys as examples). Strict: any error raises, with counts and examples."""
    told = records.withColumn("__errors", flags([(F.coalesce(F.expr(c), F.lit(False)), r) for r, c in rules]))
    long = told.select(F.col(key).cast("string").alias("k"), F.explode("__errors").alias("rule"))
    few = long.withColumn("__n", F.row_number().over(W.partitionBy("rule").orderBy("k"))).where(F.col("__n") <= examples).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("k")), ";").alias("examples"))
    errors = long.groupBy("rule").agg(F.count("*").alias("n")).join(few, "rule")
    if strict and (found := errors.orderBy("rule").collect()):  # as many rows as rules
        raise ValueError("; ".join(f"{r.rule}: {r.n}, such as {r.examples[:200]}" for r in found))
    return told.where(F.size("__errors") == 0).drop("__errors"), errors


# ---- headers


def heads(spark: SparkSession, path: str, most: int = 1 << 16) -> dict[str, bytes]:
    """The first bytes of each file of a folder or pattern: what a header or a signature needs. Files are opened one by one, and no more of them is read."""
    files = Files(spark, path)
    pattern = f"{path}/*" if files.fs.exists(files.path(path)) and files.fs.getFileStatus(files.path(path)).isDirectory() else path
    out = {}
    for s in files.fs.globStatus(files.path(pattern)) or []:
        name = s.getPath().getName()
        if s.isDirectory() or name.startswith(("_", ".")) or not s.getLen():
            continue
        stream = files.fs.open(s.getPath())
        try:
            bounded = files.jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)
            out[s.getPath().toString()] = bytes(files.jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
        finally:
            stream.close()
    return out


def header_of(head: bytes, sep: str, encoding: str) -> tuple[str, ...]:
    first = head.decode(encoding, "replace").lstrip("﻿").splitlines()[:1]
    return tuple(c.strip() for c in next(csv.reader(first, delimiter=sep), ())) if first else ()


def scan_by_header(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = (), sep: str = "|", encoding: str = "UTF-8") -> DataFrame:
    """Delimited files whose layouts differ, as one table of text columns. Each file's own header is checked before Spark renames what is doubled in it: a doubled or missing required column raises and names the file. Files of one layout are read together; optional columns that a layout lacks are null, other columns are kept."""
    layouts: dict[tuple[str, ...], list[str]] = {}
    for name, head in heads(spark, path).items():
        header = header_of(head, sep, encoding)
        if twice := sorted({c for c in header if header.count(c) > 1}):
            raise ValueError(f"{name}: doubled columns {twice}")
        if missing := sorted(set(required) - set(header)):
            raise ValueError(f"{name}: missing columns {missing}")
        layouts.setdefault(header, []).append(name)
    if not layouts:
        raise ValueError(f"no file with a header in {path}")
    out = None
    for header, names in sorted(layouts.items()):
        schema = ", ".join(f"`{c}` string" for c in header)
        one = spark.read.schema(schema).csv(names, sep=sep, header=True, quote='"', escape='"', multiLine=True, encoding=encoding, mode="FAILFAST")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumns({c: F.lit(None).cast("string") for c in optional if c not in out.columns})


# ---- a ledger of text with rejects that are counted


def ledger_rows(raw: DataFrame, bad: str, key: Sequence[str], date: str, numbers: Sequence[str], previous: str, closing: str, ins: Sequence[str], outs: Sequence[str], tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(rows, counters). Text columns become typed; rows that are ragged (bad isn't null), whose key has a blank or whose date is none go. counters, one row and one pass over the input: rows, bad_cols, bad_key, bad_date, kept, and of those kept bad_numbers, neg_closing, neg_prev, identity_checked and identity_bad
    (previous + ins - outs = closing, where both stocks are known)."""
    blank = F.lit(False)
    for k in key:
        blank = blank | (F.coalesce(F.trim(F.col(k)), F.lit("")) == "")
    number = {n: F.expr(f"try_cast(nullif(replace(trim(`{n}`), ',', ''), '') as double)") for n in numbers}
    day = F.coalesce(*(F.try_to_timestamp(F.trim(date), F.lit(f)) for f in ("yyyy-MM-dd", "yyyyMMdd"))).cast("date")
    state = ladder([(F.col(bad).isNotNull(), "bad_cols"), (blank, "bad_key"), (day.isNull(), "bad_date")], "kept")
    rows = raw.withColumns({"__state": state, "__bad_number": F.lit(False)}).withColumn("__bad_number", sum(((v.isNull() & (F.trim(F.coalesce(F.col(n), F.lit(""))) != "")).cast("int") for n, v in number.items()), F.lit(0)) > 0)
    rows = rows.withColumns({**{k: F.trim(k) for k in key}, date: day, **number})
    zero = lambda cs: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cs), F.lit(0.0))
    ok = F.col("__state") == "kept"
    both = ok & F.col(previous).isNotNull() & F.col(closing).isNotNull()
    off = F.abs(F.col(previous) + zero(ins) - zero(outs) - F.col(closing)) > tolerance
    counters = rows.agg(
        F.count("*").alias("rows"), *(F.count_if(F.col("__state") == s).alias(s) for s in ("bad_cols", "bad_key", "bad_date", "kept")), F.count_if(ok & F.col("__bad_number")).alias("bad_numbers"), F.count_if(ok & (F.col(closing) < 0)).alias("neg_closing"), F.count_if(ok & (F.col(previous) < 0)).alias("neg_prev"),
        F.count_if(both).alias("identity_checked"), F.count_if(both & off).alias("identity_bad"),
    )
    return rows.where(ok).drop("__state", "__bad_number", bad), counters


# ---- reference codes


def reference_codes(df: DataFrame, code: str = "code", name: str = "name", valid_from: str = "valid_from", valid_to: str = "valid_to", leaf: int = 10) -> tuple[DataFrame, DataFrame]:
    """(codes, problems). Trimmed codes of digits with valid dates in order, one row for a code and first day; digits and whether it is a leaf. problems (problem, n): what was left out, by its first reason."""
    day = lambda c: F.expr(f"try_cast(trim(cast(`{c}` as string)) as date)")
    rows = df.select(F.trim(code).alias("code"), F.trim(F.coalesce(F.col(name), F.lit(""))).alias("name"), day(valid_from).alias("valid_from"), day(valid_to).alias("valid_to"))
    n = rows.groupBy("code", "valid_from").agg(F.count("*").alias("__n"))
    rows = rows.join(n, (rows["code"] == n["code"]) & rows["valid_from"].eqNullSafe(n["valid_from"]), "left").drop(n["code"], n["valid_from"])
    problem = ladder([
        (~F.coalesce(F.col("code").rlike(r"^\d{2,10}$"), F.lit(False)), "bad_code"), (F.col("valid_from").isNull() | F.col("valid_to").isNull(), "bad_date"), (F.col("valid_from") > F.col("valid_to"), "dates_reversed"), (F.col("name") == "", "blank_name"), (F.col("__n") > 1, "doubled_code"),
    ], None)
    rows = rows.withColumn("problem", problem)
    good = rows.where("problem is null").select("code", "name", "valid_from", "valid_to", F.length("code").alias("digits"), (F.length("code") == leaf).alias("is_leaf"))
    return good, rows.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


# ---- signals


def prepared(signals: DataFrame, key: Sequence[str], month: str, defaults: Mapping[str, object], order: Sequence[Column]) -> DataFrame:
    """Signals with a month as yyyy-MM from any of yyyy-MM, yyyyMM, yyyy.MM or a date, missing columns and null values at their defaults, and of one key and month the last row by order. Rows without a key or month go."""
    text = F.regexp_replace(F.trim(F.col(month).cast("string")), r"[^0-9]", "")
    made = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))
    ok = F.length(text).isin(6, 8) & F.substring(text, 5, 2).between("01", "12")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in signals.columns else F.lit(v) for c, v in defaults.items()}
    rows = signals.withColumns({month: F.when(ok, made), **filled}).where(F.col(month).isNotNull())
    for k in key:
        rows = rows.where(F.trim(F.col(k)) != "")
    last = F.max_by(F.struct(*(c for c in rows.columns if c not in (*key, month))), F.struct(*order))
    return rows.groupBy(*key, month).agg(last.alias("__x")).select(*key, month, "__x.*")
