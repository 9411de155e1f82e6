"""Golden cases: parsing, scoring, structure."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strip, try_int


def key_values(text: Column, pair: str = "; ", value: str = "=") -> Column:
    """Map of ``k=v`` parts, split at the first ``=``; parts without one have a null value; of equal keys the last counts.  Null and empty give null."""
    parts = F.filter(F.split(text, pair), lambda x: x != "")
    cut = F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit(value), F.lit(1)).alias("key"), F.when(x.contains(value), F.substring(x, F.instr(x, value) + 1, F.length(x))).alias("value")))
    last = F.filter(cut, lambda x, i: ~F.exists(F.slice(cut, i + 2, F.size(cut)), lambda y: y["key"] == x["key"]))
    return F.when(F.size(parts) > 0, F.map_from_entries(last))


def parse_inputs(prompt: Column, marker: str = "Input: ") -> Column:
    """Map of the ``k=v; k=v`` text after the marker, without its last full stop."""
    return key_values(F.regexp_replace(F.regexp_extract(prompt, f"(?s){marker}(.*)$", 1), r"\.\s*$", ""))


def parse_expected(text: Column) -> Column:
    """(decision, reason, checks) of ``Decision=…; reason=…; checks: a=PASS, b=FAIL``; ``all_pass`` where the checks are ``all PASS``.  What is missing is null."""
    get = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(r"(\w+=(?:PASS|FAIL))"), F.lit(1))
    return F.struct(get(r"Decision=(\w+)").alias("decision"), get(r"reason=([^;]*)").alias("reason"), found.alias("checks"), F.coalesce(text.rlike("all PASS"), F.lit(False)).alias("all_pass"))


#: An assertion, and how its parts are read.
ASSERTION = r"^(\S+)\s+expected\s+(PASS|FAIL)$"


def needle_of(assertion: Column, pattern: str = ASSERTION) -> Column:
    """``name=STATUS`` of an assertion, null if it is malformed."""
    a = strip(assertion)
    return F.when(a.rlike(pattern), F.concat(F.regexp_extract(a, pattern, 1), F.lit("="), F.regexp_extract(a, pattern, 2)))


def assertion_needles(cases: DataFrame, case_id: str = "id", assertions: str = "assertions", pattern: str = ASSERTION) -> DataFrame:
    """One row per assertion: (id, assertion, needle ``name=STATUS``); a malformed one has no needle, a case without any has one row of nulls."""
    out = cases.select(F.col(case_id).alias("id"), F.explode_outer(assertions).alias("assertion"))
    return out.withColumn("needle", needle_of(F.col("assertion"), pattern))


def score_cases(cases: DataFrame, outputs: DataFrame, case_id: str = "id", expected: str = "expected_output", assertions: str | None = "assertions", key: str = "key", output: str = "output") -> DataFrame:
    """(id, passed, why, n_assertions): missing output, unequal text, missing or malformed needle, or passed.

    Keys are read as whole numbers; others match nothing.  Texts are compared stripped.  Of several outputs of a case the largest counts; extra outputs don't.
    """
    said = outputs.select(try_int(F.col(key)).alias("key"), F.col(output).alias("output")).filter("key is not null").groupBy("key").agg(F.max("output").alias("output"))
    own = F.col(assertions) if assertions else F.array().cast("array<string>")
    out = cases.select(F.col(case_id).alias("id"), F.col(expected).alias("expected"), own.alias("assertions")).join(said, F.col("id") == F.col("key"), "left")
    given = F.filter(F.coalesce("assertions", F.array().cast("array<string>")), lambda x: x.isNotNull())
    needles = F.transform(given, lambda x: needle_of(x))
    bad = F.exists(needles, lambda x: x.isNull())
    met = F.forall(needles, lambda x: F.coalesce(F.col("output").contains(x), F.lit(False)))
    why = F.when(F.col("output").isNull(), "no output").when(strip(F.col("output")) != strip(F.col("expected")), "output differs").when(bad, "malformed assertion").when(~met, "assertion not met")
    return out.select("id", why.isNull().alias("passed"), why.alias("why"), F.size(given).cast("long").alias("n_assertions"))


def score_summary(scores: DataFrame) -> DataFrame:
    """One row: cases passed, cases failed, assertions of the passing ones."""
    return scores.agg(F.count_if("passed").alias("cases_passed"), F.count_if(~F.col("passed")).alias("cases_failed"), F.coalesce(F.sum(F.when(F.col("passed"), F.col("n_assertions"))), F.lit(0)).alias("assertions_evaluated"))


def kind_of(variant: Column, path: str) -> Column:
    """Type of a field of a JSON variant: BIGINT, STRING, ARRAY…; null if it isn't there."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def structural_report(df: DataFrame, raw: str, rules: list[tuple[str, str, str]], sizes: Mapping[str, str] | None = None) -> DataFrame:
    """Adds ``problem``: the first (path, type prefix, message) that the JSON breaks, or that it isn't JSON; null if none.

    ``sizes``: columns to add, each with the path of an array, whose elements are counted, or of a text, whose characters are; null for anything else.
    """
    v = F.try_parse_json(F.col(raw))
    out = F.when(v.isNull(), "not JSON")
    for path, kind, message in rules:
        out = out.when(~F.coalesce(kind_of(v, path).startswith(kind), F.lit(False)), message)
    size = lambda path: F.coalesce(F.size(F.try_variant_get(v, path, "array<variant>")), F.when(kind_of(v, path) == "STRING", F.length(F.try_variant_get(v, path, "string"))))
    return df.withColumns({"problem": out} | {name: F.when(v.isNotNull(), size(path)).cast("long") for name, path in (sizes or {}).items()})
