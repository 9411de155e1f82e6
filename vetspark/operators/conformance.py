"""Conformance of records, documents, references and identifiers: all errors of a row, not the first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fresh, strip
from .scoring import kind_of

# Fixed value: what marks an identifier as a placeholder.
PLACEHOLDERS = r"(?i)YOUR_|HERE|TODO|FIXME|XXX|\.\.\.|placeholder|example|sample"
# Fixed value: the form of a calendar's identifier.
CALENDAR_ID = r"(?i)^[a-f0-9]{64}@group\.calendar\.google\.com$"


def errors(found: Sequence[Column]) -> Column:
    """The messages that are not null, as an array."""
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _wrong_items(v: Column, field: str, kind: str) -> Column:
    values = F.coalesce(F.try_variant_get(v, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))
    fine = lambda x: F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False))
    message = F.transform(values, lambda x, i: F.when(~fine(x), F.concat(F.lit(f"{field}["), i.cast("string"), F.lit(f"] is not {kind}"))))
    return F.filter(message, lambda x: x.isNotNull())


def record_conformance(df: DataFrame, raw: str, required: Sequence[str], types: Mapping[str, str], extra: Sequence[Column] = (), items: Mapping[str, str] | None = None) -> DataFrame:
    """Adds ``errors`` of a JSON text: not JSON; missing keys (sorted, and then no more); fields of another type; ``extra``.

    ``types``: type prefix of a field, such as BIGINT or ARRAY; ``items``: type that every element of an array field must have.
    """
    v = F.try_parse_json(F.col(raw))
    missing = F.array_compact(F.array(*[F.when(F.try_variant_get(v, f"$.{k}", "variant").isNull(), F.lit(k)) for k in sorted(required)]))
    wrong = [F.when(~F.coalesce(kind_of(v, f"$.{k}").startswith(t), F.lit(False)), f"{k} is not {t}") for k, t in types.items()]
    per_item = [_wrong_items(v, k, t) for k, t in (items or {}).items()]
    rest = F.concat(errors([*wrong, *extra]), *per_item) if wrong or extra else F.concat(F.array().cast("array<string>"), *per_item)
    out = F.when(v.isNull(), F.array(F.lit("not JSON"))).when(F.size(missing) > 0, F.array(F.concat(F.lit("missing: "), F.array_join(missing, ", ")))).otherwise(rest)
    return df.withColumn("errors", out)


def corpus_conformance(df: DataFrame, raw: str, name: str | None, field: str = "evals", name_key: str = "skill_name") -> DataFrame:
    """Adds ``errors`` of a JSON document that holds an array of records: not JSON; another name than ``name``; ``field`` is no list; the same ``id`` twice."""
    v = F.try_parse_json(F.col(raw))
    own = F.try_variant_get(v, f"$.{name_key}", "string")
    items = F.try_variant_get(v, f"$.{field}", "array<variant>")
    ids = F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$.id", "string")), lambda x: x.isNotNull())
    other = F.when(~own.eqNullSafe(F.lit(name)), F.concat(F.lit(f"{name_key} is not {name}: "), F.coalesce(own, F.lit("missing")))) if name is not None else F.lit(None).cast("string")
    found = [other, F.when(items.isNull(), f"{field} is no list"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated id")]
    return df.withColumn("errors", F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(errors(found)))


def document_conformance(
    df: DataFrame, text: str, expected_name: str | None, required_keys: Sequence[str] = ("name", "description", "version", "category"), headings: Sequence[str] = (),
    max_name: int = 64, max_description: int = 1024, max_compatibility: int = 500, max_lines: int = 250, name_pattern: str = r"^[a-z0-9]+(-[a-z0-9]+)*$",
) -> DataFrame:
    """Adds ``errors`` of a document with frontmatter between ``---`` lines; without it that is the only one besides headings."""
    t = F.coalesce(F.col(text), F.lit(""))
    head = r"(?s)^---\n(.*?)\n---\n"
    has = t.rlike(head)
    front = F.regexp_extract(t, head, 1)
    field = lambda k: F.when(front.rlike(rf"(?m)^{k}:[ \t]*\S"), strip(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1)))
    keys = F.transform(F.filter(F.split(front, "\n"), lambda x: x.contains(":") & ~x.startswith(" ")), lambda x: strip(F.split_part(x, F.lit(":"), F.lit(1))))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required_keys]), keys))
    name, description, compatibility = field("name"), field("description"), field("compatibility")
    body = F.regexp_replace(t, head, "")
    lines = F.when(body == "", 0).otherwise(F.size(F.split(F.regexp_replace(body, r"\n$", ""), "\n")))
    inner = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))),
        F.when(name != expected_name, "another name") if expected_name else F.lit(None).cast("string"),
        F.when(~name.rlike(name_pattern), "name malformed"), F.when(F.length(name) > max_name, "name too long"),
        F.when(F.length(description) > max_description, "description too long"), F.when(F.length(compatibility) > max_compatibility, "compatibility too long"),
        F.when(lines > max_lines, "body too long"),
    ]
    found = [F.when(~has, "no frontmatter"), *[F.when(has, x) for x in inner]]
    wanted = F.array(*[F.lit(h) for h in headings]) if headings else F.array().cast("array<string>")
    absent = F.array_except(wanted, F.regexp_extract_all(t, F.lit(r"(?m)^(## .+)$"), F.lit(1)))
    return df.withColumn("errors", errors([*found, F.when(F.size(absent) > 0, F.concat(F.lit("missing sections: "), F.array_join(F.array_sort(absent), ", ")))]))


def measured_conformance(df: DataFrame, limits: Mapping[str, Column]) -> DataFrame:
    """Adds ``errors``: the name of every condition of ``limits`` that a row breaks; null breaks it."""
    return df.withColumn("errors", errors([F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in limits.items()]))


def dangling_references(references: DataFrame, known: DataFrame, reference: str = "reference", target: str = "path") -> DataFrame:
    """Distinct references that name no known target, by a left anti join."""
    return references.select(F.col(reference).alias("reference")).filter("reference is not null").distinct().join(known.select(F.col(target).alias("reference")).distinct(), "reference", "left_anti")


def missing_documents(wanted: DataFrame, documents: DataFrame, name: str = "name") -> DataFrame:
    """(name, warning): documents that are to be scanned for references and aren't there.  A warning, not an error: the others are scanned all the same."""
    there = documents.select(F.col(name).alias("name")).distinct()
    absent = wanted.select(F.col(name).alias("name")).filter("name is not null").distinct().join(there, "name", "left_anti")
    return absent.select("name", F.concat("name", F.lit(": not there, so its references were not looked at")).alias("warning"))


def path_references(df: DataFrame, text: str, pattern: str = r"`([\w/.-]+\.md)`") -> DataFrame:
    """(reference): every back-quoted path with a slash that a text names."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    return df.select(F.explode(found).alias("reference")).filter(F.col("reference").contains("/"))


def identifier_problem(x: Column, pattern: str = CALENDAR_ID, placeholders: str | None = PLACEHOLDERS) -> Column:
    """The first rule an identifier breaks: missing, blank, placeholder, malformed; null if none."""
    s = strip(x)
    out = F.when(x.isNull(), "missing").when(s == "", "blank")
    if placeholders:
        out = out.when(s.rlike(placeholders), "placeholder")
    return out.when(~s.rlike(pattern), "malformed")


def missing_fields(fields: Mapping[str, Column]) -> Column:
    """Warnings: recommended fields that are null or blank."""
    return errors([F.when(F.coalesce(strip(c.cast("string")), F.lit("")) == "", name) for name, c in fields.items()])


def conformance_verdict(registry: DataFrame, found: DataFrame, check: str = "check") -> DataFrame:
    """(check, n_errors, verdict) for every registered check, also those that found nothing."""
    own, n = fresh(registry, "check", "n")
    counts = found.groupBy(F.col(check).alias(own)).agg(F.count("*").alias(n))
    out = registry.select(check).distinct().join(counts, F.col(check) == F.col(own), "left")
    return out.select(check, F.coalesce(n, F.lit(0)).alias("n_errors"), F.when(F.col(n) > 0, "FAIL").otherwise("PASS").alias("verdict"))


def unproven_checks(registry: DataFrame, fixtures: DataFrame, check: str = "check", verdict: str = "verdict") -> DataFrame:
    """(check, problem): registered checks that no fixture makes fail.  ``fixtures``: one row per fixture run, with the check it is for and its verdict."""
    runs = fixtures.groupBy(F.col(check).alias("check")).agg(F.bool_or(F.col(verdict) == "FAIL").alias("failed"))
    out = registry.select(F.col(check).alias("check")).filter("check is not null").distinct().join(runs, "check", "left")
    return out.filter(~F.coalesce("failed", F.lit(False))).select("check", F.when(F.col("failed").isNull(), "no failing fixture").otherwise("its fixtures pass").alias("problem"))
