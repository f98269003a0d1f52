"""Requirement lists: gate, ingest, validation, conformance, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.cluster import latest
from shortlist.functions import fixed
from shortlist.functions.text import utf16_length

_ELEMENTS = "array<variant>"


def _field_type(entry: Column, name: str) -> Column:
    """JSON type name of a field of a variant, null when the field is absent."""
    return F.schema_of_variant(F.try_variant_get(entry, f"$.{name}", "variant"))


def _is_string(entry: Column, name: str) -> Column:
    return F.coalesce(_field_type(entry, name) == "STRING", F.lit(False))


def _is_array(entry: Column, name: str) -> Column:
    return F.coalesce(F.startswith(_field_type(entry, name), F.lit("ARRAY<")), F.lit(False))


def _violations(*pairs: tuple[Column, str]) -> Column:
    """Names of the rules whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def gate_requirements(jobs: DataFrame) -> DataFrame:
    """Verdict on each job's stored requirement JSON before any run.

    Adds `verdict` (ok / no requirements / malformed) and `bad_index`, the first entry that is
    not an object with a string id and keyword and synonym arrays.
    """
    entries = F.try_variant_get(F.try_parse_json("requirements_json"), "$", _ELEMENTS)
    parsed = jobs.withColumn("_entries", entries)
    bad = F.transform(
        F.col("_entries"),
        lambda e, i: F.when(
            e.isNull() | ~(_is_string(e, "id") & _is_array(e, "keywords") & _is_array(e, "synonyms")), i
        ),
    )
    indexed = parsed.withColumn("bad_index", F.array_min(bad))
    verdict = (
        F.when(F.coalesce(F.size("_entries"), F.lit(0)) <= 0, fixed.NO_REQUIREMENTS)
        .when(F.col("bad_index").isNotNull(), fixed.MALFORMED)
        .otherwise(fixed.GATE_OK)
    )
    return indexed.withColumn("verdict", verdict).drop("_entries")


def ingest_requirement_json(df: DataFrame, payload_col: str) -> DataFrame:
    """Model output to requirement lists: unusable entries dropped, missing synonyms become [],
    ids numbered after the drop. Adds `requirements` (null on error), `dropped` and `error`."""
    entries = F.try_variant_get(F.try_parse_json(payload_col), "$.requirements", _ELEMENTS)

    def text_array(entry: Column, name: str) -> Column:
        values = F.try_variant_get(entry, f"$.{name}", "array<string>")
        return F.when(_is_array(entry, name), values).otherwise(F.array().cast("array<string>"))

    def build(entry: Column, index: Column) -> Column:
        def get(name: str, kind: str) -> Column:
            return F.try_variant_get(entry, f"$.{name}", kind)

        return F.struct(
            F.concat(F.lit("req_"), (index + 1).cast("string")).alias("id"),
            get("text", "string").alias("text"),
            get("type", "string").alias("type"),
            get("weight", "int").alias("weight"),
            get("isRequired", "boolean").alias("isRequired"),
            text_array(entry, "keywords").alias("keywords"),
            text_array(entry, "synonyms").alias("synonyms"),
        )

    usable = F.filter(
        "_entries",
        lambda e: e.isNotNull() & _is_string(e, "text") & _is_array(e, "keywords"),
    )
    staged = df.withColumn("_entries", entries).withColumn("_usable", usable)
    none_given = F.coalesce(F.size("_entries"), F.lit(0)) <= 0
    error = F.when(none_given, "AI returned no usable requirements").when(
        F.size("_usable") == 0, "AI returned requirements but none passed schema validation"
    )
    return (
        staged.withColumn("error", error)
        .withColumn("requirements", F.when(F.col("error").isNull(), F.transform("_usable", build)))
        .withColumn("dropped", F.when(~none_given, F.size("_entries") - F.size("_usable")).otherwise(0))
        .drop("_entries", "_usable")
    )


def explode_requirements(jobs: DataFrame, json_col: str = "requirements_json") -> DataFrame:
    """Stored requirement JSON to one row per requirement with its list position."""
    from shortlist.schemas import REQUIREMENT_STRUCT

    listed = jobs.select(
        "job_position_id",
        F.posexplode(F.from_json(json_col, f"array<{REQUIREMENT_STRUCT}>")).alias("req_pos", "r"),
    )
    return listed.select(
        "job_position_id",
        "req_pos",
        F.col("r.id").alias("requirement_id"),
        "r.text",
        "r.type",
        "r.weight",
        F.col("r.isRequired").alias("is_required"),
        "r.keywords",
        "r.synonyms",
    )


def validate_requirements(reqs: DataFrame) -> DataFrame:
    """Add `violations` against the edit form's constraints. `weight` may be fractional here."""
    low, high = fixed.WEIGHT_RANGE

    def bad_list(name: str) -> Column:
        return F.col(name).isNull() | F.exists(name, lambda v: v.isNull())

    weight = F.col("weight")
    return reqs.withColumn(
        "violations",
        _violations(
            (F.col("requirement_id").isNull(), "id"),
            (F.col("text").isNull(), "text"),
            (F.col("type").isNull() | ~F.col("type").isin(fixed.REQUIREMENT_TYPES), "type"),
            (weight.isNull() | (weight != F.floor(weight)) | ~weight.between(low, high), "weight"),
            (F.col("is_required").isNull(), "is_required"),
            (bad_list("keywords"), "keywords"),
            (bad_list("synonyms"), "synonyms"),
        ),
    )


def requirement_conformance(reqs: DataFrame) -> DataFrame:
    """Add `departures` from the extraction rules: weight bands, lowercase synonyms, no keyword
    repeated as a synonym, 4 to 10 synonyms."""
    in_band = F.when(
        F.col("is_required"), F.col("weight").between(*fixed.REQUIRED_WEIGHT_BAND)
    ).otherwise(F.col("weight").between(*fixed.OPTIONAL_WEIGHT_BAND))
    return reqs.withColumn(
        "departures",
        _violations(
            (~in_band, "weight band"),
            (F.exists("synonyms", lambda s: s != F.lower(s)), "synonym case"),
            (F.size(F.array_intersect("keywords", "synonyms")) > 0, "keyword repeated"),
            (~F.size("synonyms").between(*fixed.SYNONYM_COUNT_BAND), "synonym count"),
        ),
    )


def edit_requirements(reqs: DataFrame, patches: DataFrame, removals: DataFrame) -> DataFrame:
    """Patch flag, text and weight by id where a patch gives them; drop removed ids."""
    keys = ["job_position_id", "requirement_id"]
    given = latest(patches, *keys).select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in ("text", "weight", "is_required")]
    )
    patched = reqs.join(removals.select(*keys), keys, "left_anti").join(given, keys, "left")
    return patched.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if f"_new_{c}" in given.columns else F.col(c)
            for c in reqs.columns
        ]
    )


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """Add `violations` of the job form: title 3-200, description 50-20,000 characters."""

    def outside(name: str, band: tuple[int, int]) -> Column:
        return F.col(name).isNull() | ~utf16_length(F.col(name)).between(*band)

    return jobs.withColumn(
        "violations",
        _violations(
            (outside("title", fixed.TITLE_LENGTH_BAND), "title"),
            (outside("job_description_text", fixed.DESCRIPTION_LENGTH_BAND), "description"),
        ),
    )
