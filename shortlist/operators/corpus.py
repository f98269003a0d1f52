"""Synthetic CVs: quality mix, sanitising of model output, rendering to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.functions import fixed
from shortlist.functions.text import js_trim, json_string, round_half_up
from shortlist.operators.inference import GENERATION_INSTRUCTIONS


def allocate_mix(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (job_position_id, count, strong, partial) to one row per CV wanted, numbered from 0
    with strong first, then partial, then weak. Requests whose rounded shares exceed the count
    are returned apart. Rows are made block by block, so one huge request fills many tasks."""
    sized = requests.withColumns(
        {
            "_strong": round_half_up(F.col("count") * F.col("strong")),
            "_partial": round_half_up(F.col("count") * F.col("partial")),
        }
    )
    fits = F.col("_strong") + F.col("_partial") <= F.col("count")
    blocks = (
        sized.where(fits & (F.col("count") > 0))
        .withColumn("count", F.col("count").cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr("(count - 1) div 10000").cast("int"))))
        .repartition("job_position_id", "_block")
    )
    first = F.col("_block") * 10000
    numbered = blocks.withColumn(
        "idx", F.explode(F.sequence(first, F.least(F.col("count"), first + 10000) - 1))
    )
    tier = (
        F.when(F.col("idx") < F.col("_strong"), "strong")
        .when(F.col("idx") < F.col("_strong") + F.col("_partial"), "partial")
        .otherwise("weak")
    )
    allocated = numbered.select("job_position_id", "idx", tier.alias("quality_tier"))
    return allocated, sized.where(~fits).select(*requests.columns)


def _or_default(col: Column, default: str) -> Column:
    return F.coalesce(F.nullif(js_trim(col), F.lit("")), F.lit(default))


def _clean_list(col: Column) -> Column:
    trimmed = F.transform(col, lambda v: js_trim(F.coalesce(v, F.lit(""))))
    return F.coalesce(F.filter(trimmed, lambda v: v != ""), F.array().cast("array<string>"))


def _year(text: Column, current_year: int) -> Column:
    """JSON null and blank read as 0 and so clamp to the first year; absent (SQL null) or
    non-numeric values take the current year."""
    bare = js_trim(text)
    numeric = F.rlike(bare, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"))
    number = F.when(bare.isin("", "null"), F.lit(0.0)).when(numeric, bare.try_cast("double"))
    usable = number.isNotNull()
    clamped = F.greatest(F.lit(fixed.FIRST_YEAR), F.least(F.lit(current_year), F.floor(number)))
    return F.when(usable, clamped).otherwise(F.lit(current_year)).cast("int")


def parse_generated(df: DataFrame, payload_col: str) -> DataFrame:
    """Model output to the `content` struct; broken JSON gives nulls, which sanitising fills.
    Years are kept as text with JSON null spelled out, since null and absent clamp differently."""
    document = F.try_parse_json(payload_col)

    def scalar(source: Column, name: str) -> Column:
        return F.try_variant_get(source, f"$.{name}", "string")

    def year(entry: Column, name: str) -> Column:
        is_null = F.schema_of_variant(F.try_variant_get(entry, f"$.{name}", "variant")) == "VOID"
        return F.when(is_null, F.lit("null")).otherwise(scalar(entry, name))

    def strings(source: Column, name: str) -> Column:
        return F.transform(
            F.try_variant_get(source, f"$.{name}", "array<variant>"),
            lambda v: F.try_variant_get(v, "$", "string"),
        )

    years_kind = F.schema_of_variant(F.try_variant_get(document, "$.yearsExperience", "variant"))
    is_number = ~F.coalesce(years_kind, F.lit("STRING")).isin("STRING", "VOID", "BOOLEAN")
    content = F.struct(
        scalar(document, "name").alias("name"),
        scalar(document, "email").alias("email"),
        F.when(is_number, F.try_variant_get(document, "$.yearsExperience", "double")).alias("yearsExperience"),
        scalar(document, "summary").alias("summary"),
        F.transform(
            F.try_variant_get(document, "$.experience", "array<variant>"),
            lambda e: F.struct(
                scalar(e, "company").alias("company"),
                scalar(e, "role").alias("role"),
                year(e, "startYear").alias("startYear"),
                year(e, "endYear").alias("endYear"),
                strings(e, "bullets").alias("bullets"),
            ),
        ).alias("experience"),
        strings(document, "skills").alias("skills"),
        scalar(document, "education").alias("education"),
    )
    return df.withColumn("content", content)


def sanitize_generated(df: DataFrame, current_year: int) -> DataFrame:
    """Fill and bound the `content` struct so that rendering never meets a missing field. Years
    arrive as text (`null` spelled out for JSON null)."""
    c = F.col("content")

    def entry(e: Column) -> Column:
        start, end = _year(e["startYear"], current_year), _year(e["endYear"], current_year)
        return F.struct(
            _or_default(e["company"], fixed.DEFAULT_COMPANY).alias("company"),
            _or_default(e["role"], fixed.DEFAULT_ROLE).alias("role"),
            start.alias("startYear"),
            F.greatest(start, end).alias("endYear"),
            _clean_list(e["bullets"]).alias("bullets"),
        )

    years = c["yearsExperience"]
    experience = F.coalesce(
        F.transform(c["experience"], entry),
        F.array().cast(
            "array<struct<company:string,role:string,startYear:int,endYear:int,bullets:array<string>>>"
        ),
    )
    clean = F.struct(
        _or_default(c["name"], fixed.DEFAULT_NAME).alias("name"),
        _or_default(c["email"], fixed.DEFAULT_EMAIL).alias("email"),
        F.when(years >= 0, F.floor(years)).otherwise(F.lit(0)).cast("int").alias("yearsExperience"),
        F.coalesce(js_trim(c["summary"]), F.lit("")).alias("summary"),
        experience.alias("experience"),
        _clean_list(c["skills"]).alias("skills"),
        F.coalesce(js_trim(c["education"]), F.lit("")).alias("education"),
    )
    return df.withColumn("content", clean)


def end_sentence(col: Column) -> Column:
    """Trailing blanks off, and a full stop unless the line already ends a sentence."""
    bare = F.rtrim(col, F.lit(fixed.WHITESPACE))
    return F.regexp_replace(bare, r"(?<![.!?])\z", ".")


def render_text(content: Column) -> Column:
    """The CV as lines of text in the order of the printed document; empty parts leave no line."""

    def lines_of(e: Column) -> Column:
        heading = F.concat(e["role"], F.lit(" — "), e["company"])
        span = F.concat(e["startYear"].cast("string"), F.lit(" – "), e["endYear"].cast("string"))
        bullets = F.transform(e["bullets"], lambda b: F.concat(F.lit("• "), end_sentence(b)))
        return F.concat(F.array(heading, span), bullets)

    none = F.array().cast("array<string>")

    def part(present: Column, title: str, body: Column) -> Column:
        return F.when(present, F.concat(F.array(F.lit(title)), body)).otherwise(none)

    jobs = content["experience"]
    return F.array_join(
        F.concat(
            F.array(content["name"], content["email"]),
            part(content["summary"] != "", "Summary", F.array(end_sentence(content["summary"]))),
            part(F.size(jobs) > 0, "Experience", F.flatten(F.transform(jobs, lines_of))),
            part(
                F.size(content["skills"]) > 0,
                "Skills",
                F.array(F.concat(F.array_join(content["skills"], ", "), F.lit("."))),
            ),
            part(content["education"] != "", "Education", F.array(end_sentence(content["education"]))),
        ),
        "\n",
    )


def generated_filename(quality_tier: Column, idx: Column, extension: str = "txt") -> Column:
    return F.concat(
        F.lit("generated_"), quality_tier, F.lit("_"), (idx + 1).cast("string"), F.lit(f".{extension}")
    )


def generation_prompts(wanted: DataFrame, jobs: DataFrame, reqs: DataFrame) -> DataFrame:
    """Prompt columns for each CV wanted (job_position_id, idx, quality_tier)."""
    from shortlist.cluster import salted_lookup

    item = F.struct(
        "req_pos",
        F.concat(
            F.lit('  {\n    "text": '), json_string(F.col("text")),
            F.lit(',\n    "type": '), json_string(F.col("type")),
            F.lit(',\n    "isRequired": '), F.col("is_required").cast("string"),
            F.lit(',\n    "keywords": '), F.to_json("keywords"), F.lit("\n  }"),
        ).alias("json"),
    )
    lists = reqs.groupBy("job_position_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(item)), lambda r: r["json"]), ",\n"
        ).alias("_list")
    )
    header = jobs.select("job_position_id", "title").join(lists, "job_position_id")
    joined = salted_lookup(wanted, header, ["job_position_id"], ["idx"], bounded_by=reqs)
    prompt = F.concat(
        F.lit("JOB TITLE: "), F.col("title"), F.lit("\nTARGET TIER: "), F.col("quality_tier"),
        F.lit("\n\nREQUIREMENTS:\n[\n"), F.col("_list"), F.lit("\n]"),
    )
    return joined.select(
        *wanted.columns,
        F.concat_ws("/", F.col("job_position_id").cast("string"), F.col("idx").cast("string")).alias("item"),
        F.lit(fixed.CHEAP_MODEL).alias("model"),
        F.lit(GENERATION_INSTRUCTIONS).alias("system_prompt"),
        prompt.alias("user_prompt"),
    )
