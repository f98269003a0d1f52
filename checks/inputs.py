"""Screening tables derived from the driver's parquet tables, row for row and in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shortlist.cluster import spread
from shortlist.functions.text import split_sentences

CORPUS_REQUIREMENTS = """
('en', 0, 'req_1', 'Articles', 'technology', 9, true, array('the'), array('of the')),
('en', 1, 'req_2', 'Links', 'technology', 8, true, array('with', 'that'), array()),
('en', 2, 'req_3', 'Rest', 'experience', 9, true, array('rest'), array('Of', ' - ')),
('en', 3, 'req_4', 'Pointing', 'softSkill', 6, false, array('this'), array()),
('en', 4, 'req_5', 'Symbols', 'technology', 5, false, array('c++'), array('.net')),
('de', 0, 'req_1', 'Links', 'technology', 9, true, array('und'), array()),
('de', 1, 'req_2', 'Articles', 'technology', 6, true, array('der'), array('die')),
('de', 2, 'req_3', 'Negation', 'softSkill', 3, false, array('nicht'), array()),
('fr', 0, 'req_1', 'Articles', 'technology', 3, false, array('les'), array('des')),
('fr', 1, 'req_2', 'One', 'education', 5, false, array('une'), array())
"""

DEMO_REQUIREMENTS = """
(0, 'need_a', 'Has built web services', 'experience', 7, true, array('node.js', 'express'), array('on call')),
(1, 'need_b', 'Writes typed code', 'technology', 6, true, array('typescript'), array('c++')),
(2, 'need_c', 'Has run clusters', 'technology', 8, false, array('kubernetes', 'k8s'), array('managed')),
(3, 'need_d', 'Has built pages', 'technology', 4, false, array('react'), array('php sites')),
(4, 'need_e', 'Knows hosting', 'technology', 5, false, array('aws', '+1'), array('docker at scale'))
"""

STATUSES = [
    "CREATED", "EXTRACTING_REQUIREMENTS", "REQUIREMENTS_EXTRACTED",
    "PROCESSING", "COMPLETED", "FAILED",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_requirements(spark: SparkSession) -> DataFrame:
    """Requirement lists of the three document languages that have one."""
    return spark.sql(
        f"SELECT * FROM VALUES {CORPUS_REQUIREMENTS} AS t(job_position_id, req_pos, requirement_id, "
        "text, type, weight, is_required, keywords, synonyms)"
    ).withColumn("synonyms", F.col("synonyms").cast("array<string>"))


def long_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirement per document for its language's job, with terms from the document's own text: its
    first words, their pair, a word with its mark, and marks alone, so that lists grow with the table."""
    word = F.split(F.regexp_replace(F.trim("raw_text"), r"\s+", " "), " ")
    pair = F.concat_ws(" ", F.get(word, F.lit(0)), F.get(word, F.lit(1)))
    place = (F.row_number().over(Window.partitionBy("job_position_id").orderBy("cv_id")) - 1).cast("int")
    return document_cvs(spark, sf_dir).where("raw_text is not null").select(
        "job_position_id",
        place.alias("req_pos"),
        F.concat(F.lit("req_"), F.col("cv_id").cast("string")).alias("requirement_id"),
        F.lit("Terms of a document").alias("text"),
        F.lit("experience").alias("type"),
        (F.col("cv_id") % 10 + 1).cast("int").alias("weight"),
        (F.col("cv_id") % 3 == 0).alias("is_required"),
        F.array(F.coalesce(F.get(word, F.lit(2)), F.lit("")), pair).alias("keywords"),
        F.array(F.concat(F.coalesce(F.get(word, F.lit(3)), F.lit("")), F.lit(",")), F.lit("§"), F.lit(" - ")).alias("synonyms"),
    )


def demo_requirements(spark: SparkSession) -> DataFrame:
    """The same five requirements for each market segment that hires; MACHINERY has none."""
    return spark.sql(
        f"""SELECT job_position_id, t.* FROM VALUES {DEMO_REQUIREMENTS}
        AS t(req_pos, requirement_id, text, type, weight, is_required, keywords, synonyms)
        LATERAL VIEW explode(array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')) j
        AS job_position_id"""
    )


def document_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CV text, one job per language."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("cv_id"), F.col("lang").alias("job_position_id"), F.col("text").alias("raw_text")
    )
    return spread(docs, "cv_id")


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_cvs(spark, sf_dir).select(
        "cv_id", "job_position_id", split_sentences(F.col("raw_text")).alias("sentences")
    )


def template_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resume per customer, built from the key."""
    k = F.col("c_custkey")

    def pick(modulus, *options):
        return F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]),
                            (k % modulus + 1).cast("int"))

    def num(col):
        return col.cast("string")

    name = pick(5, "Ada Byron", "Grace Hopper (she/her)", "Jean-Luc O'Neil",
                "Engineer 2024 Edition", "Senior Backend Engineer")
    contact = F.concat(F.lit("Email: user"), num(k), F.lit("@example.com | +1 (415) 555-0"), num(k % 900 + 100))
    portfolio = F.concat(F.lit("Portfolio: https://example.com/u/"), num(k))
    personal = pick(
        4,
        F.concat(F.lit("DOB: 12/03/19"), num(k % 40 + 60)),
        F.concat(F.lit("Age: "), num(k % 50 + 20)),
        F.concat(F.lit("Address: "), num(k + 1), F.lit(" Main Street")),
        "",
    )
    years = pick(
        3,
        F.concat(num(k % 70), F.lit(" years of experience in backend.")),
        F.concat(F.lit("Experience: "), num(k % 40), F.lit(" years")),
        "I love coding.",
    )
    header = F.when(k % 6 != 5, F.when(k % 2 == 0, F.lit("Employment History")).otherwise(F.lit("Work Experience")))
    bullets = pick(
        3,
        "• Built Node.js services. Scaled Node.js apps. Node.js on-call! Managed Kubernetes "
        "clusters; k8s daily. Used TypeScript. AWS and React.",
        "• Built Express APIs. Some TypeScript.",
        "• Maintained PHP sites in C++ and C++11.",
    )
    skills = pick(3, "Node.js, React, AWS.", "TypeScript, Docker.", "PHP, MySQL.")
    school = pick(4, "B.Sc. Computer Science, Technion, 2019", "MSc in Physics", "Ph.D Engineering", "Self-taught")
    structured = F.concat_ws(
        "\n", name, contact, portfolio, personal, F.lit("Summary"), years, header,
        F.lit("Acme Corp - Lead Engineer"), F.lit("Northbeam Labs 2019"), bullets,
        F.lit("Skills"), skills, F.lit("Education"), school,
    )
    flat = F.concat(
        F.lit("A flat block about customer "), num(k),
        F.lit(" who shipped Node.js and Docker at scale with no headers anywhere."),
    )
    raw = F.when(k % 7 == 6, flat).otherwise(structured)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    cvs = customers.select(
        k.alias("cv_id"),
        F.col("c_mktsegment").alias("job_position_id"),
        F.concat(F.col("c_name"), pick(4, ".pdf", ".DOCX", ".txt", ".rtf")).alias("original_filename"),
        pick(5, "application/pdf", "application/octet-stream", "text/plain", "image/png",
             "application/vnd.openxmlformats-officedocument.wordprocessingml.document").alias("mime_type"),
        raw.alias("raw_text"),
    )
    return spread(cvs, "cv_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order; counters are deliberately not what a recount gives."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (k % 6 + 1).cast("int"))
    running = F.element_at(
        F.array(*map(F.lit, ["parsing", "filtering", "scoring", "generating"])),
        (F.floor(k / 6) % 4 + 1).cast("int"),
    )
    stage = F.when(k % 6 == 3, running).when(k % 6 == 4, F.lit("completed")).when(k % 6 == 5, F.lit("failed"))
    return table(spark, sf_dir, "orders").select(
        k.alias("job_position_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("Position "), F.col("o_orderpriority")).alias("title"),
        status.alias("status"),
        stage.alias("current_stage"),
        (k % 9).cast("int").alias("total_cvs"),
        (k % 5).cast("int").alias("processed_cvs"),
        (k % 4).cast("int").alias("great_match_count"),
        (k % 3).cast("int").alias("good_match_count"),
        (k % 2).cast("int").alias("no_match_count"),
        (F.col("o_totalprice") / 1e6).alias("ai_cost_usd"),
        F.col("o_orderdate").alias("created_at"),
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (k % 1440) * 60).alias("updated_at"),
    )


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored CV per order line, its job being the order."""
    p = F.col("l_partkey")
    tier = F.element_at(
        F.array(F.lit("great"), F.lit("good"), F.lit("no-match"), F.lit("good"), F.lit(None).cast("string")),
        (p % 5 + 1).cast("int"),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("cv_id"),
        F.col("l_orderkey").alias("job_position_id"),
        F.concat(F.lit("CV_"), F.col("l_suppkey").cast("string"), F.lit("_"), F.col("l_returnflag"),
                 F.when(p % 2 == 0, F.lit(".pdf")).otherwise(F.lit(".TXT"))).alias("original_filename"),
        tier.alias("tier"),
        F.when(p % 11 != 0, F.col("l_quantity") * 2).alias("final_score"),
        F.when(p % 5 == 2, F.lit("Score too low")).alias("elimination_reason"),
        F.when(p % 13 == 0, F.lit("failed")).when(p % 3 == 0, F.lit("low")).otherwise(F.lit("high")).alias("parsing_confidence"),
        (F.col("l_suppkey") % 30).cast("int").alias("years_of_experience"),
        F.col("l_tax").alias("ai_cost_usd"),
        F.when(p % 2 == 0, F.lit("gpt-5.1")).alias("ai_model_used"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = (
        F.when(F.col("event_type") == "view", "parsing")
        .when(F.col("event_type") == "click", "filtering")
        .when(F.col("event_type") == "purchase", "scoring")
        .when(F.col("event_type") == "signup", "completed")
        .otherwise("failed")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_position_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        stage.alias("stage"),
        (F.col("event_id") % 50).cast("int").alias("processed"),
        F.lit(50).alias("total"),
    )
