"""Synthetic corpus over every customer and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from shortlist.operators import corpus
from shortlist.plans import screening

JOB = "job_position_id"


def mix_requests(spark, sf):
    k = F.col("c_custkey")
    return inputs.table(spark, sf, "customer").select(
        k.alias(JOB),
        (k % 23).alias("count"),
        ((k % 4) * 0.25).alias("strong"),
        ((k % 3) * 0.25).alias("partial"),
    )


MIX = """asked AS (SELECT c_custkey AS job_position_id, c_custkey % 23 AS n, floor(c_custkey % 23 * (c_custkey % 4 * 0.25::DOUBLE) + 0.5) AS strong,
 floor(c_custkey % 23 * (c_custkey % 3 * 0.25::DOUBLE) + 0.5) AS partial FROM customer)"""


@check(
    "g1_allocate_mix",
    sql.with_(MIX) + """SELECT job_position_id, idx, CASE WHEN idx < strong THEN 'strong' WHEN idx < strong + partial THEN 'partial' ELSE 'weak' END AS quality_tier
    FROM asked, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS idx) WHERE strong + partial <= n AND n > 0""",
)
def g1_allocate_mix(spark, sf):
    return corpus.allocate_mix(mix_requests(spark, sf))[0].withColumn("idx", F.col("idx").cast("long"))


@check("g1_rejected_mixes", sql.with_(MIX) + "SELECT job_position_id FROM asked WHERE strong + partial > n")
def g1_rejected_mixes(spark, sf):
    return corpus.allocate_mix(mix_requests(spark, sf))[1].select(JOB)


def generated(spark, sf):
    """Content built from parts, with gaps, blanks and impossible years."""
    k = F.col("p_partkey")
    year = lambda shift: F.element_at(
        F.array(
            (k % 60 + 1975 + shift).cast("string"), F.lit("null"), F.lit("soon"), F.lit(" 2010 "), F.lit("2012.9"),
            F.lit(None).cast("string"), F.lit(""),
        ),
        ((k + shift) % 7 + 1).cast("int"),
    )
    entry = F.struct(
        F.when(k % 3 != 0, F.concat(F.lit("  "), "p_brand")).alias("company"),
        F.when(k % 4 != 0, F.col("p_type")).otherwise("  ").alias("role"),
        year(0).alias("startYear"),
        year(3).alias("endYear"),
        F.array(F.concat("p_name", F.lit(" ")), F.lit("  "), F.lit("Shipped it!"), F.lit(None).cast("string")).alias("bullets"),
    )
    content = F.struct(
        F.when(k % 5 != 0, F.col("p_name")).alias("name"),
        F.when(k % 6 != 0, F.lit(" a@b.example ")).alias("email"),
        F.when(k % 7 != 0, (k % 9) - 2.5).alias("yearsExperience"),
        F.when(k % 8 != 0, F.concat(F.lit("Sum of "), "p_name")).alias("summary"),
        F.when(k % 9 != 0, F.array(entry, entry)).alias("experience"),
        F.when(k % 10 != 0, F.array(F.col("p_brand"), F.lit(" "), F.lit(" sql "))).alias("skills"),
        F.when(k % 11 != 0, F.lit("BSc?")).alias("education"),
    )
    return inputs.table(spark, sf, "part").select("p_partkey", content.alias("content"))


def _year_sql(shift):
    raw = f"[(p_partkey % 60 + 1975 + {shift})::DOUBLE, 0, NULL, 2010, 2012, NULL, 0][(p_partkey + {shift}) % 7 + 1]"
    return f"coalesce(greatest(1990, least(2024, {raw})), 2024)::INT"


CLEAN = f"""clean AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN trim(p_name) ELSE 'Candidate' END AS name,
 CASE WHEN p_partkey % 6 <> 0 THEN 'a@b.example' ELSE 'candidate@example.com' END AS email,
 CASE WHEN p_partkey % 7 <> 0 THEN greatest(0, floor(p_partkey % 9 - 2.5::DOUBLE))::INT ELSE 0 END AS years,
 CASE WHEN p_partkey % 8 <> 0 THEN trim('Sum of ' || p_name) ELSE '' END AS summary, p_partkey % 9 <> 0 AS has_jobs,
 CASE WHEN p_partkey % 3 <> 0 THEN trim(p_brand) ELSE 'Unknown Company' END AS company,
 CASE WHEN p_partkey % 4 <> 0 THEN trim(p_type) ELSE 'Engineer' END AS role,
 {_year_sql(0)} AS y1, greatest({_year_sql(0)}, {_year_sql(3)}) AS y2, trim(p_name) AS bullet,
 CASE WHEN p_partkey % 10 <> 0 THEN trim(p_brand) || ', sql' ELSE '' END AS skills,
 CASE WHEN p_partkey % 11 <> 0 THEN 'BSc?' ELSE '' END AS education FROM part)"""


@check(
    "g2_sanitize_generated",
    sql.with_(CLEAN) + """SELECT p_partkey, name, email, years, summary, skills, education,
    CASE WHEN has_jobs THEN repeat(company || '/' || role || '/' || y1 || '/' || y2 || '/' || bullet || '+Shipped it!;', 2) ELSE '' END AS jobs FROM clean""",
)
def g2_sanitize_generated(spark, sf):
    clean = corpus.sanitize_generated(generated(spark, sf), 2024)
    line = lambda e: F.concat(
        F.concat_ws("/", e["company"], e["role"], e["startYear"].cast("string"), e["endYear"].cast("string"), F.array_join(e["bullets"], "+")),
        F.lit(";"),
    )
    return clean.select(
        "p_partkey", "content.name", "content.email", F.col("content.yearsExperience").alias("years"), "content.summary",
        F.array_join("content.skills", ", ").alias("skills"), "content.education",
        F.array_join(F.transform("content.experience", line), "").alias("jobs"),
    )


@check(
    "g3_render_text",
    sql.with_(CLEAN) + """SELECT p_partkey, concat_ws(chr(10), name, email,
     CASE WHEN summary <> '' THEN 'Summary' || chr(10) || summary || CASE WHEN right(summary, 1) IN ('.', '!', '?') THEN '' ELSE '.' END END,
     CASE WHEN has_jobs THEN 'Experience' || repeat(chr(10) || role || ' — ' || company || chr(10) || y1 || ' – ' || y2 || chr(10) || '• ' || bullet
       || CASE WHEN right(bullet, 1) IN ('.', '!', '?') THEN '' ELSE '.' END || chr(10) || '• Shipped it!', 2) END,
     CASE WHEN skills <> '' THEN 'Skills' || chr(10) || skills || '.' END,
     CASE WHEN education <> '' THEN 'Education' || chr(10) || education END) AS raw_text,
    'generated_weak_' || (p_partkey + 1) || '.txt' AS filename FROM clean""",
)
def g3_render_text(spark, sf):
    clean = corpus.sanitize_generated(generated(spark, sf), 2024)
    return clean.select(
        "p_partkey",
        corpus.render_text(F.col("content")).alias("raw_text"),
        corpus.generated_filename(F.lit("weak"), F.col("p_partkey")).alias("filename"),
    )


@check(
    "g4_generate_corpus",
    """WITH asked AS (SELECT c_mktsegment AS job, count(*) AS n FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1),
    made AS (SELECT job, idx, CASE WHEN idx < floor(n * 0.25::DOUBLE + 0.5) THEN 'strong'
      WHEN idx < floor(n * 0.25::DOUBLE + 0.5) + floor(n * 0.5::DOUBLE + 0.5) THEN 'partial' ELSE 'weak' END AS quality
     FROM asked, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS idx))
    SELECT job AS job_position_id, 'generated_' || quality || '_' || (idx + 1) || '.txt' AS original_filename,
     CASE quality WHEN 'strong' THEN 'great' WHEN 'partial' THEN 'good' ELSE 'no-match' END AS tier,
     CASE quality WHEN 'strong' THEN 8 WHEN 'partial' THEN 4 ELSE 0 END AS years FROM made""",
)
def g4_generate_corpus(spark, sf):
    """As many CVs per hiring segment as it has customers, from a fixed stand-in for the model.
    MACHINERY has no requirements: its CVs are refused."""
    customers = inputs.table(spark, sf, "customer")
    requests = customers.groupBy(F.col("c_mktsegment").alias(JOB)).agg(
        F.count(F.lit(1)).alias("count"), F.lit(0.25).alias("strong"), F.lit(0.5).alias("partial")
    )
    jobs = requests.select(JOB, F.concat(F.lit("Engineer, "), JOB).alias("title"))

    def client(model, system, user):
        import json

        tier = user.split("TARGET TIER: ")[1].split("\n")[0]
        bullets = {
            "strong": ["Built Node.js services", "Scaled Node.js apps", "Ran nodejs on call", "Led Kubernetes work",
                       "Kubernetes upgrades", "More k8s", "TypeScript everywhere", "TypeScript at work", "More TypeScript"],
            "partial": ["Built Express APIs", "Some TypeScript", "A little k8s"],
            "weak": ["Kept a PHP site going"],
        }[tier]
        years = {"strong": "8 years of experience", "partial": "4 years of experience", "weak": "Eager to learn"}[tier]
        content = {
            "name": "Ada Byron", "email": "ada@example.com", "yearsExperience": 8, "summary": years,
            "experience": [{"company": "Acme", "role": "Engineer", "startYear": 2015, "endYear": 2020, "bullets": bullets}],
            "skills": ["SQL"], "education": "BSc",
        }
        return json.dumps(content), 100, 50

    rows, _ = screening.generate_corpus(requests, jobs, inputs.demo_requirements(spark), client, 2024)
    return rows.select(JOB, "original_filename", "tier", F.col("entities.years_of_experience").alias("years"))
