"""Requirement lists as JSON and as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from shortlist.operators import requirements

GATE_CASES = [
    None,
    "[]",
    '{"id": "a", "keywords": [], "synonyms": []}',
    "not json",
    '[{"id": "r#", "keywords": ["a"], "synonyms": []}]',
    '[{"id": "r1", "keywords": [], "synonyms": []}, {"id": #, "keywords": [], "synonyms": []}]',
    '[null, {"id": "r#", "keywords": [], "synonyms": []}]',
    '[{"id": "a", "keywords": [], "synonyms": []}, {"id": "b", "keywords": [], "synonyms": []}, {"id": "c", "keywords": "x", "synonyms": []}]',
    '[{"id": "a", "keywords": ["k"]}]',
]
INGEST_CASES = [
    '{"requirements": [{"text": "T#", "type": "technology", "weight": 9, "isRequired": true, "keywords": ["a", "b"], "synonyms": ["c"]}, {"text": "U", "keywords": []}]}',
    '{"requirements": [ not json at all',
    '{"requirements": []}',
    '{"requirements": [null, {"wrongShape": true}, {"text": "AWS#", "keywords": ["aws"], "synonyms": "none"}, {"text": 5, "keywords": []}, {"text": "Docker", "keywords": ["docker"], "weight": 3}]}',
    '{"requirements": [null, {}, {"wrongShape": 1}]}',
    '{"requirements": "x"}',
    '{"other": 1}',
]


def spark_case(key, cases):
    chosen = F.element_at(F.array(*[F.lit(c) if c else F.lit(None).cast("string") for c in cases]), (key % len(cases) + 1).cast("int"))
    return F.replace(chosen, F.lit("#"), key.cast("string"))


def sql_case(key, cases):
    listed = ", ".join("NULL" if c is None else "'" + c + "'" for c in cases)
    return f"replace([{listed}][{key} % {len(cases)} + 1], '#', {key}::VARCHAR)"


ENTRIES = "CASE WHEN json_valid(doc) AND json_type(doc::JSON) = 'ARRAY' THEN json_extract(doc::JSON, '$[*]') END"
BAD_ENTRY = """(json_type(e) <> 'OBJECT' OR json_type(e, '$.id') IS DISTINCT FROM 'VARCHAR'
 OR json_type(e, '$.keywords') IS DISTINCT FROM 'ARRAY' OR json_type(e, '$.synonyms') IS DISTINCT FROM 'ARRAY')"""


@check(
    "e1_gate_requirements",
    f"""WITH given AS (SELECT o_orderkey AS job_position_id, {sql_case('o_orderkey', GATE_CASES)} AS doc FROM orders),
    listed AS (SELECT job_position_id, {ENTRIES} AS entries FROM given),
    bad AS (SELECT job_position_id, min(i) - 1 AS bad_index FROM (SELECT job_position_id, unnest(entries) AS e,
     generate_subscripts(entries, 1) AS i FROM listed) WHERE {BAD_ENTRY} GROUP BY 1)
    SELECT job_position_id, bad_index, CASE WHEN coalesce(len(entries), 0) = 0 THEN 'no requirements'
     WHEN bad_index IS NOT NULL THEN 'malformed' ELSE 'ok' END AS verdict FROM listed LEFT JOIN bad USING (job_position_id)""",
)
def e1_gate_requirements(spark, sf):
    jobs = inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_position_id"),
        spark_case(F.col("o_orderkey"), GATE_CASES).alias("requirements_json"),
    )
    gated = requirements.gate_requirements(jobs)
    return gated.select("job_position_id", F.col("bad_index").cast("long").alias("bad_index"), "verdict")


USABLE = "(json_type(e) = 'OBJECT' AND json_type(e, '$.text') = 'VARCHAR' AND json_type(e, '$.keywords') = 'ARRAY')"


def json_list(field):
    return (
        f"coalesce(CASE WHEN json_type(e, '$.{field}') = 'ARRAY' "
        f"THEN array_to_string(json_extract_string(e, '$.{field}[*]'), '/') END, '')"
    )


@check(
    "e2_ingest_requirement_json",
    f"""WITH given AS (SELECT o_orderkey AS job_position_id, {sql_case('o_orderkey', INGEST_CASES)} AS doc FROM orders),
    listed AS (SELECT job_position_id, CASE WHEN json_valid(doc) AND json_type(doc::JSON, '$.requirements') = 'ARRAY'
      THEN json_extract(doc::JSON, '$.requirements[*]') ELSE [] END AS entries FROM given),
    usable AS (SELECT job_position_id, e, row_number() OVER (PARTITION BY job_position_id ORDER BY i) AS n FROM
     (SELECT job_position_id, unnest(entries) AS e, generate_subscripts(entries, 1) AS i FROM listed) WHERE {USABLE}),
    lines AS (SELECT job_position_id, count(*) AS kept, string_agg('req_' || n || '=' || json_extract_string(e, '$.text') || ':'
      || coalesce(json_extract_string(e, '$.weight'), '-') || ':' || {json_list('keywords')} || ':' || {json_list('synonyms')}, ';' ORDER BY n) AS summary
     FROM usable GROUP BY 1)
    SELECT job_position_id, summary, CASE WHEN len(entries) = 0 THEN 0 ELSE len(entries) - coalesce(kept, 0) END AS dropped,
     CASE WHEN len(entries) = 0 THEN 'AI returned no usable requirements'
      WHEN kept IS NULL THEN 'AI returned requirements but none passed schema validation' END AS error
    FROM listed LEFT JOIN lines USING (job_position_id)""",
)
def e2_ingest_requirement_json(spark, sf):
    answers = inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_position_id"),
        spark_case(F.col("o_orderkey"), INGEST_CASES).alias("payload"),
    )
    ingested = requirements.ingest_requirement_json(answers, "payload")
    summary = F.array_join(
        F.transform(
            "requirements",
            lambda r: F.concat(
                r["id"], F.lit("="), r["text"], F.lit(":"),
                F.coalesce(r["weight"].cast("string"), F.lit("-")), F.lit(":"),
                F.array_join(r["keywords"], "/"), F.lit(":"), F.array_join(r["synonyms"], "/"),
            ),
        ),
        ";",
    )
    return ingested.select("job_position_id", summary.alias("summary"), F.col("dropped").cast("long").alias("dropped"), "error")


@check(
    "e3_validate_requirements",
    """WITH reqs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
     CASE WHEN l_partkey % 10 <> 0 THEN 'req_' || l_linenumber END AS requirement_id,
     CASE WHEN l_suppkey % 12 <> 0 THEN l_returnflag END AS text,
     ['technology', 'experience', 'education', 'softSkill', 'hobby', NULL][l_partkey % 6 + 1] AS type,
     l_partkey % 13 + CASE WHEN l_suppkey % 4 = 0 THEN 0.5 ELSE 0 END AS weight,
     CASE WHEN l_partkey % 14 <> 0 THEN l_linestatus = 'O' END AS is_required,
     CASE WHEN l_suppkey % 15 <> 0 THEN [l_returnflag, CASE WHEN l_partkey % 16 <> 0 THEN 'k' END] END AS keywords,
     CASE WHEN l_partkey % 18 <> 0 THEN []::VARCHAR[] END AS synonyms FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string([v FOR v IN [
     CASE WHEN requirement_id IS NULL THEN 'id' END, CASE WHEN text IS NULL THEN 'text' END,
     CASE WHEN type IS NULL OR type NOT IN ('technology', 'experience', 'education', 'softSkill') THEN 'type' END,
     CASE WHEN weight <> floor(weight) OR weight < 1 OR weight > 10 THEN 'weight' END,
     CASE WHEN is_required IS NULL THEN 'is_required' END,
     CASE WHEN keywords IS NULL OR len([k FOR k IN keywords IF k IS NULL]) > 0 THEN 'keywords' END,
     CASE WHEN synonyms IS NULL THEN 'synonyms' END] IF v IS NOT NULL], ',') AS violations FROM reqs""",
)
def e3_validate_requirements(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    types = ["technology", "experience", "education", "softSkill", "hobby"]
    reqs = inputs.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(p % 10 != 0, F.concat(F.lit("req_"), F.col("l_linenumber").cast("string"))).alias("requirement_id"),
        F.when(s % 12 != 0, F.col("l_returnflag")).alias("text"),
        F.element_at(F.array(*map(F.lit, types), F.lit(None).cast("string")), (p % 6 + 1).cast("int")).alias("type"),
        (p % 13 + F.when(s % 4 == 0, 0.5).otherwise(0.0)).alias("weight"),
        F.when(p % 14 != 0, F.col("l_linestatus") == "O").alias("is_required"),
        F.when(s % 15 != 0, F.array("l_returnflag", F.when(p % 16 != 0, "k"))).alias("keywords"),
        F.when(p % 18 != 0, F.array().cast("array<string>")).alias("synonyms"),
    )
    return requirements.validate_requirements(reqs).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("violations", ",").alias("violations")
    )


PART_REQS = """part_reqs AS (SELECT p_brand AS job_position_id, 'req_' || p_partkey AS requirement_id, p_name AS text,
 p_partkey % 12 AS weight, p_partkey % 3 = 0 AS is_required, [lower(p_brand), 'w0'] AS keywords,
 [CASE WHEN i = 3 AND p_partkey % 5 = 0 THEN 'W3' ELSE 'w' || (i + p_partkey % 2) END
  FOR i IN generate_series(0, p_size % 12)] AS synonyms FROM part)"""


def part_requirements(spark, sf):
    """One requirement per part, the brand being its job."""
    k = F.col("p_partkey")
    word = lambda i: F.when((i == 3) & (k % 5 == 0), "W3").otherwise(
        F.concat(F.lit("w"), (i + k % 2).cast("string"))
    )
    return inputs.table(spark, sf, "part").select(
        F.col("p_brand").alias("job_position_id"),
        F.concat(F.lit("req_"), k.cast("string")).alias("requirement_id"),
        F.col("p_name").alias("text"),
        (k % 12).alias("weight"),
        (k % 3 == 0).alias("is_required"),
        F.array(F.lower("p_brand"), F.lit("w0")).alias("keywords"),
        F.transform(F.sequence(F.lit(0), F.col("p_size") % 12), word).alias("synonyms"),
    )


@check(
    "e4_requirement_conformance",
    sql.with_(PART_REQS) + """SELECT requirement_id, array_to_string([v FOR v IN [
     CASE WHEN NOT (CASE WHEN is_required THEN weight BETWEEN 6 AND 10 ELSE weight BETWEEN 1 AND 6 END) THEN 'weight band' END,
     CASE WHEN len([s FOR s IN synonyms IF s <> lower(s)]) > 0 THEN 'synonym case' END,
     CASE WHEN list_has_any(keywords, synonyms) THEN 'keyword repeated' END,
     CASE WHEN len(synonyms) NOT BETWEEN 4 AND 10 THEN 'synonym count' END] IF v IS NOT NULL], ',') AS departures FROM part_reqs""",
)
def e4_requirement_conformance(spark, sf):
    return requirements.requirement_conformance(part_requirements(spark, sf)).select(
        "requirement_id", F.array_join("departures", ",").alias("departures")
    )


@check(
    "e5_edit_requirements",
    sql.with_(PART_REQS) + """SELECT job_position_id, requirement_id,
     CASE WHEN weight % 4 = 0 AND weight % 8 <> 0 THEN 'edited ' || text ELSE text END AS text,
     CASE WHEN weight % 4 = 0 THEN 10 ELSE weight END AS weight,
     CASE WHEN weight % 4 = 0 THEN NOT is_required ELSE is_required END AS is_required
    FROM part_reqs WHERE weight % 5 <> 0""",
)
def e5_edit_requirements(spark, sf):
    reqs = part_requirements(spark, sf)
    patches = reqs.where("weight % 4 = 0").select(
        "job_position_id",
        "requirement_id",
        F.when(F.col("weight") % 8 != 0, F.concat(F.lit("edited "), "text")).alias("text"),
        F.lit(10).cast("long").alias("weight"),
        (~F.col("is_required")).alias("is_required"),
    )
    removals = reqs.where("weight % 5 = 0").select("job_position_id", "requirement_id")
    return requirements.edit_requirements(reqs, patches, removals).select(
        "job_position_id", "requirement_id", "text", "weight", "is_required"
    )


@check(
    "e6_validate_jobs",
    f"""SELECT doc_id, array_to_string([v FOR v IN [
     CASE WHEN {sql.units('title')} NOT BETWEEN 3 AND 200 THEN 'title' END,
     CASE WHEN {sql.units('text')} NOT BETWEEN 50 AND 20000 THEN 'description' END] IF v IS NOT NULL], ',') AS violations
    FROM (SELECT doc_id, text, repeat('é', (doc_id % 210)::INT) AS title FROM documents)""",
)
def e6_validate_jobs(spark, sf):
    jobs = inputs.table(spark, sf, "documents").select(
        "doc_id",
        F.expr("repeat('é', cast(doc_id % 210 as int))").alias("title"),
        F.col("text").alias("job_description_text"),
    )
    return requirements.validate_jobs(jobs).select("doc_id", F.array_join("violations", ",").alias("violations"))


JSON_LIST = (
    '[{"id": "a#", "text": "First", "type": "technology", "weight": 9, "isRequired": true, "keywords": ["x", "y"], "synonyms": []}, '
    '{"id": "b#", "text": "Sécond", "type": "softSkill", "weight": 2, "isRequired": false, "keywords": [], "synonyms": ["z"]}]'
)


@check(
    "s9_explode_requirements",
    f"""WITH given AS (SELECT o_orderkey AS job_position_id, {sql_case('o_orderkey', [JSON_LIST, '[]', JSON_LIST])} AS doc FROM orders),
    listed AS (SELECT job_position_id, unnest(entries) AS e, generate_subscripts(entries, 1) - 1 AS req_pos
     FROM (SELECT job_position_id, json_extract(doc::JSON, '$[*]') AS entries FROM given))
    SELECT job_position_id, req_pos, json_extract_string(e, '$.id') AS requirement_id, json_extract_string(e, '$.text') AS text,
     json_extract_string(e, '$.type') AS type, json_extract(e, '$.weight')::INT AS weight,
     json_extract(e, '$.isRequired')::BOOLEAN AS is_required, {json_list('keywords')} AS keywords, {json_list('synonyms')} AS synonyms FROM listed""",
)
def s9_explode_requirements(spark, sf):
    jobs = inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_position_id"),
        spark_case(F.col("o_orderkey"), [JSON_LIST, "[]", JSON_LIST]).alias("requirements_json"),
    )
    rows = requirements.explode_requirements(jobs)
    return rows.withColumns(
        {
            "req_pos": F.col("req_pos").cast("long"),
            "keywords": F.array_join("keywords", "/"),
            "synonyms": F.array_join("synonyms", "/"),
        }
    )
