"""Redaction, parsing and file intake over every document, page and template CV."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from checks import inputs, sql
from checks.registry import check
from shortlist.cluster import cut_lineage, shared_folder, spread
from shortlist.functions import entities, fixed, redaction
from shortlist.functions.text import js_trim
from shortlist.operators import parsing
from shortlist.sources import files, layout, tables

B = sql.BLANK
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = rf"(?:\+?\d{{1,3}}[-.{B}]?)?\(?\d{{2,4}}\)?[-.{B}]?\d{{3,4}}[-.{B}]?\d{{3,4}}"
URL = rf"https?://[^{B}]+"
ADDRESS = [
    rf"(?i)\baddress[:{B}]+[^\n]+",
    rf"(?i)\b\d+[{B}]+[A-Z][a-z]+[{B}]+(?:st|street|ave|avenue|rd|road|blvd)\b[^\n]*",
]
BIRTH = [
    rf"(?i)\bdate of birth[:{B}]+[\d/.-]+",
    rf"(?i)\bdob[:{B}]+[\d/.-]+",
    rf"(?i)\bborn(?:[{B}]+on)?[:{B}]+\d[\d/.-]+",
    rf"(?i)\bage[:{B}]+\d{{1,2}}\b",
]
PRONOUNS = ["he/him", "she/her", "they/them", "he/they", "she/they"]


def sub(x, pattern, mark):
    return f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"


def chain(x, patterns, mark):
    for pattern in patterns:
        x = sub(x, pattern, mark)
    return x


def pronouns(x):
    return chain(x, [rf"(?i)\(?{p}\)?" for p in PRONOUNS], "")


def name_line(x):
    """First non-blank line replaced when its trimmed form has 2-4 plain words under 60 characters."""
    ib = sql.INLINE_BLANK
    head = rf"^(?:[{ib}]*\n)*"
    line = sql.trim(rf"regexp_extract({x}, '({head})([^\n]*)', 2)")
    words = rf"len(regexp_split_to_array({line}, '[{B}]+')) BETWEEN 2 AND 4"
    plain = rf"regexp_full_match({line}, '[A-Za-z{B}''-]+')"
    return (
        f"CASE WHEN {plain} AND {words} AND {sql.units(line)} < 60 "
        rf"THEN regexp_replace({x}, '({head})[^\n]*', '\1[NAME]') ELSE {x} END"
    )


STEPS = {
    "r1_redact_email": (redaction.redact_email, lambda x: sub(x, EMAIL, "[EMAIL]")),
    "r2_redact_phone": (redaction.redact_phone, lambda x: sub(x, PHONE, "[PHONE]")),
    "r3_redact_url": (redaction.redact_url, lambda x: sub(x, URL, "[URL]")),
    "r4_redact_address": (redaction.redact_address, lambda x: chain(x, ADDRESS, "[ADDRESS]")),
    "r5_redact_birth": (redaction.redact_birth, lambda x: chain(x, BIRTH, "[PERSONAL_DATA]")),
    "r6_strip_pronouns": (redaction.strip_pronouns, pronouns),
    "r7_redact_name": (redaction.redact_name, name_line),
}
BOTH_TEXTS = sql.with_(
    sql.TEMPLATES,
    """texts AS (SELECT 'cv' AS origin, cv_id, raw_text FROM template_base
    UNION ALL SELECT 'document', doc_id, text FROM documents)""",
)


def both_texts(spark, sf):
    """Template CVs and documents together."""
    resumes = inputs.template_cvs(spark, sf).select(F.lit("cv").alias("origin"), "cv_id", "raw_text")
    documents = inputs.document_cvs(spark, sf).select(F.lit("document").alias("origin"), "cv_id", "raw_text")
    return resumes.unionByName(documents)


def _register_step(name, step, as_sql):
    @check(name, BOTH_TEXTS + f"SELECT origin, cv_id, {as_sql('raw_text')} AS redacted FROM texts")
    def query(spark, sf):
        return both_texts(spark, sf).select("origin", "cv_id", step(F.col("raw_text")).alias("redacted"))


for _name, (_step, _as_sql) in STEPS.items():
    _register_step(_name, _step, _as_sql)


def _redacted_sql(source):
    """Each step in a subquery of its own, in order."""
    for _, as_sql in STEPS.values():
        source = f"(SELECT * EXCLUDE (raw_text), {as_sql('raw_text')} AS raw_text FROM {source})"
    return f"(SELECT * EXCLUDE (raw_text), {sql.trim('raw_text')} AS anonymized_text FROM {source})"


@check("r8_redact", BOTH_TEXTS + f"SELECT origin, cv_id, anonymized_text FROM {_redacted_sql('texts')}")
def r8_redact(spark, sf):
    return redaction.redact(both_texts(spark, sf)).select("origin", "cv_id", "anonymized_text")


# --- parsing ----------------------------------------------------------------

HEADERS = fixed.SECTION_HEADERS


def _position_sql(header):
    pattern = rf"(?i)(?:^|\n)[{B}]*" + header.replace("~s", f"[{B}]").replace("~>", r"\b")
    return f"CASE WHEN regexp_matches(raw_text, '{pattern}') THEN length(regexp_split_to_array(raw_text, '{pattern}')[1]) END"


POSITIONS = ", ".join(
    f"coalesce({', '.join(_position_sql(h) for h in headers)}) AS at_{name}" for name, headers in HEADERS.items()
)
SECTION_LIST = list(HEADERS)


def _slice_sql(name):
    later = ", ".join(f"CASE WHEN at_{o} > at_{name} THEN at_{o} END" for o in SECTION_LIST if o != name)
    end = f"coalesce(least({later}), length(raw_text))"
    cut = sql.trim(f"substring(raw_text, (at_{name} + 1)::INT, ({end} - at_{name})::INT)")
    return f"coalesce({cut}, '') AS {name}"


SECTIONED = f"""marked AS (SELECT *, {POSITIONS} FROM template_base),
sectioned AS (SELECT *, {', '.join(_slice_sql(n) for n in SECTION_LIST)},
 CASE WHEN coalesce({', '.join('at_' + n for n in SECTION_LIST)}) IS NULL THEN raw_text ELSE '' END AS other FROM marked)"""


@check(
    "p1_classify_confidence",
    BOTH_TEXTS + f"""SELECT origin, cv_id, format, {sql.units('kept')} AS kept_length, parsing_confidence, failed FROM (
    SELECT *, CASE WHEN format = 'pdf' AND n < 50 THEN '' ELSE raw_text END AS kept,
    CASE WHEN format = 'pdf' THEN CASE WHEN n < 50 THEN 'failed'
      WHEN length(regexp_replace(raw_text, '[^a-zA-Z]', '', 'g')) / n::DOUBLE >= 0.6::DOUBLE THEN 'high' ELSE 'low' END
     WHEN format = 'docx' THEN CASE WHEN n < 50 THEN 'failed' ELSE 'high' END
     ELSE CASE WHEN n > 50 THEN 'high' ELSE 'low' END END AS parsing_confidence,
    format <> 'txt' AND n < 50 AS failed
    FROM (SELECT *, {sql.units('raw_text')} AS n FROM texts, (VALUES ('pdf'), ('docx'), ('txt')) AS f(format)))""",
)
def p1_classify_confidence(spark, sf):
    formats = F.explode(F.array(F.lit("pdf"), F.lit("docx"), F.lit("txt"))).alias("format")
    classified = parsing.classify_confidence(both_texts(spark, sf).select("*", formats))
    return classified.select(
        "origin", "cv_id", "format",
        (F.octet_length(F.encode("raw_text", "UTF-16BE")) / 2).cast("long").alias("kept_length"),
        "parsing_confidence",
        F.col("parse_error").isNotNull().alias("failed"),
    )


ROUTED_SQL = """CASE
 WHEN mime_type = 'application/pdf' OR lower(original_filename) LIKE '%.pdf' THEN 'pdf'
 WHEN mime_type = 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  OR lower(original_filename) LIKE '%.docx' THEN 'docx'
 WHEN mime_type = 'text/plain' OR lower(original_filename) LIKE '%.txt' THEN 'txt' ELSE 'unsupported' END"""


def read_errors(df):
    """Every 23rd file could not be read, every 46th without a message."""
    return df.withColumn(
        "read_error",
        F.when(F.col("cv_id") % 46 == 0, F.lit("")).when(F.col("cv_id") % 23 == 0, F.lit("bad xref")),
    )


@check(
    "p2_split_outcomes",
    sql.with_(sql.TEMPLATES) + f"""SELECT cv_id, CASE
     WHEN read_error = '' THEN 'Could not read file.'
     WHEN read_error IS NOT NULL THEN 'Could not read file: ' || read_error
     WHEN format = 'unsupported' THEN 'Could not read file: Unsupported file type: ' || mime_type || ' / ' || original_filename
     WHEN format = 'pdf' AND length(raw_text) < 50 THEN 'PDF parsed but no meaningful text was extracted. This is usually an image-only/scanned PDF; OCR is not available.'
     WHEN format = 'docx' AND length(raw_text) < 50 THEN 'DOCX parsed but no meaningful text was extracted.' END AS reason
    FROM (SELECT cv_id, mime_type, original_filename, {ROUTED_SQL} AS format,
      CASE WHEN cv_id % 17 = 0 THEN 'too short' ELSE raw_text END AS raw_text,
      CASE WHEN cv_id % 46 = 0 THEN '' WHEN cv_id % 23 = 0 THEN 'bad xref' END AS read_error FROM template_base)""",
)
def p2_split_outcomes(spark, sf):
    texts = inputs.template_cvs(spark, sf).withColumn(
        "raw_text", F.when(F.col("cv_id") % 17 == 0, "too short").otherwise(F.col("raw_text"))
    )
    good, failed = parsing.split_outcomes(parsing.classify_confidence(files.route_format(read_errors(texts))))
    return good.select("cv_id", F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select("cv_id", F.col("failure_reason").alias("reason"))
    )


@check(
    "p3_section_markers",
    sql.with_(sql.TEMPLATES, SECTIONED) + " UNION ALL ".join(
        f"SELECT cv_id, '{n}' AS section, at_{n} AS position FROM marked WHERE at_{n} IS NOT NULL" for n in SECTION_LIST
    ),
)
def p3_section_markers(spark, sf):
    found = parsing.section_markers(inputs.template_cvs(spark, sf))
    return found.select("cv_id", "section", F.col("position").cast("long").alias("position"))


@check(
    "p4_detect_sections",
    sql.with_(sql.TEMPLATES, SECTIONED) + "SELECT cv_id, experience, skills, education, summary, other FROM sectioned",
)
def p4_detect_sections(spark, sf):
    return parsing.detect_sections(inputs.template_cvs(spark, sf)).select("cv_id", "sections.*")


@check(
    "p5_split_sentences",
    f"""WITH texts AS (SELECT 'document' AS origin, doc_id AS id, 0 AS part, text AS raw_text FROM documents
     UNION ALL SELECT 'conversation', conv_id, turn, text FROM conversations
     UNION ALL SELECT 'page', page_id, 0, html FROM pages)
    SELECT origin, id, part, i - 1 AS pos, list[i] AS sentence FROM (
     SELECT origin, id, part, {sql.sentences('raw_text')} AS list FROM texts),
     LATERAL (SELECT unnest(generate_series(1, len(list))) AS i)""",
)
def p5_split_sentences(spark, sf):
    def texts(table, origin, key, part, text):
        rows = inputs.table(spark, sf, table).select(
            F.lit(origin).alias("origin"), F.col(key).alias("cv_id"), part.cast("long").alias("part"),
            F.col(text).alias("raw_text"),
        )
        return spread(rows, "cv_id")

    every = (
        texts("documents", "document", "doc_id", F.lit(0), "text")
        .unionByName(texts("conversations", "conversation", "conv_id", F.col("turn"), "text"))
        .unionByName(texts("pages", "page", "page_id", F.lit(0), "html"))
    )
    split = parsing.explode_sentences(every, "origin", "part")
    return split.select("origin", F.col("cv_id").alias("id"), "part", F.col("pos").cast("long").alias("pos"), "sentence")


@check(
    "p5_explode_sentences",
    sql.with_(sql.TEMPLATES) + f"""SELECT cv_id, i - 1 AS pos, list[i] AS sentence FROM (
     SELECT cv_id, {sql.sentences('raw_text')} AS list FROM template_base),
     LATERAL (SELECT unnest(generate_series(1, len(list))) AS i)""",
)
def p5_explode_sentences(spark, sf):
    return parsing.explode_sentences(inputs.template_cvs(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


YEARS = [
    rf"(?i)(\d+)\+?[{B}]*years?[{B}]+(?:of[{B}]+)?experience",
    rf"(?i)experience:?[{B}]*(\d+)\+?[{B}]*years?",
    rf"(?i)(\d+)\+?[{B}]*years?[{B}]+in",
]


def _year_sql(pattern):
    n = f"try_cast(regexp_extract(raw_text, '{pattern}', 1) AS BIGINT)"
    return f"CASE WHEN {n} BETWEEN 1 AND 59 THEN {n} END"


YEARS_SQL = f"coalesce({', '.join(_year_sql(p) for p in YEARS)}, 0)"


@check("p6_years_of_experience", BOTH_TEXTS + f"SELECT origin, cv_id, {YEARS_SQL} AS years FROM texts")
def p6_years_of_experience(spark, sf):
    return both_texts(spark, sf).select(
        "origin", "cv_id", entities.years_of_experience(F.col("raw_text")).cast("long").alias("years")
    )


def _tech_sql():
    hits = []
    for term in fixed.TECHNOLOGIES:
        literal = term.replace(".", r"\.").replace("+", r"\+")
        hits.append(rf"CASE WHEN regexp_matches(lower(raw_text), '\b{literal}\b') THEN '{term}' END")
    return f"[t FOR t IN [{', '.join(hits)}] IF t IS NOT NULL]"


TECH_SQL = _tech_sql()


@check(
    "p7_technologies",
    BOTH_TEXTS + f"SELECT origin, cv_id, array_to_string({TECH_SQL}, ',') AS technologies FROM texts",
)
def p7_technologies(spark, sf):
    return both_texts(spark, sf).select(
        "origin", "cv_id", F.array_join(entities.technologies(F.col("raw_text")), ",").alias("technologies")
    )


DEGREES = [
    rf"(?i)\b(b\.?sc\.?|bachelor(?:''s)?|bs)\b.*?(?:computer[{B}]+science|cs|engineering|mathematics|physics|[a-z]+)",
    rf"(?i)\b(m\.?sc\.?|master(?:''s)?|ms)\b.*?(?:computer[{B}]+science|cs|engineering|mathematics|[a-z]+)",
    rf"(?i)\b(ph\.?d\.?|doctorate)\b.*?(?:computer[{B}]+science|cs|engineering|[a-z]+)",
]
DEGREE_SQL = "[{} FOR d IN [{}] IF d <> '']".format(
    sql.trim("d"), ", ".join(f"regexp_extract(raw_text, '{p}', 0)" for p in DEGREES)
)


@check("p8_degrees", BOTH_TEXTS + f"SELECT origin, cv_id, array_to_string({DEGREE_SQL}, '|') AS degrees FROM texts")
def p8_degrees(spark, sf):
    return both_texts(spark, sf).select(
        "origin", "cv_id", F.array_join(entities.degrees(F.col("raw_text")), "|").alias("degrees")
    )


COMPANY = rf"(?m)(?:^|\n)[{B}]*([A-Z][A-Za-z0-9&.{B}]{{2,40}}?)(?:[{B}]+[-–|]|[{B}]+\d{{4}}|\n)"
ROLE = (
    rf"(?i)\b(senior|lead|staff|principal|junior|mid)?[{B}]*"
    rf"(?:software|backend|frontend|fullstack|full-stack|devops|platform|data|ml|ai)?[{B}]*"
    r"(engineer|developer|architect|manager|director|lead)\b"
)


def _first_seen(items, keep):
    """Distinct values in order of first appearance, cut to `keep`."""
    return (
        f"(SELECT list(v ORDER BY p) FROM (SELECT v, min(p) AS p FROM (SELECT unnest({items}) AS v, "
        f"generate_subscripts({items}, 1) AS p) GROUP BY v ORDER BY p LIMIT {keep}))"
    )


COMPANIES_SQL = f"[n FOR n IN [{sql.trim('m')} FOR m IN regexp_extract_all(experience, '{COMPANY}', 1)] IF length(n) > 2]"
ROLES_SQL = f"[{sql.trim('lower(m)')} FOR m IN regexp_extract_all(experience, '{ROLE}', 0)]"


@check(
    "p9_companies",
    sql.with_(sql.TEMPLATES, SECTIONED, f"named AS (SELECT cv_id, {COMPANIES_SQL} AS items FROM sectioned)")
    + f"SELECT cv_id, coalesce(array_to_string({_first_seen('items', 10)}, '|'), '') AS companies FROM named",
)
def p9_companies(spark, sf):
    sectioned = parsing.detect_sections(inputs.template_cvs(spark, sf))
    return sectioned.select(
        "cv_id", F.array_join(entities.companies(F.col("sections.experience")), "|").alias("companies")
    )


@check(
    "p10_roles",
    sql.with_(sql.TEMPLATES, SECTIONED, f"named AS (SELECT cv_id, {ROLES_SQL} AS items FROM sectioned)")
    + f"SELECT cv_id, coalesce(array_to_string({_first_seen('items', 5)}, '|'), '') AS roles FROM named",
)
def p10_roles(spark, sf):
    sectioned = parsing.detect_sections(inputs.template_cvs(spark, sf))
    return sectioned.select("cv_id", F.array_join(entities.roles(F.col("sections.experience")), "|").alias("roles"))


ENRICHED = f"""enriched AS (SELECT cv_id, job_position_id, raw_text, experience, skills, education, summary, other,
 {sql.sentences('raw_text')} AS sentences, {YEARS_SQL} AS years_of_experience, {TECH_SQL} AS technologies,
 {DEGREE_SQL} AS degrees, {COMPANIES_SQL} AS company_items, {ROLES_SQL} AS role_items FROM sectioned)"""


@check(
    "p11_enrich",
    sql.with_(sql.TEMPLATES, SECTIONED, ENRICHED) + f"""SELECT cv_id, experience, skills, education, summary, other,
     array_to_string(sentences, chr(10)) AS sentences, years_of_experience,
     array_to_string(technologies, ',') AS technologies, array_to_string(degrees, '|') AS degrees,
     coalesce(array_to_string({_first_seen('company_items', 10)}, '|'), '') AS companies,
     coalesce(array_to_string({_first_seen('role_items', 5)}, '|'), '') AS roles FROM enriched""",
)
def p11_enrich(spark, sf):
    e = F.col("entities")
    return parsing.enrich(inputs.template_cvs(spark, sf)).select(
        "cv_id",
        "sections.*",
        F.array_join("sentences", "\n").alias("sentences"),
        e["years_of_experience"].cast("long").alias("years_of_experience"),
        F.array_join(e["technologies"], ",").alias("technologies"),
        *[F.array_join(e[n], "|").alias(n) for n in ("degrees", "companies", "roles")],
    )


# --- sources ----------------------------------------------------------------


@check(
    "s1_read_cvs",
    sql.with_(sql.CVS) + """SELECT cv_id, job_position_id, final_score,
    row_number() OVER (PARTITION BY job_position_id ORDER BY final_score DESC NULLS FIRST, cv_id) AS place FROM cvs""",
)
def s1_read_cvs(spark, sf):
    """CVs of all jobs written and read back; the order of the read is kept as it comes."""
    path = f"{shared_folder(spark)}/shortlist-cvs-{uuid.uuid4().hex}"
    tables.write_cvs(inputs.cvs(spark, sf).select("cv_id", "job_position_id", "final_score"), path, many_jobs=True)
    numbered = cut_lineage(tables.read_cvs(spark, path).withColumn("_at", F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("job_position_id").orderBy("_at")).cast("long")
    return numbered.select("cv_id", "job_position_id", "final_score", place.alias("place"))


PER_FILE = 20


@check(
    "s2_read_cv_files",
    f"""SELECT 'batch=' || doc_id // {PER_FILE} AS folder, 'txt' AS extension, 'text/plain' AS mime_type,
    sum(strlen(coalesce(text, '')) + 1)::BIGINT AS length, md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS content_md5
    FROM documents GROUP BY doc_id // {PER_FILE}""",
)
def s2_read_cv_files(spark, sf):
    """Documents written as text files, a few to a file, and read back as uploads."""
    docs = inputs.table(spark, sf, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(f"doc_id div {PER_FILE}").alias("batch")
    )
    path = f"{shared_folder(spark)}/shortlist-files-{uuid.uuid4().hex}"
    docs.repartition("batch").sortWithinPartitions("batch", "doc_id").drop("doc_id").write.partitionBy("batch").text(path)
    return files.read_cv_files(spark, path).where(~F.startswith("filename", F.lit("_"))).select(
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.regexp_extract("filename", r"\.([^.]+)$", 1).alias("extension"),
        "mime_type",
        "length",
        F.md5("content").alias("content_md5"),
    )


UPLOADS = """uploads AS (SELECT l_orderkey AS batch_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS filename,
 (l_extendedprice * 120)::BIGINT AS length FROM lineitem)"""


@check(
    "s3_guard_uploads",
    sql.with_(UPLOADS) + """, sizes AS (SELECT batch_id, count(*) AS n, max(length) AS largest FROM uploads GROUP BY 1)
    SELECT u.batch_id, u.filename, CASE WHEN n > 500 THEN 'Too many files in a single upload.'
     WHEN largest > 10485760 THEN 'One or more files exceed the per-file size limit (10 MB).' END AS reason
    FROM uploads u JOIN sizes USING (batch_id)
    UNION ALL SELECT o_orderkey, NULL, 'No files uploaded' FROM orders ANTI JOIN sizes ON o_orderkey = batch_id""",
)
def s3_guard_uploads(spark, sf):
    uploads = inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("filename"),
        F.round(F.col("l_extendedprice") * 120).cast("long").alias("length"),
    )
    batches = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("batch_id"))
    accepted, rejected = files.guard_uploads(uploads, batches)
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejected, allowMissingColumns=True
    ).select("batch_id", "filename", "reason")


@check(
    "s4_route_format",
    sql.with_(sql.TEMPLATES) + f"""SELECT 'cv' AS origin, cv_id AS id, {ROUTED_SQL} AS format FROM template_base
    UNION ALL SELECT 'page', page_id, {ROUTED_SQL} FROM (SELECT page_id, url AS original_filename,
     CASE WHEN page_id % 3 = 0 THEN 'text/plain' ELSE 'text/html' END AS mime_type FROM pages)""",
)
def s4_route_format(spark, sf):
    resumes = inputs.template_cvs(spark, sf).select(
        F.lit("cv").alias("origin"), F.col("cv_id").alias("id"), "original_filename", "mime_type"
    )
    pages = inputs.table(spark, sf, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("url").alias("original_filename"),
        F.when(F.col("page_id") % 3 == 0, "text/plain").otherwise("text/html").alias("mime_type"),
    )
    return files.route_format(resumes.unionByName(pages)).select("origin", "id", "format")


@check(
    "s5_decode_text",
    f"""SELECT doc_id AS cv_id, {sql.trim('text')} AS raw_text,
    CASE WHEN {sql.units(sql.trim('text'))} > 50 THEN 'high' ELSE 'low' END AS parsing_confidence FROM documents""",
)
def s5_decode_text(spark, sf):
    stored = inputs.document_cvs(spark, sf).select("cv_id", F.encode("raw_text", "UTF-8").alias("content"))
    return files.decode_text(stored).select("cv_id", "raw_text", "parsing_confidence")


def text_items(spark, sf):
    """Order lines as page items: one document per order, two pages, heights that may be missing."""
    k = F.col("l_partkey")
    from pyspark.sql import Window

    idx = F.row_number().over(
        Window.partitionBy("l_orderkey", F.col("l_linenumber") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey")
    )
    return inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") % 2).alias("page"),
        idx.alias("idx"),
        F.when(k % 9 == 0, "").when(k % 4 == 0, F.concat(F.col("l_returnflag"), F.lit(" "))).otherwise(
            F.concat(F.col("l_returnflag"), k.cast("string"))
        ).alias("str"),
        F.col("l_quantity").alias("y"),
        F.when(k % 5 != 0, (k % 13).cast("double")).alias("height"),
        (k % 6 == 0).alias("has_eol"),
    )


ITEMS = """items AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page,
 row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) AS idx,
 CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_partkey % 4 = 0 THEN l_returnflag || ' ' ELSE l_returnflag || l_partkey END AS str,
 l_quantity AS y, CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey % 13)::DOUBLE END AS height,
 l_partkey % 6 = 0 AS has_eol FROM lineitem)"""


@check(
    "s6_assemble_pages",
    f"""WITH RECURSIVE {ITEMS},
    fold AS (SELECT doc_id, page, idx, str AS body, CASE WHEN height > 0 THEN height ELSE 12 END AS h, y, has_eol
      FROM items WHERE idx = 1
     UNION ALL SELECT doc_id, page, idx, body || CASE WHEN abs(old_y - y) > h * 1.8::DOUBLE THEN chr(10) || chr(10)
       WHEN old_eol OR abs(old_y - y) > h * 0.4::DOUBLE THEN chr(10)
       WHEN body <> '' AND right(body, 1) NOT IN (' ', chr(10)) AND str <> '' AND left(str, 1) <> ' ' THEN ' '
       ELSE '' END || str, h, y, has_eol
      FROM (SELECT i.doc_id, i.page, i.idx, f.body, i.str, f.y AS old_y, i.y, f.has_eol AS old_eol, i.has_eol,
        CASE WHEN i.height > 0 THEN i.height ELSE f.h END AS h
       FROM fold f JOIN items i ON i.doc_id = f.doc_id AND i.page = f.page AND i.idx = f.idx + 1))
    SELECT doc_id, page, regexp_replace(regexp_replace(arg_max(body, idx), '[ \\t]+\\n', chr(10), 'g'),
     '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM fold GROUP BY doc_id, page""",
)
def s6_assemble_pages(spark, sf):
    return layout.assemble_pages(text_items(spark, sf))


@check(
    "s7_stitch_pages",
    f"""WITH pages_in AS (SELECT conv_id AS doc_id, turn AS page,
      replace(text, '. ', '. ' || chr(9) || chr(10) || chr(10) || chr(10)) || '  ' AS text FROM conversations)
    SELECT doc_id, {sql.trim(r"string_agg(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10) ORDER BY page)")} AS raw_text
    FROM pages_in GROUP BY doc_id""",
)
def s7_stitch_pages(spark, sf):
    pages = inputs.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("page"),
        F.concat(F.replace("text", F.lit(". "), F.lit(". \t\n\n\n")), F.lit("  ")).alias("text"),
    )
    return layout.stitch_pages(pages)


@check(
    "s8_failed_row",
    sql.with_(sql.TEMPLATES) + """SELECT cv_id, job_position_id, original_filename, mime_type, '' AS raw_text,
    '' AS anonymized_text, '' AS sections, 0 AS sentence_count, 0 AS years, 0 AS facts, 'failed' AS parsing_confidence,
    0 AS score_entries, 0.0::DOUBLE AS final_score, 'no-match' AS tier, 'Could not read file: ' || mime_type AS elimination_reason
    FROM template_base""",
)
def s8_failed_row(spark, sf):
    lost = inputs.template_cvs(spark, sf).withColumn(
        "failure_reason", F.concat(F.lit("Could not read file: "), "mime_type")
    )
    rows = tables.failed_row(lost)
    e = F.col("entities")
    return rows.select(
        "cv_id", "job_position_id", "original_filename", "mime_type", "raw_text", "anonymized_text",
        F.concat_ws("", "sections.*").alias("sections"),
        F.size("sentences").alias("sentence_count"),
        e["years_of_experience"].alias("years"),
        (F.size(e["technologies"]) + F.size(e["degrees"]) + F.size(e["companies"]) + F.size(e["roles"])).alias("facts"),
        "parsing_confidence",
        F.size("keyword_scores").alias("score_entries"),
        "final_score", "tier", "elimination_reason",
    )


@check(
    "s10_insert_absent",
    sql.with_(sql.JOBS) + """, fresh AS (SELECT c_custkey // 2 * 7 AS job_position_id, arg_max('New ' || c_name, c_custkey) AS title
     FROM customer GROUP BY 1)
    SELECT job_position_id, title FROM jobs UNION ALL SELECT job_position_id, title FROM fresh
    WHERE job_position_id NOT IN (SELECT job_position_id FROM jobs)""",
)
def s10_insert_absent(spark, sf):
    """Every new key comes twice; the later row goes in."""
    fresh = inputs.table(spark, sf, "customer").select(
        F.expr("c_custkey div 2 * 7").alias("job_position_id"), F.concat(F.lit("New "), "c_name").alias("title"), F.col("c_custkey").alias("seq")
    )
    base = inputs.jobs(spark, sf).select("job_position_id", "title", F.lit(0).cast("long").alias("seq"))
    return tables.insert_absent(base, fresh, ["job_position_id"]).drop("seq")
