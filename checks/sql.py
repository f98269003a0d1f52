"""SQL fragments for the independent checks, written for DuckDB's regex engine (no look-around)."""

from __future__ import annotations

BLANK = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
INLINE_BLANK = BLANK.replace(r"\n", "")


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def units(x: str) -> str:
    """UTF-16 length."""
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def normalize(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), '-', ' '), '[{BLANK}]+', ' ', 'g'))"


def boundary(norm: str, needle: str) -> str:
    return (
        f"(contains({norm}, {needle}) AND regexp_matches({norm}, "
        f"'(^|[^a-z0-9])' || regexp_escape({needle}) || '($|[^a-z0-9])'))"
    )


def sentences(x: str) -> str:
    """Sentence array: mark sentence ends, then split on marks, newlines and bullets."""
    marked = rf"regexp_replace({x}, '([.!?])[{BLANK}]+', '\1' || chr(1), 'g')"
    parts = rf"regexp_split_to_array({marked}, '\x01|\n+|[•▪·●◦∙►]')"
    return f"[s FOR s IN [{trim('p')} FOR p IN {parts}] IF {units('s')} >= 3]"


def one_decimal(x: str) -> str:
    return f"printf('%.1f', floor({x} * 10 + 0.5) / 10)"


def _values(rows: list[str], columns: str) -> str:
    return f"(VALUES {', '.join(rows)}) AS t({columns})"


REQ_COLUMNS = "job_position_id, req_pos, requirement_id, text, type, weight, is_required, keywords, synonyms"

CORPUS_REQS = """corpus_reqs AS (SELECT * FROM (VALUES
('en', 0, 'req_1', 'Articles', 'technology', 9, true, ['the'], ['of the']),
('en', 1, 'req_2', 'Links', 'technology', 8, true, ['with', 'that'], []::VARCHAR[]),
('en', 2, 'req_3', 'Rest', 'experience', 9, true, ['rest'], ['Of', ' - ']),
('en', 3, 'req_4', 'Pointing', 'softSkill', 6, false, ['this'], []::VARCHAR[]),
('en', 4, 'req_5', 'Symbols', 'technology', 5, false, ['c++'], ['.net']),
('de', 0, 'req_1', 'Links', 'technology', 9, true, ['und'], []::VARCHAR[]),
('de', 1, 'req_2', 'Articles', 'technology', 6, true, ['der'], ['die']),
('de', 2, 'req_3', 'Negation', 'softSkill', 3, false, ['nicht'], []::VARCHAR[]),
('fr', 0, 'req_1', 'Articles', 'technology', 3, false, ['les'], ['des']),
('fr', 1, 'req_2', 'One', 'education', 5, false, ['une'], []::VARCHAR[]))
AS t(job_position_id, req_pos, requirement_id, text, type, weight, is_required, keywords, synonyms))"""

DEMO_REQS = """demo_reqs AS (SELECT j.job_position_id, t.* FROM (VALUES
(0, 'need_a', 'Has built web services', 'experience', 7, true, ['node.js', 'express'], ['on call']),
(1, 'need_b', 'Writes typed code', 'technology', 6, true, ['typescript'], ['c++']),
(2, 'need_c', 'Has run clusters', 'technology', 8, false, ['kubernetes', 'k8s'], ['managed']),
(3, 'need_d', 'Has built pages', 'technology', 4, false, ['react'], ['php sites']),
(4, 'need_e', 'Knows hosting', 'technology', 5, false, ['aws', '+1'], ['docker at scale']))
AS t(req_pos, requirement_id, text, type, weight, is_required, keywords, synonyms)
CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD')) AS j(job_position_id))"""

LONG_REQS = r"""worded AS (SELECT doc_id, lang, string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ') AS word
 FROM documents WHERE text IS NOT NULL),
long_reqs AS (SELECT lang AS job_position_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::INT AS req_pos,
 'req_' || doc_id AS requirement_id, 'Terms of a document' AS text, 'experience' AS type, (doc_id % 10 + 1)::INT AS weight,
 doc_id % 3 = 0 AS is_required, [coalesce(word[3], ''), concat_ws(' ', word[1], word[2])] AS keywords,
 [coalesce(word[4], '') || ',', '§', ' - '] AS synonyms FROM worded)"""

DOCS = f"""docs AS (SELECT doc_id AS cv_id, lang AS job_position_id, text AS raw_text,
 {sentences('text')} AS sentences FROM documents)"""

TEMPLATES = """template_base AS (SELECT c_custkey AS cv_id, c_mktsegment AS job_position_id,
 c_name || ['.pdf', '.DOCX', '.txt', '.rtf'][c_custkey % 4 + 1] AS original_filename,
 ['application/pdf', 'application/octet-stream', 'text/plain', 'image/png',
  'application/vnd.openxmlformats-officedocument.wordprocessingml.document'][c_custkey % 5 + 1] AS mime_type,
 CASE WHEN c_custkey % 7 = 6 THEN 'A flat block about customer ' || c_custkey
   || ' who shipped Node.js and Docker at scale with no headers anywhere.'
 ELSE concat_ws(chr(10),
  ['Ada Byron', 'Grace Hopper (she/her)', 'Jean-Luc O''Neil', 'Engineer 2024 Edition',
   'Senior Backend Engineer'][c_custkey % 5 + 1],
  'Email: user' || c_custkey || '@example.com | +1 (415) 555-0' || (100 + c_custkey % 900),
  'Portfolio: https://example.com/u/' || c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN 'DOB: 12/03/19' || (60 + c_custkey % 40)
   WHEN 1 THEN 'Age: ' || (20 + c_custkey % 50)
   WHEN 2 THEN 'Address: ' || (c_custkey + 1) || ' Main Street' ELSE '' END,
  'Summary',
  CASE c_custkey % 3 WHEN 0 THEN (c_custkey % 70) || ' years of experience in backend.'
   WHEN 1 THEN 'Experience: ' || (c_custkey % 40) || ' years' ELSE 'I love coding.' END,
  CASE WHEN c_custkey % 6 = 5 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Employment History'
   ELSE 'Work Experience' END,
  'Acme Corp - Lead Engineer', 'Northbeam Labs 2019',
  ['• Built Node.js services. Scaled Node.js apps. Node.js on-call! Managed Kubernetes clusters; k8s daily. Used TypeScript. AWS and React.',
   '• Built Express APIs. Some TypeScript.',
   '• Maintained PHP sites in C++ and C++11.'][c_custkey % 3 + 1],
  'Skills', ['Node.js, React, AWS.', 'TypeScript, Docker.', 'PHP, MySQL.'][c_custkey % 3 + 1],
  'Education', ['B.Sc. Computer Science, Technion, 2019', 'MSc in Physics', 'Ph.D Engineering',
   'Self-taught'][c_custkey % 4 + 1]) END AS raw_text FROM customer)"""


def matches(cvs: str, reqs: str) -> str:
    """kw: one row per (CV, requirement) with its matched sentences and raw score."""
    terms = f"[n FOR n IN [{normalize('k')} FOR k IN list_concat(keywords, synonyms)] IF n <> '']"
    return f"""sent AS (SELECT cv_id, job_position_id, u.pos, sentences[u.pos] AS sentence,
 {normalize('sentences[u.pos]')} AS norm
 FROM {cvs}, LATERAL (SELECT unnest(generate_series(1, len(sentences))) AS pos) u),
terms AS (SELECT job_position_id, requirement_id, unnest({terms}) AS needle FROM {reqs}),
hit AS (SELECT DISTINCT s.cv_id, t.requirement_id, s.pos, s.sentence FROM sent s
 JOIN terms t ON s.job_position_id = t.job_position_id AND {boundary('s.norm', 't.needle')}),
hits AS (SELECT cv_id, requirement_id, count(*) AS n, list(sentence ORDER BY pos) AS matched
 FROM hit GROUP BY ALL),
kw AS (SELECT c.cv_id, c.job_position_id, r.req_pos, r.requirement_id, r.text, r.weight, r.is_required,
 coalesce(h.matched, []) AS matched_sentences, coalesce(h.n, 0) AS n,
 CASE WHEN coalesce(h.n, 0) = 0 THEN 0.0::DOUBLE WHEN h.n >= 3 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS score
 FROM {cvs} c JOIN {reqs} r USING (job_position_id)
 LEFT JOIN hits h ON h.cv_id = c.cv_id AND h.requirement_id = r.requirement_id),
bare AS (SELECT cv_id, job_position_id FROM {cvs} WHERE job_position_id IS NULL
 OR job_position_id NOT IN (SELECT job_position_id FROM {reqs}))"""


def tier(score: str, missing: str, total: str, great: int, good: int, ratio: str) -> str:
    return (
        f"CASE WHEN {total} > 0 AND {missing} >= ceil({total} * {ratio}::DOUBLE) THEN 'no-match' "
        f"WHEN {missing} = 0 AND {score} >= {great} THEN 'great' WHEN {score} >= {good} THEN 'good' "
        "ELSE 'no-match' END"
    )


WEIGHT = "(weight * CASE WHEN is_required THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)"

JUDGED = f"""agg AS (SELECT cv_id, job_position_id,
 sum(score * {WEIGHT}) / sum({WEIGHT}) * 100 AS preliminary_score,
 count(*) FILTER (WHERE is_required AND score = 0) AS missing_required,
 count(*) FILTER (WHERE is_required) AS total_required FROM kw GROUP BY ALL),
judged AS (SELECT *, {tier('preliminary_score', 'missing_required', 'total_required', 70, 40, '0.6')} AS tier FROM agg),
screened AS (SELECT *, CASE WHEN tier <> 'no-match' THEN NULL
 WHEN total_required > 0 AND missing_required >= ceil(total_required * 0.6::DOUBLE)
 THEN 'Missing ' || missing_required || ' of ' || total_required || ' required requirements'
 ELSE 'Score too low (' || {one_decimal('preliminary_score')} || '/100)' END AS elimination_reason FROM judged
 UNION ALL SELECT cv_id, job_position_id, 0.0::DOUBLE, 0, 0, 'no-match', 'Not screened: no requirements' FROM bare)"""

JOBS = """jobs AS (SELECT o_orderkey AS job_position_id, o_custkey AS user_id,
 'Position ' || o_orderpriority AS title,
 ['CREATED', 'EXTRACTING_REQUIREMENTS', 'REQUIREMENTS_EXTRACTED', 'PROCESSING', 'COMPLETED',
  'FAILED'][o_orderkey % 6 + 1] AS status,
 CASE o_orderkey % 6 WHEN 3 THEN ['parsing', 'filtering', 'scoring', 'generating'][(o_orderkey // 6) % 4 + 1]
  WHEN 4 THEN 'completed' WHEN 5 THEN 'failed' END AS current_stage,
 (o_orderkey % 9)::INT AS total_cvs, (o_orderkey % 5)::INT AS processed_cvs,
 (o_orderkey % 4)::INT AS great_match_count, (o_orderkey % 3)::INT AS good_match_count,
 (o_orderkey % 2)::INT AS no_match_count, o_totalprice / 1e6 AS ai_cost_usd,
 o_orderdate AS created_at, o_orderdate + to_minutes((o_orderkey % 1440)::INT) AS updated_at FROM orders)"""

CVS = """cvs AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cv_id,
 l_orderkey AS job_position_id,
 'CV_' || l_suppkey || '_' || l_returnflag || CASE WHEN l_partkey % 2 = 0 THEN '.pdf' ELSE '.TXT' END AS original_filename,
 ['great', 'good', 'no-match', 'good', NULL][l_partkey % 5 + 1] AS tier,
 CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 2 END AS final_score,
 CASE WHEN l_partkey % 5 = 2 THEN 'Score too low' END AS elimination_reason,
 CASE WHEN l_partkey % 13 = 0 THEN 'failed' WHEN l_partkey % 3 = 0 THEN 'low' ELSE 'high' END AS parsing_confidence,
 (l_suppkey % 30)::INT AS years_of_experience, l_tax AS ai_cost_usd,
 CASE WHEN l_partkey % 2 = 0 THEN 'gpt-5.1' END AS ai_model_used FROM lineitem)"""

COUNTS = """counts AS (SELECT job_position_id, count(*) FILTER (WHERE tier = 'great') AS great,
 count(*) FILTER (WHERE tier = 'good') AS good,
 count(*) FILTER (WHERE tier IS NULL OR tier NOT IN ('great', 'good')) AS no_match,
 count(*) AS total FROM cvs GROUP BY 1)"""

EVENTS = """progress AS (SELECT user_id AS job_position_id, event_id AS seq, ts,
 CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'filtering' WHEN 'purchase' THEN 'scoring'
  WHEN 'signup' THEN 'completed' ELSE 'failed' END AS stage,
 (event_id % 50)::INT AS processed, 50 AS total FROM events)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
