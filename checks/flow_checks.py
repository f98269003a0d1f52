"""The screening flow up to the model, as the continuous intake runs it, over every template CV."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from checks.scoring_checks import RESUMES
from checks.text_checks import ROUTED_SQL
from shortlist.plans.screening import screen_texts


@check(
    "t1_screen_texts",
    sql.with_(*RESUMES, f"routed AS (SELECT *, {ROUTED_SQL} AS format, length(raw_text) AS n FROM template_base)")
    + """SELECT cv_id, s.job_position_id, CASE WHEN format = 'unsupported' THEN 'failed'
      WHEN format = 'pdf' AND length(regexp_replace(raw_text, '[^a-zA-Z]', '', 'g')) / n::DOUBLE < 0.6::DOUBLE THEN 'low'
      ELSE 'high' END AS parsing_confidence,
     CASE WHEN format = 'unsupported' THEN 'no-match' ELSE tier END AS tier,
     CASE WHEN format = 'unsupported' THEN 0 ELSE round(preliminary_score, 6) END AS final_score,
     CASE WHEN format = 'unsupported' THEN 'Could not read file: Unsupported file type: ' || mime_type || ' / ' || original_filename
      ELSE elimination_reason END AS elimination_reason
    FROM screened s JOIN routed USING (cv_id)""",
)
def t1_screen_texts(spark, sf):
    rows = screen_texts(inputs.template_cvs(spark, sf), inputs.demo_requirements(spark))
    return rows.select(
        "cv_id", "job_position_id", "parsing_confidence", "tier", F.round("final_score", 6).alias("final_score"), "elimination_reason"
    )
