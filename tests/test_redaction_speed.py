"""The guarded passes of the redaction find what the plain patterns find, in time that grows with the text."""

import random
import time

from pyspark.sql import functions as F

from shortlist.functions import fixed, redaction
from shortlist.functions.fixed import java_pattern


def plain(col):
    def replace(col, pattern, mark):
        return F.regexp_replace(col, java_pattern(pattern), mark)

    col = replace(col, fixed.EMAIL_PATTERN, "[EMAIL]")
    col = replace(col, fixed.PHONE_PATTERN, "[PHONE]")
    col = replace(col, fixed.URL_PATTERN, "[URL]")
    for pattern in fixed.ADDRESS_PATTERNS:
        col = replace(col, pattern, "[ADDRESS]")
    for pattern in fixed.BIRTH_PATTERNS:
        col = replace(col, "(?i)" + pattern, "[PERSONAL_DATA]")
    for tag in fixed.PRONOUN_TAGS:
        col = replace(col, rf"(?i)\(?{tag}\)?", "")
    return col


def test_same_matches_as_the_plain_patterns(spark):
    rng = random.Random(11)
    parts = [
        "a@b.com", "_x@c.org", "a@b.com_x@c.org", "@", "a@b", "x.y+z@q.co.uk", "..@a.bc", "+1 (415) 555-0123", "(", "+", "12345678", "555-1234-567",
        "https://a.b/c", "http://", "Http://x", "ADDRESS: 1 Main", "address", "12 Elm Street", "3 oak RD x", "DoB: 1/2/90", "Date Of Birth: 3.4.80",
        "BORN on: 12/3", "born 1990", "Age: 44", "page 3", "aGe 7", "(She/Her)", "she/they", "(HE/HIM", "they/them", "them/they", "É", "ſhe/her", "İ", "漢", "\n", " ", " ", "x", "-", "_",
    ]
    rows = [(i, None if i == 0 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(3000)]
    texts = spark.createDataFrame(rows, "i int, t string")
    got = texts.select("i", "t", redaction.redact_inline(F.col("t")).alias("got"), plain(F.col("t")).alias("want"))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []
    assert got.where("got <> t").count() > 2500


def test_a_long_run_of_letters_takes_no_squared_time(spark):
    texts = spark.createDataFrame([("a" * 150_000 + " x@y.zz",)], "t string")
    started = time.time()
    assert texts.select(redaction.redact_email(F.col("t")).alias("r")).first().r.endswith(" [EMAIL]")
    assert time.time() - started < 8


def test_quality_reads_and_moves_entries_once(spark):
    from shortlist.operators import inference

    entries = spark.createDataFrame(
        [(1, 0, "r1", 0.6, "a"), (1, 1, "r1", 0.3, "b"), (1, 2, None, 0.5, ""), (1, 3, None, 1.0, "a"), (9, 0, "r1", 0.0, None)],
        "cv_id int, pos int, requirement_id string, score double, evidence string",
    )
    reqs = spark.createDataFrame([("j", "r1")], "job_position_id string, requirement_id string")
    cvs = spark.createDataFrame([(1, "j", "xax")], "cv_id int, job_position_id string, anonymized_text string")
    flagged = inference.score_quality(entries, reqs, cvs)
    got = {(r.cv_id, r.pos): (r.repeated, r.requirement_known, r.cv_known, r.evidence_verbatim) for r in flagged.collect()}
    assert got == {
        (1, 0): (True, True, True, True), (1, 1): (True, True, True, False), (1, 2): (False, False, True, True),
        (1, 3): (False, False, True, True), (9, 0): (False, False, False, True),
    }
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("evidence#") > 0 and plan.count("LogicalRDD [cv_id") + plan.count("LocalRelation [cv_id") <= 3
