"""Repeated keys, glued personal data, odd file names and missing MIME types."""

from pyspark.sql import functions as F

from shortlist.functions.redaction import redact_birth
from shortlist.operators.keyword import keyword_scores_map
from shortlist.operators.lifecycle import override_tiers
from shortlist.operators.parsing import outcome_reason
from shortlist.sources.files import read_cv_files


def test_birth_data_in_list_order(value):
    assert value(redact_birth, "born 12/03/1990age: 34 x") == "[PERSONAL_DATA][PERSONAL_DATA] x"
    assert value(redact_birth, "dob: 1/1/1990born 1990 y") == "[PERSONAL_DATA][PERSONAL_DATA] y"


def test_file_names_as_they_are(spark, tmp_path):
    names = {"C++ dev.txt", "100% fit.txt", "a#b é.txt"}
    for n in names:
        (tmp_path / n).write_text("x")
    assert {r.filename for r in read_cv_files(spark, str(tmp_path)).collect()} == names


def test_unsupported_file_without_mime_type(spark):
    frame = spark.createDataFrame([("unsupported", None, "x.rtf", None, "high", None)], "format string, mime_type string, original_filename string, read_error string, parsing_confidence string, parse_error string")
    assert "Unsupported file type" in outcome_reason(frame).first().failure_reason


def test_repeated_overrides_and_unknown_tiers(spark):
    cvs = spark.createDataFrame([(1, "a", "good", None), (2, "a", "good", None)], "cv_id long, job_position_id string, tier string, elimination_reason string")
    given = spark.createDataFrame([(1, "a", "great", 1), (1, "a", "no-match", 2), (2, "a", "superb", 1)], "cv_id long, job_position_id string, new_tier string, seq int")
    changed, rejected = override_tiers(cvs, given)
    assert sorted((r.cv_id, r.tier) for r in changed.collect()) == [(1, "no-match"), (2, "good")]
    assert [r.new_tier for r in rejected.collect()] == ["superb"]


def test_repeated_requirement_ids(spark):
    frame = spark.sql("SELECT array(named_struct('requirement_id', 'r', 'matched_sentences', array('x'), 'score', 0.5D), named_struct('requirement_id', 'r', 'matched_sentences', array('y'), 'score', 1.0D)) AS s")
    found = frame.select(keyword_scores_map(F.col("s")).alias("m")).first().m
    assert found["r"].raw_score == 1.0 and len(found) == 1
