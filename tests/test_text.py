"""Redaction, sentences, sections and entities on hand-made strings."""

import random

import pytest
from pyspark.sql import functions as F

from shortlist.functions import entities, fixed, redaction
from shortlist.functions.sections import section_positions, section_slices
from shortlist.functions.text import (
    boundary_match, js_trim, normalize, one_decimal, round_half_up, split_sentences, utf16_length,
)
from shortlist.operators import parsing


@pytest.mark.parametrize(
    "text, gone, kept",
    [
        ("Contact me at jo.do@example.org for details", "jo.do@example.org", "[EMAIL]"),
        ("Call me at +1 (415) 555-0172", "555-0172", "[PHONE]"),
        ("Ticket 12345678 closed", "12345678", "[PHONE]"),
        ("Portfolio: https://portfolio.example/dev", "portfolio.example", "[URL]"),
        ("Jane Roe\nSenior Engineer", "Jane Roe", "[NAME]"),
        ("Senior Backend Engineer\nmore 1", "Senior Backend", "[NAME]"),
        ("Date of birth: 01/01/1990\nx1", "1990", "[PERSONAL_DATA]"),
        ("DOB: 12/03/1988\nx1", "1988", "[PERSONAL_DATA]"),
        ("born on: 1.2.1990\nx1", "1990", "[PERSONAL_DATA]"),
        ("Age: 34\nSenior", "34", "[PERSONAL_DATA]"),
        ("éage: 34\nx", "34", "[PERSONAL_DATA]"),
        ("Jane Roe 2 (he/him)\nx", "he/him", "Jane Roe 2"),
        ("Contact:\n123 Main Street, Apt 4\nx", "123 Main Street", "[ADDRESS]"),
        ("Address: 99 Fake Ave, Town\nx", "Fake Ave", "[ADDRESS]"),
        ("We address performance issues.", "performance", "[ADDRESS]"),
        ("x1 (she/they)", "she/they", "x1 (s"),
    ],
)
def test_redaction(value, text, gone, kept):
    result = value(redaction.redact_text, text)
    assert gone not in result and kept in result


@pytest.mark.parametrize(
    "text",
    [
        "EXPERIENCE\nBuilt Kubernetes tooling in Go over five years.",
        "This is a much longer first line that nobody would take for a name because it exceeds sixty characters\nx",
        "Engineer 2024 Edition\nExperience at Acme",
        "Single",
        "a manage: 34 b1",
        "",
    ],
)
def test_redaction_leaves_alone(value, text):
    assert value(redaction.redact_text, text) == text


def test_name_line_rules(value):
    assert value(redaction.redact_name, " \n\t\n  Ada Byron \nx") == " \n\t\n[NAME]\nx"
    assert value(redaction.redact_name, "Ada Byron") == "[NAME]"
    assert value(redaction.redact_name, "one two three four five\nx").startswith("one")
    sixty, under = " ".join(["a" * 29, "b" * 30]), " ".join(["a" * 29, "b" * 29])
    assert value(redaction.redact_name, sixty + "\nx").startswith("aaa")
    assert value(redaction.redact_name, under + "\nx") == "[NAME]\nx"
    assert value(redaction.redact_name, "Jean-Luc O'Neil\r\nx") == "[NAME]\nx"


def test_redaction_leaves_no_mail_or_url(spark):
    rng = random.Random(5)
    pieces = ["a@b.co", "http://x.y/z", "mail", "\n", " ", "https://q", "u.v@w.xyz", "text.", "12345678"]
    rows = [("".join(rng.choice(pieces) for _ in range(12)),) for _ in range(200)]
    out = redaction.redact(spark.createDataFrame(rows, "raw_text string"))
    left = F.rlike("anonymized_text", F.lit(fixed.EMAIL_PATTERN)) | F.rlike("anonymized_text", F.lit(r"https?://\S"))
    assert out.where(left).count() == 0


def test_sentences(value):
    assert value(split_sentences, "Built Node.js services. Managed Kubernetes! Deployed to AWS?") == [
        "Built Node.js services.", "Managed Kubernetes!", "Deployed to AWS?"]
    assert value(split_sentences, "One line\nTwo lines") == ["One line", "Two lines"]
    assert value(split_sentences, "• Built APIs ▪ Scaled clusters · Mentored team") == [
        "Built APIs", "Scaled clusters", "Mentored team"]
    assert value(split_sentences, "I\nGo\nC#\nSQL\n   abc　") == ["SQL", "abc"]
    assert value(split_sentences, "\n\n  \n") == [] and value(split_sentences, "") == []
    assert value(split_sentences, "😀a\nab") == ["😀a"]


def test_small_helpers(value):
    assert value(js_trim, " \t x \n﻿") == "x"
    assert value(utf16_length, "a😀é") == 4
    assert value(normalize, "  CI-CD\t Pipe--line ") == "ci cd pipe line"
    number = lambda helper: lambda c: helper(c.cast("double"))
    assert [value(number(one_decimal), x) for x in ("0.35", "6.25", "0", "38.04", "100")] == [
        "0.4", "6.3", "0.0", "38.0", "100.0"]
    assert [value(number(round_half_up), x) for x in ("2.5", "2.4", "0")] == [3, 2, 0]


def _loop_match(haystack, needle):
    """Plain scan over every occurrence."""
    if not needle:
        return False
    word = "abcdefghijklmnopqrstuvwxyz0123456789"
    for at in range(len(haystack) - len(needle) + 1):
        if haystack[at:at + len(needle)] == needle:
            before = haystack[at - 1] if at else " "
            after = haystack[at + len(needle)] if at + len(needle) < len(haystack) else " "
            if before not in word and after not in word:
                return True
    return False


def test_boundary_match_equals_plain_scan(spark):
    rng = random.Random(7)
    alphabet = "ab1 .+#-é_\\E$("
    rows = []
    for _ in range(3000):
        hay = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))).lower()
        needle = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 3))).lower()
        rows.append((hay, needle, _loop_match(hay, needle)))
    for hay, needle in (("asp.net", ".net"), ("use .net now", ".net"), ("c++ dev", "c++"), ("xa a a", "a a")):
        rows.append((hay, needle, _loop_match(hay, needle)))
    frame = spark.createDataFrame(rows, "h string, n string, want boolean")
    assert frame.where(boundary_match(F.col("h"), F.col("n")) != F.col("want")).count() == 0


def _sections(spark, text):
    frame = spark.createDataFrame([(1, text)], "cv_id int, raw_text string")
    return parsing.detect_sections(frame).first()["sections"].asDict()


def test_sections(spark):
    flat = _sections(spark, "  A flat block with no headers. ")
    assert flat["other"] == "  A flat block with no headers. " and flat["skills"] == ""
    text = "Dropped line\nProfile\nShips things.\n\nEMPLOYMENT history\nWidget Co\n\nCompetencies\nSQL\nEducation\nBSc 😀"
    found = _sections(spark, text)
    assert found == {
        "summary": "Profile\nShips things.", "experience": "EMPLOYMENT history\nWidget Co",
        "skills": "Competencies\nSQL", "education": "Education\nBSc 😀", "other": "",
    }


def test_first_pattern_wins_over_earlier_position(spark):
    found = _sections(spark, "Employment\nA\nExperience\nB")
    assert found["experience"] == "Experience\nB"


def test_position_counts_code_points(spark, value):
    positions = section_positions(F.col("t"))
    assert value(lambda c: positions["skills"], "😀😀\nSkills") == 2
    assert value(lambda c: section_slices(c, section_positions(c))["skills"], "😀😀\nSkills") == "Skills"


@pytest.mark.parametrize(
    "text, years",
    [
        ("I have 5+ years of experience", 5), ("7 years in backend", 7), ("I love coding", 0),
        ("61 years of experience", 0), ("61 years of experience and 4 years in ops", 4),
        ("99999999999 years of experience", 0), ("Experience: 12 years", 12),
    ],
)
def test_years(value, text, years):
    assert value(entities.years_of_experience, text) == years


def test_technologies(value):
    assert value(entities.technologies, "KUBERNETES pro, Node.js and React.") == ["react", "node.js", "kubernetes"]
    assert value(entities.technologies, "C++ developer") == []
    assert value(entities.technologies, "C++11 and éjava, google cloud, javascript") == [
        "javascript", "java", "c++", "google cloud"]
    assert value(entities.technologies, "Postgres; postgresql; rest-api; c++go") == [
        "go", "c++", "postgres", "postgresql", "rest"]


def test_one_pass_dictionary_equals_single_terms(spark):
    """The one-pattern search must find what one search per term would."""
    rng = random.Random(11)
    glue = [" ", "", ".", "+", "#", "1", "é", "_", "-"]
    rows = [("".join(rng.choice(fixed.TECHNOLOGIES) + rng.choice(glue) for _ in range(6)),) for _ in range(400)]
    escape = lambda t: "".join("\\" + c if c in ".+#" else c for c in t)
    single = F.array_compact(F.array(*[
        F.when(F.rlike("t", F.lit(fixed.java_pattern(f"~b{escape(t)}~b"))), F.lit(t)) for t in fixed.TECHNOLOGIES
    ]))
    frame = spark.createDataFrame(rows, "t string")
    assert frame.where(entities.technologies(F.col("t")) != single).count() == 0


def test_degrees_companies_roles(value):
    assert value(entities.degrees, "B.Sc Computer Science, then PhD in Physics") == ["B.Sc Computer Science", "PhD in"]
    section = "Experience\nAcme Corp - Lead Engineer\nNorthbeam Labs 2019\nAcme Corp | Senior Backend Developer"
    assert value(entities.companies, section) == ["Experience", "Acme Corp", "Northbeam Labs"]
    assert value(entities.roles, section) == ["lead engineer", "senior backend developer"]
