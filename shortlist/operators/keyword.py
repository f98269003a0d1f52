"""Keyword stage: weighted requirement matching of CV sentences.

Jobs with long term lists are looked up by token (see `token_index`), the others term by term.

Two forms give the same answers. `keyword_filter` keeps a CV on one row from end to end: the
job's requirements are looked up once and matched inside the row, so no sentence is exploded,
shuffled or grouped, whatever the size of a job. `match_sentences` and `collect_matches` are the
long form for callers that want one row per hit. `keyword_verdicts` is for callers that want verdicts
only: a long list then costs a CV no entry per requirement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.cluster import salted_lookup
from shortlist.functions import fixed
from shortlist.functions.text import boundary_match, boundary_pattern, normalize
from shortlist.operators import token_index
from shortlist.operators.scoring import (
    assign_tier,
    elimination_reason,
    keyword_missing,
    missing_required_of,
    raw_score,
    required_count_of,
    weighted_score_of,
)


def _needle_list() -> Column:
    normalized = F.transform(F.concat("keywords", "synonyms"), normalize)
    return F.filter(normalized, lambda n: n != "")


def needles(reqs: DataFrame) -> DataFrame:
    """One row per non-blank search term of each requirement, keywords before synonyms."""
    listed = reqs.select(
        "job_position_id", "req_pos", "requirement_id", F.posexplode(_needle_list())
    )
    return listed.withColumnRenamed("pos", "needle_pos").withColumnRenamed("col", "needle")


def _with_patterns(reqs: DataFrame) -> DataFrame:
    """Requirement rows carrying their terms with the boundary regex of each, built once."""
    return reqs.withColumn(
        "needles",
        F.transform(
            _needle_list(),
            lambda n: F.struct(n.alias("needle"), boundary_pattern(n).alias("pattern")),
        ),
    )


def requirement_lists(reqs: DataFrame) -> DataFrame:
    """One row per job with its ordered requirement list, terms included, and `requirement_gate`:
    malformed when an entry lacks its id, keyword list or synonym list."""
    broken = F.col("requirement_id").isNull() | F.col("keywords").isNull() | F.col("synonyms").isNull()
    item = F.struct(
        "req_pos", "requirement_id", "text", "weight", "is_required", "needles"
    )
    return (
        _with_patterns(reqs)
        .groupBy("job_position_id")
        .agg(
            F.array_sort(F.collect_list(item)).alias("requirements"),
            F.when(F.bool_or(broken), fixed.MALFORMED).otherwise(fixed.GATE_OK).alias("requirement_gate"),
        )
    )


def _any_needle(norm: Column, terms: Column) -> Column:
    return F.exists(terms, lambda n: boundary_match(norm, n["needle"], n["pattern"]))


def match_sentences(sentences: DataFrame, reqs: DataFrame) -> DataFrame:
    """Sentence x requirement theta join: equal job, any term matching.

    Terms stay an array on the requirement row, so a sentence meets each requirement of its job
    once and no duplicate hits arise that a distinct would have to remove. With long lists, sentences
    meet terms through their tokens instead; (cv_id, pos) is then the sentences' key.
    """
    terms = needles(reqs)
    if token_index.is_long(terms):
        return token_index.match_by_token(sentences, terms)
    lookup = _with_patterns(reqs).select("job_position_id", "req_pos", "requirement_id", "needles")
    prepared = sentences.withColumn("_norm", normalize(F.col("sentence")))
    joined = salted_lookup(
        prepared, lookup, ["job_position_id"], ["cv_id", "pos"], bounded_by=reqs
    )
    return joined.where(_any_needle(F.col("_norm"), F.col("needles"))).select(
        "cv_id", "job_position_id", "req_pos", "requirement_id", "pos", "sentence"
    )


def collect_matches(hits: DataFrame) -> DataFrame:
    """Matched sentences per (CV, requirement) in document order, repeats kept."""
    return hits.groupBy("cv_id", "job_position_id", "req_pos", "requirement_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda h: h["sentence"]
        ).alias("matched_sentences")
    )


def _with_norms(cvs: DataFrame) -> DataFrame:
    return cvs.withColumn("_norms", F.transform("sentences", normalize))


def _usable(lists: DataFrame) -> DataFrame:
    return lists.where((F.col("requirement_gate") == fixed.GATE_OK) & F.col("job_position_id").isNotNull())


def score_requirements(cvs: DataFrame, reqs: DataFrame) -> DataFrame:
    """Add `scored`: per requirement, in list order, its matched sentences and raw score; and
    `requirement_gate`: ok, or why the job's list cannot be used (then `scored` is empty).

    In a short list, terms absent from the whole document are dropped with one substring test each
    before the sentence loop; in a long one, a sentence only meets terms filed under its tokens.
    Normalised sentences are computed below the join, once per CV.
    """
    lists, long = requirement_lists(reqs), token_index.is_long(needles(reqs))
    if long:
        cvs = token_index.match_in_groups(_with_norms(cvs), _usable(lists), placed=True).drop("_norms")
    prepared = cvs if long else cvs.withColumn(
        "_pairs",
        F.transform("sentences", lambda s: F.struct(s.alias("sentence"), normalize(s).alias("norm"))),
    ).withColumn(
        "_all", F.array_join(F.transform("_pairs", lambda p: p["norm"]), "\n")
    )
    joined = salted_lookup(
        prepared, lists, ["job_position_id"], ["cv_id"], "left", bounded_by=reqs
    )
    gate = F.coalesce("requirement_gate", F.lit(fixed.NO_REQUIREMENTS))
    none = F.array().cast(joined.schema["requirements"].dataType)
    usable = F.when(gate == fixed.GATE_OK, F.col("requirements")).otherwise(none)
    joined = joined.withColumns({"requirement_gate": gate, "requirements": usable})

    def live(r: Column) -> Column:
        return r.withField(
            "needles", F.filter(r["needles"], lambda n: F.contains(F.col("_all"), n["needle"]))
        )

    def tried(r: Column) -> Column:
        hits = F.filter(F.col("_pairs"), lambda p: _any_needle(p["norm"], r["needles"]))
        return F.transform(hits, lambda p: p["sentence"])

    def entry(r: Column, matched: Column) -> Column:
        return F.struct(
            r["req_pos"].alias("req_pos"),
            r["requirement_id"].alias("requirement_id"),
            r["text"].alias("text"),
            r["weight"].alias("weight"),
            r["is_required"].alias("is_required"),
            F.when(F.size(r["needles"]) > 0, matched).otherwise(F.array().cast("array<string>")).alias("matched_sentences"),
        )

    def with_score(r: Column) -> Column:
        return r.withField("score", raw_score(F.size(r["matched_sentences"])))

    if long:
        placed = lambda at: F.transform(F.get("_placed", at), lambda p: F.get("sentences", p))
        listed = F.transform("requirements", lambda r, at: entry(r, placed(at)))
    else:
        listed = F.transform(F.transform("requirements", live), lambda r: entry(r, tried(r)))
    scored = F.transform(listed, with_score)
    # Exploding a one-element array pins the result: a later filter on score or tier would otherwise
    # be pushed below this step with the whole matching copied into it, several times over.
    pinned = joined.select("*", F.explode(F.array(scored)).alias("scored"))
    return pinned.drop("_pairs", "_all", "requirements", "_placed")


def keyword_scores_map(scored: Column) -> Column:
    """Requirement id to (matched sentences, raw score); of entries with one id the last counts."""

    def last_of_id(entry: Column, at: Column) -> Column:
        later = F.slice(F.transform(scored, lambda r: r["requirement_id"]), at + 2, F.size(scored))
        return ~F.coalesce(F.array_contains(later, entry["requirement_id"]), F.lit(False))

    return F.map_from_entries(
        F.transform(
            F.filter(scored, last_of_id),
            lambda r: F.struct(
                r["requirement_id"].alias("key"),
                F.struct(
                    r["matched_sentences"].alias("matched_sentences"),
                    r["score"].alias("raw_score"),
                ).alias("value"),
            ),
        )
    )


def judge(scored: DataFrame) -> DataFrame:
    """Score, missing count, tier and reason from `scored` and `requirement_gate`. Without a usable
    requirement list the score is 0, the tier no-match, and the reason says so."""
    return _tiered(
        scored.select(
            "*",
            weighted_score_of(F.col("scored")).alias("preliminary_score"),
            missing_required_of(F.col("scored"), keyword_missing).alias("missing_required"),
            required_count_of(F.col("scored")).alias("total_required"),
        )
    )


def _tiered(counted: DataFrame) -> DataFrame:
    facts = [F.col(c) for c in ("preliminary_score", "missing_required", "total_required")]
    tiered = counted.withColumn("tier", assign_tier(*facts, fixed.KEYWORD_THRESHOLDS))
    return tiered.withColumn(
        "elimination_reason",
        F.when(
            F.col("requirement_gate") != fixed.GATE_OK, F.concat(F.lit("Not screened: "), "requirement_gate")
        ).otherwise(
            elimination_reason(
                F.col("tier"), F.col("missing_required"), F.col("total_required"), F.col("preliminary_score")
            )
        ),
    )


def keyword_filter(cvs: DataFrame, reqs: DataFrame) -> DataFrame:
    """Whole keyword stage over (cv_id, job_position_id, sentences, ...). Every CV gets a verdict, those
    of jobs without a usable requirement list included."""
    return judge(score_requirements(cvs, reqs))


def keyword_verdicts(cvs: DataFrame, reqs: DataFrame) -> DataFrame:
    """The verdicts of `keyword_filter` without `scored`."""
    if not token_index.is_long(needles(reqs)):
        return keyword_filter(cvs, reqs).drop("scored")
    lists = requirement_lists(reqs)
    matched = token_index.match_in_groups(_with_norms(cvs), _usable(lists), placed=False).drop("_norms")
    gates = lists.select("job_position_id", "requirement_gate")
    gated = salted_lookup(matched, gates, ["job_position_id"], ["cv_id"], "left")
    score = F.when(F.col("_all") == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide("_hit", "_all") * 100, F.lit(0.0)))
    counted = gated.withColumns(
        {
            "requirement_gate": F.coalesce("requirement_gate", F.lit(fixed.NO_REQUIREMENTS)),
            "preliminary_score": score,
            "missing_required": F.col("_missing"),
            "total_required": F.col("_required"),
        }
    )
    return _tiered(counted.drop("_hit", "_all", "_missing", "_required"))


def score_rows(scored: DataFrame) -> DataFrame:
    """Long form of `scored`, one row per (CV, requirement)."""
    return scored.select("cv_id", "job_position_id", F.inline("scored"))
