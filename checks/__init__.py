"""Registered queries: each operator on the driver's tables, with independent SQL where SQL can say it."""

from checks import (  # noqa: F401
    corpus_checks,
    flow_checks,
    job_checks,
    keyword_checks,
    lifecycle_checks,
    progress_checks,
    requirement_checks,
    scoring_checks,
    text_checks,
    view_checks,
)
from checks.registry import ORACLES, QUERIES  # noqa: F401
