"""All queries of the engine by name, with SQL for those that SQL can express."""

from __future__ import annotations

from quillstone.plans.corpus import corpus
from quillstone.plans.evaluation import evaluation
from quillstone.plans.study import study

QUERIES = corpus.queries | evaluation.queries | study.queries
SQL = corpus.sql | evaluation.sql | study.sql
