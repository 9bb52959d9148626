"""All queries of the library outside the optional subpackages."""

from __future__ import annotations

from embervane.plans import curation, evaluation

QUERIES = {**evaluation.QUERIES, **curation.QUERIES}
SQL = {**evaluation.SQL, **curation.SQL}
FLAGSHIP = "label_retrieval"
