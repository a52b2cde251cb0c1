"""All registered queries of the core and their SQL."""

from __future__ import annotations

from deponent.plans import evidence, problems, problems_sql, recording

QUERIES = {**evidence.QUERIES, **recording.QUERIES, **problems.QUERIES}
SQL = {**evidence.SQL, **recording.SQL, **problems_sql.SQL}
FLAGSHIP = "q_grounded_answer"
