"""All queries of the library's core."""

from __future__ import annotations

from strandlake.plans import elements, files, methylation, quality

QUERIES = {**quality.QUERIES, **methylation.QUERIES, **elements.QUERIES, **files.QUERIES}
ORACLE = {**quality.ORACLE, **methylation.ORACLE, **elements.ORACLE, **files.ORACLE}
