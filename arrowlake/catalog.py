"""All registered queries outside ``arrowlake.llm`` with their SQL twins."""

from __future__ import annotations

from .queries import boxes, datasets, graphs, metrics, prep, quality, repair, sources, text, tracks, transcripts, video, streams  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
