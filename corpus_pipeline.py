"""The corpus pipeline: documents through quality rules, near copies, secrets, mixing and encoding."""

from __future__ import annotations

from staylens.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
