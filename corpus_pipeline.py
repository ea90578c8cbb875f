"""The five-stage pipeline of ``fieldloom.llm.pipeline``, where the driver looks for it."""

from fieldloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
