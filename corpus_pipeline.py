"""From raw documents to sharded training data, in five stages; see skein.llm.pipeline."""

from skein.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
