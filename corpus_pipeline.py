"""The corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

``STAGES`` lists the stages in their order, ``run(spark, sf_dir)`` applies them to ``documents``, each stage written and
read again. The stages themselves are in ``docframe.llm.pipeline``.
"""

from docframe.llm.pipeline import ORACLE_SQL, STAGES, language_id, ngram_join, packing, quality_rules, run

__all__ = ["ORACLE_SQL", "STAGES", "language_id", "ngram_join", "packing", "quality_rules", "run"]
