"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .boosting import op8_boosted_quality
from .bpe import op6_byte_bpe
from .forest import OP5_SQL, op5_forest
from .licenses import op7_licenses
from .packing import op10_packing
from .passages import OP3_SQL, op3_passages
from .pii import op1_pii
from .quality_rules import OP2_SQL, op2_quality_rules
from .secrets import op9_secrets
from .simhash import op4_simhash


def queries() -> dict:
    found = (op1_pii, op2_quality_rules, op3_passages, op4_simhash, op5_forest, op6_byte_bpe, op7_licenses, op8_boosted_quality, op9_secrets, op10_packing)
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op3_passages": OP3_SQL, "op5_forest": OP5_SQL}
