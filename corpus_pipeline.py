"""The corpus pipeline: quality rules, line dedup, near-duplicate dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns the columns of documents; the
last returns packed pieces. Every hand-over is written as Parquet and read again, so a lost executor costs a stage at
most. A stage's own tables are deleted when the next stage begins, as its result has been written by then; what ``docs``
reads is never deleted. Quality rules and near-duplicate dedup drop documents; line and substring dedup shorten texts and
drop none.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrashift.llm import lines, minhash, packing, quality, spans
from terrashift.llm.common import recording, release, stage, sweep

_STAGED = threading.local()


def _left() -> list[DataFrame]:
    """Tables that this thread's stages have written and not deleted."""
    if not hasattr(_STAGED, "tables"):
        _STAGED.tables = []
    return _STAGED.tables


def _tidy(step: Callable) -> Callable:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(_left(), docs)
        with recording(_left()):
            return step(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", _tidy(quality.stage_quality)),
    ("line_dedup", _tidy(lines.stage_lines)),
    ("minhash_dedup", _tidy(minhash.stage_minhash)),
    ("span_dedup", _tidy(spans.stage_spans)),
    ("packing", _tidy(packing.stage_packing)),
]

#: No SQL can express a tokenizer or the covariance steps; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, handed = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        # What the stage has read is not needed any more.
        release(*handed)
        handed = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)
    # The result reads the packed ids alone; a hand-over that it still read would stay.
    sweep(handed, out)
    return out
