"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import op13_centroids
from .ctw import op2_ctw
from .filters import op12_filters
from .html import op10_html
from .languages import op11_languages
from .lines import op3_lines, op3_links, op3_members
from .minhash import op9_minhash
from .oracles import ORACLES
from .packing import op7_packing
from .pieces import op5_pieces
from .quality import op8_quality
from .spans import op6_spans
from .tiff import op1_tiff
from .toxicity import op4_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tiff, op2_ctw, op3_lines, op3_links, op3_members, op4_toxicity, op5_pieces, op6_spans, op7_packing, op8_quality, op9_minhash, op10_html, op11_languages, op12_filters, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
