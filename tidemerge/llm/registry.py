"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP7_SQL, op7_chat_format
from .langid import op9_language_id
from .mixing import OP2_SQL, op2_source_mixing
from .neardup import OP8_SQL, op8_near_duplicates
from .packing import op1_best_fit_packing
from .pii import op6_pii_boosted
from .quality import OP4_SQL, op4_line_quality
from .secret_scan import op10_secret_scan
from .urls import op5_url_filter
from .webp import op3_media_webp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_source_mixing, op3_media_webp, op4_line_quality, op5_url_filter, op6_pii_boosted, op7_chat_format, op8_near_duplicates, op9_language_id, op10_secret_scan)
}
SQL: dict[str, str] = {"op2_source_mixing": OP2_SQL, "op4_line_quality": OP4_SQL, "op7_chat_format": OP7_SQL, "op8_near_duplicates": OP8_SQL}
