"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acrelight.llm import phrases, warc
from acrelight.llm.alignment import op12_alignment
from acrelight.llm.bpe import op4_bpe
from acrelight.llm.fingerprint import op7_fingerprints
from acrelight.llm.licenses import op8_licenses
from acrelight.llm.licenses import oracle as licenses_sql
from acrelight.llm.line_templates import op3_lines
from acrelight.llm.media import op2_media
from acrelight.llm.packing import op1_packing
from acrelight.llm.pii import op6_pii
from acrelight.llm.quality import op9_quality
from acrelight.llm.shingles import op10_jaccard
from acrelight.llm.suffixes import op5_suffixes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_media, op3_lines, op4_bpe, op5_suffixes, op6_pii, op7_fingerprints, op8_licenses, op9_quality, op10_jaccard, phrases.op11_collocations, op12_alignment, warc.op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op8_licenses": licenses_sql(), "op11_collocations": phrases.SQL, "op13_warc": warc.SQL}
