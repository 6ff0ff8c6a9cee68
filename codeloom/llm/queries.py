"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_byte_bpe
from .exact import ORACLE_SQL as EXACT_SQL
from .exact import op10_exact_dedup
from .htmltree import op5_html_text
from .matroska import op8_matroska
from .merkle import ORACLE_SQL as MERKLE_SQL
from .merkle import op11_merkle_manifest
from .packing import op3_packing
from .records import op2_token_records
from .shards import op13_shards
from .simhash import op6_simhash
from .suffix import op7_suffix_dedup
from .toxicity import op1_toxicity
from .trie import ORACLE_SQL as TRIE_SQL
from .trie import op12_prefix_trie
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op4_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_records": op2_token_records,
    "op3_packing": op3_packing,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_html_text": op5_html_text,
    "op6_simhash": op6_simhash,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_matroska": op8_matroska,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_shards": op13_shards,
}

ORACLES: dict[str, str] = {"op4_warc_revisits": WARC_SQL, "op10_exact_dedup": EXACT_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_prefix_trie": TRIE_SQL}
