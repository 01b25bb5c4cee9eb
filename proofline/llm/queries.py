"""The operators as queries over the tables of a folder: QUERIES by name, and SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, extract, fim, kdtree, licenses, pieces, quality, records, rules, simhash, toxicity, turns, urls

Query = Callable[[SparkSession, str], DataFrame]


def _over(f: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": _over(decontam.op1, "documents", "benchmark"),
    "op2_toxicity": _over(toxicity.op2, "documents", "labels"),
    "op3_sentencepiece": _over(pieces.op3, "documents"),
    "op4_url_filter": _over(urls.op4, "pages"),
    "op5_top_k": _over(kdtree.op5, "embeddings"),
    "op6_main_text": _over(extract.op6, "pages"),
    "op7_simhash": _over(simhash.op7, "documents"),
    "op8_token_records": _over(records.op8, "documents"),
    "op9_licenses": _over(licenses.op9, "documents"),
    "op10_quality": _over(quality.op10, "documents", "labels"),
    "op11_repair_turns": _over(turns.op11, "conversations"),
    "op12_fill_in_middle": _over(fim.op12, "documents"),
    "op13_quality_rules": _over(rules.op13, "documents"),
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontam.OP1_SQL,
    "op5_top_k": kdtree.OP5_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op11_repair_turns": turns.OP11_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_quality_rules": rules.OP13_SQL,
}
