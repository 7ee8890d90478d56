"""Functions for SQL: the engine's expressions under names of their own in a session, and a table function for chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession, functions as F

from lectern.functions import fixed

_CODES = f"transform(regexp_extract_all(t, r'(?U){fixed.CODE}', 0), c -> regexp_replace(c, r'(?U)^([A-Z]+)\\s*', '$1 '))"

#: name: (parameters, type, body)
FUNCTIONS = {
    "course_codes": ("t STRING", "ARRAY<STRING>", _CODES),
    "citations": ("t STRING", "ARRAY<STRING>", f"transform(regexp_extract_all(t, r'{fixed.CITATION}', 1), c -> trim(c))"),
    "reciprocal_rank": ("found ARRAY<STRING>, relevant ARRAY<STRING>", "DOUBLE", "coalesce(1 / array_min(filter(transform(found, (x, i) -> CASE WHEN array_contains(relevant, x) THEN i + 1 END), i -> i IS NOT NULL)), 0D)"),
    "hit_rate": ("found ARRAY<STRING>, relevant ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_intersect(found, relevant)) > 0 THEN 1D ELSE 0D END"),
    "text_hash": ("t STRING", "STRING", "sha2(t, 256)"),
    "strip_markup": ("t STRING", "STRING", f"regexp_replace(regexp_replace(t, r'(?s){fixed.COMMENT}', ''), r'{fixed.TAG}', ' ')"),
}


def register(spark: SparkSession, prefix: str = "lectern_") -> list[str]:
    """Make FUNCTIONS and the table function <prefix>chunks(text, size, overlap, least) known to SQL; returns their names."""
    from lectern.functions.chunking import chunks_of

    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")

    class Chunks:
        def eval(self, text: str, size: int, overlap: int, least: int) -> Iterator[tuple[int, str]]:
            yield from enumerate(chunks_of(text, size, overlap, least))

    spark.udtf.register(f"{prefix}chunks", F.udtf(Chunks, returnType="chunk_index int, chunk string"))
    return [f"{prefix}{n}" for n in (*FUNCTIONS, "chunks")]
