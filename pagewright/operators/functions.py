"""Extraction as a table function, for SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pagewright.functions import json_records as J
from pagewright.operators import extraction
from pagewright.sources.session import prepare_workers


def register(spark: SparkSession, tiers: Sequence[extraction.Tier] = extraction.CASCADE, name: str = "page_records") -> None:
    """Register a table function that runs the tiers on a page:

        SELECT page_id, r.* FROM pages, LATERAL page_records(url, html, content_type, 'name,price') AS r

    The last argument, a constant, names the fields; each is a column of the result, as text (JSON for what isn't a string), behind tier_used, confidence,
    rec_idx and record_json. Without fields these four are all. A page without records gives no rows; a null page is an empty one.
    """
    prepare_workers(spark)
    chosen = tuple(tiers)

    class PageRecords:
        @staticmethod
        def analyze(url: AnalyzeArgument, html: AnalyzeArgument, content_type: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
            if not fields.isConstantExpression:
                raise ValueError("the fields must be a constant, such as 'name,price'")
            out = StructType().add("tier_used", StringType()).add("confidence", DoubleType()).add("rec_idx", IntegerType()).add("record_json", StringType())
            for field in PageRecords.named(fields.value):
                out = out.add(field, StringType())
            return AnalyzeResult(schema=out)

        @staticmethod
        def named(fields: str | None) -> tuple[str, ...]:
            return tuple(dict.fromkeys(f.strip() for f in (fields or "").split(",") if f.strip()))

        def eval(self, url: str, html: str, content_type: str, fields: str) -> Iterator[tuple]:
            names = self.named(fields)
            page = extraction.Page(url or "", html or "", content_type or "", {}, {})
            records, tier, confidence = extraction.first_records(page, extraction.Options(names), chosen)
            for i, record in enumerate(records):
                values = record if isinstance(record, dict) else {}
                shown = [values.get(n) if isinstance(values.get(n), str) else None if values.get(n) is None else J.dumps(values[n]) for n in names]
                yield (tier, confidence, i, json.dumps(record, default=str), *shown)

    spark.udtf.register(name, udtf(PageRecords))
