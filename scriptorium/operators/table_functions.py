"""Span generators as table functions of SQL: ``FROM texts t, LATERAL text_spans(t.text) s``.

register() makes them known to a session. ``text_spans`` gives a row for each capitalized span and for each code of
each word of three letters or more. ``first_rows`` takes a partitioned table and gives the first rows of each
partition in its order; it stops reading a partition as soon as it has them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException

from scriptorium.operators.fuzzy import candidates, spans_of
from scriptorium.operators.phonetic_join import coded, codes_of


class TextSpans:
    """span, start, capital, code: capitalized spans without a code, words with each of theirs."""

    def eval(self, text: str) -> Iterator[tuple]:
        if not text:
            return
        for span, start, capital in spans_of(text):
            if capital:
                yield span, start, True, None
            else:
                for code in sorted({c for _, *cs in codes_of(span) for c in cs if c}):
                    yield span, start, False, code


class FirstRows:
    """The first n rows of each partition, as they are, with their place."""

    @staticmethod
    def analyze(n: AnalyzeArgument, rows: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=StructType().add("place", IntegerType()).add("row", StringType()))

    def __init__(self):
        self.place = 0

    def eval(self, n: int, rows: Row) -> Iterator[tuple]:
        if self.place >= n:
            raise SkipRestOfInputTableException("all that was wanted of this partition")
        self.place += 1
        yield self.place, "|".join("" if v is None else str(v) for v in rows)


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_spans", F.udtf(TextSpans, returnType="span string, start bigint, capital boolean, code string"))
    spark.udtf.register("first_rows", F.udtf(FirstRows))


MATCH_SPANS = """
WITH found AS (SELECT t.{key} AS id, s.span, s.start, s.capital, s.code FROM {{texts}} t, LATERAL text_spans(t.text) s),
heard AS (
  SELECT id, span, start, false AS strict FROM found WHERE capital
  UNION ALL
  SELECT f.id, f.span, f.start, true FROM found f LEFT SEMI JOIN {{codes}} c ON f.code = c.code
),
spans AS (SELECT id, span, start, min(strict) AS strict FROM heard GROUP BY id, span, start)
"""


def match_spans(spark: SparkSession, texts: DataFrame, rows: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """What fuzzy.match_spans() gives, by SQL over the table functions: key, span, start, end, candidates."""
    register(spark)
    codes = coded(rows.select("form").distinct(), "form").select(F.explode("codes").alias("code")).distinct()
    body = MATCH_SPANS.format(key=key)
    asked = spark.sql(body + "SELECT DISTINCT span AS query FROM spans", texts=texts, codes=codes)
    return spark.sql(
        body
        + f"""SELECT s.id AS {key}, s.span, s.start, s.start + length(s.span) AS end, c.candidates FROM spans s
        JOIN (SELECT query, sort_array(collect_list(struct(place, entry_id, form, confidence, match_type))) AS candidates FROM {{best}} GROUP BY query) c ON c.query = s.span
        WHERE NOT s.strict OR c.candidates[0].confidence >= {least}""",
        texts=texts,
        codes=codes,
        best=candidates(asked, rows),
    )
