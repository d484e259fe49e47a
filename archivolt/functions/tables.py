"""Table functions for SQL: personal data of a text as rows, and the chunks of documents given as pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from archivolt.functions import fixed
from archivolt.operators import chunking

INT = IntegerType()
CHUNKS = StructType().add("document_id", LongType()).add("chunk_index", INT).add("content", StringType()).add("page_numbers", ArrayType(INT)).add("token_count", INT).add("edad", INT)


@udtf
class ChunkFold:
    """chunk_fold(TABLE(pages)): chunks of documents, pages having document_id, page, text and, if it is known, age.

    The rows of a document come together and in the order of their pages, as
    the function itself asks for; it holds one document at a time.
    """

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        names = {f.name for f in pages.dataType.fields} if pages.isTable else set()
        if missing := {"document_id", "page", "text"} - names:
            raise ValueError(f"chunk_fold takes a table with {', '.join(sorted(missing))}")
        return AnalyzeResult(schema=CHUNKS, partitionBy=[PartitioningColumn("document_id")], orderBy=[OrderingColumn("page")])

    def __init__(self):
        self.document, self.pages = None, []

    def eval(self, row: Row) -> None:
        self.document = row["document_id"]
        self.pages.append((row["page"], row["text"], row["age"] if "age" in row.__fields__ else None))

    def terminate(self) -> Iterator[tuple]:
        index = 0
        for text, numbers, age in chunking.groups(self.pages):
            for content, on, tokens in chunking.pack(text, numbers):
                yield self.document, index, content, on, tokens, age
                index += 1


def personal_data() -> str:
    """The definition of personal_data(text): kind, label and match of all personal data, kind after kind, in order of place."""
    kinds = ", ".join(
        f"named_struct('kind_order', {n}, 'kind', '{kind}', 'label', '{label}', 'matches', regexp_extract_all(s, r\"(?U){pattern}\", 0))" for n, (kind, pattern, label) in enumerate(fixed.PII)
    )
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION personal_data(s STRING) RETURNS TABLE (kind_order INT, kind STRING, label STRING, place INT, match STRING)
RETURN SELECT k.kind_order, k.kind, k.label, m.place, m.match FROM (SELECT inline(array({kinds})) AS (kind_order, kind, label, matches)) AS k, LATERAL (SELECT posexplode(k.matches) AS (place, match)) AS m"""


def register(spark: SparkSession) -> None:
    spark.sql(personal_data())
    spark.udtf.register("chunk_fold", ChunkFold)

