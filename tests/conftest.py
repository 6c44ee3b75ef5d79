import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from workload.check import session

    spark = session("4")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def make_corpus(spark):
    """Corpus of (path, body) rows; a dict adds or replaces file columns."""
    from pyspark.sql import functions as F

    from lodestone.sources.corpus import Corpus
    from lodestone.sources.documents import from_documents

    def make(*docs, **tables):
        columns = {
            "normalized_path": "string", "content": "string", "created_at": "double", "mtime": "double",
            "click_count": "bigint", "imported_click_count": "bigint", "importance": "double",
            "size": "bigint", "source_type": "string", "file_id": "bigint",
        }
        rows = []
        for number, (path, body, *more) in enumerate(docs, start=1):
            row = {
                "normalized_path": path, "content": body, "created_at": 1_700_000_000.0, "mtime": 1_700_000_000.0,
                "click_count": 0, "imported_click_count": 0, "importance": 0.0, "size": len(body or ""),
                "source_type": "local", "file_id": number,
            }
            row.update(more[0] if more else {})
            rows.append(tuple(row[c] for c in columns))
        df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in columns.items()))
        return Corpus.of(from_documents(df, {c: F.col(c) for c in columns}), **tables)

    return make


@pytest.fixture(scope="session")
def names_of():
    def names(result):
        return [r.file_name for r in result.page().orderBy("position").collect()]

    return names
