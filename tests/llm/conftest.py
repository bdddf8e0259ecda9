import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents from texts; with columns of clashing names beside them."""

    def make(*texts, ids=None, extra=False):
        ids = ids or range(len(texts))
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
        if extra:
            schema += ", node long, key long, component_id string, spans string, start string, score string, `slot` long, text_key string"
            rows = [(*r, 1, 2, "x", "y", "z", "s", 3, "k") for r in rows]
        return spark.createDataFrame(rows, T._parse_datatype_string(schema))

    return make
