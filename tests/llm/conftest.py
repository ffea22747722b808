import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) or (id, text, lang, source) rows, with extra
    columns whose names clash with ones the operators add."""
    def make(rows, extra=False):
        full = [(*r, None, None)[:4] if len(r) == 2 else tuple(r) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            for c in ("size", "score", "hit", "slot", "shard", "n", "copies", "cls", "grp", "held_out", "predicted",
                      "_slot", "_shard", "_row", "_rows", "_source", "_null", "_bucket", "_text", "_id", "_h", "_t",
                      "_given", "_found", "_whole", "_from", "_one", "word", "key", "set", "item", "token"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df
    return make
