import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, score string, kept string, z string, n long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names clash with those that operators add."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "s", "k", "z", 1) for i, t in zip(ids, texts, strict=True)], DOCS)

    return make
