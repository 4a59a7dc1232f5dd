import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark):
    import corpus

    rows = corpus.documents()
    return rows, corpus.frame(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    import corpus

    return corpus.frame(spark, [])
