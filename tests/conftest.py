import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from semblance.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def pair(spark):
    """Four rows a side with nulls, a constant column and one-sided categories."""
    schema = "amount double, score double, merchant string, fraud string"
    real = [(10.0, 1.0, "A", "No"), (10.0, 2.0, "B", "No"), (None, 3.0, "A", "Yes"), (10.0, 4.0, None, "Yes")]
    syn = [(10.0, 1.1, "A", "No"), (None, 2.1, "C", "Yes"), (10.0, None, None, "Yes"), (10.0, 3.8, "B", "No")]
    return spark.createDataFrame(real, schema), spark.createDataFrame(syn, schema)
