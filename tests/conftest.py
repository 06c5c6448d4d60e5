import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillmark.session import local_session

    return local_session(8, memory="6g", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("no test tables here")
    return SMALL


@pytest.fixture(scope="session")
def jokes(spark):
    """Five short documents with known statistics."""
    rows = [(0, "a freudian slip is a slip of intel inside"), (1, "intel inside idiot outside"), (2, "the intel inside joke is a joke"), (3, "a a b"), (4, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")
