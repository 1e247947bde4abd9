import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from poolsight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """A local session; where no shared folder is named, the tests name a temporary one."""
    return local_session(8, "tests", shared=tempfile.mkdtemp(prefix="poolsight-"))
