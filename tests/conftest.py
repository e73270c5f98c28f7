from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from attrition.session import build_session, work_dir

    s = build_session("local[*]", app_name="attrition-tests", shuffle_partitions=8)
    work_dir(s)  # tests set their own checkpoint folder only when none is configured
    yield s
    s.stop()
