import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wavelane import session  # noqa: E402
from wavelane.functions import ordinals, scans  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session.build("4", shuffle=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_blocks():
    """Tiny blocks, so that every scan, halo and carry crosses many block borders."""
    targets = {ordinals.block: (8,), ordinals.with_halo: (8, 0), ordinals.lagged: (8,), scans.affine_scan: (8,)}
    saved = {f: f.__defaults__ for f in targets}
    for f, d in targets.items():
        f.__defaults__ = d
    yield
    for f, d in saved.items():
        f.__defaults__ = d
