import re
from pathlib import Path

import pytest

from fleetgauge.llm import common


def held() -> int:
    """KB of memory of this process that no file is behind."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1])


@pytest.mark.skipif(common._trim() is None, reason="glibc only")
def test_a_task_gives_back_what_it_has_freed():
    pins = []

    def make(batches):
        for n in batches:
            blocks = [bytes(1000 + i % 7) for i in range(n)]
            pins.append(blocks[-1])  # on top of the heap: nothing below it goes back by itself
            yield len(blocks)
    before = held()
    assert list(make(iter([150_000]))) == [150_000]
    kept = held() - before
    assert kept > 100_000
    assert list(common.released(make)(iter([150_000]))) == [150_000]
    assert held() - before < kept / 3
