import os
from pathlib import Path

import pytest

from veilframe.llm.common import give_back


def test_free_memory_between_used_pieces_goes_back():
    # a worker that stays keeps such memory otherwise, also through stages that run no Python
    if "VmRSS" not in Path("/proc/self/status").read_text() or os.confstr("CS_GNU_LIBC_VERSION") is None:
        pytest.skip("needs Linux and glibc")
    held = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    pieces = [bytes(20_000) for _ in range(10_000)]
    last = pieces[-1]
    for i in range(len(pieces)):
        pieces[i] = None
    before = held()
    give_back()
    assert len(last) == 20_000
    assert before - held() > 100_000_000
