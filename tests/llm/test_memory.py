"""What a worker keeps of its memory when its work is done; Spark keeps the worker."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORK = """
import random, re
import pyarrow as pa
from textloom.llm import linededup
from textloom.llm.common import trimmed

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read())))

def batches():
    r = random.Random(1)
    for _ in range(4):
        yield pa.RecordBatch.from_pydict({"text": ["\\n".join("%030x" % r.getrandbits(120) for _ in range(60)) for _ in range(1500)]})

base, most = held(), 0
for b in trimmed(linededup._signer(7, 24, 4, 10))(batches()):
    most = max(most, held())
del b
print(base, most, held())
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="no figures of memory")
def test_workers_give_memory_back():
    out = subprocess.run([sys.executable, "-c", WORK], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    base, most, after = map(int, out.stdout.split())
    assert after - base < 0.6 * (most - base), (base, most, after)
