import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from terravox.llm import queries as Q

#: What a Python worker of ``round_trip`` does, without Spark: many distinct words in batches of 4 MB.
CODE = """
import sys
from types import SimpleNamespace as Some
import numpy as np
import pyarrow as pa
from terravox.llm import bpe

def used():
    with open("/proc/self/status") as f:
        return int(f.read().split("RssAnon:")[1].split()[0]) / 1024

kind = Some(dataType=Some(simpleString=lambda: "bigint"))
bpe.with_columns_safe = lambda *a: Some(schema={"doc_id": kind}, mapInArrow=lambda f, schema: f)
run = bpe.round_trip(None, sys.argv[1], with_ids=True)
random = np.random.default_rng(5)

def batches():
    for _ in range(8):
        numbers = (300_000 * random.random(600_000) ** 3).astype(int)
        texts = [" ".join(f"w{n:x}" for n in own) for own in np.split(numbers, 2000)]
        yield pa.RecordBatch.from_pydict({"doc_id": np.arange(2000), "text": texts})

batches = list(batches())
before, most, rows = used(), 0, 0
for out in run(iter(batches)):
    most, rows = max(most, used()), rows + len(out)
    del out
print(rows, round(most - before), round(used() - before))
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup") or not os.path.exists(Q.TOKENIZER), reason="no figures of memory")
def test_encoding_keeps_a_worker_small():
    out = subprocess.run([sys.executable, "-c", CODE, Q.TOKENIZER], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, check=True)
    rows, most, left = map(int, out.stdout.split())
    assert rows == 16_000
    assert most < 110 and left < 60, (most, left)
