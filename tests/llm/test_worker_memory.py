"""What a Python worker of the token store holds, in a process of its own."""

import subprocess
import sys

HELD = """
import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa

from colsense.llm import token_store


def anon():
    return int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024


token_store.encoder(public_tokenizers.path(token_store.VOCABULARY), False)
r, most = np.random.default_rng(3), 0
words = np.array([f"w{k}" for k in range(30_000)])
texts = [" ".join(words[r.integers(0, len(words), 1200)]) for _ in range(2_000)] * 2
batches = [pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]
before, n = anon(), 0
for out in token_store._chunked(iter(batches), public_tokenizers.path(token_store.VOCABULARY), 2, False):
    n, most = n + out.num_rows, max(most, anon() - before)
assert n == len(texts)
print(most)
"""


def test_a_worker_of_the_token_store_holds_little_between_slices():
    told = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True)
    assert float(told.stdout) < 45, told.stdout
