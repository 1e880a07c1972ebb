"""What Python workers keep: the encoder's tables and memory of pieces, and what tasks have freed."""

import random
import subprocess
import sys

from kinograph.llm import bpe

HELD = r"""
import random, re
import numpy as np
from kinograph.llm import bpe, common

def held():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

"""


def megabytes(code):
    out = subprocess.run([sys.executable, "-c", HELD + code], capture_output=True, text=True, check=True, timeout=120).stdout
    return [float(x) for x in out.split()]


def test_an_encoder_with_full_memory_is_small():
    before, after = megabytes("""
rng = random.Random(1)
texts = ["".join(" " + "".join(rng.choices("etaoinshr", k=rng.randrange(4, 12))) for _ in range(1000)) for _ in range(300)]
print(held())
c, d = bpe.encoder(bpe.default_vocabulary()), bpe.decoder(bpe.default_vocabulary())
for t in texts:
    c.encode(t)
print(held())
""")
    assert after - before < 80


def test_a_task_gives_its_memory_back():
    before, after = megabytes("""
pins = []

def run(batches):
    for b in batches:
        # freed below pieces that stay, as a worker's caches do
        parts = []
        for k in range(3000):
            parts.append(np.ones(40_000, np.uint8))
            if k % 10 == 0:
                pins.append(np.ones(64, np.uint8))
        yield sum(map(len, parts))
        del parts

print(held())
assert list(common.giving_back(run)(iter([1, 2]))) == [120_000_000] * 2
print(held())
""")
    assert after - before < 40


def test_remembered_answers_about_pairs_are_those_of_the_merges():
    c = bpe.encoder(bpe.default_vocabulary())
    rng, size = random.Random(2), len(c.rank)
    pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(3000)]
    # pairs that share a place with others, in turn
    pairs += [(a, b) for a in range(256, 300) for b in (1, 1 + bpe.PAIRS // 8, 2, 1)] + pairs[::-1]
    pairs = [(a, min(b, size - 1)) for a, b in pairs]
    assert all(c.compatible(a, b) == c._compatible(a, b) for a, b in pairs)
