"""What operators hold: peaks of arrays, what a worker keeps after a task, and rounds that close nothing."""

import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers

from texlith.llm import bpe, shingle_join

BPE = public_tokenizers.path("byte_bpe_50k.json")


def peak(run) -> float:
    """Most MB that are allocated at once."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_tokens_of_a_batch_take_little_at_once():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(700)) for _ in range(1000)]
    coder = bpe.loaded(BPE)
    assert peak(lambda: sum(len(x) for x in coder.ids(texts))) < 50


def test_frequency_classes_take_little_at_once():
    counts = np.random.default_rng(1).poisson(3, shingle_join.CELLS)
    counts[7::1000] = 5000
    got = []
    assert peak(lambda: got.append(shingle_join.frequency_classes(counts))) < 20
    chance = 6 * np.sqrt(counts.mean()) + 8
    assert (got[0][7::1000] == 127 + np.ceil(np.log2(5000 - counts.mean() - chance + 1))).all()
    assert len(got[0]) == len(counts) and got[0][0] == int((((counts[0] - counts.mean() - chance) / chance + 2) / 2) * 127)


def test_a_worker_gives_memory_back():
    code = """
import re, numpy as np
from texlith.llm._common import released
def anonymous():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def run(rows):
    for _ in rows:
        held = [np.ones(12_000) for _ in range(3000)]
        last.extend(held[::100])  # what stays keeps the heap from shrinking
        held.clear()
        yield anonymous()
last, before = [], anonymous()
plain = [*run(range(2))][-1] - before
list(released(run)(range(2)))
print(plain, anonymous() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    plain, after = map(float, done.stdout.split())
    assert plain > 200 and after < 40


def test_rounds_that_close_nothing_end(spark, monkeypatch):
    """Texts with a passage in common, none of them linked: their pairs stay open however often pivots are drawn."""
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(100))
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(20))) for i in range(60)]
    calls, verified = [], shingle_join._verified
    monkeypatch.setattr(shingle_join, "_verified", lambda *a: calls.append(1) or verified(*a))
    got = shingle_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i, _ in rows]
    assert 0 < len(calls) <= shingle_join._TURNS + 1
