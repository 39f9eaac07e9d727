"""The index of byte positions and the count of shared bytes."""

import random

import numpy as np
import pyarrow as pa

from loomline.llm import simhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_pairs_within_four_bits_meet_in_four_lists_and_others_are_dropped_by_count(spark):
    rng = random.Random(17)
    pairs = []
    for _ in range(60):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))))
        keep = rng.sample(range(8), 3)  # three bytes agree, the others differ in one bit each
        pairs.append((a, a ^ sum(1 << (8 * p + rng.randrange(8)) for p in range(8) if p not in keep)))
    fps = sorted({signed(x) for pair in pairs for x in pair})
    lists = {}
    for r in simhash.index(spark.createDataFrame([(x,) for x in fps], "fp long")).collect():
        lists.setdefault(r.fp, set()).add(r.posting)
    assert all(len(postings) == 56 for postings in lists.values())
    kept = dropped = 0
    for a, b in pairs:
        meet = len(lists[signed(a)] & lists[signed(b)])
        shared = sum((a ^ b) >> 8 * p & 255 == 0 for p in range(8))
        near = simhash.near_bits(pa.RecordBatch.from_pydict({"key": pa.array([signed(a), signed(b)])}))(0, np.array([1]))[0]
        assert meet == shared * (shared - 1) * (shared - 2) // 6 and near == ((a ^ b).bit_count() <= 4)
        assert simhash.shared_bytes(np.array([a ^ b], np.uint64))[0] == shared
        kept += near and meet >= 4
        dropped += shared < simhash.SHARED and meet == 1
    assert kept >= 60 and dropped >= 60
