"""The samples of fingerprints against the formula read off term by term."""

import math

import numpy as np

from loomline.llm import fingerprints as fp
from loomline.llm.common import BASE, mix

MASK = (1 << 64) - 1


def test_quantiles_invert_the_distribution():
    below = lambda x: 1 - (1 + x) * math.exp(-x)
    for p in (1e-4, 0.01, 0.3, 0.5):
        low, high = fp.gamma_quantiles(np.array([p, -p]))
        assert math.isclose(below(low), p, rel_tol=1e-6) and math.isclose(1 - below(high), p, rel_tol=1e-6)
    draws = fp.RATE.astype(float)
    assert abs(draws.mean() - 2) < 1e-3 and abs(draws.var() - 2) < 1e-2 and (np.diff(draws) > 0).all() and fp.RATE_TAIL.min() >= fp.RATE[-2]


def test_samples_equal_the_formula():
    rng = np.random.default_rng(7)
    text = " ".join(f"w{k}" for k in np.minimum(rng.zipf(1.6, 500), 4)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    term, weight, _ = fp.bags(data, offsets)
    assert weight.max() > 10 and len(term) > 60
    salts = mix(np.arange(1, 2 * fp.SLOTS + 1, dtype=np.uint64) * np.uint64(BASE)).tolist()
    one = lambda x: int(mix(np.array([x & MASK], np.uint64))[0])
    want = []
    for slot in range(fp.SLOTS):
        best = None
        for x, w in zip(term.tolist(), weight.tolist()):
            bits = (x ^ salts[slot]) * (salts[fp.SLOTS + slot] | 1) & MASK
            top, second, third = bits >> 48, bits >> 32 & 0xFFFF, bits >> 16 & 0xFFFF
            log_c = fp.LOG_SCALE_TAIL[one(bits) & 0xFFFF] if top == 0 else fp.LOG_SCALE[top]
            r = fp.RATE_TAIL[one(bits) & 0xFFFF] if second == 0xFFFF else fp.RATE[second]
            b = (third + 0.5) / 65536
            t = math.floor(math.log(w) / r + b)
            a = float(log_c) - float(r) * (t - b) - float(r)
            if best is None or a < best[0] - 1e-5:
                best = (a, one(x + t * BASE) & 0xFFFFFFFF)
        want.append(best[1])
    found = fp.signatures(data, offsets)[0].tolist()
    assert sum(x == y for x, y in zip(found, want)) >= fp.SLOTS - 1  # a tie by rounding may go the other way
