import os
import random

import numpy as np
import pytest

from gridloom.llm import bwt


def brute(strings, match, owner):
    low = {}
    for s, o in zip(strings, owner, strict=True):
        for i in range(len(s) - match + 1):
            w = s[i : i + match]
            low[w] = min(low.get(w, o), o)
    return low


@pytest.mark.parametrize("seed", range(25))
def test_transform_and_windows_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 3 == 0:
        monkeypatch.setattr(bwt, "CHUNK", 37)
        monkeypatch.setattr(bwt, "IN_MEMORY", 90)
    match = rng.choice([3, 8, 10])
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 24))) for _ in range(rng.randint(1, 40))]
    strings += strings[:3]
    coll = bwt.Collection(strings, match)
    state = bwt.build(coll)
    parts = [state.read(i) for i in range(len(state))]
    symbol, entry, common = (np.concatenate(x) for x in zip(*parts))
    state.close()
    suffixes = [(strings[int(e) >> 16][len(strings[int(e) >> 16]) - (int(e) & 0xFFFF) :]) for e in entry]
    assert len(entry) == sum(len(s) + 1 for s in strings)
    assert suffixes == sorted(suffixes)
    for i, (e, b) in enumerate(zip(entry.tolist(), symbol.tolist())):
        s, n = strings[e >> 16], e & 0xFFFF
        assert b == (0 if n == len(s) else coll.code[s[len(s) - n - 1]])
        shared = len(os.path.commonprefix([suffixes[i], suffixes[i - 1]])) if i else 0
        assert common[i] == min(match, shared)
    owner = np.array([rng.randint(0, 9) for _ in strings])
    low = brute(strings, match, owner.tolist())
    got = bwt.least_owner(coll, owner)
    for k, s in enumerate(strings):
        for o in range(len(s) - match + 1):
            assert got[k, o] == low[s[o : o + match]]
