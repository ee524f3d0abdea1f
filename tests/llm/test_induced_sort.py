"""Suffix order and shared prefixes against sorting the suffixes themselves."""

import random

import numpy as np
import pytest

from hazardspark.llm import induced_sort as s


def mapped(data: bytes) -> np.ndarray:
    return np.frombuffer(b"\0" * 8 + bytes(b + 1 for b in data) + b"\0" + b"\0" * 8, dtype=np.uint8)


def shared(a: bytes, b: bytes, most: int) -> int:
    n = 0
    while n < most and n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def plain(data: bytes, most: int):
    at = sorted(range(len(data)), key=lambda i: data[i:], reverse=True)
    return at, [0] + [shared(data[i:], data[j:], most) for i, j in zip(at, at[1:], strict=False)]


CASES = [b"", b"a", b"aaaaaaaaaaaa", b"banana", b"mississippi" * 9, bytes(range(240)) * 3, b"abcabcabcab" * 30, b"\x00\x00\x01\x00" * 20]
CASES += [bytes(random.Random(k).choices(b"ab" if k % 3 else b"abcdefgh \n", k=700)) for k in range(12)]
CASES += [b"".join(random.Random(50 + k).choices([b"the quick brown fox ", b"jumps", b"aaaaaaaaaaaaaaaaaaaaaaa", b"over it. "], k=60)) for k in range(6)]


@pytest.mark.parametrize("data", CASES)
@pytest.mark.parametrize("small", [False, True])
def test_order_and_shared_prefixes(data, small, tmp_path, monkeypatch):
    if small:  # every queue goes to disk, and all is sorted in many parts
        monkeypatch.setattr(s, "BATCH", 7)
        monkeypatch.setattr(s, "PART", 16)
        monkeypatch.setattr(s, "SMALL", 0)
    got = [(p.copy(), n.copy()) for p, n in s.suffixes(mapped(data), s.Folder(str(tmp_path)), 20, 200 if small else 0)]
    pos = np.concatenate([np.empty(0, np.int64), *[p for p, _ in got]]).tolist()
    lcp = np.concatenate([np.empty(0, np.int64), *[n for _, n in got]]).tolist()
    want, least = plain(data, 20)
    assert pos == want
    assert lcp == (least if data else [])
