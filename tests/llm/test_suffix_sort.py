"""Suffix sorting against brute force, with long ties, periods and many buckets."""

import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import suffix_sort


def test_the_cover_has_every_difference():
    assert {(a - b) % suffix_sort.V for a in suffix_sort.COVER for b in suffix_sort.COVER} == set(range(suffix_sort.V))
    assert suffix_sort.SHIFT.max() < suffix_sort.V <= suffix_sort.WIDTH


@pytest.mark.parametrize("length", [128, 200, 240, 400])
@pytest.mark.parametrize("kind", ["copies", "periods", "random"])
def test_against_brute_force(length, kind):
    rng = random.Random(length + len(kind))
    base = bytes(rng.choices(b"ab" if kind != "random" else b"abcdefgh", k=900))
    parts = []
    for _ in range(12):
        x = bytearray(base)
        if kind == "periods":
            x = bytearray((base[: rng.randint(1, 40)] * 900)[:900])
        if kind == "random":
            x = bytearray(rng.choices(b"ab", k=900))
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(900)] = rng.choice(b"xyz")
        cut = rng.randint(0, 60)
        parts.append(bytes(x[cut:]))
    data = b"".join(parts)
    start, bucket, at = [], [], 0
    for k, p in enumerate(parts):
        own = range(len(p) - length + 1)
        start += [at + i for i in own]
        bucket += [k % 2] * len(own)
        at += len(p)
    count = Counter((b, data[s : s + length]) for s, b in zip(start, bucket))
    got = suffix_sort.repeated(np.frombuffer(data, np.uint8), np.array(start), np.array(bucket), length)
    assert got.tolist() == [count[b, data[s : s + length]] > 1 for s, b in zip(start, bucket)]


def test_ranks_are_the_order_of_the_bytes():
    rng = random.Random(2)
    data = bytes(rng.choices(b"ab", k=600)) * 2
    heads = suffix_sort.prefix(np.frombuffer(data + bytes(400), np.uint8)).byteswap()
    ranks = suffix_sort.cover_ranks(heads, 700, 11)
    at = [i for i in range(700) if i % suffix_sort.V in suffix_sort.COVER and i + 341 <= 700]
    order = sorted(at, key=lambda i: data[i : i + 341])
    assert all((ranks[a] < ranks[b]) == (data[a : a + 341] < data[b : b + 341]) for a, b in zip(order, order[1:]))
