"""Locally consistent parsing against a parse of one symbol at a time."""

import random

import numpy as np
import pytest

from veldspar.llm import _words, fingerprint

FULL = (1 << 64) - 1


def mixed(x):
    return int(_words.mix(np.array([x & FULL], np.uint64))[0])


def tossed(x):
    """The place and value of the lowest bit in which each symbol differs from the one before."""
    out = []
    for k, v in enumerate(x):
        low = 0 if k == 0 else (v ^ x[k - 1] & FULL).bit_length() and next(j for j in range(64) if (v ^ x[k - 1]) >> j & 1)
        out.append(2 * low + (v >> low & 1))
    return out


def plain_round(symbols):
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    s = [mixed(v + n * 0xA0761D6478BD642F) for v, n in runs]
    label = s
    for _ in range(4):
        label = tossed(label)
    starts = [k for k in range(len(s)) if k == 0 or (k < len(s) - 1 and label[k - 1] < label[k] > label[k + 1])]
    names = []
    for a, b in zip(starts, [*starts[1:], len(s)]):
        names.append(mixed(sum(v * pow(_words._BASE, j, 1 << 64) for j, v in enumerate(s[a:b])) + b - a))
    return names, label


def texts():
    rng = random.Random(5)
    return ["a", "ab", "aaaa", "abab" * 30, "x" * 500, *("".join(rng.choice(letters) for _ in range(rng.randint(2, 300))) for letters in ("ab", "abcdefgh ", "é你\U0001f600 z") for _ in range(15))]


def test_rounds_equal_a_plain_parse():
    own = texts()
    s = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(own)), [len(t) for t in own])
    symbols = [[ord(c) for c in t] for t in own]
    for _ in range(4):
        s, doc = fingerprint.parse_round(s, doc)
        symbols = [plain_round(x)[0] for x in symbols]
        assert [s[doc == k].tolist() for k in range(len(own))] == symbols


def test_neighbouring_labels_differ_and_are_small():
    for t in texts():
        _, label = plain_round([ord(c) for c in t])
        assert all(a != b for a, b in zip(label, label[1:])) and max(label) < 8


def test_fingerprint_is_the_least_name_of_each_bin():
    for t in texts():
        names, symbols, k = [], [ord(c) for c in t], 0
        while symbols:
            k += 1
            symbols = plain_round(symbols)[0]
            if k >= fingerprint.FIRST or len(symbols) == 1:
                names += symbols
            if len(symbols) == 1:
                break
        least = {}
        for x in names:
            h = mixed(x ^ 0x2545F4914F6CDD1D)
            least[h % fingerprint.BINS] = min(h, least.get(h % fingerprint.BINS, FULL))
        want = [(mixed(least[b]) >> 48) | 1 if b in least else 0 for b in range(fingerprint.BINS)]
        assert fingerprint.sketch([t])[0].tolist() == want


def test_likeness_follows_shared_text():
    rng, got, want = random.Random(7), [], []
    for k in range(60):
        a = "".join(rng.choice("abcdefghij ") for _ in range(4000))
        keep = int(4000 * k / 59)
        b = a[:keep] + "".join(rng.choice("abcdefghij ") for _ in range(4000 - keep))
        x, y = ({t[i : i + 9] for i in range(3992)} for t in (a, b))
        want.append(len(x & y) / len(x | y))
        got.append(fingerprint.likeness(*fingerprint.sketch([a, b])[:, None])[0])
    assert np.corrcoef(got, want)[0, 1] > 0.97 and got[0] < 0.1 and got[-1] == pytest.approx(1.0)
