"""SetSketch registers, their estimates, and near copies against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import setsketch


def sets_of(jaccard, size, rng):
    """Two random sets of about the size and of the Jaccard index."""
    both = round(size * 2 * jaccard / (1 + jaccard))
    values = rng.integers(0, 1 << 63, 2 * size - both, np.uint64)
    return values[:size], values[size - both :]


def test_registers_are_of_the_set_and_merge():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 5000, np.uint64)
    a, b, whole = setsketch.sketches([x[:3000], x[2000:], x])
    assert (setsketch.merged(a, b) == whole).all()
    assert (setsketch.sketches([np.roll(x, 7)])[0] == whole).all()
    assert (setsketch.sketches([np.zeros(0, np.uint64)]) == 0).all()
    for n in (1, 10, 1000, 100_000):
        assert abs(setsketch.cardinality(setsketch.sketches([rng.integers(0, 1 << 63, n, np.uint64)])[0]) / n - 1) < 4 / setsketch.REGISTERS**0.5


@pytest.mark.parametrize("jaccard", [0.1, 0.5, 0.7, 0.85, 0.97])
def test_registers_agree_as_the_sets_do(jaccard):
    rng, same, found = np.random.default_rng(2), [], []
    for size in [40] * 60 + [700] * 60:
        x, y = sets_of(jaccard, size, rng)
        a, b = setsketch.sketches([x, y])
        same.append((a == b).mean())
        greater, less = (a > b).sum(), (a < b).sum()
        estimate = setsketch.joint_estimate(*(np.array([n], float) for n in (greater, less, setsketch.REGISTERS - greater - less, len(x), len(y))))[0]
        found.append(estimate - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(same) - jaccard) < 0.02
    assert abs(np.mean(found)) < 0.01 and np.std(found) < 1.3 * (jaccard * (1 - jaccard) / setsketch.REGISTERS) ** 0.5


def test_bands_meet():
    """All of 400 pairs at the limit share a band and pass the estimate."""
    rng, test = np.random.default_rng(3), setsketch.estimated(0.85)
    for size in (20, 100, 1000):
        for _ in range(133):
            x, y = sets_of(0.86, size, rng)
            regs = setsketch.sketches([x, y])
            keys = setsketch.band_keys(regs)
            assert (keys[0] == keys[1]).any() and test(np.array([len(x), len(y)]), list(regs), 0, np.array([1])).all()


def brute(rows):
    """The definition: words, sets of shingles, all pairs, the least id that is reachable."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append(frozenset(" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if None in (rows[i][0], rows[j][0]) or not a or not b:
                continue
            if rows[i][0] == rows[j][0] or 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = None if doc_id is None else min(least[find(i)]) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id is not None and doc_id == component))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def chains(spark):
    """Texts that change by a few words from one to the next, copies, and pairs about the limit; one large group."""
    rng, rows = random.Random(4), []
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(5))
    for _ in range(6):
        text = [word() for _ in range(120)]
        for _ in range(25):
            text = list(text)
            for _ in range(rng.choice([0, 1, 2, 3])):
                text[rng.randrange(120)] = word()
            rows.append((len(rows), (" " if rng.random() < 0.8 else "  \n").join(w.upper() if rng.random() < 0.1 and "é" not in w else w for w in text)))
    common = [word() for _ in range(100)]
    for _ in range(150):
        own = list(common)
        for at in rng.sample(range(0, 100, 3), rng.randrange(0, 5)):
            own[at] = word()
        rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("group_rows", [2000, 40])
def test_near_duplicates(chains, group_rows):
    """Whole groups, and large ones dealt into blocks."""
    got = setsketch.near_duplicates(chains, 0.85, group_rows).collect()
    assert sorted(str(tuple(r)) for r in got) == brute([tuple(r) for r in chains.collect()])


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in setsketch.near_duplicates(odd).collect()) == brute(rows)
    assert setsketch.near_duplicates(none).count() == 0
