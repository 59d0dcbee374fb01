"""Exact dedup, sharding and SimHash against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, near_copies, sharding, simhash
from quarry.llm.queries import table
from quarry.llm.components import components


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("block", "bits", "hot"), [(4096, 64, 1000), (7, 64, 8), (7, 3, 1)])
def test_block_naming(spark, odd, block, bits, hot):
    """bits=3 makes most blocks share a hash, so their bytes decide; hot=8 joins small groups by name and broadcasts the others, 1 joins all by name."""
    small = odd if block > 7 else odd.where("length(text) < 6000 or text is null")
    groups = defaultdict(list)
    for doc_id, text in texts(small):
        groups[text].append(doc_id)
    got = exact_dedup.exact_duplicates(small, block, bits, hot).collect()
    assert len(got) == small.count()
    want = sorted((str(d), str(max((x for x in groups[t] if x is not None), default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts(small))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_block_naming_of_none(none):
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_keep_one(odd, none):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    rows = texts(kept)
    assert len(rows) == len({t for _, t in texts(odd)}) == len({t for _, t in rows})
    assert exact_dedup.keep_one(none).count() == 0


def test_sharding(spark, odd, none):
    got = sharding.shard_documents(odd, 3).collect()
    rows = texts(odd)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    held = [r.bytes for r in sharding.shard_documents(docs, 8).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(held) == 8 and max(held) - min(held) <= 0.01 * sum(held) / 8
    assert sharding.shard_documents(none, 3).count() == 0


def test_map_versions(spark, tmp_path):
    rng = random.Random(1)
    sizes = {s: rng.randrange(1, 1000) for s in range(512)}
    first = sharding.first_map(sizes, 8, 512)
    held = lambda m, z: [sum(z.get(s, 0) for s, x in enumerate(m.slots) if x == k) for k in range(m.shards)]
    assert max(held(first, sizes)) - min(held(first, sizes)) < 1000
    skewed = sizes | {s: sizes[s] * 20 for s, x in enumerate(first.slots) if x == 0}
    second = sharding.rebalance(first, skewed)
    assert second.version == 2 and max(held(second, skewed)) < 1.1 * sum(skewed.values()) / 8
    assert sum(a != b for a, b in zip(first.slots, second.slots, strict=True)) < 128
    assert set(sharding.rebalance(second, skewed, 6).slots) == set(range(6))
    for m in (first, second):
        sharding.save_map(spark, m, f"file://{tmp_path}/map")
    assert sharding.load_map(spark, f"file://{tmp_path}/map", 2) == second


def slow_fingerprint(text, words=3):
    parts = text.encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
    return sum(1 << k for k in range(64) if counts[k] * 2 > len(shingles))


def slow_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_simhash(odd, none):
    rows = [(d, slow_fingerprint(t)) for d, t in texts(odd)]
    root = slow_components({f for _, f in rows}, 3)
    least = defaultdict(list)
    for d, f in rows:
        least[root[f]].append(d)
    want = sorted((str(d), f"{f:016x}", str(min((x for x in least[root[f]] if x is not None), default=None))) for d, f in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(odd).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("tree_nodes", [20_000, 4])
def test_links_of_clusters(spark, tree_nodes):
    """tree_nodes=4 deals hot shards out again."""
    rng = random.Random(5)
    values = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(12):
            v = centre
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = simhash.links(fps, 3, tree_nodes).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for u, v in edges:
        x, y = sorted((find(unsigned(u)), find(unsigned(v))))
        root[y] = x
    want = slow_components(values, 3)
    assert {v: find(v) for v in values} == want or len({find(v) for v in values}) == len(set(want.values()))


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 1, np.uint64)
    values = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 12, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    tree = simhash.BKTree(values)
    got = {(n, int(q)) for n, near in tree.within(values, 3) for q in near}
    assert got == {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if int(a ^ b).bit_count() <= 3}


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5), (9, 200), (200, 150)]
    got = {r.u: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 9 for i in [*range(100, 161), 200]} | {7: 3}


def slow_shingles(text):
    parts = text.encode().lower().split()
    return {b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))}


def test_near_copies(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rng, rows = random.Random(8), []
    for doc_id, text in texts(docs):
        rows.append((doc_id, text))
        parts = text.split(" ")
        if doc_id % 5 == 0:  # edits of several sizes, so pairs lie on both sides of the limit
            for _ in range(max(1, int(len(parts) * rng.choice([0.005, 0.01, 0.02, 0.03])))):
                parts[rng.randrange(len(parts))] = rng.choice(["alpha", "beta"])
            rows.append((doc_id + 10_000, " ".join(parts)))
    sets, by_hash = {d: slow_shingles(t) for d, t in rows}, defaultdict(list)
    for d, own in sets.items():
        for s in own:
            by_hash[s].append(d)
    pairs = {(a, b) for own in by_hash.values() if len(own) < 60 for a in own for b in own if a < b}
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = {d: d for d in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.u: r.root for r in near_copies.classes(made).collect()}
    assert {r.u: r.root for r in near_copies.classes(made, shard_rows=40).collect()} == got
    expected = {d: find(d) for d in sets if find(d) != d}
    assert len(expected) > 100 and set(got) <= set(expected) and len(got) >= 0.97 * len(expected)
    assert {d for d, _ in texts(near_copies.keep_one(made))} == set(sets) - set(got)
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {0, 2, 5, 6, 7, None} and not {1, 3, 4} & {r.doc_id for r in kept.collect()}
    assert near_copies.keep_one(none).count() == 0


@pytest.mark.parametrize("shard_rows", [2000, 30])
def test_large_groups_of_near_copies(spark, shard_rows):
    """Two groups that share half of their words, a chain between them and texts of their own, against all pairs; 30 deals their shards out in two rounds."""
    rng, rows = random.Random(12), []
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base = [word() for _ in range(200)]
    bases = [base, base[:150] + [word() for _ in range(50)], [word() for _ in range(120)]]
    for i in range(360):
        own = list(bases[0 if i % 3 else 1 + i % 2])
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    rows += [(1000 + k, " ".join(base[: 200 - k] + bases[1][200 - k :])) for k in range(0, 51, 10)]
    sets = {d: slow_shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.u: r.root for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=shard_rows).collect()}
    assert got == {d: find(d) for d in sets if find(d) != d}


def test_near_copies_of_every_kind(spark):
    """Appended, cut, block-replaced and repeated-line copies at the limit: only sharing no shard (0.2 ** 4) may lose a pair."""
    rng, rows, pairs = random.Random(11), [], []
    new = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    for i in range(240):
        n = rng.choice([100, 300, 600])
        own, some = new(n), int(n * rng.uniform(0.17, 0.21))
        at = rng.randrange(n - n // 4)
        other = [own + new(some), own[some:], own[:at] + new(n // 10) + own[at + n // 10 :], own + own[at : at + n // 4] * rng.randint(2, 8)][i % 4]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
        a, b = slow_shingles(rows[-2][1]), slow_shingles(rows[-1][1])
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((i % 4, 2 * i + 1))
    got = {r.u for r in near_copies.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {u for _, u in pairs}
    for kind in range(4):
        own = [u for k, u in pairs if k == kind]
        assert len(own) >= 15 and len(set(own) & got) >= 0.97 * len(own)


def test_prefixes_pass_over_no_similar_pair():
    rng = np.random.default_rng(3)
    bases = [rng.integers(0, 1 << 40, rng.integers(1, 60), np.uint64) for _ in range(30)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.95], rng.integers(0, 1 << 40, rng.integers(0, 4), np.uint64), np.arange(3, dtype=np.uint64)])) for b in bases for _ in range(6)]
    found = {(b, a) for a, near in near_copies.prefix_candidates(sets, 0.8) for b in near.tolist()}
    similar = {(b, a) for a in range(len(sets)) for b in range(a) if near_copies.jaccard(sets[a], sets[b]) >= 0.8}
    assert len(similar) > 50 and similar <= found
