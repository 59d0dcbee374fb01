"""The prefix trie and the structure repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarry.llm import prefix_trie, queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, node string, path string, kind int, n long, least long, audit string, end string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd_talks(spark):
    """Nulls in every column, ties, repeated rows, a long text, a common start, and columns named as the operators' own."""
    rng = random.Random(3)
    said = ["Hi.", "hi", "What is it?", "", "  \t", None, "no end", "Yes! ", "日本。", "word " * 30_000]
    rows = []
    for conv in [*range(0, 66), 81, 99, -3, -20, 100_000_000_007]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system" if turn == 0 else "user", "user", "assistant", "assistant", "tool", "", None])
            rows.append((conv, turn if rng.random() < 0.9 else None, role, "Hi." if turn == 0 and conv % 3 else rng.choice(said[: 9 if conv % 20 else 10])))
    rows += rows[:7] + [(None, 1, "user", "x."), (None, None, None, None), (None, 2, "assistant", "y")]
    return spark.createDataFrame([(*r, "n", "p", 1, 2, 3, "a", "e") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def no_talks(odd_talks):
    return odd_talks.limit(0)


def brute_repair(initials, faults):
    """Row by row, the least (cost, audit) of each last initial, with up to two insertions anywhere."""
    best = {"": (0, "")}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(3):
            for last, (cost, audit) in list(best.items()):
                way = cost + 5, audit + "I"
                best[follow[last]] = min(best.get(follow[last], way), way)
        return best

    best = inserted(best)
    for initial, fault in zip(initials, faults, strict=True):
        after = {}
        for last, (cost, audit) in best.items():
            ways = [(last, 2, "D")]
            if fault not in (1, 2):
                charge = 5 * (fault == 3)
                ways += [(to, charge, "K") for to in ("s", "u", "a") if initial == to and (to == follow[last] or (to, last) == ("s", ""))]
                ways.append((follow[last], charge + 1, "R"))
            for to, more, letter in ways:
                way = cost + more, audit + letter
                after[to] = min(after.get(to, way), way)
        best = inserted(after)
    return min(best[last] for last in ("", "a") if last in best)


def test_cheapest_repairs():
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randrange(0, 9)
        initials, faults = [rng.choice("suuaaat") for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert repair.cheapest(initials, faults) == brute_repair(initials, faults), (initials, faults)
    initials, faults = [rng.choice("suuaaat") for _ in range(900)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(900)]
    assert repair.cheapest(initials, faults) == brute_repair(initials, faults)


def test_long_conversations_take_steps_in_proportion():
    n = 100_000
    cost, audit = repair.cheapest(["u", "a", "t", "u"] * (n // 4), [0, 3, 0, 0] * (n // 4))
    assert len(audit) >= n and cost > 0


def test_audits_compare_as_text():
    rng, nodes = random.Random(1), [repair.Audit(None)]
    children = {}
    for _ in range(400):
        up, letter = rng.choice(nodes[-30:]), rng.choice("DIKR")
        if (id(up), letter) not in children:
            nodes.append(children.setdefault((id(up), letter), repair.Audit(up, letter)))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert (a < b) == (str(a) < str(b))


def brute_repaired(rows):
    """What op13 returns, from the words of its definition."""
    blank = lambda x: " " if x is None else str(x)
    found = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, blank(r[2]), blank(r[3]))):
            kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
            role, text = blank(role), blank(text)
            if kind:
                own += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = brute_repair(initials, faults)
        rest, out = iter(own), []
        for letter in audit:
            row = next(rest) if letter != "I" else (0, "", "")
            if letter != "D":
                shift = 1 if out and out[0][0][:1] == "s" else 0
                out.append((row[1] if letter == "K" else ("user", "assistant")[(len(out) - shift) % 2], row[2]))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
        turns = {t for t, *_ in own if t is not None}
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )
    return found


def through(monkeypatch, query, df):
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return queries.QUERIES[query](df.sparkSession, "")


def test_repair(monkeypatch, odd_talks, no_talks):
    rows = [tuple(r) for r in odd_talks.select("conv_id", "turn", "role", "text").collect()]
    got = through(monkeypatch, "op13_repair", odd_talks).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repaired(rows) and len(got) == len({r[0] for r in rows})
    assert through(monkeypatch, "op13_repair", no_talks).count() == 0


def brute_trie(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            token = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            talks[conv].append(((turn is not None, turn or 0, token), (role or "", text or "")))
    turns = {c: [t for _, t in sorted(x)] for c, x in talks.items()}
    rebuilt = {c: turns.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + turns[c][h:] for c in turns}
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        children[node[:-1]] += bool(node)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * (len(WORD.findall(node[-1][1])) if node else 0)
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(rebuilt[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize(("run_bytes", "memory_bytes", "tasks"), [(1 << 20, 1 << 26, 8), (300, 0, 2), (500, 2000, 1), (400, 900, 40)])
def test_prefix_trie(spark, odd_talks, no_talks, run_bytes, memory_bytes, tasks):
    """Of one run a task, or of many, in memory and in the shared folder, in one range or in many."""
    rows = [tuple(r) for r in odd_talks.select("conv_id", "turn", "role", "text").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    got = prefix_trie.prefix_trie(odd_talks, 20, run_bytes, memory_bytes).drop("node").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(str(tuple(r)) for r in got) == brute_trie(rows)
    assert prefix_trie.prefix_trie(no_talks).count() == 0


def test_loser_tree(tmp_path):
    """Runs merge in order, with the LCPs of neighbours; shared turns are compared about once a row."""
    rng = random.Random(2)
    turn = lambda: rng.randrange(2).to_bytes(prefix_trie.TURN, "big")
    rows = [(b"".join(turn() for _ in range(rng.randrange(40))), 1, i) for i in range(2000)]
    for memory in (0, 20_000, 1 << 30):
        got = list(prefix_trie.merged(iter(rows), f"file://{tmp_path}/runs", 4000, memory))
        assert [r[0] for _, r in got] == sorted(r[0] for r in rows) and sorted(r for _, r in got) == sorted(rows)
        assert [lcp for lcp, _ in got[1:]] == [prefix_trie.shared_turns(a[1][0], b[1][0]) for a, b in zip(got, got[1:])]
    assert not list((tmp_path / "runs").iterdir())
    long = [(bytes(prefix_trie.TURN * 1000) + i.to_bytes(prefix_trie.TURN, "big"), 1, i) for i in range(256)]
    tree = prefix_trie.LoserTree([prefix_trie.sorted_run(long[k::16]) for k in range(16)])
    assert len(list(tree)) == 256 and tree.compared < 20_000  # a plain tree compares 256 * 4 * 1000 turns
