"""Conversation prefix trie against a trie of rebuilt conversations, node by node."""

import hashlib
import random
from collections import defaultdict
from math import fmod
from zlib import crc32

import pytest

from demandgrid.llm import prefix_trie

from .conftest import pick

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, c string, depth string, x string, w string, cell string, pos string"


def plain_trie(rows):
    stored = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            stored[c].append(((turn is not None, turn or 0), role.encode(), text[:128].encode(), hashlib.md5(text.encode()).hexdigest(), (role, text)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in stored.items()}
    built = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - int(fmod(c, 20)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        words = len(prefix[-1][1].encode().split()) if prefix else 0
        saved[prefix] = (len(members[prefix]) - 1) * words + sum(saved[k] for k in kids[prefix])
        leaves[prefix] = sum(leaves[k] for k in kids[prefix]) or 1
    out = []
    for prefix, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(prefix))))
        out.append((min(m), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(m), len(kids[prefix]), leaves[prefix],
                    saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def turns():
    """Shared first turns, copies, a hot long conversation, nulls, ties, repeats, odd ids, bases without rows."""
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 70, 1), *range(105, 118), -5, -20, -39]:
        start = rng.randrange(3)
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"opening {start} of \n many  " * (t < 3) + (f"own {rng.randrange(4)}" if t > 1 else "")))
    rows += [(200, t, "user", f"hot {t % 7}") for t in range(300)]
    rows += [(220 + i, t, "user", f"copy {t}") for i in range(30) for t in range(5)]
    rows += [(300, None, "user", "b"), (300, None, "assistant", None), (300, 1, None, "tie"), (300, 1, None, "tie"), (300, 1, "user", "a"),
             (300, 1, "user", "x" * 200 + "1"), (300, 1, "user", "x" * 200 + "2"), (None, 1, "user", "nobody's"), (301, 0, None, None),
             (302, 0, "user", "z " * 40_000)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([r + ("x",) * 6 for r in rows], SCHEMA).repartition(6)


def test_trie(spark, turns):
    out = prefix_trie.prefix_trie(frame(spark, turns))
    assert sorted(pick(out, *NAMES), key=str) == plain_trie(turns)
    assert prefix_trie.prefix_trie(frame(spark, turns[:1]).limit(0)).count() == 0


def test_other_hashes_when_turns_agree(spark, turns, monkeypatch):
    few = [r for r in turns if r[0] is not None and 200 < r[0]]
    fine, turn_hashes = prefix_trie.bases, prefix_trie.turn_hashes
    tried = []

    def constant(role, text, seed):
        tried.append(seed)
        a, b = turn_hashes(role, text, seed)
        return (a * 0, b * 0) if seed == prefix_trie.SEEDS[0] else (a, b)

    monkeypatch.setattr(prefix_trie, "turn_hashes", constant)
    out = prefix_trie.prefix_trie(frame(spark, few))
    assert sorted(pick(out, *NAMES), key=str) == plain_trie(few) and set(tried) == set(prefix_trie.SEEDS[:2])
    monkeypatch.setattr(prefix_trie, "turn_hashes", turn_hashes)
    # a base of 1 forgets the order of turns, so that two orders of the same turns agree
    monkeypatch.setattr(prefix_trie, "bases", lambda seed: [1] * 4 if seed == prefix_trie.SEEDS[0] else fine(seed))
    swapped = few + [(400 + 4 * i, t, "user", f"s {(t + i) % 2}") for i in range(40) for t in range(2)]
    out = prefix_trie.prefix_trie(frame(spark, swapped))
    assert sorted(pick(out, *NAMES), key=str) == plain_trie(swapped)
