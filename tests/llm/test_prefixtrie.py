import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from calibrium.llm import prefixtrie as P

TURNS = "conv_id long, turn long, role string, text string, depth string, g string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    for turns in own.values():
        turns.sort(key=lambda t: t[:2])
    paths = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        rest = abs(conv) % 20
        base = conv - rest if conv >= 0 else conv + rest
        paths[conv] = [t[2:] for t in own.get(base, [])[:h] + own[conv][h:]]
    nodes = defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(conv)
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * words
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items()), key=str
    )


def same(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", None) for r in rows], TURNS).repartition(5)
    got = P.trie(frame, **more)
    assert got.columns == P.NODE
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def talk(n, seed, words=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randrange(1, words)))) for c in range(n) for t in range(rng.randrange(1, 7))]


@pytest.mark.parametrize("bound", [1, 40, 10_000])
def test_against_brute_force(spark, bound):
    same(spark, talk(160, bound), least_turns=bound, most_turns=bound)


def test_hot_first_turns_and_copies(spark):
    rows = [(c, t, "system", "the same long opening" if t < 4 else f"turn {t} of {c % 3}") for c in range(120) for t in range(4 + c % 5)]
    rows += [(1000 + c, t, "user", "a copy") for c in range(50) for t in range(3)]
    same(spark, rows, least_turns=9, most_turns=9)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (0, None, None, None), (0, 2, "user", "b"), (0, 2, "user", "a"), (0, 2, "user", "a"), (7, 0, "user", "only"), (21, 5, "", ""), (40, 1, "u", "x y\n z"), (43, None, "u", None), (-3, 1, "u", "n"), (-20, 1, "u", "m")]
    rows += [(2**63 - 1, 0, "user", "w " * 5000), (2**63 - 1, 1, "user", "")]
    same(spark, rows)
    same(spark, rows, least_turns=1, most_turns=1)
    same(spark, [])


def test_one_very_long_conversation(spark):
    rows = [(5, t, "user", f"t {t}") for t in range(160)] + [(25, t, "user", f"t {t}") for t in range(150)]
    same(spark, rows, least_turns=20, most_turns=20)


def test_ends_of_a_path_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_IDS", 3)
    frame = spark.createDataFrame([("p", i) for i in range(20, 0, -1)] + [("q", 7)], "pid string, conv_id long").repartition(3)
    got = {tuple(r) for r in P.ends(frame).select("pid", "conv_id", "n", "sha").collect()}
    assert got == {("p", 1, 20, sha256(",".join(map(str, range(1, 21))).encode()).hexdigest()), ("q", 7, 1, sha256(b"7").hexdigest())}
