"""The trie of prefixes against a plain one, with few and many ranges."""

import hashlib
import random
import zlib

import pytest

from voicewright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string"


def plain(turns):
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(rows)] for c, rows in own.items()}
    members = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        path = tuple(own.get(base, [])[:h] + rows[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    children = {p: 0 for p in members}
    leaves, saved = dict(children), dict(children)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        mine = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += mine
            leaves[p[:d]] += not children[p]
    low = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted(
        (low[p], len(p), low[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c, end in m if end))).encode()).hexdigest()) for p, m in members.items()
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def table(rng, n):
    rows = []
    for c in rng.sample(range(-9, 4 * n), n):
        rows += [(c, t if rng.random() < 0.97 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None, "é" * 3])) for t in range(rng.randrange(1, 12))]
    rows += [(1000 + k, t, "user", f"copy {t}") for k in range(60) for t in range(10)]  # copies
    rows += [(2000 + k, t, "user", "hi" if t < 9 else f"own {k}") for k in range(200) for t in range(10)]  # many children
    rows += [(5003, t, "user", "long " * (t % 7)) for t in range(700)] + [(5004, t, "user", "long " * (t % 7)) for t in range(650)]
    return rows + [(None, 1, "user", "nobody's"), (5100, 0, "user", "x" * 400_000), rows[0]]


@pytest.mark.parametrize("shards", [1, 40])
def test_trie(spark, monkeypatch, shards):
    rows = table(random.Random(shards), 80)
    monkeypatch.setattr(trie, "HELD", 20)
    monkeypatch.setattr(trie, "SKELETON_BYTES", 60 * trie.UNIT * 30)  # long splitters are cut
    turns = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    paths = trie.forked(trie.ordered_units(turns))
    if shards > 1:
        assert len(trie.splitters(paths, shards)) >= shards // 2
    assert rows_of(trie.prefix_trie(paths, shards)) == plain(rows)


def test_query_and_empty(spark, tmp_path):
    rows = table(random.Random(5), 30)
    for name, some in (("a", rows), ("b", [])):
        spark.createDataFrame([(*r, "x") for r in some], SCHEMA).write.parquet(str(tmp_path / name / "conversations.parquet"))
        assert rows_of(trie.op12_prefix_trie(spark, str(tmp_path / name))) == plain(some)
