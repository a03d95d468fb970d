"""Repair of conversations: the parser against all edits of short conversations, the job against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from voicewright.llm import repair

RIGHT = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit) over all edits of ``rows`` (initial, must go, truncated), with up to three insertions at each place."""
    best = None
    gaps = ["".join(p) for n in range(4) for p in itertools.product("ua", repeat=n)]
    for middle in itertools.product(*(["D"] if forced else ["D", "K", "Ru", "Ra"] for _, forced, _ in rows)):
        for gap in itertools.product(gaps, repeat=len(rows) + 1):
            if sum(map(len, gap)) > 4:
                continue
            said, audit, cost = gap[0], "I" * len(gap[0]), 2 * len(gap[0])
            for (initial, _, cut), edit, more in zip(rows, middle, gap[1:]):
                audit += edit[0] + "I" * len(more)
                cost += {"D": 3, "K": cut, "R": 2 + cut}[edit[0]] + 2 * len(more)
                said += {"D": "", "K": initial or "?", "R": edit[1:]}[edit[0]] + more
            if RIGHT.fullmatch(said) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_states(rows):
    """The same for long conversations: four states, whole audits."""
    def open_(at):
        at = dict(at)
        for _ in range(3):
            for a, b in (("", "u"), ("s", "u"), ("b", "u"), ("u", "b")):
                if a in at:
                    way = (at[a][0] + 2, at[a][1] + "I")
                    at[b] = min(at.get(b, way), way)
        return at

    at = {"": (0, "")}
    for initial, forced, cut in rows:
        new = {}
        for state, (cost, audit) in open_(at).items():
            ways = [(state, (cost + 3, audit + "D"))]
            go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("b", "u"): "u", ("u", "a"): "b"}
            if not forced:
                ways += [(go.get((state, initial)), (cost + cut, audit + "K"))] + [(go.get((state, x)), (cost + 2 + cut, audit + "R")) for x in "ua"]
            for to, way in ways:
                if to is not None:
                    new[to] = min(new.get(to, way), way)
        at = new
    at = open_(at)
    return min(at[s] for s in ("", "b") if s in at)


def parsed(rows, size):
    parser, chain = repair.Parser(), repair.Chain()
    for k in range(0, len(rows), size):
        chain.piece([(e, to, cost, "".join(letters)) for e in (repair.STACKS if k else repair.STACKS[:1]) for to, cost, letters in parser.parse(e, [(*r, 1) for r in rows[k : k + size]])])
    cost, tail, ways = chain.end()
    text = ""
    for k, way in zip(range(0, len(rows), size), ways):
        every = [letters for e in (repair.STACKS if k else repair.STACKS[:1]) for _, _, letters in parser.parse(e, [(*r, 1) for r in rows[k : k + size]])]
        text += "".join(every[way])
    return cost, text + tail


def test_parser_is_exact():
    rng = random.Random(3)
    for _ in range(30):
        rows = [(rng.choice("suuaa") if rng.random() < 0.9 else "", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(4))]
        want = cheapest(rows)
        assert parsed(rows, 99) == parsed(rows, 1) == by_states(rows) == want, rows
    for n in (30, 200):
        rows = [(rng.choice("suuuaaa"), rng.random() < 0.1, rng.random() < 0.3) for _ in range(n)]
        assert parsed(rows, 7) == parsed(rows, 1000) == by_states(rows)


def plain(turns):
    """What op11 gives, by loops."""
    rows = []
    for conv, turn, role, text in turns:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, flags, n = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            flags.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = by_states(flags)
        given = [r[1] for r in own if r[1] is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        fixed, rest = [], iter(own)
        for letter in audit:
            row = None if letter == "I" else next(rest)
            role = "assistant" if fixed and fixed[-1][:1] == "u" else "user"
            if letter != "D":
                fixed.append((row[2] if letter == "K" else role) + ":" + ("" if letter == "I" else row[3]))
        assert RIGHT.fullmatch("".join(f[:1] for f in fixed))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, text_ string"


@pytest.mark.parametrize("size", [2, 1024])
def test_job_equals_loops(spark, tmp_path, monkeypatch, size):
    rng = random.Random(size)
    texts = ["Yes.", "No", "What?", " ", "", None, "Well! ", "a\nb.\n", "x" * 300_000 + "."]
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None)] + rows[:7]
    rows += [(77, t, "user" if t % 3 else "assistant", f"Turn {t % 50}.") for t in range(400)]  # one long conversation with repeats
    rows += [(78, 5, "user", "Same.")] * 50
    path = tmp_path / "conversations.parquet"
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5).write.parquet(str(path))
    monkeypatch.setattr(repair, "PIECE", size)
    monkeypatch.setattr(repair.repair, "__defaults__", ("conv_id", "turn", "role", "text", size))
    found = {r.conv_id: tuple(r)[1:] for r in repair.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert found == plain(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.op11_conversation_repair(spark, str(tmp_path)).collect() == []


def test_operator_gives_rows(spark):
    turns = spark.createDataFrame([("c", 1, "assistant", "Fine."), ("c", 0, "system", "Be kind."), ("c", 3, "user", "Then?")], "conv_id string, turn int, role string, text string")
    fixed, report = repair.repair(turns)
    assert [tuple(r) for r in fixed.collect()] == [("c", 0, "K", "system", "Be kind."), ("c", 1, "I", "user", ""), ("c", 2, "K", "assistant", "Fine."), ("c", 3, "K", "user", "Then?"), ("c", 4, "I", "assistant", "")]
    assert report.first().audit == "KIKKI" and report.first().cost == 4 and report.first().gaps == 1
