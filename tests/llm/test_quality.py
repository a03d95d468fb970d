"""Quality rules against regular expressions, the language model and its bands against plain dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from voicewright.llm import quality

SCHEMA = "doc_id long, text string, lang string, quality string, bits double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside)


def kneser_ney(texts, order=quality.ORDER):
    """Probability of each n-gram of the highest order, by recursion over dictionaries."""
    top = Counter()
    for t in texts:
        data = b"\xff" * (order - 1) + t.encode()
        top.update(data[i : i + order] for i in range(len(data) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    below = None
    for k in range(1, order + 1):
        n = [sum(c == i for c in counts[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.0
        d = [0.0] + [min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.0 for i in (1, 2, 3)]
        total, taken = defaultdict(int), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            taken[g[:-1]] += min(d[min(c, 3)], c)
        below = {g: (c - min(d[min(c, 3)], c)) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * (below[g[1:]] if k > 1 else 1 / 256) for g, c in counts[k].items()}
    return below


def middle(values):
    values = sorted(round(v * 1024) for v in values)  # rounding half to even differs from Spark's only on exact halves
    return values[len(values) // 2] / 1024 if values else None


def plain(rows):
    langs = defaultdict(list)
    for _, text, lang in rows:
        langs[lang or ""].append(text or "")
    models = {k: kneser_ney(v) for k, v in langs.items()}
    out = []
    for doc, text, lang in rows:
        text, model, o = text or "", models[lang or ""], quality.ORDER
        data = b"\xff" * (o - 1) + text.encode()
        bits = [-math.log2(model[data[i : i + o]]) for i in range(len(data) - o + 1)]
        b = base(text)
        out.append([doc, lang or "", *b, b[0] < 50 or 100 * b[4] > 50 * b[0], sum(bits) / len(bits) if bits else None, len(bits)])
    for lang in langs:
        own = [r for r in out if r[1] == lang and not r[7]]
        mid = middle([r[8] for r in own])
        off = [(abs(r[8] - mid) * 1.4826, r[9]) for r in own]
        spread, each = middle([x for x, _ in off]), middle([x * math.sqrt(n) for x, n in off])
        for r in out:
            if r[1] == lang:
                r.append(not r[7] and abs(r[8] - mid) <= quality.WIDTH * max(spread, quality.LEAST_SPREAD, max(each, quality.LEAST_BYTE_SPREAD) / math.sqrt(r[9])))
    return sorted((r[0], *r[2:8], r[10], None if r[8] is None else round(r[8], 9)) for r in out)


def documents(rng):
    said = lambda n, parts: " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, said(rng.randrange(45, 160), ["the", "an", "er", "ing", "st"]), "en") for i in range(60)]
    rows += [(100 + i, said(120, ["über", "schlag", "ñu", "を"]), rng.choice(["de", None])) for i in range(25)]
    rows += [(200, said(80, ["the", "an"]).upper().replace(" ", "!! "), "en"), (201, said(90, ["$%", "&|", "<#"]), "en"), (202, "a b c " * 60, "en"), (203, "the an\n" * 40 + said(60, ["er", "ing"]), "en")]
    rows += [(300, None, "en"), (301, "", None), (302, " \n\t ", "fr"), (303, "x", "fr"), (304, said(20_000, ["the", "ing"]), "en"), (305, "w " * 49 + "\r\x1cw\n\nw\n", ""), rows[0]]
    return rows


def test_base_measures():
    import numpy as np

    rng = random.Random(1)
    texts = [t or "" for _, t, _ in documents(rng)] + ["".join(rng.choices("ab# \n\t\r|é\x1c", k=rng.randrange(60))) for _ in range(300)]
    for some in (texts, texts[:1], [""], []):
        data = [t.encode() for t in some]
        got = quality.base_measures(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert list(zip(*(g.tolist() for g in got))) == [base(t) for t in some]


@pytest.mark.parametrize("most", [quality.shared.SENT_BYTES, 20_000])
def test_query(spark, tmp_path, monkeypatch, most):
    rows = documents(random.Random(2))
    monkeypatch.setattr(quality.measure, "__defaults__", ("text", "lang", "quality", most))  # a small bound sends the model in parts
    monkeypatch.setattr(quality, "HELD", 500)
    spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = quality.op13_quality_rules(spark, str(tmp_path)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits_per_byte").collect()
    got = sorted((*r[:8], None if r[8] is None else round(r[8], 9)) for r in found)
    assert got == plain(rows)
    kept = {r[0]: r[7] for r in got}
    assert not kept[200] and not kept[201] and sum(kept[i] for i in range(60)) > 40


def test_unseen_text_and_empty_table(spark, tmp_path):
    train = spark.createDataFrame([("abcabcab", "en"), ("abd", "en")], "text string, lang string")
    model = quality.estimate(quality.count_grams(train))
    other = spark.createDataFrame([("zzabc", "en", 1), ("abc", "xx", 2)], "text string, lang string, n int")
    bits = {r.n: r.quality.bits for r in quality.measure(other, model).collect()}
    assert bits[2] == 24 and 0 < bits[1] < 40
    total = sum(2 ** -quality.Arrays(model.filter("lang = 'en'").toArrow()).cost(quality.np.arange(256, dtype=quality.np.uint32) + (ord("a") << 16) + (ord("b") << 8)))
    assert abs(total - 1) < 1e-9
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert quality.op13_quality_rules(spark, str(tmp_path)).collect() == []


def whole_model(texts, order=quality.ORDER):
    """As ``kneser_ney``, with an end mark; n-grams that begin with the begin mark keep their own counts in lower orders."""
    counts = {order: Counter(), **{k: Counter() for k in range(1, order)}}
    for t in texts:
        data = b"\xff" * (order - 1) + t.encode() + b"\xfe"
        counts[order].update(data[i : i + order] for i in range(len(data) - order + 1))
    for k in range(order - 1, 0, -1):
        for g, c in counts[k + 1].items():
            counts[k][g[1:]] += c if g[1] == 0xFF else 1
    below = None
    for k in range(1, order + 1):
        n = [sum(c == i for c in counts[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.0
        d = [0.0] + [min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.0 for i in (1, 2, 3)]
        total, taken = defaultdict(int), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            taken[g[:-1]] += min(d[min(c, 3)], c)
        below = {g: (c - min(d[min(c, 3)], c)) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * (below[g[1:]] if k > 1 else 1 / 256) for g, c in counts[k].items()}
    return below


@pytest.mark.parametrize("most", [quality.shared.SENT_BYTES, 20_000])
def test_whole_texts(spark, tmp_path, monkeypatch, most):
    rows = documents(random.Random(3))
    monkeypatch.setattr(quality.measure, "__defaults__", ("text", "lang", "quality", most))
    spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = quality.op13_quality_rules(spark, str(tmp_path)).collect()
    o, models, want = quality.ORDER, {}, []
    for doc, text, lang in rows:
        text, lang = text or "", lang or ""
        if lang not in models:
            models[lang] = whole_model([t or "" for _, t, other in rows if (other or "") == lang])
        data = b"\xff" * (o - 1) + text.encode() + b"\xfe"
        bits = sum(-math.log2(models[lang][data[i : i + o]]) for i in range(len(data) - o + 1))
        b = base(text)
        want.append([doc, lang, b[0] < 50 or 100 * b[4] > 50 * b[0], len(text.encode()), bits / (len(text.encode()) + 1) if text else None])
    for lang in models:
        own = [r for r in want if r[1] == lang and not r[2]]
        mid = middle([r[4] for r in own])
        off = [(abs(r[4] - mid) * 1.4826, r[3]) for r in own]
        spread, each = middle([x for x, _ in off]), middle([x * math.sqrt(n) for x, n in off])
        for r in want:
            if r[1] == lang:
                r.append(not r[2] and abs(r[4] - mid) <= quality.WIDTH * max(spread, quality.LEAST_SPREAD, max(each, quality.LEAST_BYTE_SPREAD) / math.sqrt(r[3])))
    rounded = lambda x: None if x is None else round(x, 9)
    assert sorted((r.doc_id, r.kept, rounded(r.whole_bits_per_symbol)) for r in found) == sorted((r[0], r[5], rounded(r[4])) for r in want)


def test_ends(spark):
    model = quality.estimate(quality.count_grams(spark.createDataFrame([("abcabcab", "en"), ("abd", "en"), ("", "en")], "text string, lang string")))
    texts = spark.createDataFrame([("abcab", "en", 1), ("abcabc", "en", 2), ("abc", "xx", 3), ("", "xx", 4), (None, "en", 5)], "text string, lang string, n int")
    got = {r.n: r.quality for r in quality.measure(texts, model).collect()}
    assert got[3].whole_bits == 32 and got[4].whole_bits == 8 and got[5].bits == 0 < got[5].whole_bits < 8
    own = quality.Arrays(model.filter("lang = 'en'").toArrow(), whole=True)
    end = lambda context: own.cost(quality.np.array([int.from_bytes(context + b"\xfe", "big")], quality.np.uint32))[0]
    assert end(b"ab") < 3 and end(b"\xff\xff") < 3 and end(b"bc") > end(b"ab") + 1  # one of four goes on with "d", none ends after "bc"
    assert got[2].whole_bits - got[2].bits > got[1].whole_bits - got[1].bits
    for context in (b"ab", b"bc", b"\xff\xff", b"\xffa", b"zz"):
        keys = quality.np.arange(256, dtype=quality.np.uint32) + int.from_bytes(context + b"\0", "big")
        assert abs(sum(2 ** -own.cost(keys)) - 1) < 1e-9
