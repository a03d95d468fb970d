"""The text operators against brute force, round trips and held-out rows, on small tables with odd rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicewright.llm import bpe, chat, decontaminate, jaccard_join, licenses, lz, pii, shared, suffix_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, id string"


def odd_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_ = say(6000)
    near = say(200)
    edit = near.split()
    edit[50] = "changed"
    texts = [None, "", " \n\t ", "one", "one two three", "One Two THREE", near, " ".join(edit), near, long_, long_ + " end", "a" * 2000, "ab" * 700, "x " + "a" * 900, "日本語 テキスト " * 30, say(30), say(30)]
    passage = say(90)
    texts += [say(40) + " " + passage + " " + say(40), say(20) + " " + passage, passage + " tail", "mail a.b@c.de or +1 (377) 555-0271, 3775550271, 10.0.0.1 and 4111 1111 1111 1111"]
    rows = [(i, t, "en", "s", None, "k", "x") for i, t in enumerate(texts)]
    return rows + [(6, near, None, None, 1, None, None), (None, near, None, None, 1, None, None), (None, "lonely text of a null id here", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_bpe_is_tiktokens(spark, docs, none):
    tt = tiktoken_encoding()
    rows = bpe.round_trip(docs).collect()
    want = sorted((r[0] if r[0] is not None else -1, len(i := tt.encode_ordinary(r[1] or "")), sha(array("I", i).tobytes()), sha((r[1] or "").encode())) for r in odd_rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert all(r.exact for r in rows)
    assert bpe.round_trip(none).count() == 0
    back = bpe.decode(bpe.encode(docs, offsets=True)).filter("text is not null").collect()
    assert all(r.text == r.bpe_text and len(r.bpe_ids) == len(r.bpe_starts) == len(r.bpe_ends) for r in back)
    codec = bpe.Codec.of(bpe.public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZ  '\n\t.,!019éß\u0085\x1c中😀") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert [list(array("I", x)) for x in codec.encode(texts)] == [tt.encode_ordinary(t) for t in texts]
    split = codec.encode(["😀"])[0]
    assert codec.decode([split[:4]])[0].decode(errors="ignore") == "" and codec.decode([split])[0].decode() == "😀"


def test_token_counts(spark, docs, none, monkeypatch, tmp_path):
    tt = tiktoken_encoding()
    monkeypatch.setattr(token_counts, "BLOCK_IDS", 512)
    monkeypatch.setattr(token_counts, "RANGE_BLOCKS", 2)
    monkeypatch.setattr(token_counts, "SPAN", 3)
    files, names, end = token_counts.write_flat(docs, str(tmp_path / "flat"))
    want = sorted((r[0] is None, r[0] or 0, len(tt.encode_ordinary(r[1] or ""))) for r in odd_rows())
    count = lambda files: names.join(token_counts.scan(token_counts.read_flat(files), end), ["file", "ordinal"], "left").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in count(files)) == want
    listed = token_counts.flat_files(spark, str(tmp_path / "flat"))
    assert listed.count() == files.count() and {r.bytes for r in listed.collect()} == {r.bytes for r in files.collect()}
    for kind, width in ((np.uint16, 2), (np.uint32, 4)):
        flat = spark.createDataFrame([(f, k, None if x is None else np.array(x, kind).tobytes(), width) for f, k, x in ((0, 0, [1, 2, 9]), (0, 1, [3]), (0, 2, [9, 9, 4]), (1, 0, []), (2, 0, None))], "file int, block long, ids binary, width int")
        assert sorted(map(tuple, token_counts.scan(flat, 9).collect())) == [(0, 0, 2), (0, 1, 1), (0, 2, 0), (0, 3, 1)]
    # Files of both widths, longer than a range and ending within a document, against one pass over all ids.
    rng = np.random.default_rng(3)
    for name, kind in (("a.u16", np.uint16), ("b.u32", np.uint32), ("c.u16", np.uint16)):
        ids = rng.integers(0, 40, 0 if name[0] == "c" else 5000).astype(kind)
        ids.tofile(tmp_path / name)
        (tmp_path / "other.bin").write_bytes(b"x")
        ends = np.flatnonzero(ids == 7)
        runs = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
        runs = runs if len(ids) and ids[-1] != 7 else runs[:-1]
        got = token_counts.scan(token_counts.read_flat(token_counts.flat_files(spark, str(tmp_path / name))), 7).orderBy("ordinal").collect()
        assert [r.n_tokens for r in got] == runs.tolist()
    files, names, end = token_counts.write_flat(none)
    assert files.count() == 0 and token_counts.scan(token_counts.read_flat(files), end).count() == 0


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(rows):
    sets = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0] is None, r[0] or 0, len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))


def test_jaccard_join(spark, docs, none):
    got = jaccard_join.classes(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == components_of(odd_rows())
    assert jaccard_join.classes(none).count() == 0


def test_jaccard_join_finds_links_at_the_threshold(spark):
    """Families of edits around the threshold, passages shared by unlinked texts, chains, and many copies."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [say(60) for _ in range(4)]
    rows = []
    for _ in range(12):
        base = say(rng.randint(20, 120))
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(t)
    for p in passages:
        rows += [say(rng.randint(3, 25)) + p + say(rng.randint(0, 12)) for _ in range(14)]
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)] + [(1000 + i, "the same five words here") for i in range(20)]
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in got) == components_of(rows)


def test_jaccard_join_of_a_large_family(spark, monkeypatch):
    """Many sets that share one passage, most not linked to the leader, in blocks of few."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 3_000)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage = say(40)
    rows = []
    for i in range(150):
        t = say(rng.randint(4, 14)) + passage + say(rng.randint(0, 12))
        rows.append(t)
        if i % 5 == 0:
            rows.append(t[:-1] + ["other"])
            rows.append(["start"] + t)
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in got) == components_of(rows)


def test_jaccard_join_derives_overlaps():
    """The condition on differences is that on whole sets, for blocks of one side and of two."""
    rng = np.random.default_rng(5)
    for trial in range(60):
        lead = np.arange(40)
        sets = [np.setdiff1d(np.union1d(rng.choice(lead, rng.integers(15, 41), False), rng.integers(100, 110, rng.integers(0, 9))), []).astype(np.int64) for _ in range(14)]
        less, more = [np.setdiff1d(lead, s) for s in sets], [np.setdiff1d(s, lead) for s in sets]
        cost = np.array([4 * len(a) + 3 * len(b) for a, b in zip(less, more)])
        tokens = [np.concatenate([a, b]) for a, b in zip(less, more)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        right = np.arange(14) >= 6 if trial % 2 else np.zeros(14, bool)
        ids = np.array([bytes([i]) for i in range(14)], object)
        comp = np.where(cost <= 40, 0, np.arange(1, 15))
        got = list(jaccard_join._block_links(ids, comp, cost, np.concatenate(tokens), at, right, 40))

        def parts(edges):
            top = {int(c): int(c) for c in comp}
            for a, b in edges:
                x, y = top[a], top[b]
                top = {k: (x if v == y else v) for k, v in top.items()}
            return {frozenset(k for k in top if top[k] == v) for v in top.values()}

        want = []
        for i in range(14):
            for j in range(14):
                if i != j and comp[i] != comp[j] and (not right.any() or right[i] != right[j]):
                    n = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                        want.append((int(comp[i]), int(comp[j])))
        assert parts([(int(comp[u[0]]), int(comp[v[0]])) for u, v in got]) == parts(want)


def test_pii(spark, docs, none):
    rng = random.Random(2)
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = {}
        for k, rule in rules.items():
            out[k] = []
            for m in re.finditer(rule, t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[k]():  # noqa: B023
                    out[k].append(m.span())
        return out

    for _ in range(20_000):
        t = "".join(rng.choice("a@.-+ 0123456789(3.1@b") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("4" * 30_000 + "@" * 5_000)["card"] == []
    field = pii.train(shared.read(spark, "/root/testdata/sf0.01", "documents"))
    rows = {r.doc_id: r for r in pii.find(docs, field=field).collect()}
    last = rows[20]
    base, every = last.pii_base.split(","), last.pii_spans.split(",")
    assert len(base) == 4 and set(base) < set(every) and "phone:36:46" in every
    assert rows[0].pii_spans == rows[1].pii_spans == ""
    masked = {r.doc_id: r.text for r in pii.mask(docs, field=field).collect()}
    assert masked[20] == "mail [EMAIL] or [PHONE], [PHONE], [IP] and [CARD]" and masked[0] is None
    assert pii.find(none).count() == 0


def test_pii_labels_reach_far_tokens():
    """On a chain of equal tokens, the marginals are those of the product of the edges' tables."""
    n, kinds = 40, len(pii.KINDS) + 1
    labels = np.zeros(n, np.int64)
    labels[0] = 4
    nothing = np.zeros((kinds, kinds))
    field = pii.Field(np.zeros((len(pii._shape("0")), kinds)), nothing, 4 * np.eye(kinds))
    skip = np.stack([np.arange(n - 1), np.arange(1, n)], 1)
    p = field.marginals(pii.Graph([(i, i + 1) for i in range(n)], np.zeros((n, len(pii._shape("0")))), labels, np.zeros((0, 2), np.int64), skip))
    row = np.eye(kinds)[4]
    for k in range(1, n):
        row = row @ np.exp(4 * np.eye(kinds))
        row /= row.sum()
        assert np.allclose(p[k], row, atol=1e-3), k


def test_pii_marginals_are_exact_on_trees():
    """Message passing gives the marginals that summing over all labellings gives, of nodes and of edges, for both sorts of edges."""
    rng = np.random.default_rng(4)
    kinds = len(pii.KINDS) + 1
    for _ in range(6):
        n = 5
        edges = np.array([(rng.integers(0, j), j) for j in range(1, n)])
        own, table = rng.normal(size=(n, kinds)), rng.normal(size=(n - 1, kinds, kinds))
        node, pair = np.zeros((n, kinds)), np.zeros((n - 1, kinds, kinds))
        for labels in itertools.product(range(kinds), repeat=n):
            w = np.exp(sum(own[i, k] for i, k in enumerate(labels)) + sum(table[e, labels[a], labels[b]] for e, (a, b) in enumerate(edges)))
            node[np.arange(n), labels] += w
            for e, (a, b) in enumerate(edges):
                pair[e, labels[a], labels[b]] += w
        p, q = pii.pass_messages(own, edges, table)
        assert np.allclose(p, node / node.sum(1, keepdims=True), atol=1e-4) and np.allclose(q, pair / pair.sum((1, 2), keepdims=True), atol=1e-4)


def test_pii_fit_raises_the_likelihood(spark):
    """Fitted potentials make the held labels likelier than flat ones, and hidden repeats of held-out texts get their label back."""
    texts = [r.text for r in shared.read(spark, "/root/testdata/sf0.01", "documents").filter("text rlike '[0-9@]'").orderBy("doc_id").select("text").collect()]
    half = len(texts) // 2
    field = pii.fit(texts[:half])
    right = total = 0
    told, flat = [], np.log(1 / (len(pii.KINDS) + 1))
    for t in texts[half:]:
        g = pii.graph(t, pii.base_spans(t))
        free = field.marginals(pii.Graph(g.spans, g.shapes, np.zeros_like(g.labels), g.chain, g.skip)) if len(g.spans) else None
        told += [float(np.log(free[i, g.labels[i]])) for i in np.flatnonzero(g.labels)]
        for i in np.unique(g.skip):
            if g.labels[i] and len(set(g.labels[j] for e in g.skip if i in e for j in e)) == 1:
                hidden = g.labels.copy()
                hidden[i] = 0
                p = field.marginals(pii.Graph(g.spans, g.shapes, hidden, g.chain, g.skip))[i]
                total += 1
                right += int(p.argmax() == g.labels[i])
    assert np.mean(told) > flat + 1 and total >= 8 and right / total > 0.95, (np.mean(told), total, right)


def test_lz(spark, docs, none):
    texts = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = lz.compare_edited(docs).collect()
    assert len(got) == len(texts)
    want = []
    for (i, t), (_, u) in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = (lz.signature(x.encode()) for x in (t, edited, u))
        want.append((i, len(t), sha(edited.encode()), a.tobytes().hex(), b.tobytes().hex(), lz.likeness(a, b, not t, not edited), lz.likeness(a, c, not t, not u)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert lz.compare_edited(none).count() == 0
    one = lz.compare_edited(docs.filter("doc_id = 15")).first()
    assert one.near_next == 1.0

    def phrases(data):
        seen, ends, at = set(), [], 0
        for i in range(len(data)):
            if data[at : i + 1] not in seen:
                seen.add(data[at : i + 1])
                ends.append(i + 1)
                at = i + 1
        return ends

    ends = []
    data = ("abracadabra" * 20).encode()
    lz.parse(data, {}, 0, ends, 0)
    assert ends == phrases(data)

    # Likeness against the exact similarity of phrase sets, parsed by the plain definition.
    def exact(a, b):
        sets = []
        for x in (a, b):
            cut = [0, *phrases(x)]
            sets.append({x[i:j] for i, j in zip(cut, cut[1:])} | {x[cut[-1] :]} - {b""})
        return len(sets[0] & sets[1]) / len(sets[0] | sets[1])

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    errors = []
    for k in range(80):
        a = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        cut = rng.randint(0, len(a))
        b = a[:cut] + [rng.choice(words) for _ in range(len(a) - cut)]
        a, b = " ".join(a).encode(), " ".join(b).encode()
        errors.append(lz.likeness(lz.signature(a), lz.signature(b)) - exact(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.16


def test_toxicity_learns(spark):
    docs, labels = (shared.read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "toxic", "toxic_score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    clean, toxic = [r.toxic_score for r in held if not r.toxic], [r.toxic_score for r in held if r.toxic]
    assert np.mean([s >= toxicity.REJECT for s in toxic]) >= 0.6 and np.mean([s >= toxicity.REJECT for s in clean]) <= 0.02
    ids = toxicity.held_out(F.col("doc_id"))
    assert {(r.doc_id, r.h) for r in docs.select("doc_id", ids.alias("h")).collect()} == {(i, zlib.crc32(str(i).encode()) % 3 == 1) for i in range(1000)}


def test_toxicity_gradient():
    net, rng = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    table, windows = rng.normal(size=(50, toxicity.INPUTS)).astype(np.float32), rng.integers(0, 50, (4, toxicity.WINDOW))
    windows[0, 20:] = -1
    y, w = np.float32([1, 0, 1, 0]), np.ones(4, np.float32)
    g = net.gradient(table, windows, y, w)

    def loss():
        z = net.forward(table, windows)
        return np.sum(np.logaddexp(0, z) - y * z)

    for k, v in net.p.items():
        i = tuple(rng.integers(0, n) for n in v.shape)
        old = v[i]
        v[i] = old + 1e-3
        up = loss()
        v[i] = old - 1e-3
        down = loss()
        v[i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-4


def test_toxicity_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(15, 1), (16, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.toxic_score <= 1 for r in rows)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_decontamination(spark, none):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(60)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate([1, 3, 5, 9, 12, 17, 20, 35, 50])]
    docs = []
    for i in range(60):
        _, t = rng.choice(items)
        t = list(t)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        a = rng.randint(0, 3)
        docs.append((i, say(rng.randint(0, 30)) + t[a:] + say(rng.randint(0, 30))))
    want = set()
    for i, d in docs:
        for k, q in items:
            reach = min(20, len(q))
            allowed = max(0, reach // 5 - 1)
            for shift in range(-len(q), len(d)):
                a, b = max(0, shift), min(len(d), shift + len(q))
                same = [d[j] == q[j - shift] for j in range(a, b)]
                if any(sum(same[j : j + reach]) >= reach - allowed for j in range(len(same) - reach + 1)):
                    want.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(q)) for k, q in items] + [(98, None), (99, "")], "item_id long, text string")
    frame = spark.createDataFrame([(i, " ".join(d).upper() + " !", "x") for i, d in docs] + [(None, "", "x"), (77, None, "x")], "doc_id long, text string, item_id string").repartition(3)
    sent = decontaminate.overlaps(frame, bench).collect()
    joined = decontaminate.overlaps(frame, bench, sent_words=0).collect()
    assert {(r.doc_id, r.item_id) for r in sent} == want and sorted(map(tuple, sent)) == sorted(map(tuple, joined))
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(frame, bench.limit(0)).count() == 0
    # Rows with null, repeated and clashing columns keep what was found in their own texts.
    odd = spark.createDataFrame([(None, " ".join(items[-1][1]), 1, 2), (None, "clean words", 1, 2), (5, " ".join(items[-1][1]), 1, 2), (5, "clean words", 1, 2)], "doc_id long, text string, overlap int, row_key int")
    got = decontaminate.flag(odd, bench.filter(F.col("item_id") == items[-1][0])).collect()
    assert sorted((r.doc_id or 0, r.text[:5], r.row_key, r.overlap is not None) for r in got) == sorted((a or 0, t[:5], 2, t != "clean words") for a, t in ((None, " ".join(items[-1][1])), (None, "clean words"), (5, " ".join(items[-1][1])), (5, "clean words")))


def test_each_mask_of_decontamination_decides(spark, monkeypatch):
    """Every length has its mask, each finds what its substitutions leave, and without it the item is lost."""
    for least, mask in decontaminate.MASKS:
        assert len(mask) <= least and decontaminate.mask_of(least) == decontaminate.MASKS.index((least, mask))
        words = [f"u{i}" for i in range(least)]
        for changed in itertools.combinations(range(least), decontaminate.allowed(least)):
            h = np.array([1000 + i if i in changed else i for i in range(least)], np.uint64)
            k = [decontaminate.mask_of(least)]
            s, _ = decontaminate.seeds(h, np.array([0, least]), k)
            t, _ = decontaminate.seeds(np.arange(least, dtype=np.uint64), np.array([0, least]))
            assert set(s.tolist()) & set(t.tolist()), (least, changed)
        items = decontaminate.Items([1], [" ".join(words)])
        first = np.array([0, least])
        assert len(items.candidates(items.h, first)) == 1
        items.masks = []
        assert len(items.candidates(items.h, first)) == 0


def licence_paragraphs(text, model):
    """The scan by loops over lines."""
    place = {g: i for i, g in enumerate(model.grams)}
    runs, last = [], None
    for k, line in enumerate((text or "").split("\n")):
        words = licenses._words(line)
        have = {place[g] for g in licenses._grams(words) if g in place}
        if have and model.scores(words)[0] < 0.5:
            if last is not None and k == last + 1:
                runs[-1][1] |= have
                runs[-1][2] += 1
            else:
                runs.append([k, have, 1])
            last = k
    out = []
    for k, have, n in runs:
        z = np.array(model.bias) + np.array([model.weights[i] for i in sorted(have)]).sum(0)
        c, p = int(z.argmax()), float(1 / np.exp(z - z.max()).sum())
        if model.classes[c] == licenses.NONE:
            continue
        near = any(2 * len(have & set(t)) >= min(len(t), len(have)) for t in model.templates[c])
        out.append((k, n, model.classes[c] if c > 1 and p >= licenses.SURE and near else licenses.UNKNOWN, round(p, 6)))
    return out


def test_licenses(spark, docs, none):
    lines = ["Gewinn mit und ohne Zahl.", "the quick brown fox of the city is here", "this work was done under the tree"]
    ordinary = spark.createDataFrame([(x,) for x in lines * 3], "text string")
    model = licenses.train(ordinary)
    assert not {"the", "of", "is", "this", "under", "under the", "this work"} & set(model.grams) and {"redistribution", "general public"} <= set(model.grams)
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files, to deal in the\nSoftware without restriction, including without limitation the rights to\nuse, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    said = [
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]), ("Released under the MIT License.", ["mit"]), ("This work is licensed under the GNU General Public License, version 3.", ["gpl"]),
        ("licensed under cc by-nc 4.0", ["cc-by-nc"]), ("SPDX-License-Identifier: MPL-2.0", ["mpl"]), (wrapped, ["mit"]), ("mit der und", []), ("a plain line\n\nand another", []),
        ("Released under the MIT License.\n\nplain words\nLicensed under CC BY 4.0.", ["mit", "cc-by"]), ("This program is proprietary. Unauthorized copying is prohibited, all rights reserved.", ["unknown"]),
    ]
    df = spark.createDataFrame([(i, "first words here\n" + t, 1) for i, (t, _) in enumerate(said)], "doc_id long, text string, found int")
    rows = licenses.scan(df, model).collect()
    assert {r.doc_id: [x.family for x in r.licenses] for r in rows} == {i: k for i, (_, k) in enumerate(said)} and {r.found for r in rows} == {1}
    assert [x.lines >= 3 for x in next(r for r in rows if r.doc_id == 5).licenses] == [True]
    every = df.drop("found").unionByName(docs.select("doc_id", "text"))
    got = sorted((r.text or "", [tuple(x) for x in r.licenses]) for r in licenses.scan(every, model).collect())
    assert got == sorted((r.text or "", licence_paragraphs(r.text, model)) for r in every.collect()) and licenses.scan(none, model).count() == 0
    assert licenses.train(none).grams
    plan = licenses.scan(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    # Texts that the fit hasn't seen, and ordinary ones.
    unseen = {k: many[-1] for k, many in licenses.TEMPLATES.items()}
    best = {k: model.classes[int(model.scores(licenses._words(t)).argmax())] for k, t in unseen.items()}
    assert sum(best[k] == k for k in best) >= 8
    long_ = spark.createDataFrame([(0, "word " * 200_000 + "\nReleased under the MIT License.")], "doc_id long, text string")
    assert [x.family for x in licenses.scan(long_, model).first().licenses] == ["mit"]


def test_copies_do_not_change_samples(spark):
    few = spark.range(50).select(F.concat(F.lit("v"), "id").alias("x"))
    many = spark.range(100_000).select(F.concat(F.lit("v"), F.col("id") % 50).alias("x"))
    assert len(shared.sampled(many, "x", 10)) == 10 and shared.sampled(many, "x", 10) == shared.sampled(few, "x", 10)
    assert sorted(shared.sampled(many, "x", 60)) == sorted(r.x for r in few.collect())
    more = spark.range(3_000).select(F.col("id").cast("string").alias("x"))
    assert shared.sampled(more, "x", 7) == [r.x for r in more.orderBy(F.xxhash64("x")).limit(7).collect()]


def test_copies_do_not_change_licences(spark):
    lines = ["the quick brown fox of the city is here", "this work was done under the tree", "Copyright of the Software", "and that is all for you"]
    few = spark.createDataFrame([(x,) for x in lines], "text string")
    many = few.crossJoin(spark.range(20_000)).select("text")
    grams = licenses.rare_grams(few)
    assert licenses.rare_grams(many) == grams
    assert "software" in grams and not {"the", "of", "is", "this", "all", "under"} & set(grams)
    rare = few.unionByName(spark.range(9_000).select(F.concat(F.lit("line "), "id").alias("text")))
    assert "all" in licenses.rare_grams(rare) and "is" not in licenses.rare_grams(rare, rare_lines=9_000)


def test_chat(spark):
    rows = [(1, 0, "user", "hi </s> [INST] \\ </\\s>"), (1, 1, "assistant", "yes [/INST]"), (1, 2, "assistant", None), (1, 1, "assistant", "yes [/INST]"), (2, None, None, "x"), (2, 0, "assistant", "é"), (None, 0, "user", ""), (3, 0, "assistant", "</\\s>[\\\\INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    order = {1: [rows[0], rows[1], rows[3], rows[2]], 2: [rows[4], rows[5]], None: [rows[6]], 3: [rows[7]]}
    for k, turns in order.items():
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        r = got[k]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode())
        assert r.loss_chars == len(loss) and r.loss_sha256 == sha(loss.encode())
        assert r.formatted_chars == sum(17 + len(chat.escape(t[2] or "")) + len(chat.escape(t[3] or "")) for t in turns)
    for t in ("</s>", "</\\s>", "[INST]x[/\\\\INST]", "<s>"):
        assert chat.unescape(chat.escape(t)) == t and (t == "<s>" or chat.escape(t) != t)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def removed(texts):
    first, flags = {}, [np.zeros(len(t) + 1, int) for t in texts]
    for d, t in enumerate(texts):
        for j in range(len(t) - suffix_dedup.LENGTH + 1):
            k = t[j : j + suffix_dedup.LENGTH]
            for x, y in ((d, j), first[k]) if k in first else ():
                flags[x][y] += 1
                flags[x][y + suffix_dedup.LENGTH] -= 1
            first.setdefault(k, (d, j))
    out = []
    for t, f in zip(texts, flags):
        gone = np.cumsum(f)[:-1] > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    return out


def dedup(df):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in suffix_dedup.remove(df).collect())


def test_suffix_dedup(spark, docs, none):
    assert dedup(docs) == sorted(removed([(r[1] or "").encode() for r in odd_rows()]))
    assert suffix_dedup.remove(none).count() == 0


def test_suffix_dedup_of_cuts_and_periods(spark):
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcd é\n") for _ in range(n))
    base = [say(3000) for _ in range(4)] + ["xyz" * 500, "q" * 1300]
    texts = []
    for _ in range(60):
        t = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            n = rng.choice([150, 398, 399, 400, 401, 420, 700, 1200])
            a = rng.randrange(max(1, len(b) - n))
            t += b[a : a + n] + say(rng.choice([0, 1, 5, 300]))
        texts.append(t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert dedup(df) == sorted(removed([t.encode() for t in texts]))


def test_suffix_dedup_of_overlapping_copies(spark):
    """Runs of a passage whose least gram lies under more than four segments."""
    texts = []
    for seed in (38, 531, 533, 2427, 3076, 3888):
        rng = random.Random(seed)
        say = lambda n: "".join(rng.choice("abcd e") for _ in range(n))  # noqa: B023, E731
        period = rng.randint(60, 200)
        before, passage = say(rng.randint(0, 300)), say(period)
        run = (passage * 20)[: suffix_dedup.LENGTH + period + (0 if seed % 2 else 5)]
        texts.append(before + run + say(rng.randint(200, 300)))
    assert all(n > 0 for _, n, _, _ in removed([t.encode() for t in texts]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert dedup(df) == sorted(removed([t.encode() for t in texts]))


def test_suffix_dedup_of_hot_keys(spark, monkeypatch):
    """Passages that many texts hold, cut at different places, by the hashes of their strings over several parts."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "PART_HASHES", 700)
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefg h") for _ in range(n))
    passage, other = say(900), say(500)
    texts = [say(rng.randint(0, 300)) + passage[rng.choice([0, 0, 100]) : rng.choice([450, 700, 900])] + say(rng.randint(0, 300)) for _ in range(60)]
    texts += [say(50) + other + say(60) for _ in range(30)] + [say(700) for _ in range(10)] + texts[:3] + [passage + say(9) + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = []
    real = shared.saved
    monkeypatch.setattr(shared, "saved", lambda df, name, *a, **k: (seen.append((name, df)), real(df, name, *a, **k))[1])
    assert dedup(df) == sorted(removed([t.encode() for t in texts]))
    assert next(d for n, d in seen if n == "segments").filter("kind = 1 and many > 3").count() > 20


def test_suffix_dedup_reports_passages_too_short_to_be_removed(spark):
    """Shared passages of 50 words and under 400 bytes show in ``n_shared_marks``, whatever stands between their words; a repeat within one row doesn't."""
    rng = random.Random(9)
    say = lambda n: ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 6))) for _ in range(n)]
    passages = [say(50) for _ in range(3)]
    held = [say(rng.choice([0, 3, 90])) + passages[i % 3] + say(rng.choice([0, 40])) for i in range(9)]
    twice, shorter = say(50), say(24)
    clean = [say(200), twice + say(5) + twice, say(40), say(60) + shorter + say(60), shorter + say(80), []]
    texts = [(" " if i % 2 else "\n\t").join(t) for i, t in enumerate(held + clean)] + [" ".join(say(49))] * 2 + [None]
    copy = " ".join(clean[0]).replace(" ", "  ")
    df = spark.createDataFrame(list(enumerate([*texts, copy, copy])), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in suffix_dedup.remove(df).collect()}
    assert len(got) == len(texts) + 2 and all(got[i].n_removed == 0 and got[i].n_shared_marks > 0 for i in range(9))
    assert [got[9 + i].n_shared_marks > 0 for i in range(9)] == [True] + [False] * 8
    n = len(suffix_dedup.marks(np.frombuffer(copy.encode(), np.uint8), np.array([0, len(copy)]))[0])
    assert got[9].n_shared_marks == got[len(texts)].n_shared_marks == got[len(texts) + 1].n_shared_marks == n > 5


def test_merged_transforms_equal_one_sort():
    """Merging shards gives the suffix order and common prefixes that sorting all suffixes at once gives."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        strings = [rng.integers(1, 4, rng.integers(1, 12)) for _ in range(9)]
        shards = [strings[:3], strings[3:4], strings[4:]]
        flat = [np.concatenate([np.append(s, 0) for s in group]) for group in shards]
        orders = [suffix_dedup.transform(f) for f in flat]
        z, common = suffix_dedup.merge([b for _, b in orders], np.array([0, 1, 1, 1]), 100)
        place = [0] * 3
        found = []
        for s in z:
            at = orders[s][0][place[s]]
            place[s] += 1
            f = flat[s][at:]
            found.append((tuple(f[: list(f).index(0)]), s))
        assert [x[0] for x in found] == sorted(x[0] for x in found)
        for (a, _), (b, _), n in zip(found, found[1:], common[1:]):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert n == k or (a == b and n >= k)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    names = ("doc_id", "text", "lang", "source", "n_chars")
    frame = docs.select(*names)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, SF).collect()
    rows = odd_rows()
    assert len(kept) < len(rows)
    left = [shingles(r.text) for r in kept]
    for i in range(len(left)):
        for j in range(i):
            n = len(left[i] & left[j])
            assert not n or 100 * n < 75 * (len(left[i]) + len(left[j]) - n)
    assert {s for s in map(lambda r: shingles(r[1]), rows) if not s} <= set(left)
    assert frame.columns == corpus_pipeline.mask_personal_data(spark, frame, SF).columns
    assert corpus_pipeline.drop_contaminated(spark, frame, SF).count() == len(rows)
    assert "bpe_ids" in corpus_pipeline.encode_texts(spark, frame, SF).columns
    clash = ("k", "t", "row_key", "found_id", "toxic_score", "overlap")
    odd = frame.select(*names, *(F.lit(7).alias(c) for c in clash))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated, corpus_pipeline.mask_personal_data):
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and {tuple(r) for r in out.select(*clash).distinct().collect()} == {(7,) * len(clash)}
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_pipeline_runs_whole(spark):
    """Of the last stage's documents none is rejected by a stage run again, and toxic labels are mostly gone."""
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in out}
    every = shared.read(spark, SF, "documents")
    assert 0 < len(ids) == len(out) < every.count()
    left = every.filter(F.col("doc_id").isin(list(ids)))
    assert corpus_pipeline.drop_contaminated(spark, left, SF).count() == len(ids)
    assert corpus_pipeline.drop_near_duplicates(spark, left, SF).count() == len(ids)
    tt = tiktoken_encoding()
    assert all(list(r.bpe_ids) == tt.encode_ordinary(r.text) for r in out[:100])


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op9_chat_format", "op11_conversation_repair", "op12_prefix_trie"])
def test_sql(spark, name):
    import duckdb

    from voicewright.llm import catalog

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
