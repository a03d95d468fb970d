"""The field adds spans only where an observed span of that kind stands, and finds hidden repeats in planted texts."""

import random

import numpy as np
import pytest

from voicewright.llm import pii, shared


def fields():
    """Fits on several samples, and fields that nobody fitted."""
    rng = random.Random(4)
    for seed in range(3):
        words = [f"w{rng.randrange(99)}" for _ in range(30)]
        texts = []
        for _ in range(60):
            tel = f"+{rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(10**6, 10**7)}"
            texts.append(" ".join([*rng.sample(words, 5), tel, *rng.sample(words, 3), tel[-7:], f"{rng.randrange(256)}.0.{rng.randrange(256)}.1", f"a{seed}@b.org", str(rng.randrange(10**9)), str(rng.randrange(2000))]))
        yield pii.fit(texts)
    for seed in range(4):
        draw = np.random.default_rng(seed)
        n = len(pii.KINDS) + 1
        yield pii.Field(draw.normal(0, 3, (len(pii._shape("0")), n)), draw.normal(0, 2, (n, n)), draw.normal(0, 2, (n, n)) + 3 * np.eye(n))


def observed_kinds(text, spans):
    """Kinds of the base spans that share a key with the token, directly or through equal tokens: keys are equalities, so directly."""
    return {(k, pii._key(text[a:b])) for k in pii.KINDS for a, b in spans[k]}


def test_nothing_is_added_without_an_observed_neighbour():
    texts = [
        "mail a@b.cd then 3775550271 word 3775550271",
        "10.0.0.1 and 123456789012 x 123456789012 x 123456789012",
        "+49 30 1234567 but 7654321 7654321, 99999999 99999999",
        "4111 1111 1111 1111 and 12345678 and 12345678 and a.b@c.org and 2222222 2222222",
    ]
    for field in fields():
        for t in texts:
            base = pii.base_spans(t)
            assert any(base.values()) and not any(pii.added_spans(t, base, field).values()), t


def test_added_spans_are_linked_by_key():
    rng = random.Random(9)
    for field in fields():
        for _ in range(40):
            tel = f"+{rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(10**6, 10**7)}"
            parts = [tel, tel[-7:], tel.replace(" ", "")[1:], str(rng.randrange(10**9)), f"{rng.randrange(10**9)}", "x@y.org", "8.8.8.8", "word"]
            t = " - ".join(rng.choices(parts, k=9))
            base = pii.base_spans(t)
            known = observed_kinds(t, base)
            for k, spans in pii.added_spans(t, base, field).items():
                for a, b in spans:
                    assert (k, pii._key(t[a:b])) in known
                    assert all(b <= x or a >= y for kind in pii.KINDS for x, y in base[kind])


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_hidden_repeats_of_the_whole_table(spark, sf):
    """Every phone of the table is written again without its plus (which the rules can't see), beside as many numbers of the same length that are nobody's."""
    docs = shared.read(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text")
    field, rng = pii.train(docs), random.Random(1)
    hits = wanted = wrong = 0
    for r in docs.filter("text like '%+%'").orderBy("doc_id").collect():
        base = pii.base_spans(r.text)
        tels = [r.text[a:b] for a, b in base["phone"]]
        if not tels:
            continue
        bare = "".join(c for c in tels[0] if c.isdigit())
        other = str(rng.randrange(10 ** (len(bare) - 1), 10 ** len(bare)))
        t = f"{r.text} again {bare} or {other} and {other}"
        base = pii.base_spans(t)
        added = pii.added_spans(t, base, field)
        if any(t[a:b] == bare for a, b in base["card"]):
            continue
        wanted += 1
        hits += any(t[a:b] == bare for a, b in added["phone"])
        wrong += sum(t[a:b] == other for k in pii.KINDS for a, b in added[k])
    assert wanted >= 10 and hits / wanted > 0.9 and wrong == 0, (wanted, hits, wrong)
