"""Personal data, packing, licenses and language against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from histomesh.llm import langid, licenses, packing, personal

MARKED = [
    "write to jo.an-x+1@mail.example.com, or @no or a@b or x@y.z.",
    "at 10.0.255.7 and 300.1.2.3 and 1.2.3.4.5.6.7.8 and 01.002.3.4 end",
    "pay 4111 1111 1111 1111 or 4111111111111112 or 4111-1111-1111-1111-9 now",
    "call +1 (743) 555-3824 or +123 or +49 30 1234567890123456",
    "ü é 𝄞 a@b.c@d.e.f 378282246310005 +12.34.56.78.90.12",
]


def plain(text):
    """The four base patterns just as they are stated."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    found = []
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), m.end(), k))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(8)
    made = ["".join(r.choice(["1", "23", ".", "@", "a", "-", " ", "+", "(", ")", "4111111111111111", "b.c", "%", "é"]) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for text in [*MARKED, *made]:
        assert personal.base_spans(text) == plain(text), text


@pytest.fixture(scope="module")
def field(docs):
    return personal.train(personal.stretches(docs))


def test_field_finds_planted_kinds_and_leaves_others(field, texts):
    carriers = [t[:150] for _, t, *_ in texts if t and len(t) > 150]
    hit = total = wrong = 0
    for text, spans in personal.training(carriers, 300, seed=99):
        base, added = personal.spans(text, field)
        found = {(a, b) for a, b, _ in base + added}
        total += len(spans)
        hit += sum((a, b) in found for a, b, _ in spans)
        wrong += sum(not any(a < y and x < b for x, y, _ in spans) for a, b, _ in added)
    assert hit / total > 0.9 and wrong / total < 0.05


def test_decoding_equals_all_segmentations(field):
    text = "token = \"0123456789abcdef0123456789abcdef\" 7, 123-45-6789"
    tokens = next(personal.zones(text, []))
    segments = personal.candidates(text, tokens)
    scores = {(i, j): field.weights[f].sum(0) for i, j, f in segments}

    def best(at, before):
        if at == len(tokens):
            return 0.0, []
        top = best(at + 1, personal.OUTSIDE)
        for (i, j), s in scores.items():
            if i == at:
                for kind in range(len(personal.KINDS)):
                    rest, spans = best(j, kind)
                    value = rest + s[kind] + field.follows[before, kind] - 1.0
                    if value > top[0]:
                        top = (value, [(i, j, kind), *spans])
        return top

    assert field.decode(len(tokens), segments, 1.0) == best(0, personal.OUTSIDE)[1]


def test_redaction_and_rows(spark, field, odd, none):
    rows = spark.createDataFrame([(1, "mail me@x.org now", 5), (2, None, 6), (3, "nothing here", 7)], "doc_id long, text string, spans long")
    found = {r["doc_id"]: r for r in personal.find_personal(rows, field).collect()}
    assert found[1]["redacted"] == "mail [EMAIL] now" and found[1]["spans"] == "email:5:13" and found[1]["n_email"] == 1
    assert found[2]["spans"] == "" and found[3]["redacted"] is None
    assert personal.find_personal(odd, field).count() == 5
    assert personal.find_personal(none, field).collect() == []
    assert personal.stretches(none) == []


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def packed(docs, **options):
    pieces = defaultdict(list)
    for r in packing.pack(docs, tokenizer(), **options).collect():
        pieces[r["sequence_id"]].append(r)
    return pieces


def test_packing_keeps_every_token_once(docs, texts):
    from tokenizers import Tokenizer

    plain_ids = Tokenizer.from_file(tokenizer())
    want = {i: [*plain_ids.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in texts}
    pieces = packed(docs, length=64)
    got, sizes = defaultdict(dict), {}
    for sequence, rows in pieces.items():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1].tolist()]
        sizes[sequence] = sum(r["length"] for r in rows)
        for r in rows:
            assert r["doc_tokens"] == len(want[r["doc_id"]])
            got[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    assert {i: sum((got[i][k] for k in sorted(got[i])), []) for i in got} == want
    full = sum(map(len, want.values())) // 64
    assert all(sizes[k] == 64 for k in range(full)) and all(n & (n - 1) == 0 for n in sizes.values())
    assert sorted(sizes) == list(range(len(sizes)))


def test_every_window_has_the_mixture(docs, texts):
    source, pieces = {i: s for i, _, _, s in texts}, packed(docs, length=256)
    totals = Counter()
    for rows in pieces.values():
        for r in rows:
            totals[source[r["doc_id"]]] += r["length"]
    for rows in pieces.values():
        own = Counter()
        for r in rows:
            own[source[r["doc_id"]]] += r["length"]
        if sum(own.values()) == 256:
            assert all(abs(own[s] - 256 * totals[s] / sum(totals.values())) <= len(totals) + 1 for s in totals)


@pytest.mark.parametrize("weights", [[1, 1, 1], [5, 1, 2], [30, 7, 900]])
def test_rounds_are_deficit_round_robin(weights):
    """The closed form against serving token by token credit, queues running dry on the way."""
    from fractions import Fraction

    sizes, length = [30, 7, 900], 50
    rounds = packing.Rounds(sizes, weights, length)
    served = [Fraction(0)] * 3
    for r in range(1, 20):
        left = Fraction(length)
        while left > 0 and any(v < n for v, n in zip(served, sizes, strict=True)):
            open_ = [k for k in range(3) if served[k] < sizes[k]]
            step = min([left / sum(weights[k] for k in open_), *((sizes[k] - served[k]) / Fraction(weights[k]) for k in open_)])
            for k in open_:
                served[k] += step * weights[k]
            left -= step * sum(weights[k] for k in open_)
        assert rounds.after(r)[0] == [int(v) for v in served]
    stream = sorted(x for s in range(3) for a, b, place in rounds.stretches(s, 0, sizes[s]) for x in range(place, place + b - a))
    assert stream == list(range(sum(sizes)))


def test_packing_odd_and_no_rows(odd, none):
    assert sum(r["length"] for rows in packed(odd).values() for r in rows) == 3 * 5 + 2
    assert packed(none) == {}


def test_rest_is_cut_into_powers_of_two():
    assert packing.cuts_of_rest(4096 * 3 + 11, 4096) == [4096 * 3 + 8, 4096 * 3 + 10, 4096 * 3 + 11]
    assert packing.cuts_of_rest(4096, 4096) == []


def test_license_notices(spark, odd, none):
    rows = [
        (1, "é before. Licensed under the Apache License, Version 2.0. after"),
        (2, "LICENSED UNDER THE\nAPACHE license - version 2.0 and later Released under the MIT License."),
        (3, "Licensed under a strange License, Version 9"),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, None),
        (6, "Permission is hereby granted, free of cost, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, change, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ]
    found = sorted(tuple(r) for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(r[0], r[1]) for r in found] == [(1, "Apache-2.0"), (2, "Apache-2.0"), (2, "MIT"), (4, "CC-BY-NC-4.0"), (6, "MIT")]
    assert rows[0][1][found[0][5] : found[0][6]] == "Licensed under the Apache License, Version 2.0"
    assert found[0][3] == 1.0 and 0.9 < found[4][3] < 1
    assert licenses.find_licenses(odd).collect() == [] and licenses.find_licenses(none).collect() == []


def test_alignment_equals_full_table():
    r = random.Random(6)
    for _ in range(200):
        a, b = (np.array([r.randrange(4) for _ in range(r.randint(1, 8))]) for _ in range(2))
        table, best = np.zeros((len(a) + 1, len(b) + 1)), 0
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (1 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
                best = max(best, table[i + 1, j + 1])
        assert licenses.align(a, b, 0)[0] == best


def test_language_of_held_out_texts(docs, texts, spark):
    train = docs.filter(F.col("doc_id") % 2 == 0)
    net = langid.fit(train)
    assert net.languages == ["aa", "oo"]
    rows = {r["doc_id"]: r for r in langid.identify(docs, net).collect()}
    real = [(i, lang) for i, t, lang, _ in texts if t and re.search(r"[^\W\d_]", t) and len(t) > 40 and i % 2]
    assert sum(rows[i]["lang_pred"] == lang for i, lang in real) / len(real) > 0.95
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (2000, 2001, 2002, 2003))
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[0]["row"] == "x"


def test_network_gradient_and_reader_agree():
    samples = [(bytes(random.Random(k).choices(b"abc " if k % 2 else b"xyz ", k=90)), "pq"[k % 2]) for k in range(24)]
    net = langid.train(samples, hidden=4, epochs=6, batch=8)
    data, at = np.frombuffer(b"".join(s for s, _ in samples), np.uint8), np.arange(25) * 90
    p = langid.document_probabilities(langid.Reader(net), data, at)
    codes = data.reshape(24, 90).T
    forth, back = langid._forward(net.tables[0], net.recurrent[0], codes)[0], langid._forward(net.tables[1], net.recurrent[1], codes[::-1])[0][::-1]
    scores = forth @ net.outputs[0] + back @ net.outputs[1] + net.bias
    e = np.exp(scores)
    assert np.allclose(p, (e / e.sum(2, keepdims=True)).mean(0), atol=1e-4)
    assert (p.argmax(1) == np.arange(24) % 2).all()
    table, slopes = net.tables[0].copy(), np.ones((90, 24, 4), np.float32)
    d_inputs, d_own = langid._backward(net.recurrent[0], langid._forward(table, net.recurrent[0], codes)[1], slopes)
    step = 1e-2
    for spot in ((0, 0), (1, 5), (3, 11)):
        up, down = net.recurrent[0].copy(), net.recurrent[0].copy()
        up[spot] += step
        down[spot] -= step
        slope = (langid._forward(table, up, codes)[0].sum() - langid._forward(table, down, codes)[0].sum()) / (2 * step)
        assert abs(slope - d_own[spot]) < 0.05 * max(abs(slope), 1)


def test_language_without_training_rows(odd, none):
    net = langid.fit(none)
    assert [r["lang_pred"] for r in langid.identify(odd, net).collect()] == ["und"] * 5
    assert langid.identify(none, net).collect() == []


def test_pieces_of_batches():
    from histomesh.llm.words import pieces

    cuts = list(pieces(np.array([0, 5, 5, 30, 31]), 10))
    assert cuts == [(0, 2), (2, 3), (3, 4)] and all(a[1] == b[0] for a, b in pairwise(cuts))
