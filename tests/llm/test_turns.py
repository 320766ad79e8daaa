"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest

from histomesh.llm import turns

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string, digest int, conv string"


def cheapest(rows):
    """rows: (initial, goes, truncated); the cheapest edits, of equal ones the ASCII-least."""

    @cache
    def best(i, done, inserted):
        ways = [(0, "")] if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape(done)) else []
        following = "a" if done.endswith("u") else "u"
        if inserted < 2:
            cost, rest = best(i, step(done, following), inserted + 1)
            ways.append((cost + 3, "I" + rest))
        if i < len(rows):
            initial, goes, truncated = rows[i]
            cost, rest = best(i + 1, done, 0)
            ways.append((cost + 4, "D" + rest))
            if not goes:
                if initial == following or (initial == "s" and not done):
                    cost, rest = best(i + 1, step(done, initial), 0)
                    ways.append((cost + 3 * truncated, "K" + rest))
                cost, rest = best(i + 1, step(done, following), 0)
                ways.append((cost + 3 + 3 * truncated, "R" + rest))
        return min(ways, default=(10**9, ""))

    def step(done, initial):
        return initial

    def shape(done):
        return {"": "", "s": "s", "u": "u", "a": "ua"}[done]

    return best(0, "", 0)


def plain(rows):
    """The contract's report for rows (conv, turn, role, text) after damage, and all ids."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=order)
    own, seen, counts = [], set(), [0, 0, 0]
    for _, role, text in rows:
        solid = [c for c in text if not re.match(r"[\x20\x09-\x0D]", c)]
        blank, again, cut = not solid, (role, text) in seen, bool(solid) and solid[-1] not in ".!?"
        seen.add((role, text))
        fault = [blank, again and not blank, cut and not again and not blank]
        counts = [a + b for a, b in zip(counts, fault, strict=True)]
        own.append((role[:1], fault[0] or fault[1], fault[2]))
    stated = {t for t, _, _ in rows if t is not None}
    gaps = max(stated) - min(stated) + 1 - len(stated) if stated else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
    cost, audit = cheapest(own)
    out, last, left = [], "", list(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else left.pop(0)[1:]
        if edit in "RI":
            role = "assistant" if last == "u" else "user"
        if edit != "D":
            out.append(f"{role}:{text}")
            last = role[:1]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(talks, ids):
    return sorted(((i, *plain([r[1:] for r in talks if r[0] == i])) for i in set(ids)), key=repr)


def table(spark, talks):
    return spark.createDataFrame([(*r, 1, "x") for r in talks], SCHEMA).repartition(3)


def found(spark, talks, ids, **settings):
    rows = turns.repaired_digests(table(spark, talks), table(spark, [(i, 0, "", "") for i in ids]), **settings)
    assert rows.columns == ["conv_id", *turns.RESULTS, "repaired_sha256"]
    return sorted(map(tuple, rows.collect()), key=repr)


def talk(r, i, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"]
    texts = ["Yes.", "So what", "Why?\n", " \t", "", None, "No! ", "Ünd so", "..."] + [f"text {k}." for k in range(8)]
    return [(i, r.choice([k, k, k, k + 1, None]), r.choice(roles[: r.choice([2, 4, 9])]), r.choice(texts)) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_auction_finds_the_cheapest_and_least_edits(seed):
    r = random.Random(seed)
    for _ in range(400):
        rows = [(r.choice("suaux"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 14))]
        rows = [(i, goes, cut and not goes) for i, goes, cut in rows]
        assert turns.repair(rows) == cheapest(tuple(rows)), rows


def test_prices_are_feasible_and_tight():
    r = random.Random(9)
    for _ in range(100):
        codes = bytes(turns.code_of(r.choice("suax"), r.random() < 0.2, False) for _ in range(r.randint(1, 40)))
        arcs, prices = turns.lattice(codes, turns.CLOSING, True)
        length = turns.auction(arcs, prices, 0)
        assert all(prices[k] <= cost + prices[node] for k, out in enumerate(arcs) for _, cost, node in out)
        assert prices[-1] == 0 and length == prices[0] == turns.prices_before(codes, turns.CLOSING, True)[0]


@pytest.mark.parametrize("piece", [1, 3, 128])
def test_reports_equal_a_plain_search(spark, piece):
    r = random.Random(piece)
    talks = [row for i in range(60) for row in talk(r, i, r.randint(1, 12))]
    talks += [row for row in talks if r.random() < 0.1 for _ in range(r.randint(1, 3))]
    talks += talk(r, None, 5) + [(70, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(400)]
    ids = [row[0] for row in talks] + [1000, 1001]
    assert found(spark, talks, ids, piece=piece) == expected(talks, ids)


def test_repaired_rows_have_the_right_shape(spark):
    r = random.Random(2)
    talks = [row for i in range(40) for row in talk(r, i, r.randint(1, 9))]
    rows = turns.repaired_rows(table(spark, talks), piece=4).orderBy("conv_id", "nth").collect()
    for i in range(40):
        own = [x for x in rows if x["conv_id"] == i]
        assert [x["nth"] for x in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in own))
        lines = "\n".join(f"{x['role']}:{x['text']}" for x in own)
        assert hashlib.sha256(lines.encode()).hexdigest() == plain([t[1:] for t in talks if t[0] == i])[-1]


def test_odd_rows(spark):
    talks = [(None, None, None, None), (None, None, None, None), (1, None, "user", "Hi."), (1, 5, "user", "Hi."), (2, 3, "assistant", "A" * 300_000 + ".")]
    ids = [None, 1, 2, 3, 3]
    assert found(spark, talks, ids) == expected(talks, ids)
    assert found(spark, [], [4]) == expected([], [4])
    assert found(spark, [], []) == [] and turns.repaired_rows(table(spark, [])).collect() == []


def test_many_copies_of_one_row(spark):
    talks = [(1, 0, "user", "Hi.")] * 3000 + [(1, 1, "assistant", "Yes.")]
    rows = found(spark, talks, [1])
    assert rows[0][3] == 2999 and rows[0][7] == "K" + "D" * 2999 + "K" and rows[0][6] == 4 * 2999


def test_damage(spark):
    r = random.Random(4)
    talks = [(i, k, r.choice(["user", "assistant", None]), r.choice(["A. b! c?", None, "x"])) for i in range(80) for k in range(5)] + [(None, None, "user", "t.")]
    out = []
    for i, k, role, text in talks:
        fate = zlib.crc32(f"{' ' if i is None else i}:{' ' if k is None else k}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (i, k, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        out += [row] * (fate != 0) + [row] * (fate == 3)
    assert sorted(map(tuple, turns.damaged(table(spark, talks)).collect()), key=repr) == sorted(out, key=repr)
