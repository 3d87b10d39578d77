"""Repairs against a brute-force shortest path over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidelattice.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, kind int, k string, copies int, edits string, part int"
WORD = re.compile(r"[^\x20\x09-\x0D]")
WANTED = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        show = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        r = zlib.crc32(":".join(show).encode()) % 20
        if r == 0:
            continue
        text = "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
        role = "user" if r == 4 else role
        out += [(conv, turn, role, text)] * (2 if r == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by Dijkstra over (row, wanted prefix state); ties by audit."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, q, done = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in ("", "a"):
            return cost, audit, "\n".join(done)
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in after[q]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, after[q][r], (*done, f"{name}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, done))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 * (fault == "truncated")
        if role[:1] in after[q]:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, after[q][role[:1]], (*done, f"{role}:{text}")))
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in after[q]:
                heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, after[q][r], (*done, f"{name}:{text}")))
    raise AssertionError


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damage(rows):
        convs[r[0]].append(r)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, judged = set(), []
        for _, _, role, text in own:
            fault = ""
            if not WORD.search(text):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
                fault = "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, text = cheapest(judged)
        n = [f for _, _, f in judged]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, n.count("blank"), n.count("duplicate"), n.count("truncated"),
            illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for t in range(rng.choice([0, 1, 2, 5, 8, 13])):
            turn = rng.choice([t, t, t, t + 3, None])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool"])
            text = rng.choice(["A b.", "Yes!", "cut off", "", " \n\t", None, f"Line {t}.", "é? \n", "x" * rng.choice([1, 50_000]) + "."])
            rows.append((conv, turn, role, text, 1, "k", 9, "K", 3))
    return rows


def found(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    damaged = turn_repair.damaged(table)
    out = turn_repair.digests(table, damaged, turn_repair.repair(damaged))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return [(r[0], tuple(r[1:])) for r in out.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_digests_equal_brute_force(spark, seed):
    rows = random_rows(seed, 120)
    got = found(spark, rows)
    assert len(got) == len({r[0] for r in rows})
    assert dict(got) == expected(rows)


def test_a_conversation_over_many_partitions(spark):
    """One conversation holds most rows; its pieces compose to the repair of the whole."""
    rng = random.Random(4)
    hot = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Go on.", f"Text {t}", f"Said {t // 2}.", ""]), 1, "k", 9, "K", 3) for t in range(3000)]
    rows = hot + random_rows(5, 20)
    want = expected(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert dict(found(spark, rows)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_copies_of_one_row(spark):
    rows = [(1, 0, "user", "Same.", 1, "k", 9, "K", 3)] * 40 + [(1, 1, "assistant", "Yes.", 1, "k", 9, "K", 3)]
    assert dict(found(spark, rows)) == expected(rows)


def test_empty_and_all_null(spark):
    assert found(spark, []) == []
    nulls = [(None, None, None, None, None, None, None, None, None)] * 3
    assert dict(found(spark, nulls)) == expected(nulls)


def test_repaired_rows_have_the_wanted_form(spark):
    rows = random_rows(9, 60)
    damaged = turn_repair.damaged(spark.createDataFrame(rows, SCHEMA))
    out = turn_repair.repaired(damaged, turn_repair.repair(damaged)).orderBy("conv", "turn", "role", "k", "place").collect()
    roles = {}
    for r in out:
        roles.setdefault(r["conv"], []).append((r["new_role"], r["new_text"]))
    assert roles
    for conv, own in roles.items():
        assert WANTED.fullmatch("".join(role[0] for role, _ in own))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest()
        assert digest == expected(rows)[conv][-1]


def test_block_tables_equal_single_steps():
    rng = random.Random(2)
    t = turn_repair.tables()
    for _ in range(200):
        symbols = turn_repair.np.array([rng.randrange(9) for _ in range(rng.randint(0, 11))], dtype=int)
        costs = t.vectors[0]
        for s in reversed(symbols):
            costs = turn_repair._before(int(s), costs)
        _, vector, total = turn_repair.behind_blocks(turn_repair.blocks_of(symbols), 0)
        assert [c + total for c in t.vectors[vector]] == list(costs)
