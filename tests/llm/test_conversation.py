"""Conversation repair against a plain dynamic programme over (cost, audit) pairs."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import conversation as C

SCHEMA = "conv_id long, turn long, role string, text string, n_words int, piece int"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WORD = re.compile("[^\x20\x09-\x0d]")


def damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, [])
        show = lambda x: " " if x is None else x
        draw = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    for conv in out:
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
        out[conv].sort(key=key)
    return out


def plain(rows):
    """Contract's values of one conversation's rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {}
    for i in range(len(rows), -1, -1):
        found = {}
        for state in step:
            ways = []
            if i == len(rows):
                if state in ("", "a"):
                    ways.append((0, "", ()))
            else:
                late = 5 * (faults[i] == "truncated")
                cost, audit, lines = best[i + 1][state]
                ways.append((cost + 2, "D" + audit, lines))
                if faults[i] not in ("blank", "duplicate"):
                    for name, letter, price in ((rows[i][1], "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                        if name[:1] in step[state]:
                            cost, audit, lines = best[i + 1][step[state][name[:1]]]
                            ways.append((cost + price + late, letter + audit, (f"{name}:{rows[i][2]}", *lines)))
            found[state] = min(ways) if ways else (10**9, "", ())
        for _ in range(3):  # inserts may follow each other
            for state in step:
                for name in ("user", "assistant"):
                    if name[0] in step[state]:
                        cost, audit, lines = found[step[state][name[0]]]
                        found[state] = min(found[state], (cost + 5, "I" + audit, (f"{name}:", *lines)))
        best[i] = found
    cost, audit, lines = best[0][""]
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talk(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rng.choice([0, 5, -3])
        for k in range(rng.randrange(9)):
            role = "system" if not k and rng.random() < 0.4 else rng.choice(["user", "assistant"] * 6 + ["tool", "", "sys", "User", None])
            text = rng.choice(["Hello. ", "yes", "Why?", " ", "", "ok!\t", "\x1c", "a.b", "Ünï."]) + f"{k}" * rng.randrange(2) if rng.random() < 0.9 else None
            rows.append((conv, turn, role, text, 1, 1))
            turn = None if rng.random() < 0.05 else (turn or 0) + rng.choice([0, 1, 1, 1, 1, 4])
    rows += [(None, 1, "user", "No id.", 1, 1), (None, 2, "assistant", "None.", 1, 1), (10**18 + 1, 10**18, "user", "x.", 1, 1), (10**18 + 1, -(10**18), "assistant", "x.", 1, 1)]
    return rows + [rows[3]] * 5


def test_repairs_match_a_plain_programme(spark):
    rows = talk(1500)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = C.summaries(C.repaired(C.damaged(frame)))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((c, *plain(r)) for c, r in damage(rows).items()), key=str)


@pytest.mark.parametrize("most", [1, 3, 40])
def test_conversations_in_many_pieces(spark, most):
    rng = random.Random(most)
    rows = [(7, i // 2 if i % 11 else None, rng.choice(["user", "assistant", "system", "bot"]), f"{rng.randrange(80)}{rng.choice(['.', '', '?'])}", 1, 1) for i in range(700)]
    rows += [(8, i, ["user", "assistant"][i % 2], f"{i}.", 1, 1) for i in range(300)] + [(9, 1, "user", "same", 1, 1)] * 200
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = C.summaries(C.repaired(C.damaged(frame), most))
    assert sorted(map(tuple, got.collect())) == sorted((c, *plain(r)) for c, r in damage(rows).items())


def test_empty_and_all_dropped(spark):
    assert C.summaries(C.repaired(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = C.summaries(C.repaired(C.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", 1, 1)], SCHEMA))))
    assert [tuple(r) for r in got.collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_runs_use_powers():
    runs = [(C.USER, 3000), (C.ASSISTANT + 4, 1500), (C.GONE, 10**9), (C.SYSTEM, 2)]
    v = C.END
    for symbol, n in reversed([r for r in runs if r[1] < 10**6]):
        for _ in range(n):
            v = C.apply(C.power(symbol, 0), v)
    assert C.apply(C.product(runs), C.END)[0] == v[0] + 2 * 10**9
    audit, _, lines = C.unroll([r for r in runs if r[1] < 10**6], C.END, 0, True)
    cut = sum(1 for row, _ in lines if 3000 <= row < 4500)
    assert C._cost(audit, cut) == v[0] and len(audit) >= 4502


def test_repaired_keeps_texts(spark):
    rows = [(1, 0, "user", "Hi.", 1, 1), (1, 1, "user", "There", 1, 1), (1, 2, "tool", "Fine!", 1, 1)]
    got = C.repaired(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got["audit"], got["text"], got["cost"]) == ("KDR", "user:Hi.\nassistant:Fine!", 3)
