import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from photonframe.llm import conversation_repair as cr

SHAPE = re.compile(r"(s?(ua)+)?")
ENDS = re.compile(r"[^\x20\x09-\x0D]")


def every_way(rows, most):
    """The least (cost, audit) by trying all edits with at most `most` insertions."""
    best = None
    for inserted in itertools.product(range(most + 1), repeat=len(rows) + 1):
        if sum(inserted) > most:
            continue
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(e != "D" and r[1] for e, r in zip(edits, rows)):
                continue
            audit, slots, cost = "I" * inserted[0], ["?"] * inserted[0], 5 * sum(inserted)
            for e, (initial, _, cut), more in zip(edits, rows, inserted[1:]):
                audit += e + "I" * more
                cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and cut else 0)
                slots += ([] if e == "D" else [(initial or "!") if e == "K" else "?"]) + ["?"] * more
            if (best is None or (cost, audit) < best) and any(SHAPE.fullmatch("".join(x)) for x in itertools.product(*(("ua" if s == "?" else [s]) for s in slots))):
                best = (cost, audit)
    return best


def programme(rows):
    """The same by a table over rows and states, without a queue."""
    ins = {0: {0: "", 2: "I", 3: "II"}, 1: {1: "", 2: "I", 3: "II"}, 2: {2: "", 3: "I"}, 3: {3: "", 2: "I"}}
    now = {s: (5 * len(a), a) for s, a in ins[0].items()}
    for initial, must_go, cut in rows:
        after = {}
        for s, (cost, audit) in now.items():
            ways = [("D", s, 2)]
            if not must_go:
                if initial in cr.NEXT[s]:
                    ways.append(("K", cr.NEXT[s][initial], 5 * cut))
                ways.append(("R", 3 if s == 2 else 2, 1 + 5 * cut))
            for e, t, c in ways:
                for u, more in ins[t].items():
                    key = (cost + c + 5 * len(more), audit + e + more)
                    after[u] = min(after.get(u, key), key)
        now = after
    return min(now[s] for s in (0, 3) if s in now)


def random_rows(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def test_search_finds_the_least_of_all_ways():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4):
        for _ in range(25):
            rows = random_rows(rng, n)
            assert cr.repair(rows) == every_way(rows, 2) == programme(rows)
    for _ in range(200):
        rows = random_rows(rng, rng.randint(5, 60))
        assert cr.repair(rows) == programme(rows)


def test_segments_join_to_the_same(monkeypatch):
    rng = random.Random(4)
    for size in (1, 2, 7):
        monkeypatch.setattr(cr, "SEGMENT", size)
        for _ in range(60):
            rows = random_rows(rng, rng.randint(0, 50))
            assert cr.repair(rows) == programme(rows)
    rows = random_rows(rng, 30_000)
    monkeypatch.setattr(cr, "SEGMENT", 512)
    assert cr.repair(rows)[0] == programme(rows)[0]


def damage(row):
    conv, turn, role, text = row
    show = lambda v: " " if v is None else str(v)
    kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
    role, text = show(role), show(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = sorted((d for r in rows if r[0] == conv for d in damage(r)), key=lambda d: (d[1] is not None, d[1] or 0, d[2].encode(), d[3].encode()))
        seen, edits, counts = set(), [], [0, 0, 0]
        for _, _, role, text in kept:
            marks = ENDS.findall(text)
            faults = [not marks, (role, text) in seen, not marks or marks[-1] not in ".!?"]
            seen.add((role, text))
            if True in faults:
                counts[faults.index(True)] += 1
            edits.append((role[:1], faults[0] or faults[1], faults[2]))
        turns = {d[1] for d in kept} - {None}
        cost, audit = programme(edits)
        made, i, state = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else kept[i][2:]
            i += e != "I"
            if e != "D":
                role = role if e == "K" else "assistant" if state == "u" else "user"
                state = role[0]
                made.append(f"{role}:{text}")
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(edits, edits[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, audit string, n int"


def odd_rows():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "", " ", None, "cut off", "é?", "x.\n", "x. \t", "." * 3, "long " * 3000 + "."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for _ in range(900)]
    rows += [(77, 5, "user", "Same.")] * 40 + [(78, None, None, None)] * 3 + [(79, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(300)]
    # Conversations that damage empties.
    rows += [(c, 0, "user", "Gone.") for c in range(1000, 1200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows


@pytest.mark.parametrize("most, segment", [(cr.ROWS, cr.SEGMENT), (12, 8), (0, 5)])
def test_odd_tables_whole_and_cut(spark, monkeypatch, most, segment):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA)
    got = cr.repaired(cr.damaged(df), most_rows=most).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repaired(cr.damaged(empty)).collect() == []
    got = cr.repaired(cr.damaged(spark.createDataFrame([("n", 1, "user", "A."), (None, 1, "user", "A.")], "conv_id string, turn long, role string, text string"))).collect()
    assert {r.conv_id for r in got} == {"n", None}


def test_query_on_its_table(spark, sf_dir):
    from photonframe.llm.queries import QUERIES

    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()]
    got = QUERIES["op11_conversation_repair"](spark, sf_dir).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)
