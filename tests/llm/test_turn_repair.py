"""Repairs against a plain search over all edit strings, and the query against a plain version of the whole job."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

from gridsurvey.llm import queries, turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit int, conv string, copies string"


def cheapest(initials, must_go, cut):
    """(cost, audit): the first goal that a best-first search over (cost, audit) reaches."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(initials) and re.fullmatch(r"(s?(ua)+)?", out):
            return cost, audit
        state = (i, out[-1:])
        if (state, "done") in done:
            continue
        done.add((state, "done"))

        def fits(more):
            return re.fullmatch(r"s?(ua)*u?", out + more)

        for c in "ua":
            if fits(c):
                heapq.heappush(heap, (cost + 2, audit + "I", i, out + c))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if not must_go[i]:
                if initials[i] in ("s", "u", "a") and fits(initials[i]):
                    heapq.heappush(heap, (cost + cut[i], audit + "K", i + 1, out + initials[i]))
                for c in "ua":
                    if fits(c):
                        heapq.heappush(heap, (cost + 2 + cut[i], audit + "R", i + 1, out + c))
    raise AssertionError("no repair")


def plain(turns, ids):
    """``turns``: (conv_id, turn, role, text) after damage."""
    out, by = [], defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t, r, x))
    for c in ids:
        rows = sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in rows:
            marks = re.findall(r"[^\x20\x09-\x0D]", x)
            faults.append("blank" if not marks else "duplicate" if (r, x) in seen else "truncated" if marks[-1] not in ".!?" else None)
            seen.add((r, x))
        initials = [r[:1] for _, r, _ in rows]
        cost, audit = cheapest(initials, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        k, left = 0, iter(rows)
        lines = []
        for e in audit:
            row = next(left) if e != "I" else None
            if e == "D":
                continue
            if e == "K":
                lines.append(f"{row[1]}:{row[2]}")
                k += row[1][0] != "s"
            else:
                lines.append(("user" if k % 2 == 0 else "assistant") + ":" + (row[2] if row else ""))
                k += 1
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        n = Counter(faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def harm(rows):
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub(r"[.!?]", "", x) if kind == 2 else x
        yield from [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)


def test_search_agrees_with_steps(spark):
    r = random.Random(3)
    rows = []
    for c in range(250):
        for t in range(r.randrange(9)):
            rows.append((c, t if r.random() < 0.9 else r.choice([None, 3, 50]), r.choice(["user", "assistant", "system", "u", "tool", "", None]),
                         r.choice(["Yes.", "No!", "cut", " \t\n", "", None, "a.\x0b", " ", f"own {t}?"])))
    turns = spark.createDataFrame([(*row, 1, "clash", "clash") for row in rows], SCHEMA).repartition(7)
    ids = spark.createDataFrame([(c,) for c in range(250)], "conv_id bigint")
    filled = [(c, t, " " if x is None else x, " " if y is None else y) for c, t, x, y in rows]
    got = turn_repair.repair_conversations(turns, ids, held=2)  # every conversation uses the scratch file
    assert sorted(map(tuple, got.collect()), key=str) == plain(filled, range(250))


def test_damage_and_edges(spark, tmp_path):
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["Well.", "so", None])) for c in [*range(40), None] for t in [*range(5), None]]
    rows += [(700, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(20_000)] + [(701, 0, "user", "long " * 300_000 + ".")]
    folder = str(tmp_path)
    turns = spark.createDataFrame([(*row, 1, "clash", "clash") for row in rows], SCHEMA)
    turns.write.parquet(f"{folder}/conversations.parquet")
    got = queries.QUERIES["op12_turn_repair"](spark, folder).collect()
    small = [row for row in rows if row[0] is None or row[0] < 700]
    assert sorted((tuple(g) for g in got if g[0] is None or g[0] < 700), key=str) == plain(list(harm(small)), [*range(40), None])
    long = next(g for g in got if g.conv_id == 700)
    assert long.audit.count("K") > 15_000 and long.cost < 20_000
    turns.limit(0).write.parquet(f"{folder}/none/conversations.parquet")
    assert queries.QUERIES["op12_turn_repair"](spark, f"{folder}/none").count() == 0


def test_query_on_given_table(spark, small):
    rows = [tuple(x) for x in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_turn_repair"](spark, small)
    assert sorted(map(tuple, got.collect()), key=str) == plain(list(harm(rows)), sorted({x[0] for x in rows}))
