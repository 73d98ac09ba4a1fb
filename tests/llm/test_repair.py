"""Repaired conversations against a plain table of all nodes."""

import hashlib
import random
import re
import zlib

import pytest

from haptrace.llm import catalog, repair

SF = "/root/testdata/sf0.001"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_edits(rows):
    """Least (cost, audit) from every node to the end, last rows first; rows are (initial, must go, truncated)."""
    behind = {r: ((0, "") if r in ("", "a") else (10**9, "")) for r in FOLLOWS}
    for n in range(len(rows), -1, -1):
        here = dict(behind) if n == len(rows) else {}
        if n < len(rows):
            initial, must, late = rows[n]
            for role, after in FOLLOWS.items():
                ways = [(behind[role][0] + 3, "D" + behind[role][1])]
                for to in "" if must else after:
                    cost, audit = behind[to]
                    ways += [(cost + late, "K" + audit)] if initial == to else []
                    ways += [(cost + 2 + late, "R" + audit)] if to != "s" else []
                here[role] = min(ways)
        for _ in FOLLOWS:
            for role, after in FOLLOWS.items():
                here[role] = min([here[role], *[(here[to][0] + 2, "I" + here[to][1]) for to in after if to != "s"]])
        behind = here
    return behind[""]


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        kept += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = plain_edits(codes)
        lines, at, last = [], 0, ""
        for edit in audit:
            if edit in "IR":
                last = "a" if last == "u" else "u"
            name = {"u": "user", "a": "assistant"}.get(last)
            if edit == "I":
                lines.append(f"{name}:")
                continue
            _, role, text = kept[at]
            at += 1
            if edit == "K":
                last = role[0]
                lines.append(f"{role}:{text}")
            elif edit == "R":
                lines.append(f"{name}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (conv, gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def test_least_edits():
    rng = random.Random(1)
    for letters, longest in (("suaxSUAX-", 14), ("uauauaUA-", 30)):
        for _ in range(700):
            rows = "".join(rng.choice(letters) for _ in range(rng.randrange(longest)))
            assert repair.least_edits(rows) == plain_edits([(c.lower(), c == "-", c.isupper()) for c in rows])


def odd_rows():
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "User", "a"], [None, "", "Hi.", "no end", "  \n", "What?  ", "b ", "d\n", "e.\x00", "y" * 20_000]
    rows = [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for conv in [*range(40), None] for _ in range(rng.randrange(1, 30))]
    # One conversation with most of the rows, many of them alike.
    rows += [(777, n // 3, rng.choice(roles[:3]), rng.choice(["yes.", "no", f"n{n}."])) for n in range(2000)] + [(777, 5, "user", "again.")] * 300
    return rows


@pytest.mark.parametrize("segment", [1024, 7])
def test_odd_rows(spark, segment):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(5)
    found = {r[0]: tuple(r) for r in repair.repair_damaged(table, segment=segment).collect()}
    assert found == plain(rows)
    assert repair.repair_damaged(table.filter("false"), segment=segment).collect() == []


def test_query_matches_the_plain_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r) for r in catalog.QUERIES["op12_repair"](spark, SF).collect()} == plain(rows)
