import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from clerkwise.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, cost int, nth string"
TEXTS = ["Yes.", "No?", "open", " ", "", "\n\t", "end!  ", "end. ", "x ", "a.b"]
ROLES = ["user", "assistant", "system", "tool", "", " ", "Student", "student"]


def spaced(x):
    return " " if x is None else x


def damaged(rows):
    out = []
    for c, n, role, text in rows:
        role, text = spaced(role), spaced(text)
        kind = zlib.crc32(f"{spaced(c)}:{spaced(n)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(c, n, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = re.findall("[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def repaired(rows, audit):
    """The turns that a string of letters makes, or None; the targets of R and I follow from the alternation."""
    out, rest = [], iter(rows)
    for letter in audit:
        if letter == "I":
            out.append([None, ""])
        else:
            role, text = next(rest)
            if letter != "D":
                out.append([None if letter == "R" else role, text])
    lead = bool(out) and (out[0][0] or "")[:1] == "s"
    for k, turn in enumerate(out):
        turn[0] = ("assistant" if (k - lead) % 2 else "user") if turn[0] is None else turn[0]
    return out if re.fullmatch("(s?(ua)+)?", "".join((r or "-")[:1] for r, _ in out)) else None


def price(rows, audit):
    found, total, at = faults(rows), 0, 0
    for letter in audit:
        if letter == "I":
            total += 2
            continue
        if letter == "D":
            total += 3
        elif found[at] in ("blank", "duplicate"):
            return None
        else:
            total += 2 * (letter == "R") + (found[at] == "truncated")
        at += 1
    return total


def exhaustive(rows, most=4):
    """Every string of edits with up to ``most`` inserts."""
    best = None
    for inserts in range(most + 1):
        for places in itertools.combinations(range(len(rows) + inserts), inserts):
            for letters in itertools.product("DKR", repeat=len(rows)):
                rest = iter(letters)
                audit = "".join("I" if k in places else next(rest) for k in range(len(rows) + inserts))
                cost = price(rows, audit)
                if cost is not None and (best is None or (cost, audit) < best) and repaired(rows, audit) is not None:
                    best = (cost, audit)
    return best


def cheapest(rows):
    """Shortest path by cost and then letters, for conversations of any length."""
    found = faults(rows)
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, said = heapq.heappop(heap)
        if (at, said) in done:
            continue
        if at == len(rows) and said in ("", "a"):
            return cost, audit
        done.add((at, said))
        after = "a" if said == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", at, after))
        if at < len(rows):
            initial, late = rows[at][0][:1], int(found[at] == "truncated")
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, said))
            if found[at] in ("none", "truncated"):
                if initial == after or (initial == "s" and said == ""):
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, initial))
                heapq.heappush(heap, (cost + 2 + late, audit + "R", at + 1, after))


def brute(rows):
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, sha and the repaired turns; rows in order."""
    groups = defaultdict(list)
    for c, n, role, text in rows:
        groups[c].append((n, spaced(role), spaced(text)))
    out = {}
    for c, mine in groups.items():
        turns = {n for n, _, _ in mine if n is not None}
        plain = [(r, t) for _, r, t in mine]
        f = faults(plain)
        initials = [r[:1] for r, _ in plain]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest(plain)
        turns_after = [tuple(t) for t in repaired(plain, audit)]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns_after).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha, turns_after)
    return out


def talk(rnd, c, n):
    """One conversation without two different rows of one turn, so that its order is given."""
    role = ["user", "assistant"]
    rows, at = [], rnd.choice([None, 0, 3])
    for k in range(n):
        row = (c, at, rnd.choice(ROLES) if rnd.random() < 0.25 else role[k % 2], rnd.choice(TEXTS) if rnd.random() < 0.3 else f"line {k}{rnd.choice('.!? ')}")
        rows += [row] * rnd.choice([1, 1, 1, 1, 2])
        at = (at or 0) + rnd.choice([1, 1, 1, 2])
    return rows


def conversations(seed=5):
    rnd = random.Random(seed)
    rows = [r for c in range(120) for r in talk(rnd, c if c else None, rnd.randrange(1, 12))]
    rows += talk(rnd, 500, 300) + [(501, None, None, None), (502, 1, "user", None), (503, -5, "user", "Hi."), (503, 2**40, "assistant", "Ho.")]
    return rows + [(504, 2, "user", "same.")] * 40


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def test_search_agrees_with_every_string_of_edits():
    rnd = random.Random(1)
    for _ in range(60):
        rows = [(r, t) for _, _, r, t in talk(rnd, 1, rnd.randrange(1, 5))][:5]
        assert cheapest(rows) == exhaustive(rows)


def test_auction_finds_the_cheapest_least_edits():
    rnd = random.Random(2)
    for _ in range(400):
        rows = [(r, t) for _, _, r, t in talk(rnd, 1, rnd.randrange(1, 40))]
        codes = "".join(cv.code_of(r[:1] if r[:1] in ("s", "u", "a") else "-", f) for (r, _), f in zip(rows, faults(rows), strict=True))
        cost, letters, end = cv.edits_from(codes, cv.ENDS, True, (cv.NOTHING,))[0]
        assert (cost, letters) == cheapest(rows) and end in (cv.NOTHING, cv.ASSISTANT)
        # Prices are a feasible dual: no arc is cheaper than the fall of the price along it.
        lattice = cv.Lattice(codes, cv.ENDS, True)
        assert lattice.auction(cv.NOTHING) == cost
        for node in range(4 * len(codes) + 4):
            for _, on, then, c in lattice.rows[node >> 2][node & 3]:
                assert lattice.price[node] <= c + lattice.price[node - (node & 3) + 4 * on + then]


def test_costs_between_states():
    rnd = random.Random(3)
    for _ in range(60):
        codes = "".join(cv.code_of(rnd.choice("sua-"), rnd.choice(cv.FAULTS)) for _ in range(rnd.randrange(1, 6)))
        for last in (False, True):
            table = [cv.NEVER] * 16
            for start in range(4):
                best = {(0, start): 0}
                heap = [(0, 0, start)]
                while heap:
                    cost, at, q = heapq.heappop(heap)
                    for _, on, then, c in cv.arcs(codes[at])[q] if at < len(codes) else ((("I", 0, cv.NEXT[q], 2),) if last else ()):
                        if cost + c < best.get((at + on, then), cv.NEVER):
                            best[at + on, then] = cost + c
                            heapq.heappush(heap, (cost + c, at + on, then))
                for end in range(4):
                    table[4 * start + end] = best.get((len(codes), end), cv.NEVER)
            assert cv.costs_between(codes, last) == table


@pytest.mark.parametrize("segment", [cv.SEGMENT, 3])
def test_whole_conversations(spark, segment):
    rows = conversations()
    want = brute(rows)
    out = {r["conv_id"]: tuple(r)[1:] for r in cv.audit_conversations(frame(spark, rows), segment=segment).collect()}
    assert out == {c: w[:-1] for c, w in want.items()}
    turns = defaultdict(list)
    for r in cv.repair_conversations(frame(spark, rows), segment).orderBy("place").collect():
        assert r["place"] == len(turns[r["conv_id"]])
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert turns == {c: w[-1] for c, w in want.items() if w[-1]}


def test_damage_and_conversations_that_lose_all_rows(spark):
    rows = conversations(6) + [(c, 0, "user", "Hi.") for c in range(600, 700)]
    table = frame(spark, rows)
    out = {r["conv_id"]: tuple(r)[1:] for r in cv.audit_conversations(cv.damage(table), table).collect()}
    want = brute(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out == {c: want[c][:-1] if c in want else nothing for c, *_ in rows}
    assert nothing in out.values()


def test_ties_in_one_turn_and_odd_tables(spark):
    rows = [(1, 3, "user", "b."), (1, 3, "assistant", "a."), (1, 3, "user", "b."), (2, None, "user", "x."), (2, None, "user", "x.")]
    one = cv.audit_conversations(frame(spark, rows)).collect()
    two = cv.audit_conversations(frame(spark, rows[::-1])).collect()
    assert sorted(one) == sorted(two) and {r["conv_id"]: r["duplicate"] for r in one} == {1: 1, 2: 1}
    empty = frame(spark, rows).limit(0)
    assert cv.audit_conversations(cv.damage(empty), empty).count() == 0 and cv.repair_conversations(empty).count() == 0
    long = [(1, 0, "user", "q" * 3_000_000), (1, 1, "assistant", "a" * 3_000_000 + ".")]
    assert {c: w[:-1] for c, w in brute(long).items()} == {r["conv_id"]: tuple(r)[1:] for r in cv.audit_conversations(frame(spark, long)).collect()}
