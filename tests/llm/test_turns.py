"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import zlib

import pytest

from leadloom.llm import turns

BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def place(row):
    """The documented order: turn, NULL first, the role's initial, then a hash of role and text."""
    _, turn, role, text = row
    return turn is not None, turn or 0, role[:1], hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain_report(rows):
    """conv_id -> figures, by keeping the cheapest, then first, audit of every state after every turn."""
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    damaged = plain_damage(rows)
    for conv in {r[0] for r in damaged}:
        own = sorted((r for r in damaged if r[0] == conv), key=place)
        seen, faults = set(), []
        for _, _, role, text in own:
            clean = text.strip(BLANKS)
            faults.append("blank" if not clean else "duplicate" if (role, text) in seen else "truncated" if clean[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))

        def grown(best):
            """One more inserted turn, twice: more in one place never pays."""
            for _ in range(2):
                for state, (cost, audit, lines) in list(best.items()):
                    new = "a" if state == "u" else "u"
                    option = cost + 5, audit + "I", (*lines, ("user:" if new == "u" else "assistant:"))
                    if new not in best or option < best[new]:
                        best[new] = option
            return best

        best = grown({"": (0, "", ())})
        for (_, _, role, text), fault in zip(own, faults):
            after = {}
            for state, (cost, audit, lines) in best.items():
                options = [(state, 2, "D", ())]
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault else 0
                    wanted = "a" if state == "u" else "u"
                    if role[:1] == wanted or role[:1] == "s" and state == "":
                        options.append((role[:1], more, "K", (f"{role}:{text}",)))
                    if role[:1] != wanted:
                        options.append((wanted, more + 1, "R", (f"{'user' if wanted == 'u' else 'assistant'}:{text}",)))
                for new, extra, edit, line in options:
                    option = cost + extra, audit + edit, lines + line
                    if new not in after or option < after[new]:
                        after[new] = option
            best = grown(after)
        cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
        count = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(rows):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def conversations(seed, count, most):
    rng, rows = random.Random(seed), []
    for conv in range(count):
        turn = rng.choice([0, 5])
        expected = rng.choice("sua")
        for _ in range(rng.choice([1, 2, 3, 5, most])):
            role = {"s": "system", "u": "user", "a": "assistant"}[expected]
            role = rng.choice([role] * 8 + ["user", "assistant", "system", "tool", "", None])
            text = rng.choice([f"text {rng.random()}."] * 6 + ["ok!", "again?", "cut off", "", " \n", None, "Yes. \t"])
            number = rng.choice([turn] * 12 + [None])
            rows += [(conv, number, role, text)] * rng.choice([1] * 15 + [2, 3])
            turn += rng.choice([1] * 8 + [0, 3])
            expected = rng.choice(["u" if expected != "u" else "a"] * 9 + ["u", "a", "s"])
    rng.shuffle(rows)
    return rows


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,count,most,segment,parts", [(1, 300, 12, 256, 4), (2, 60, 60, 5, 16), (3, 3, 400, 7, 16), (4, 40, 1, 256, 1)])
def test_against_a_plain_search(spark, monkeypatch, seed, count, most, segment, parts):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = conversations(seed, count, most) + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hello.")]
        df = spark.createDataFrame(rows, KIND)
        assert got(turns.report(df).collect()) == plain_report(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(turns.report(df).collect()) == plain_report([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def plain_best(symbols, faults, copies, entry, end):
    """Cheapest and first audit by plain recursion over all edits, as many insertions as may pay."""
    names = "-sua"

    def follow(state, new):
        return new == 1 and state == 0 or new == 2 and state != 2 or new == 3 and state == 2

    best = (1 << 40, "")

    def search(i, state, cost, audit, run):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(symbols) and state == end:
            best = min(best, (cost, audit))
        for new in (2, 3):
            if run < 3 and follow(state, new):
                search(i, new, cost + 5, audit + "I", run + 1)
        if i < len(symbols):
            more = copies[i] - 1
            search(i + 1, state, cost + 2 * copies[i], audit + "D" * copies[i], 0)
            if faults[i] != turns.FORCED:
                base = cost + 2 * more + (5 if faults[i] == turns.BROKEN else 0)
                for new in (1, 2, 3):
                    if follow(state, new) and (new == symbols[i] or new != 1):
                        search(i + 1, new, base + (new != symbols[i]), audit + ("K" if new == symbols[i] else "R") + "D" * more, 0)

    search(0, entry, 0, "", 0)
    return best if best[0] < 1 << 40 else None, names


def test_segments_between_all_states():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(0, 5)
        symbols = [rng.choice([0, 1, 2, 2, 3, 3]) for _ in range(n)]
        faults = [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)]
        copies = [rng.choice([1, 1, 1, 2]) for _ in range(n)]
        if not n:
            continue
        found = turns.align(symbols, faults, copies, turns.ALL)
        for entry, end in turns.ALL:
            assert found.get((entry, end)) == plain_best(symbols, faults, copies, entry, end)[0], (symbols, faults, copies, entry, end)


def test_band_and_segments_agree():
    rng = random.Random(6)
    for _ in range(20):
        n = rng.randrange(30, 90)
        symbols = [2 + i % 2 if rng.random() < 0.85 else rng.choice([0, 1, 2, 3]) for i in range(n)]
        faults = [rng.choice([0] * 12 + [1, 2]) for _ in range(n)]
        copies = [rng.choice([1] * 9 + [3]) for _ in range(n)]
        whole = turns.align(symbols, faults, copies, turns.ALL)
        cuts = sorted(rng.sample(range(1, n), 4))
        parts = [turns.align(symbols[a:b], faults[a:b], copies[a:b], turns.ALL) for a, b in zip([0, *cuts], [*cuts, n])]
        assert turns.joined(parts) == whole


def test_odd_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert turns.report(empty).count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "x" * 300_000 + ".")] + [(2, 0, "user", "again.")] * 5000 + [(3, i, "user", "same.") for i in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND + ", part int, digest string, audit int")
    assert got(turns.report(df).collect()) == plain_report(rows)
    damaged = turns.damage(df)
    found, ordered = turns.audits(damaged)
    repaired = turns.repair(damaged, found, ordered)
    assert repaired.columns == ["conv_id", "step", "edit", "turn", "role", "text"]
    assert {r.role for r in repaired.collect()} <= {"user", "assistant"}
