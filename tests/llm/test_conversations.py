import hashlib
import random
import zlib

import pytest

from lodestar.llm import conversations

ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Rows after damage, as ``(turn, role, text)`` in order, to counts, cost, audit and digest, over all ways."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"n": (0, "", [])}

    def inserted(all_):
        out = []
        for st, w in all_:
            out.append((st, w))
            for _ in range(3):
                st, role = ("a", "assistant") if st == "u" else ("u", "user")
                w = (w[0] + conversations.INSERT, w[1] + "I", [*w[2], role + ":"])
                out.append((st, w))
        return out

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        new = []
        for st, (cost, audit, lines) in inserted(best.items()):
            new.append((st, (cost + conversations.DELETE, audit + "D", lines)))
            if kind in ("blank", "duplicate"):
                continue
            stay = cost + 5 * (kind == "truncated")
            to, name = ("a", "assistant") if st == "u" else ("u", "user")
            new.append((to, (stay + 1, audit + "R", [*lines, f"{name}:{text}"])))
            if role[:1] == to or (role[:1] == "s" and st == "n"):
                new.append((role[:1], (stay, audit + "K", [*lines, f"{role}:{text}"])))
        best = {}
        for st, w in new:
            if st not in best or w[:2] < best[st][:2]:
                best[st] = w
    cost, audit, lines = min((w for st, w in inserted(best.items()) if st in "na"), key=lambda w: w[:2])
    known = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
    )


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: brute(sorted(v, key=order)) for c, v in by.items()}


def got(spark, rows, damage=False):
    df = spark.createDataFrame(rows, ROWS)
    found = conversations.report(conversations.damaged(df), df) if damage else conversations.report(df)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found.collect()}


def made(seed, n, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = long if long and c == 0 else rng.randint(1, 9)
        rows += [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", ""]), rng.choice(["one.", "two!", "three", "four?", "", " \n", "five. \t", "six…"]) if rng.random() < 0.6 else f"said {t}.") for t in range(turns) if rng.random() < 0.9]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repairs_equal_brute_force(spark, seed):
    rows = made(seed, 60)
    assert got(spark, rows) == expected(rows)


def test_segments_of_a_conversation_are_joined(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BITS", 2)
    monkeypatch.setattr(conversations, "BLOCK", 4)
    rows = made(7, 12, long=70)
    assert got(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "Hello."), (None, None, "assistant", "Hi."), (1, None, None, None), (2, 1, "user", "same."), (2, 1, "user", "same."), (2, 2, "assistant", "same."), (3, 5, "user", "tie b."), (3, 5, "user", "tie a."),
        (3, 5, "assistant", "x" * 200_000 + "."), (4, -3, "system", "Rules."), (5, 0, "user", "Ends with a separator. "), (6, 1, "user", "a."), (6, 9, "assistant", None), *[(7, 1, "user", "again.")] * 50,
    ]
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == {} and got(spark, [], True) == {}


def test_damage(spark):
    rows = [(c if c % 7 else None, t if t % 5 else None, None if t == 3 else "user", None if t == 4 else f"text {t}! yes.") for c in range(60) for t in range(6)]
    want = {r[0]: None for r in rows}
    after = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        after += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = expected(after)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(spark, rows, True) == {c: found.get(c, none) for c in want}


def test_repaired_turns_are_whole(spark, monkeypatch):
    # As dear as they are by default, insertions never pay.
    monkeypatch.setattr(conversations, "INSERT", 1)
    monkeypatch.setattr(conversations, "BITS", 2)
    monkeypatch.setattr(conversations, "BLOCK", 4)
    rows = made(11, 30, long=30)
    assert got(spark, rows) == expected(rows)
    turns = conversations.ordered(spark.createDataFrame(rows, ROWS))
    plan = conversations.plans(conversations.segments(conversations.flagged(turns)))
    by = {}
    for r in conversations.repaired(plan, turns).orderBy("conv_id", "place", "line").collect():
        by.setdefault(r.conv_id, []).append(r)
    for out in by.values():
        roles = "".join(r.role[0] for r in out)
        assert roles.removeprefix("s").replace("ua", "") == "" and all((r.text == "") == (r.edit == "I") for r in out)
    assert any(r.edit == "R" for out in by.values() for r in out) and any(r.edit == "I" for out in by.values() for r in out)


def test_extra_columns_are_not_read(spark):
    rows = [(*r, 1, "x", 2) for r in made(3, 10)]
    df = spark.createDataFrame(rows, ROWS + ", place long, audit string, N long")
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.report(df).collect()} == expected([r[:4] for r in rows])
