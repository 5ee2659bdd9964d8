"""Conversation repair against all splits, all edits and a plain version over rows with every awkward case."""

import hashlib
import itertools
import random
import zlib

import pytest

from cohort.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, conv int, h string, kind int, live boolean"


def rows(n=60, seed=4):
    r = random.Random(seed)
    out = []
    for c in range(n):
        said = [f"Word {r.randint(0, 5)}{r.choice(['.', '!', '', ' \n', '?'])}" for _ in range(r.randint(1, 9))]
        roles = ["system"] * (r.random() < 0.3) + ["user", "assistant"] * 6
        for t, text in enumerate(said):
            role = roles[t] if r.random() < 0.8 else r.choice(["user", "assistant", "system", "tool", "", "ubot"])
            out.append((c, t + (r.random() < 0.1), role, text))
    out += [(700, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(300)]
    out += [(701, 5, "user", "the same."), (701, 5, "user", "the same."), (701, None, None, None), (701, None, "user", "z"), (701, 9, "assistant", "  \t")]
    out += [(None, 1, "user", "a."), (None, None, "assistant", None), (702, None, "assistant", "b" * 100_000), (-5, -3, "user", "é日."), (703, 1, "user", "")]
    return [(*x, 1, "h", 2, False) for x in out]


def brute_parse(tokens):
    """(cost, audit) by the cheapest edits of every suffix, place by place."""
    best = {p: (0, "") if p in "0a" else None for p in R.PLACES}
    best = _inserted(best)
    for token in reversed(tokens):
        now = {}
        for p in R.PLACES:
            ways = [(4 + best[p][0], "D" + best[p][1])] if best[p] else []
            if token != "-":
                more = 3 * token.isupper()
                for (a, role), q in R.STEPS.items():
                    if a == p and best[q]:
                        if role == token.lower():
                            ways.append((more + best[q][0], "K" + best[q][1]))
                        if role != "s":
                            ways.append((more + 3 + best[q][0], "R" + best[q][1]))
            now[p] = min(ways, default=None)
        best = _inserted(now)
    return best["0"]


def _inserted(best):
    for _ in range(4):
        best = {p: min([x for x in [best[p], *[(3 + best[q][0], "I" + best[q][1]) for (a, role), q in R.STEPS.items()
                                                if a == p and role != "s" and best[q]]] if x], default=None) for p in R.PLACES}
    return best


def chart(tokens):
    """Cells of the whole span by all splits of all spans."""
    n = len(tokens)
    cells = {(i, i + 1): R.leaf(t) for i, t in enumerate(tokens)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            found = [R.join(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            cells[i, i + size] = [min((f[x] for f in found if f[x]), default=None) for x in range(len(R.SYMBOLS))]
    return cells[0, n]


def test_every_short_conversation():
    for n in range(5):
        for tokens in itertools.product("suaxUA-", repeat=n):
            assert R.answer(R.parse([R.leaf(t) for t in tokens])) == brute_parse(tokens), tokens


def test_one_split_gives_the_cells_of_all_splits():
    r = random.Random(1)
    for _ in range(60):
        tokens = [r.choice("suaxSUAX-") for _ in range(r.randint(1, 11))]
        assert list(map(tuple, filter(None, R.parse([R.leaf(t) for t in tokens])))) == list(map(tuple, filter(None, chart(tokens))))
        assert R.answer(R.parse([R.leaf(t) for t in tokens])) == brute_parse(tokens)


def test_runs_of_deletions_are_one_leaf():
    assert R.parse([R.leaf("u"), R.leaf("-", 5), R.leaf("a")]) == R.parse([R.leaf(t) for t in "u-----a"])


def brute(table, damage=True):
    """The whole report by plain Python."""
    convs = {}
    for conv, turn, role, text, *_ in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        own = convs.setdefault(conv, [])
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
            own.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, counts, tokens = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, role, text in own:
            shown = text.rstrip(R.SPACES)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            token = role[:1] if role[:1] and role[:1] in "sua" else "x"
            tokens.append("-" if fault in ("blank", "duplicate") else token.upper() if fault else token)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = {t for t, *_ in own if t is not None}
        cost, audit = brute_parse(tokens) if own else (0, "")
        lines, left, last = [], iter(own), ""
        for edit in audit:
            due = "a" if last == "u" else "u"
            if edit == "I":
                lines.append(f"{R.ROLES[due]}:")
                last = due
                continue
            _, role, text = next(left)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else R.ROLES[due]}:{text}")
                last = role[:1] if edit == "K" else due
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines))
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_reports_against_plain_python(spark, block):
    turns = R.damaged(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    got = R.repaired_digests(turns, R.repair(turns, block)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(x[:-1]) for x in brute(rows()))


def test_the_query_is_the_operator(spark):
    got = R.structure_repair(spark.createDataFrame(rows(), SCHEMA))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(x[:-1]) for x in brute(rows()))


def test_repaired_turns(spark):
    turns = R.turns_of(spark.createDataFrame(rows(), SCHEMA))
    found = {}
    for r in R.repaired_turns(turns, R.repair(turns)).orderBy("conv", "position").collect():
        assert r["position"] == len(found.setdefault(r["conv"], [])) and r["edit"] in "KRI"
        found[r["conv"]].append(f"{r['role']}:{r['text']}")
    assert found == {x[0]: x[-1] for x in brute(rows(), damage=False) if x[-1]}


def test_hot_conversations_and_empty_tables(spark):
    """A third of the rows in one conversation, most of them one repeated turn: many blocks, few rows after counting."""
    table = [(1, 0, "user", "again.")] * 3000 + [(1, t, "assistant", "again.") for t in range(1, 900)] + [(k, 0, "user", "x.") for k in range(2, 3000)]
    turns = R.turns_of(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))
    got = {r["conv"]: r for r in R.repair(turns, 20).where("conv < 3").collect()}
    assert got[1]["audit"] == "K" + "D" * 2999 + "K" + "D" * 898 and got[1]["duplicate"] == 2999 + 898 and got[2]["audit"] == "KI"
    assert R.structure_repair(spark.createDataFrame([], SCHEMA)).count() == 0
