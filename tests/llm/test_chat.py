import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat as C

LEGAL = {(-1, 0), (-1, 1), (0, 1), (1, 2), (2, 1)}


def brute(roles):
    """Least cost over all labels, merges and numbers of empty turns."""
    best = None
    for labels in itertools.product(range(3), repeat=len(roles)):
        paid = sum(0 if r == C.ROLES[q] else C.UNKNOWN if r not in C.ROLES else C.RELABEL for r, q in zip(roles, labels, strict=True))
        states = {-1: 0}
        for q in labels:
            after = {}
            for p, cost in states.items():
                if p == q:
                    after[q] = min(after.get(q, 99), cost + C.MERGE)
                for n in range(3):
                    for extra in itertools.product(range(3), repeat=n):
                        path = (p, *extra, q)
                        if all(x in LEGAL for x in itertools.pairwise(path)):
                            after[q] = min(after.get(q, 99), cost + C.INSERT * n)
            states = after
        for p, cost in states.items():
            total = paid + cost + C.INSERT * {0: 2, 1: 1, 2: 0}[p]
            best = total if best is None else min(best, total)
    return best


def legal(text):
    roles = [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line != "<|end|>"]
    states = [-1, *map(C.ROLES.index, roles)]
    return all(x in LEGAL for x in itertools.pairwise(states)) and states[-1] == 2


def test_least_cost_and_legal(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    rng = random.Random(4)
    convs = {c: [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.randint(1, 5))] for c in range(60)}
    convs[60], convs[61] = ["user", "assistant"] * 20, ["system"]
    rows = [(c, t, r, f"t{c}.{t}" if (c + t) % 7 else None, 0) for c, roles in convs.items() for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int").repartition(5)
    out = {r.conv_id: r for r in C.rendered(df).collect()}
    assert len(out) == len(convs)
    for c, roles in convs.items():
        assert legal(out[c].rendered)
        if len(roles) <= 5:
            assert out[c].cost == brute(roles), roles
        at = [out[c].rendered.index(f"t{c}.{t}") for t in range(len(roles)) if (c + t) % 7]
        assert at == sorted(at)
    assert out[60].cost == 0


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_blocks_change_no_cost(spark, block):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "x"]), f"<{c}.{t}>") for c in range(30) for t in range(40)]
    rows += [(30, None, "user", "first"), (30, 0, "assistant", "then"), (None, 3, "user", "nobody"), (None, 900, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = C.format_turns(df, block).collect()
    assert len(got) == len(rows)
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in got if r.conv_id == c), key=lambda r: r.place)
        assert [r.place for r in turns] == list(range(len(turns)))
        repair = C.Repair()
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0)):
            repair.feed(r[2])
        assert [r.cost for r in turns] == [None] * (len(turns) - 1) + [C._whole(repair.paths)[0]]
        text = "".join(r.piece for r in turns)
        assert legal(text)
        messages = [r.message for r in turns]
        assert all(b == a + (0 if "merge" in r.action else 1 + (r.inserted if r is not turns[-1] else r.message - a - 1)) for a, b, r in zip([-1, *messages], messages, turns, strict=False))
        opened = text.count("<|user|>") + text.count("<|assistant|>") + text.count("<|system|>")
        assert opened == messages[-1] + 1 + len(C._CLOSING[C.ROLES.index(turns[-1].role)])


def test_long_conversation_of_one_role(spark):
    """100,000 turns of the user: as many blocks as numbers ask for, and no task with more than a block in memory."""
    n = 100_000
    df = spark.range(n).selectExpr("7L as conv_id", "id as turn", "'user' as role", "'t' as text")
    out = C.format_turns(df)
    r = out.selectExpr("count(*) n", "max(cost) cost", "count(cost) costs", "max(place) place", "max(message) message").first()
    assert (r.n, r.cost, r.costs, r.place) == (n, n - 1 + C.INSERT, 1, n - 1) and r.message == 0
    long_text = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert [len(r.piece) for r in C.format_turns(long_text).orderBy("place").collect()][0] > 3_000_000


def test_edges(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert C.format_turns(spark.createDataFrame([], kind)).count() == 0
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x")], kind)
    out = {r.conv_id: r for r in C.rendered(df).collect()}
    assert set(out) == {None, 1}
    assert out[1].rendered == "<|user|>\nx\nx<|end|>\n<|assistant|>\n<|end|>\n" and out[1].cost == 3


def test_blocks_hold_few_rows_whatever_the_turn_numbers(spark, monkeypatch):
    """Rows without a turn number, and a conversation whose turns share one, are cut like others: no block holds more than BLOCK rows."""
    rows = [(1, None, "user", f"n{k}") for k in range(90)] + [(2, 5, ("user", "assistant")[k % 2], f"s{k}") for k in range(90)] + [(None, 1, "user", "x")] * 90
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    dealt = []
    real = C.global_rank

    def noted(frame, order, name="rank"):
        out = real(frame, order, name)
        dealt.append(out)
        return out

    monkeypatch.setattr(C, "global_rank", noted)
    got = C.format_turns(df, 16).collect()
    most = dealt[0].groupBy("conv_id", F.expr("rank div 16")).count().agg(F.max("count")).first()[0]
    assert most <= 16 and len(got) == len(rows)
    whole = C.format_turns(df, 1000).collect()
    shown = lambda out: sorted(((r.conv_id or 0, r.place, r.piece, r.cost or 0) for r in out))
    assert shown(got) == shown(whole)
