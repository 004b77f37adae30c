"""Conversation repair and whitening against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from salesflow.llm.bit_scatter import Whitener, scatter, whiten, whole
from salesflow.llm.dialogue_repair import Repair, repair

FAULTS = {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}
STEPS = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, turns) of the best edits of rows (role, text, fault), by trying all within the least cost."""
    names = {"u": "user", "a": "assistant"}

    def ways(state, i):
        if i < len(rows):
            role, text, fault = rows[i]
            yield 4, "D", state, i + 1, None
            if fault not in (1, 2):
                for to in STEPS[state]:
                    if role[:1] == to:
                        yield 3 * (fault == 3), "K", to, i + 1, (role, text)
                    elif to != "s":
                        yield 3 + 3 * (fault == 3), "R", to, i + 1, (names[to], text)
        for to in STEPS[state]:
            if to != "s":
                yield 3, "I", to, i, (names[to], "")

    best = {}

    def least(state, i, depth=0):  # cost of the rest; at most three Inserts in a row pay
        if depth > 3:
            return 10 ** 9
        if (state, i, depth) not in best:
            done = 0 if i == len(rows) and state in ("", "a") else 10 ** 9
            best[state, i, depth] = min([done, *(c + least(s, j, depth + 1 if j == i else 0) for c, _, s, j, _ in ways(state, i))])
        return best[state, i, depth]

    def all_ways(state, i, left, depth):
        if i == len(rows) and state in ("", "a") and left == 0:
            yield "", []
        for c, initial, s, j, turn in ways(state, i):
            d = depth + 1 if j == i else 0
            if c + least(s, j, d) <= left and d <= 3:
                for audit, turns in all_ways(s, j, left - c, d):
                    yield initial + audit, [turn] * (turn is not None) + turns

    total = least("", 0)
    audit, turns = min(all_ways("", 0, total, 0))
    return total, audit, turns


def expected(rows):
    """Result of repair for rows (conv, turn, role, text)."""
    out, held = {}, {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        after = held.setdefault(conv, [])
        if damage == 1:
            text = ""
        if damage == 2:
            text = "".join(c for c in text if c not in ".!?")
        if damage == 4:
            role = "user"
        after += [(turn, role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    for conv, after in held.items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in after:
            content = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not content else 2 if (role, text) in seen else 0 if content[-1] in ".!?" else 3
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, kept = cheapest(judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        out[conv] = (gaps, *(sum(f == n for _, _, f in judged) for n in (1, 2, 3)), illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_least_of_all_cheapest_edits(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", rnd.choice([0, 0, 0, 1, 2, 3, 3])) for i in range(rnd.randint(0, 7))]
        audit, turns = [], []
        search = Repair(lambda initial, times, turn: (audit.append(initial * times), turn and turns.append(turn)))
        for row in rows:
            search.row(*row)
        assert (search.end(), "".join(audit), turns) == cheapest(rows), rows


def test_edits_leave_early_and_ties_stay():
    """A long sound conversation holds few edits; long runs of Deletes stay one node while the choice before them is open."""
    audit = []
    search = Repair(lambda initial, times, turn: audit.append(initial * times))
    for i in range(4000):
        search.row(("user", "assistant")[i % 2], f"t{i}", 0)
        if i > 20:
            assert len("".join(audit)) > i - 12
    for i in range(3000):
        search.row("user", "again", 2)
    nodes, todo = 0, [search.root]
    while todo:
        nodes, todo = nodes + 1, todo + todo.pop().after
    assert nodes < 20
    search.end()
    assert "".join(audit) == "K" * 4000 + "D" * 3000


def talk_rows(seed=5):
    rnd, rows = random.Random(seed), []
    for conv in range(60):
        for turn in range(rnd.randint(1, 7)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            rows.append((conv, rnd.choice([turn, turn, turn + 5, None]), role, rnd.choice(["Yes.", "no", "What?", " \n", "é!", None, f"own {turn}."])))
    return rows + [(None, 1, "user", "No id."), (None, None, "assistant", "Still none."), (900, 3, "user", "Twice."), (900, 3, "user", "Twice."),
                   (901, 1, "user", "word " * 20000 + "."), (901, 2, "assistant", "Fine.")]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_repair(spark):
    rows = talk_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", fault string, copy int")
    want = expected(rows)
    assert found(repair(df.repartition(5))) == want
    assert found(repair(df.repartition(1))) == want
    assert repair(df.limit(0)).count() == 0


def test_a_conversation_that_loses_all_rows_is_returned(spark):
    gone = next((c, t) for c in range(999) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = found(repair(spark.createDataFrame([(*gone, "user", "Hello.")], SCHEMA)))
    assert got == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("dims, low, high", [(1, 0, 1), (5, -9, 9), (17, -3000, 70000), (3, -10 ** 15, 10 ** 15)])
def test_scatter_is_exact(dims, low, high):
    values = np.random.default_rng(dims).integers(low, high, (20000 if dims < 17 else 300, dims))
    sums, products = scatter(values)
    exact = values.astype(object)
    assert sums.tolist() == exact.sum(axis=0).tolist() and products.tolist() == exact.T.dot(exact).tolist()


def test_scatter_takes_numbers_beyond_64_bits():
    column = pa.array([[1e30, -2.5], [0.5], [], [-1e25, 1e300]])
    values = whole(column, 2)
    assert values.tolist()[1:3] == [[32, 0], [0, 0]] and values[0, 0] == int(64e30)
    sums, products = scatter(values)
    assert products[0, 0] == sum(int(v) ** 2 for v in values[:, 0]) and sums[1] == values[:, 1].sum()


def vectors(n=300, dims=6, seed=3):
    rnd = np.random.default_rng(seed)
    return (rnd.normal(size=(n, dims)) @ rnd.normal(size=(dims, dims)) + rnd.normal(size=dims) * 9).astype(np.float32)


def test_whiten(spark):
    held = vectors()
    rows = [(i, v.tolist(), i, "x") for i, v in enumerate(held)] + [(500, None, 0, ""), (501, [1.0, None] * 3, 0, ""), (502, [float("nan")] * 6, 0, ""),
                                                                  (503, [float("inf")] * 6, 0, ""), (7, held[7].tolist(), 7, "copy"), (None, held[9].tolist(), 0, "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n int, component string").repartition(4)
    got = whiten(df).toPandas()
    fit = np.vstack([held, held[7], held[9]]).astype(np.float64)
    x = np.floor(64 * fit).astype(np.int64) + 1000000
    n, total = len(x), x.sum(axis=0)
    assert len(got) == n * 6 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    centred = x - total / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    wide = got[got.vec_id.notna() & (got.vec_id != 7)].pivot(index="vec_id", columns="component", values="whitened").sort_index()
    assert list(wide.columns) == [1, 2, 3, 4, 5, 6]
    want = (centred @ basis / np.sqrt(values))[[i for i in range(300) if i != 7]]
    signs = np.sign((wide.to_numpy() * want).sum(axis=0))
    assert np.abs(wide.to_numpy() * signs - want).max() < 1e-8
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, values / values.sum(), rtol=1e-9)
    exact = dict(zip(range(300), ((n * x - total).astype(object) ** 2).sum(axis=1)[:300]))
    assert all(exact[i] == d for i, d in got[got.vec_id.notna()][["vec_id", "deviation"]].itertuples(index=False))
    assert (got.vec_id == 7).sum() == 12 and got.vec_id.isna().sum() == 6
    assert whiten(df, components=2).count() == n * 2


def test_whiten_odd(spark):
    schema = "vec_id bigint, embedding array<float>"
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert whiten(make([])).count() == 0 and whiten(make([(1, []), (2, None)])).count() == 0
    same = whiten(make([(1, [1.0, 2.0])] * 4)).collect()
    assert len(same) == 8 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in same)
    mixed = whiten(make([(1, [1.0]), (2, [1.0, 0.5]), (3, [])])).collect()
    assert len(mixed) == 6
    far = whiten(make([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 4.0])])).collect()
    assert len(far) == 6 and any(r.deviation is None for r in far)


def test_whitener_orders_components_by_spread():
    values = whole(pa.array(vectors().tolist()), 6)
    white = Whitener(len(values), *scatter(values), 32)
    assert (np.diff(white.values) <= 0).all() and abs(white.explained.sum() - 1) < 1e-12
