"""Operators over all documents against plain Python, and the pipeline."""

import os
import random

import brute
import numpy as np
import pytest
from odd_texts import LONG, ODD

import corpus_pipeline
from salesflow.llm import near_dup
from salesflow.llm.decontaminate import decontaminate
from salesflow.llm.kneser_ney import quality_scores, train
from salesflow.llm.mixture import hypergeometric_parts, mix, split
from salesflow.llm.near_dup import near_duplicates, prefix_pairs
from salesflow.llm.queries import ORACLES, QUERIES
from salesflow.llm.suffix_levels import Index, remove_repeats
from salesflow.session import materialize
from tools.check import rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def near_rows(seed=4):
    rnd, rows = random.Random(seed), []
    for base in range(6):
        text = words(rnd, rnd.randint(30, 80), 5000)
        for _ in range(12):
            copy = list(text)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = f"z{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(1000 + i, t) for i, t in enumerate(["a b", "A  b", "a", "", None, " "])]


def test_near_duplicates(docs):
    rows = near_rows()
    want = brute.near_duplicates(rows)
    assert {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs(rows)).collect()} == want
    assert len({v[1] for v in want.values()}) < len(rows) - 10


def test_texts_around_one_passage_are_compared_by_what_is_rare(docs):
    """One bucket of many texts that share a passage and little else; some of them are linked."""
    rnd = random.Random(31)
    passage, rows = words(rnd, 40, 900), []
    for i in range(150):
        own = words(rnd, rnd.choice([3, 6, 9, 14, 25]), 100000)
        rows.append((i, " ".join(passage + own)))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(passage + own[:-1] + ["changed"])))
    want = brute.near_duplicates(rows)
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs(rows)).collect()}
    assert got == want and len({v[1] for v in want.values()}) > 40


@pytest.mark.parametrize("seed", range(3))
def test_rarest_shingles_meet_for_every_linked_pair(spark, docs, seed):
    rnd = random.Random(seed)
    passage = words(rnd, 30, 900)
    rows = [(i, " ".join(passage[:rnd.randint(0, 30)] + words(rnd, rnd.randint(0, 12), 60))) for i in range(120)]
    members = spark.createDataFrame([(i, i) for i, _ in rows], "k bigint, comp bigint")
    met = {(r.a, r.b) for r in prefix_pairs(members, docs(rows), "doc_id", "text", 75).collect()}
    sets = {d: {" ".join(x) for x in brute.shingles(t)} for d, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked and linked <= met


def edited_copies(rnd, copies, most):
    base, rows = words(rnd, 60, 100000), []
    for i in range(copies):
        copy = list(base)
        for place in rnd.sample(range(60), rnd.randint(1, most)):
            copy[place] = f"z{rnd.randrange(100000)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_edited_copies_are_compared_without_rows_for_shingles_or_pairs(docs, monkeypatch):
    """Many copies of one text, most of them too different from each other: no step writes their shingles or their pairs."""
    rows, written = edited_copies(random.Random(9), 150, 5), {}

    def counted(df, name, *more):
        out = materialize(df, name, *more)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "materialize", counted)
    want = brute.near_duplicates(rows)
    assert {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs(rows)).collect()} == want and len({v[1] for v in want.values()}) > 20
    assert max(written.values()) <= near_dup.BANDS * len(rows), written


@pytest.mark.parametrize("block", [7, 40, 1024])
def test_blocks_of_a_bucket_meet_for_every_linked_pair(spark, docs, block):
    rows, rnd = edited_copies(random.Random(block), 90, 4), random.Random(2)
    comp = {i: rnd.choice([0, 0, 0, i]) for i, _ in rows}
    reps = near_dup.signatures(docs(rows), "doc_id", "text").select("k", "n", "sketch", "parity")
    rest = spark.createDataFrame([(b, i, comp[i]) for b in (5, 6) for i in comp] + [(7, 3, 3)], "bucket bigint, k bigint, comp bigint")
    met = [(r.a, r.b) for r in near_dup.block_pairs(rest, reps, 75, block).collect()]
    sets = {d: {" ".join(x) for x in brute.shingles(t)} for d, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(met) == len(set(met)) and linked and linked <= set(met) and all(a < b and comp[a] != comp[b] for a, b in met)
    assert len(met) < 90 * 89 / 4


def test_near_duplicates_odd(odd):
    got = near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got}
    assert by[8].component_id == 7 and not by[8].kept and by[0].kept and by[None].kept and by[None].component_id is None
    assert near_duplicates(odd.limit(0)).count() == 0


def test_the_kept_text_of_a_repeated_id_stays(spark, docs):
    copied, own = " ".join(f"w{i}" for i in range(40)), {i: " ".join(f"x{i}y{j}" for j in range(40)) for i in range(5, 15)}
    rows = [(3, copied)] + [(i, t) for i in own for t in (copied, own[i])]
    got = corpus_pipeline.near_duplicate_stage(spark, docs(rows), FOLDER).collect()
    assert {r.doc_id: r.text for r in got} == {3: copied} | own and len(got) == 11


def test_remove_repeats(docs):
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = []
    for i in range(50):
        s = rnd.randint(0, 2500)
        e = s + rnd.randint(90, 300)
        rows.append((i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 80))) + base[s:e] + rnd.choice(["", "é", "x"]) + base[e:e + rnd.randint(0, 200)]))
    rows += [(60, None), (61, ""), (62, "a" * 5000), (63, "ab" * 700), (64, "a" * 99), (65, "a" * 100), (66, base * 3)]
    got = {r.doc_id: tuple(r)[1:5] for r in remove_repeats(docs(rows)).collect()}
    assert got == brute.repeats(rows)
    assert {r.doc_id: tuple(r)[1:5] for r in remove_repeats(docs(rows), batches=1).collect()} == got


def test_levels_merge_geometrically(spark):
    index = Index(spark)
    for i in range(6):
        index.add(spark.createDataFrame([(i, f"{i}" * 40 + "shared passage " * 9)], "k bigint, t string"))
    assert [n for n, _ in index.levels] == [4, 2] and index.marks.any()


def test_remove_repeats_odd(odd):
    got = remove_repeats(odd).collect()
    assert len(got) == len(ODD) + 2 and sum(r.n_removed > 0 for r in got) == 1
    assert remove_repeats(odd.limit(0)).count() == 0


def test_decontaminate(spark, docs):
    rnd = random.Random(7)
    items = [(i, " ".join(words(rnd, n))) for i, n in enumerate([40, 25, 13, 12, 3, 1, 0])] + [(8, None), (None, "orphan item " * 9), (2, "second text of item two " * 4)]
    rows = []
    for i in range(60):
        body = words(rnd, 50)
        item = brute.ITEM.findall((items[i % 6][1]).lower())
        at = rnd.randint(0, max(0, len(item) - 13))
        body[20:20] = item[at:at + rnd.choice([5, 12, 13, 14, 30])]
        rows.append((i, " ".join(w.upper() if rnd.random() < .2 else w for w in body)))
    rows += [(100, items[8][1] and items[8][1]), (101, ""), (102, "orphan-item " * 20)]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, n int")
    got = {r.doc_id: tuple(r)[1:6] for r in decontaminate(docs(rows), bench).collect()}
    assert got == brute.decontaminate(rows, items)
    assert decontaminate(docs(rows), bench.limit(0)).filter("contaminated").count() == 0


def test_decontaminate_odd(odd, spark):
    bench = spark.createDataFrame([(1, LONG[:100])], "item_id bigint, text string")
    got = decontaminate(odd, bench).collect()
    assert len(got) == len(ODD) + 2 and [r.doc_id for r in got if r.contaminated] == [6]
    assert decontaminate(odd.limit(0), bench).count() == 0


def test_mix(docs, odd):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.randint(0, 60), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(900, None, "none"), (901, "x " * 4000, "a")]
    got = mix(docs(rows)).collect()
    again = mix(docs(list(reversed(rows)))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    want, source, taken = brute.mix_targets(rows), {d: s for d, _, s in rows}, {}
    for r in got:
        size, target = want[source[r.doc_id]]
        assert r.source_size == size and abs(r.target - target) < 1e-6 * max(1, target) and 0 <= r.taken <= 3 * r.size
        assert sum(d.words for d in r.draws) == r.taken
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, (_, t) in want.items())
    assert mix(odd.limit(0)).count() == 0 and mix(odd).count() == len(ODD) + 2


def test_split_gives_exact_quotas(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 0)], "g string, quota bigint")
    got = split(quotas, 8, 1).toPandas()
    assert got.groupby("g").quota.sum().to_dict() == {"a": 1000, "b": 37, "c": 0} and len(got) == 24
    assert set(got.groupby("shard").quota.sum()) <= {129, 130}


@pytest.mark.parametrize("have", [[10 ** 9, 5, 0, 3 * 10 ** 11], [10 ** 12] * 4, [2 * 10 ** 9, 1], [7, 10 ** 10]])
def test_quotas_of_billions(have):
    draw = np.random.default_rng(1)
    for take in (0, 1, sum(have) // 3, sum(have)):
        parts = hypergeometric_parts(draw, np.array(have, np.int64), take)
        assert parts.sum() == take and (parts >= 0).all() and (parts <= have).all()
        assert all(abs(p - take * h / sum(have)) <= 8 * (h + 1) ** 0.5 for p, h in zip(parts.tolist(), have))


def test_split_of_billions(spark):
    quotas = spark.createDataFrame([("a", 4 * 10 ** 10), ("b", 37), ("c", 10 ** 9)], "g string, quota bigint")
    got = split(quotas, 8, 1).toPandas()
    assert got.groupby("g").quota.sum().to_dict() == {"a": 4 * 10 ** 10, "b": 37, "c": 10 ** 9}


def kn_rows(n=120):
    rnd = random.Random(11)
    good = [(i, " ".join(rnd.choice(["the", "cat", "sat", "on", "mat", "and", "ran"]) for _ in range(rnd.randint(20, 60)))) for i in range(n)]
    bad = [(1000 + i, "".join(rnd.choice("XQZ#%!|7") for _ in range(150))) for i in range(20)]
    return good, bad


def test_kneser_ney(spark, docs):
    good, bad = kn_rows()
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good[:80]] + [(1000, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    df = docs(good + bad + [(2000, None), (2001, "")])
    got = {r.doc_id: r for r in quality_scores(df, labels).collect()}
    assert not any(got[d].kept for d, _ in bad) and sum(got[d].kept for d, _ in good[80:]) >= 38 and not got[2000].kept and got[2001].perplexity is None
    sharded = {r.doc_id: r for r in quality_scores(df, labels, shard_rows=200).collect()}
    assert all(sharded[d].n_symbols == got[d].n_symbols and (sharded[d].perplexity or 0) == pytest.approx(got[d].perplexity or 0, abs=2e-6) for d in got)
    assert quality_scores(df, labels.limit(0)).filter("perplexity IS NOT NULL").count() == 0
    assert quality_scores(df.limit(0), labels).count() == 0


def test_model_is_the_textbook_formula(spark):
    good, _ = kn_rows(30)
    text = [(t, "en") for _, t in good]
    rows = train(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(text)], "k bigint, t string, lang string")).collect()
    plain = brute.kneser_ney([t for t, _ in text], 4)
    for n in range(1, 5):
        assert sorted(round(r.value, 9) for r in rows if r.n == n and r.seen) == sorted(round(v, 9) for v in plain["seen", n])
        assert sorted(round(r.value, 9) for r in rows if r.n == n and not r.seen) == sorted(round(v, 9) for v in plain["weight", n])


def test_kneser_ney_odd(spark, odd):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality_scores(odd, labels).count() == len(ODD) + 2


def pipeline_rows():
    rnd, rows = random.Random(21), []
    item = words(rnd, 40, 9000)
    for i in range(60):
        rows.append((i, "\n".join(" ".join(words(rnd, 12, 9000)) for _ in range(6)), f"s{i % 3}"))
    rows[5] = (5, rows[4][1], "s2")
    rows[7] = (7, " ".join(item[:30]) + " " + " ".join(words(rnd, 30, 9000)), "s1")
    rows[9] = (9, rows[9][1] + " token=abcdef0123", "s0")
    return rows + [(100, "too short", "s0"), (101, None, "s1"), (102, "", None)], [(0, " ".join(item))]


def test_pipeline_equals_its_steps(spark, docs, tmp_path):
    rows, items = pipeline_rows()
    folder = str(tmp_path)
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(folder + "/benchmark.parquet")
    held = spark.read.parquet(folder + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, folder)
        assert held.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        held = corpus_pipeline.materialize(held, "step")
    want = brute.pipeline(rows, items)
    assert {r.doc_id: r.text for r in held.collect()} == {d: t for d, t, _ in want}
    targets = brute.mix_targets(want)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == {d for d, _, _ in want}
    source = {d: s for d, _, s in want}
    assert all(abs(r.target - targets[source[r.doc_id]][1]) < 1e-6 * max(1, r.target) for r in got)


def test_pipeline_stages_take_odd_rows(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        folder = FOLDER
        if os.path.isdir(folder):
            assert stage(spark, odd, folder).count() <= len(ODD) + 2 and stage(spark, odd.limit(0), folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    assert rows_of(QUERIES[name](spark, FOLDER).toArrow()) == rows_of(sql_rows(con, ORACLES[name]))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    table = "pages" if name.startswith("op3") else "documents"
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
