"""Removal of repeated phrases against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from odd_texts import LONG, ODD

from salesflow.llm.phrase_automata import Automaton, remove_phrases
from salesflow.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLDER = "/root/testdata/sf0.001"


def expected(rows, window=13):
    """doc_id, words, removed words and hash of the rest, row by row."""
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, words in split:
        if d is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i:i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        if d is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i:i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def phrase_rows(seed, n=60, vocabulary=3000):
    rnd = random.Random(seed)
    some = lambda k, v=vocabulary: [f"w{rnd.randrange(v)}" for _ in range(k)]
    shared = [some(k) for k in (13, 14, 12, 40, 90, 25)]
    rows = []
    for i in range(n):
        words = some(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 3)):
            passage = rnd.choice(shared)
            a = rnd.randint(0, max(0, len(passage) - 13))
            words += passage[a:a + rnd.choice([12, 13, 20, 99])] + some(rnd.randint(0, 6))
        rows.append((rnd.choice([i, i, i, i // 2]), rnd.choice([" ", "\n", "  \t"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_phrases(docs, seed):
    rows = phrase_rows(seed)
    got = remove_phrases(docs(rows), per_automaton=(100_000, 7, 40)[seed], per_task=(200_000, 5, 30)[seed])
    assert rows_of(got) == expected(rows)


def test_phrases_of_few_words(docs):
    """Hardly any different words: runs that repeat within a document, ties among hashes, overlapping windows."""
    rows = [(i, " ".join(random.Random(i).choice("ab") for _ in range(60))) for i in range(30)] + [(50 + i, "a " * (10 + i)) for i in range(8)]
    assert rows_of(remove_phrases(docs(rows))) == expected(rows)


def test_large_groups_and_a_phrase_in_every_document(docs):
    rnd = random.Random(8)
    text, phrase = " ".join(f"x{rnd.randrange(999)}" for _ in range(60)), " ".join(f"p{i}" for i in range(15))
    rows = [(i, text) for i in range(200)] + [(500 + i, f"own{i} words{i} {phrase} and then{i}") for i in range(300)]
    rows += [(900 + i, f"é \x00 {phrase}\x1f {phrase.upper()} ") for i in range(3)]
    got = remove_phrases(docs(rows), per_automaton=10, per_task=50)
    assert rows_of(got) == expected(rows)
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert spans[0] == [] and [tuple(s) for s in spans[1]] == [(0, 60)] and [tuple(s) for s in spans[700]] == [(2, 18)]


def test_phrases_odd(odd, docs, spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(8, ODD[8]), (None, "no id at all")]
    assert rows_of(remove_phrases(odd)) == expected(rows)
    assert remove_phrases(odd.limit(0)).count() == 0
    nameless = [(None, LONG[:500]), (None, LONG[:500]), (4, LONG[:500]), (5, LONG[:300]), (5, LONG[:500]), (5, LONG[:500])]
    assert rows_of(remove_phrases(docs(nameless))) == expected(nameless)


def test_phrases_with_text_ids(spark):
    body = " ".join(f"v{i}" for i in range(20))
    got = remove_phrases(spark.createDataFrame([("b", body), ("a", body), ("é", "x " + body)], "doc_id string, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {"a": 0, "b": 20, "é": 20}


def test_automaton_matches_words_not_letters():
    words = [f"w{i}" for i in range(13)]
    machine = Automaton([(" ".join(words).encode(), 3)])
    bodies = [" ".join(words).encode(), " ".join(["x" + words[0], *words[1:]]).encode(), " ".join(["q", *words, *words[1:]]).encode()]
    body, start, end = machine.located(bodies, np.array([3, 9, 9]))
    assert (body.tolist(), start.tolist(), end.tolist()) == ([2], [1], [14])


@pytest.mark.parametrize("vocabulary", [2, 40])
def test_automaton_equals_all_windows(vocabulary):
    """Passages that share cores, more of them than are compared one by one, over few and over many words."""
    rnd = random.Random(vocabulary)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    core = [word() for _ in range(6)]
    passages = [([*[word() for _ in range(7)], *core, *[word() for _ in range(rnd.randint(0, 12))]], rnd.randrange(9)) for _ in range(60)]
    windows = {}
    for words, first in passages:
        for i in range(len(words) - 12):
            windows.setdefault(tuple(words[i:i + 13]), set()).add(first)
    machine = Automaton([(" ".join(w).encode(), first) for w, first in passages])
    bodies = [[word() for _ in range(rnd.randint(0, 9))] + rnd.choice(passages)[0][rnd.randint(0, 3):] + [word()] for _ in range(40)] + [["a"], []]
    keys = np.array([rnd.randrange(10) for _ in bodies])
    want = set()
    for b, (words, key) in enumerate(zip(bodies, keys)):
        for i in range(len(words) - 12):
            if any(first < key for first in windows.get(tuple(words[i:i + 13]), ())):
                want.update((b, j) for j in range(i, i + 13))
    got = {(b, j) for b, s, e in zip(*machine.located([" ".join(w).encode() for w in bodies], keys)) for j in range(s, e)}
    assert got == want


def test_query_over_the_sample(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_repeated_phrases"](spark, FOLDER)) == expected(rows)
