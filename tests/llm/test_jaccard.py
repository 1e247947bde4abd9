import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import DOCS, documents, nothing, words
from pyspark.sql import functions as F

from poolsight.llm import jaccard as J
from poolsight.llm.components import components
from poolsight.llm.histogram import histogram

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def by_hand(rows, n, percent):
    sets = [shingles(r["text"], n) for r in rows]
    near = defaultdict(set)
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(len(rows)):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        ids = [rows[j]["doc_id"] for j in reach if rows[j]["doc_id"] is not None]
        out.append((str(rows[i]["doc_id"]), len(sets[i]), str(min(ids)) if ids else "None", len(near[i])))
    return sorted(out)


def near_copies(rng):
    """Chains of edits, so that components are wider than their links."""
    out = []
    for g in range(6):
        w = words(rng, rng.choice([30, 90, 200]), 10**6).split()
        for i in range(12):
            out.append((7000 + 100 * g + i, " ".join(w), "en", "a", 1))
            w = w.copy()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    passage = words(rng, 60, 10**6)
    out += [(8000 + i, passage + " " + words(rng, rng.randint(1, 60), 10**6), "en", "a", 1) for i in range(40)]
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_as_by_hand(spark, monkeypatch, n, percent):
    monkeypatch.setattr(J, "CELLS", 64)
    docs = documents(spark, extra=near_copies(random.Random(n))).withColumn("h", F.lit("theirs"))
    got = J.ngram_jaccard_join(docs.repartition(5), n, percent).collect()
    expected = by_hand(docs.collect(), n, percent)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in got) == expected
    assert len({e[2] for e in expected}) > 60 and max(e[3] for e in expected) > 4


@pytest.mark.parametrize("percent", [50, 80, 90, 99])
def test_list_answers_keep_every_link(percent):
    rng = np.random.default_rng(percent)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = []
    for _ in range(40):
        keep = base[rng.random(60) < 0.97]
        sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 63, rng.integers(0, 4), dtype=np.uint64))))
    rank = rng.integers(0, 255, 1 << 10).astype(np.uint8)
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        length = len(s) - J.needed_alone(len(s), percent) + J.COMMON
        for pos, token in enumerate(J.order_of(s, rank)[:length].tolist()):
            lists[token].append((0, len(s), pos, i, 0, 0, *J.parity(s).tolist()))
    found = Counter()
    for rows in lists.values():
        run = np.array(sorted(rows), dtype=np.int64).T.copy()
        for x, ys in J.list_answers(run, percent):
            found.update((min(int(run[3, x]), int(y)), max(int(run[3, x]), int(y))) for y in run[3, ys])
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                assert found[j, i] >= min(J.COMMON, both)


def test_lists_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(2)
        docs = spark.createDataFrame(near_copies(rng), DOCS)
        got = J.ngram_jaccard_join(docs).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in got) == by_hand(docs.collect(), 3, 90)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_overlap_from_differences():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 200, dtype=np.uint64)) for _ in range(6)]
    sets.append(sets[0][:0])
    group = J.Group(sets[0])
    for i, s in enumerate(sets):
        group.add((i, len(s)), s, 1)
    group.freeze()
    for i in range(7):
        assert group.overlaps(i, np.arange(7)).tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]


def test_pairs_without_a_common_group(spark, monkeypatch):
    """Small parts give many; without least hashes every pair goes to its lesser set's own group."""
    docs = spark.createDataFrame(near_copies(random.Random(3)), DOCS)
    expected = by_hand(docs.collect(), 3, 90)
    columns = lambda got: sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in got)
    own = J.group_ties
    monkeypatch.setattr(J, "group_ties", lambda routes, grouped, percent: own(routes, grouped, percent, pairs=3))
    assert columns(J.ngram_jaccard_join(docs).collect()) == expected
    routed = J.routed

    def all_far(answers):
        return routed(answers.withColumn("ways", F.transform("ways", lambda w: F.lit(J.FAR).cast("long"))))

    monkeypatch.setattr(J, "routed", all_far)
    assert columns(J.ngram_jaccard_join(docs).collect()) == expected


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    joined = J.ngram_jaccard_join(docs)
    kept = J.keep_one(docs, joined).collect()
    groups = defaultdict(set)
    for e in J.ngram_jaccard_join(docs).collect():
        groups[e["group"]].add((e["doc_id"], e["text_hash"]))
    ids = Counter((r["doc_id"], r["text"]) for r in kept)
    assert max(ids.values()) == 1
    assert len(kept) == len(groups) - 1 + len(groups[None])
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None and 1000 <= r["doc_id"] < 3000} == {1000}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (-5, 200), (200, -5)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}, 200: -5}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_histogram_counts_all_rows(spark):
    counts = histogram(spark.range(10_000).repartition(3), 128, lambda b: [b.column(0).to_numpy() % 128])
    assert counts.tolist() == np.bincount(np.arange(10_000) % 128).tolist()


def test_nothing(spark):
    assert J.ngram_jaccard_join(nothing(spark)).collect() == []
    lone = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert [tuple(r) for r in J.ngram_jaccard_join(lone).select("doc_id", "n_shingles", "component_id", "n_links").collect()] == [(1, 0, 1, 0)]
