import random

import corpus_pipeline as P
from cases import documents, nothing, words
from pyspark.sql import functions as F
from test_decontamination import by_hand as hits_by_hand
from test_jaccard import by_hand as groups_by_hand

from poolsight.llm.quality import THRESHOLD, features, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def folder(spark, path):
    """A table folder with good and shouted documents, copies and benchmark passages."""
    rng = random.Random(6)
    items = [(i, words(rng, 30, 10**6)) for i in range(6)]
    docs, labels = [], []
    for i in range(260):
        text = words(rng, rng.randint(20, 150), 3000)
        if good := rng.random() < 0.75:
            text += "."
        else:
            text = text.upper().replace(" ", "!! ")
        docs.append((i, text, "en", rng.choice("aab"), len(text)))
        labels.append((i, int(good), 0))
    docs += [(500 + i, docs[0][1] if i % 2 else docs[1][1] + " tail", "en", "a", 9) for i in range(20)]
    docs += [(600 + i, words(rng, 60, 3000) + " " + text + " " + words(rng, 60, 3000), "en", "b", 9) for i, text in items]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def test_each_stage_as_by_hand(spark, tmp_path):
    sf = str(tmp_path / "t")
    items = folder(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert docs.columns[: len(COLUMNS)] == COLUMNS
        if name == "quality":
            import pyarrow as pa

            machine = train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            scores = [float(machine.score(features(pa.array([r["text"]]), pa.array([r["n_chars"]])))[0]) for r in before]
            assert {r["doc_id"] for r in kept[name]} == {r["doc_id"] for r, s in zip(before, scores, strict=True) if s >= THRESHOLD}
            shouted = {r["doc_id"] for r in before if "!!" in r["text"]}
            assert len(shouted & {r["doc_id"] for r in kept[name]}) < 0.1 * len(shouted)
            assert len(kept[name]) > 0.95 * (len(before) - len(shouted))
        elif name == "near_duplicates":
            groups = groups_by_hand(before, P.NEAR_WORDS, P.NEAR_PERCENT)
            assert {str(r["doc_id"]) for r in kept[name]} == {component for _, _, component, _ in groups}
        elif name == "decontamination":
            assert [r["doc_id"] for r in sorted(kept[name])] == sorted(r["doc_id"] for r in before if not hits_by_hand(r["text"], items)[-1])
            assert len(before) - len(kept[name]) == 6
        elif name == "mix":
            assert {r["doc_id"] for r in kept[name]} <= {r["doc_id"] for r in before} and len(kept[name]) > 0.6 * len(before)
        else:
            assert sorted(tuple(r)[:5] for r in kept[name]) == sorted(tuple(r) for r in before)
            assert len({(r["shard"], r["slot"]) for r in kept[name]}) == len(before)
    assert sorted(map(tuple, P.run(spark, sf).select(*COLUMNS).collect())) == sorted(tuple(r)[:5] for r in kept["shard"])


def test_stages_stand_awkward_and_no_rows(spark, tmp_path):
    sf = str(tmp_path / "t")
    folder(spark, sf)
    for docs in (documents(spark).withColumn("score", F.lit("theirs")).withColumn("group", F.lit(1)), nothing(spark)):
        rows = docs.count()
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf)
            assert out.columns[: len(docs.columns)] == docs.columns
            assert out.count() <= rows or name == "mix"
