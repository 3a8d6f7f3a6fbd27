"""op11: features against plain counts, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity as tx
from millrace.llm.queries import QUERIES

WORDS = [a + b for a in ("lo", "mi", "ta", "re", "sun", "gra") for b in ("rem", "nel", "vo", "dis", "ka", "pel")]


def made_up(n=500, seed=3):
    """Texts of plain words; every third has words with the beginning zorvu- at a random place, and the label 1."""
    draw = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = draw.choices(WORDS, k=draw.randint(20, 80))
        if k % 3 == 0:
            for _ in range(2):
                words.insert(draw.randrange(len(words)), "zorvu" + draw.choice(WORDS))
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def feature(text, lexicon=None):
    return dict(zip(tx.FEATURES, tx.Reader(lexicon or {}).features(text)))


def test_features():
    f = feature("You are an IDIOT, really!!")
    assert f["insult_rate"] == 20 and f["second_rate"] == 20 and f["near_second_rate"] == 20 and f["shouted_rate"] == 0.2
    assert f["mark_rate"] == pytest.approx(100 * 2 / 26) and f["mark_runs"] == 20 and f["capital_rate"] == pytest.approx(6 / 26)
    assert feature("you " + "word " * 10 + "idiot")["near_second_rate"] == 0  # too far away
    for hidden in ("1d10t", "i.d.i.o.t", "idiooooot", "i d i o t", "id!ot", "*idi0t*"):
        f = feature(f"what a {hidden} here")
        assert f["hidden_hits"] == 1 and f["insult_rate"] > 0, hidden
    for clean in ("", " \n", "a b c d e f", "3.14 http://x.y/z A1 B2", "ïdëä 日本語 ß"):
        f = feature(clean)
        assert f["insult_rate"] == f["hidden_hits"] == f["learned_hits"] == 0
    assert feature("") == dict.fromkeys(tx.FEATURES, 0.0)
    lexicon = {"zorvu-": (50.0, 4.0), "blam": (9.0, 2.0)}
    f = feature("Zorvuka is blam, zorv not", lexicon)
    assert f["learned_hits"] == 2 and f["learned_odds"] == 4.0 and f["learned_rate"] == 40 and f["learned_sum_rate"] == pytest.approx(120)


def test_rates_equal_plain_counts():
    draw = random.Random(5)
    for _ in range(50):
        words = draw.choices(["you", "Idiot!", "tree", "SHOUT", "scum", "go", "aaaargh", "x@y", "du"], k=draw.randint(1, 60))
        text, f = " ".join(words), None
        f = feature(text)
        n, hits = len(words), [k for k, w in enumerate(words) if w in ("Idiot!", "scum")]
        people = [k for k, w in enumerate(words) if w in ("you", "du")]
        assert f["insult_rate"] == pytest.approx(100 * len(hits) / n)
        assert f["second_rate"] == pytest.approx(100 * len(people) / n)
        assert f["near_second_rate"] == pytest.approx(100 * sum(any(abs(p - h) <= tx.NEAR for p in people) for h in hits) / n)
        assert f["insult_share_max"] == pytest.approx(max((sum(h <= g < h + 50 for g in hits) for h in hits), default=0) / min(n, 50))
        assert f["shouted_rate"] == pytest.approx(words.count("SHOUT") / n) and f["stretched_rate"] == pytest.approx(100 * words.count("aaaargh") / n)


def test_residual_choice_leaves_out_what_goes_beside():
    """companion is only in texts that have tell-; both words alone would look alike."""
    draw = np.random.default_rng(1)
    has = np.zeros((400, 4), np.float32)
    has[:, 0] = 1  # tell-
    has[:, 1] = 1  # tells: a relative of it
    has[draw.random(400) < 0.03, 2] = 1  # companion
    has[:300, 3] = 1  # another
    found = tx.choose(["tell-", "tells", "companion", "another"], np.array([2.0, 2.0, 20.0, 2.0]), has, [2000, 400])
    assert set(found) == {"tell-", "another"} and found["tell-"][0] > 100


def test_held_out_accuracy(spark):
    docs, labels = made_up()
    found = {r["doc_id"]: r for r in tx.score_toxicity(*frames(spark, docs, labels)).collect()}
    assert len(found) == len(docs)
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(found[k]["predicted"], y) for k, y in labels if found[k]["held_out"]]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs, labels = made_up(300)
    other = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in labels]
    score = lambda labels: sorted((r["doc_id"], r["score"]) for r in tx.score_toxicity(*frames(spark, docs, labels)).collect())
    assert score(labels) == score(other)


def test_query_finds_toxic_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op11_boosted_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p for p, y in held if y == 0) <= 0.02 * len(held) and sum(p for p, y in held if y == 1) >= 0.5 * sum(y for _, y in held)


def test_odd_rows(spark):
    docs, labels = made_up(240)
    docs += [(900, None), (901, ""), (902, "zorvuka " * 40_000), (903, "ok " * 40_000 + "zorvuka zorvunel"), (None, "zorvuka zorvurem lorem"), (0, docs[1][1])]
    labels += [(5000, 1), (None, 1), (3, None), (4, 7), (6, 0), (6, 1)]
    df, known = frames(spark, docs, labels)
    df, known = (x.withColumns({c: F.lit("x") for c in ("id", "y", "f", "score", "held_out", "fold", "weight", "label", "margin", "_text")}) for x in (df, known))
    rows = tx.score_toxicity(df, known).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[900][0]["score"] == by[901][0]["score"] < 0.3
    assert by[None][0]["held_out"] is False and by[902][0]["predicted"] == 1 and by[None][0]["predicted"] == 1 and len(by[0]) == 2
    assert tx.score_toxicity(df.limit(0), known).collect() == []
    for no_model in (known.limit(0), known.where("toxic = 0")):
        assert {r["score"] for r in tx.score_toxicity(df, no_model).collect()} == {0.0}
    assert {r["score"] for r in tx.score_toxicity(df, known.where("toxic = 1")).collect()} == {1.0}
