"""Held-out accuracy of the classifiers; the pipeline against brute force."""

import random
import zlib

import pytest

import corpus_pipeline
from tremolith.llm import compression, quality, queries, toxicity

WORDS = ["".join(random.Random(i).choice(["ka", "lo", "mi", "ter", "un", "sa", "re"]) for _ in range(3)) for i in range(300)]
RUDE = ["vlorpish", "grumble", "zzkrat", "snorfle"]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def make(n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(20, 150))]
        toxic, good = rng.random() < 0.25, rng.random() < 0.7
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        docs.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), "en", "s", 0))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_rare_insults_are_learnt():
    rng = random.Random(11)
    rude = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(120)]
    rows = []
    for i in range(2400):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(20, 80))]
        for _ in range(2 * (i % 2)):
            w.insert(rng.randrange(len(w)), rng.choice(rude))
        rows.append((" ".join(w), i % 2))
    rng.shuffle(rows)
    learn, rest = rows[:2000], rows[2000:]
    model = toxicity.train(learn, {0: 1000, 1: 1000})
    right = [(s >= 0.5) == (y == 1) for s, (_, y) in zip(compression.Scorer(model).scores([t for t, _ in rest]), rest, strict=True)]
    assert sum(right) / len(right) > 0.9


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels = make()
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    docs += [(1000, docs[5][1], "en", "s", 0), (1001, docs[5][1] + " extra", "en", "s", 0), (1002, docs[7][1] + " " + item, "en", "s", 0), (1003, None, "en", "s", 0), (1004, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), docs, labels


@pytest.mark.parametrize("name,column,threshold", [("op9_toxicity", 2, toxicity.THRESHOLD), ("op10_quality", 1, quality.THRESHOLD)])
def test_held_out_accuracy(spark, tables, name, column, threshold):
    d, docs, labels = tables
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, d).collect()}
    assert len(got) == len(docs)
    test = [(i, row[column]) for i, *row in [(lab[0], *lab) for lab in labels] if held(i)]
    right = [int(got[i]["score"] >= threshold) == y for i, y in test]
    assert sum(right) / len(right) > 0.93
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for i, r in got.items())


def test_scores_do_not_depend_on_held_out_labels(spark, tables):
    d, _, _ = tables
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.withColumn("toxic", (1 - labels.toxic) * compression.held_out(labels.doc_id).cast("int") + labels.toxic * (1 - compression.held_out(labels.doc_id).cast("int")))
    a, b = toxicity.trained_model(docs, labels), toxicity.trained_model(docs, flipped)
    assert a.first == b.first and a.second == b.second and (a.weights == b.weights).all()


def test_without_labels_and_rows(spark, tables):
    d, _, labels = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.trained_model(docs, none)
    assert {round(r["score"], 6) for r in compression.score_rows(docs, model, "doc_id", "text", 0.7).collect()} == {0.5}
    assert compression.score_rows(docs.limit(0), quality.trained_model(docs, none), "doc_id", "text", 0.5).count() == 0
    odd = spark.createDataFrame([(None, "a", 1), (1, None, 2), (1, "x" * 300000, 3)], "doc_id long, text string, score int")
    assert toxicity.remove_toxic(odd, model).columns == odd.columns
    assert toxicity.remove_toxic(odd, model).count() == 3


def test_windows_cover_texts():
    for n in (0, 1, 127, 128, 129, 240, 1000):
        seg = compression.window_segments(n, 128, 112)
        covered = set()
        for start, size in seg.tolist():
            covered.update(range(start, start + size))
        assert covered == set(range(n))


def test_pipeline(spark, tables):
    d, docs, _ = tables
    model = toxicity.trained_model(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    scorer = compression.Scorer(model)
    rows = [r for r, s in zip(docs, scorer.scores([r[1] for r in docs]), strict=True) if s < toxicity.THRESHOLD]
    last = {}
    for r in rows:
        if (r[1] or "") not in last or last[r[1] or ""][0] < r[0]:
            last[r[1] or ""] = r
    rows = sorted(last.values())

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    rows = [r for r in rows if root[r[0]] == r[0]]
    item = shingles(spark.read.parquet(f"{d}/benchmark.parquet").first()["text"])
    rows = [r for r in rows if 4 * len(item & sets[r[0]]) < 3 * len(item)]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == {r[0] for r in rows} and 1002 not in got
    assert all(got[r[0]]["text"] == (r[1] or "") and got[r[0]]["lossless"] for r in rows)


def test_stages_keep_the_columns_of_documents(spark, tables):
    d, _, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), d).columns == docs.columns, name
