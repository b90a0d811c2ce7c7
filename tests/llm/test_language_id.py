import re
from collections import Counter

from pyspark.sql import functions as F

from fleetgauge.llm import language_id as L
from fleetgauge.llm.common import held_out


def plain_ranking(texts, top):
    n = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            s = f"_{w}_"
            n.update(list(w))
            n.update(s[i:i + 2] for i in range(len(s) - 1))
            n.update(s[i:i + 3] for i in range(len(s) - 2) if len(w) > 1)
    order = lambda g: (len(g), [0 if c == "_" else ord(c) for c in reversed(g)])
    return sorted(n, key=lambda g: (-n[g], order(g)))[:top]


def plain_predict(text, learned, top):
    mine = plain_ranking([text], top)
    if not mine:
        return "und"
    far = {k: sum(abs(i - p.index(g)) if g in p else top for i, g in enumerate(mine)) for k, p in sorted(learned.items())}
    return min(far, key=lambda k: far[k])


TEXTS = [("en", "the cat and the dog went to the house"), ("en", "this is the other thing that they were after, then"), ("de", "der hund und die katze sind in dem haus"),
         ("de", "über die brücke ging ein größerer mann, nicht wahr"), ("fr", "le chat était là où les élèves étaient"), (None, "no language"), ("fr", None)]


def test_profiles_and_predictions_match_the_plain_version(spark):
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(TEXTS)], "doc_id long, text string, lang string")
    learned = L.fit(df, top=60)
    plain = {k: plain_ranking([t for x, t in TEXTS if x == k and t], 60) for k in ("en", "de", "fr")}
    got = {k: [0] * len(p) for k, p in plain.items()}
    for i, g in enumerate(learned.grams.tolist()):
        s = "".join("_" if c == 0 else chr(c) for c in [g & 0xFFFFF, g >> 20 & 0xFFFFF, g >> 40 & 0xFFFFF][:1 + (g >> 60 & 1) + 2 * (g >> 61 & 1)])
        for j, k in enumerate(learned.langs):
            if learned.rank[i, j] >= 0:
                got[k][learned.rank[i, j]] = s
    assert got == plain
    tests = ["the house", "die brücke", "les élèves", "THE CAT!! 12", "x", "a", "日本語", "Übergrößen étaient"]
    assert learned.predict(tests)[0] == [plain_predict(t, plain, 60) for t in tests]


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !! _", "x"), (4, "the dog", "x"), (4, "the dog", "x"), (None, "der hund " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")  # lang_pred clashes and is replaced
    learned = L.fit(spark.createDataFrame([(k, t) for k, t in TEXTS], "lang string, text string"))
    out = {(r.doc_id, r.lang_pred) for r in L.identify(df, learned).collect()}
    assert out == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de")}
    assert L.identify(df, learned).count() == 6 and L.identify(df.limit(0), learned).count() == 0
    nothing = L.fit(df.limit(0).withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in L.identify(df, nothing).collect()} == {"und"}
    assert all(0 <= r.score <= 1 for r in L.identify(df, learned).collect())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", held_out())
    out = L.identify(docs.filter("held_out"), L.fit(docs.filter("NOT held_out")))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
