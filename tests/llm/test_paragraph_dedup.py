import random

import pytest

from brute import shingles
from fleetgauge.functions.lineage import discard, settle, stage_folder
from fleetgauge.llm import paragraph_dedup as P
from fleetgauge.llm.queries import QUERIES


def test_bands_reach_the_recall():
    bands, rows = P.tune(0.8)
    assert 1 - (1 - 0.8 ** rows) ** bands >= P.RECALL and bands <= P.MOST_BANDS
    assert 1 - (1 - 0.8 ** (rows + 1)) ** P.MOST_BANDS < P.RECALL


def plain(rows, min_words):
    inst = [(k, j, shingles(p, 5)) for k, t in rows if k is not None for j, p in enumerate((t or "").split("\n")) if len(p.split()) >= min_words]
    root = list(range(len(inst)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(inst)):
        for b in range(a):
            x, y = inst[a][2], inst[b][2]
            if 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    first = {}
    for i, (k, _, _) in enumerate(inst):
        first[find(i)] = min(first.get(find(i), k), k)
    out = {}
    for i, (k, j, _) in enumerate(inst):
        if first[find(i)] < k:
            out.setdefault(k, set()).add(j)
    return out


def test_removals_match_brute_force(spark):
    r = random.Random(7)
    base = [[f"v{r.randrange(400)}" for _ in range(r.choice([5, 20, 60, 90]))] for _ in range(25)]
    rows = []
    for i in r.sample(range(500), 70):
        lines = []
        for _ in range(r.randint(0, 4)):
            w = list(r.choice(base))
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "edited"
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, " ".join(base[1]) + "\n" + "word " * 30000)]
    want = plain(rows, 5)
    out = P.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_words=5).collect()
    assert {r.doc_id: set(r.removed) for r in out if r.removed} == want
    texts = dict(rows)
    for r in out:
        t = texts[r.doc_id]
        assert r.text == (None if t is None else "\n".join(p for j, p in enumerate(t.split("\n")) if j not in want.get(r.doc_id, ())))
        assert r.n_paragraphs == len((t or "").split("\n"))


def test_edges(spark):
    p = " ".join(f"w{i}" for i in range(30))
    rows = [(4, f"{p}\nshort", "r"), (4, f"{p}\nshort", "r"), (2, f"x\n{p}", None), (None, p, "y"), (9, f"short\n{p}\n{p}", "z")]
    out = P.remove(spark.createDataFrame(rows, "doc_id long, text string, removed string")).collect()
    assert sorted((r.doc_id, r.removed, r.text) for r in out if r.doc_id is not None) == [(2, [], f"x\n{p}"), (4, [0], "short"), (4, [0], "short"), (9, [1, 2], "short")]
    assert [r.text for r in out if r.doc_id is None] == [p]
    assert P.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_of_the_query_match_brute_force(spark, tmp_path):
    r = random.Random(11)
    base = [" ".join(f"v{r.randrange(400)}" for _ in range(r.choice([1, 3, 5, 7, 8, 9, 12, 19]))) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = [r.choice(base) + r.choice(["", "", " more"]) for _ in range(r.randint(1, 4))]
        rows.append((i, "\n".join(lines)))
    want = plain(rows, 1)
    assert any(len(t.split("\n")[j].split()) < 5 for k, t in rows for j in want.get(k, ()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op8_paragraph_dedup"](spark, str(tmp_path)).collect()
    assert {x.doc_id: x.n_removed for x in out if x.n_removed} == {k: len(v) for k, v in want.items()}
    got = P.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: set(x.removed) for x in got} == plain(rows, 5)


def test_wrapped_paragraphs_join(spark):
    w = [f"w{i}" for i in range(60)]
    def wrap(n):
        return "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))
    rows = [(1, f"one\n\n{wrap(7)}\n\nend"), (2, f"two\n\n{wrap(11)}\n \nlast"), (3, f"three\n{' '.join(w)}")]
    got = P.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.removed for x in got} == {2: [2, 3, 4, 5, 6, 7], 3: [1]}


def test_passages_inside_longer_lines(spark):
    r = random.Random(3)
    def sentence(n, end="."):
        return " ".join(f"u{r.randrange(10**6)}" for _ in range(n)) + end
    passage = " ".join([sentence(12), sentence(3), sentence(14), sentence(21)])
    flat = sentence(120, "")  # no sentence ends
    inner = " ".join(flat.split()[20:110])
    short = sentence(9)
    rows = [(1, f"{sentence(60)} {passage} {sentence(40)}"), (2, (a := sentence(45)) + f" {passage} " + (b := sentence(50))),
            (3, passage), (4, flat), (5, sentence(30, "") + " " + inner + " " + sentence(30, "")),
            (6, f"{sentence(30)} {short} {sentence(30)}"), (7, f"{sentence(30)} {short} {sentence(30)}")]
    texts = dict(rows)
    out = {x.doc_id: x for x in P.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=1).collect()}
    assert all(out[k].text == texts[k] and not out[k].removed for k in (1, 4, 6, 7))
    assert out[2].text == f"{a} {b}" and out[2].removed == []
    assert out[3].text == "" and out[3].removed == [0]
    left = out[5].text.split()
    assert left[:30] == texts[5].split()[:30] and left[-30:] == texts[5].split()[-30:]
    assert len(left) - 60 < 45  # what is left of the 90 lies before the first and behind the last chosen word


def test_rows_with_one_key_keep_their_own_text(spark):
    s = " ".join(f"w{i}" for i in range(25)) + "."
    head = " ".join(f"h{i}" for i in range(30)) + "."
    rows = [(1, s), (2, f"{head} {s}"), (2, "quite another text of the key. " + " ".join(f"x{i}" for i in range(40)) + ".")]
    out = P.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x.text for x in out) == sorted([s, head, rows[2][1]])


def test_the_query_counts_passages_that_are_cut(spark, tmp_path):
    passage = " ".join(f"p{i}" + "." * (i % 13 == 12) for i in range(65))
    rows = [(1, f"{passage}"), (2, " ".join(f"a{i}" for i in range(40)) + f". {passage} " + " ".join(f"b{i}" for i in range(40)) + "."), (3, passage), (4, "quite another line")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id: x.n_removed for x in QUERIES["op8_paragraph_dedup"](spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_places_are_deleted_once_they_are_read(spark):
    def stages():
        folder = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
        return {x.getPath().getName() for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    settle(spark.range(3), "other")
    before = stages()
    rows = [(1, "one two three four five six\nseven eight nine ten eleven twelve"), (2, "one two three four five six\nother words stand on this line")]
    out = P.remove(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "removed")
    left = {x.split("-")[0] for x in stages() - before}
    assert "gone" in left and "places" not in left and before <= stages()
    assert sorted((r.doc_id, r.removed) for r in out.collect()) == [(1, []), (2, [0])]
    with pytest.raises(ValueError):
        discard(spark.read.text(__file__))


def test_places_are_counted_once(spark, monkeypatch):
    read, write = {}, P.settle

    def watch(df, label="stage", **options):
        read[label] = {f.rsplit("/", 2)[1].split("-")[0] for f in df.inputFiles()}
        return write(df, label, **options)
    monkeypatch.setattr(P, "settle", watch)
    a, b = ([f"{c}{i}" for i in range(40)] for c in "ab")
    near = [*a[:39], "other"]
    rows = [(1, " ".join(a)), (2, " ".join(near)), (3, f"{' '.join(near)}\n{' '.join(b)}"), (4, f"new words\n{' '.join(b)}")]
    out = P.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.removed) for r in out) == [(1, []), (2, [0]), (3, [0]), (4, [1])]
    assert sum("places" in x and label not in ("met", "sets", "gone") for label, x in read.items()) == 1
