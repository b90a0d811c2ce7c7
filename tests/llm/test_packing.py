import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetgauge.llm import packing as P
from fleetgauge.llm.common import tokenizer_path
from fleetgauge.llm.word_ids import WordIds

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def test_hilbert_curve_visits_every_cell_stepwise():
    g = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    key = P.hilbert(g, 3)
    assert sorted(key.tolist()) == list(range(512)) and np.abs(np.diff(g[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_vectors_depend_on_the_text_alone():
    v = P.vectors(pa.array(["abc", None, "ab", "abcd", "", "abcd"]).slice(1))
    assert (v[2] == v[4]).all() and (v[2] == P.vectors(pa.array(["abcd"]))[0]).all() and np.abs(v[[0, 1, 3]]).sum() == 0 and P.vectors(pa.array([], pa.string())).shape == (0, P.DIM)


def test_ids_match_the_library(lib):
    r = np.random.default_rng(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "'s", " 's", "1", ".", "!!", "<|endoftext|>", " <|endoftext|> ", "\xa0", "\x85", "²", "don't", "😀", "A"]
    texts = ["", None, " ", "a ", " a", "a  b"] + ["".join(r.choice(parts, r.integers(1, 14))) for _ in range(3000)]
    ids, at = P.ByteBpe(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_table_is_trimmed():
    calls = []

    def encode(words):
        calls.append(words)
        return np.array([len(w) for w in words]), np.arange(len(words) + 1)
    t = WordIds(4)
    for text in ("a bb ccc a", "a bb", "dddd eeeee ffffff", "a ggggggg", "bb a ccc"):
        split = [text.split()]
        ids, at = t.ids(split, t.new(split), encode)
        assert ids.tolist() == [len(w) for w in text.split()] and at.tolist() == [0, len(split[0])]
    assert calls[-1] == ["ccc"] or "a" not in calls[-1]  # words that came again were kept


def test_pieces_cover_every_document_once(spark, lib):
    rows = [(i, "some words here " * (i % 70)) for i in range(150)] + [(200, None), (201, ""), (202, "long text, " * 20000), (202, "long text, " * 20000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "start").withColumnRenamed("text", "t").selectExpr("start AS doc_id", "t AS text", "start")
    out = P.pack(df, PATH, length=64, closing=0).collect()
    docs = {}
    for r in out:
        docs.setdefault(r.doc_id, []).append((r.start, r.length, np.frombuffer(r.tokens, "<u4").tolist(), r.doc_tokens))
    for k, t in rows:
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        got = sorted(docs[k])
        if k == 202:  # repeated rows are packed each on their own
            assert sum(g[1] for g in got) == 2 * len(want)
        else:
            assert sum((g[2] for g in got), []) == want and [g[0] for g in got] == np.append(0, np.cumsum([g[1] for g in got])[:-1]).tolist()
        assert all(g[3] == len(want) and g[1] == len(g[2]) for g in got)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        n = sum(x for _, x in s)
        assert [o for o, _ in s] == np.append(0, np.cumsum([x for _, x in s])[:-1]).tolist() and (n == 64 or n & (n - 1) == 0 and n < 64)
    assert P.pack(df.limit(0), PATH).count() == 0
