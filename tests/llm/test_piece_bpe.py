import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from fleetgauge.llm import piece_bpe
from fleetgauge.llm.common import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    r = random.Random(3)
    out = ["", " ", "a", "  a  b ", "▁x ▁", "\n\na", "é ﬁ ①\t\x00z", "<s> <unk> <0x41>", "日本 😀😀", "a" * 900, "=-" * 400]
    out += [" " * n + w for n in range(50) for w in ("", "x", "\n", "continue")]
    out += ["".join(r.choice("aabbethin  ▁\n.=-é😀日01") for _ in range(r.randint(0, 60))) for _ in range(800)]
    return out + [" ".join(out)]


def test_encode_and_decode_match_the_library(lib):
    m = piece_bpe.PieceModel(PATH)
    t = texts()
    ids, at = m.encode(t)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == lib.encode(t)
    assert m.decode(ids, at) == [lib.decode(x) for x in lib.encode(t)]


def test_any_ids_decode_as_the_library_does(lib):
    import numpy as np
    r = random.Random(5)
    seqs = [[r.randrange(hi) for _ in range(r.randint(0, 9))] for hi in (262, 32000) for _ in range(800)] + [[1, 28705, 264], [28705, 28705]]
    got = piece_bpe.model(PATH).decode(np.array(sum(seqs, []), np.int64), np.append(0, np.cumsum([len(s) for s in seqs])))
    assert got == [lib.decode(s) for s in seqs]


def test_full_cache_is_emptied(lib, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_WORDS", 3)
    m = piece_bpe.PieceModel(PATH)
    for t in ("one two three four five", "one six seven", "two two"):
        assert m.encode([t])[0].tolist() == lib.encode(t)


def test_columns_nulls_and_repeats(spark, lib):
    rows = [(1, None, "x"), (2, "", "x"), (3, "in the end", None), (3, "in the end", None), (None, "a\n" * 30000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # "ids" clashes and is replaced
    out = df.withColumn("ids", piece_bpe.encode("text", PATH)).withColumn("back", piece_bpe.decode("ids", PATH)).collect()
    assert len(out) == 5
    for r in out:
        assert r.ids == lib.encode(r.text or "") and r.back == (r.text or "")
    assert df.limit(0).select(piece_bpe.encode("text", PATH).alias("i")).select(F.size("i"), piece_bpe.decode("i", PATH)).count() == 0
