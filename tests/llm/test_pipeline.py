"""The pipeline against plain versions of its stages."""

import os
import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from brute import near_groups, repeated
from fleetgauge.llm import language_id, quality_crf
from fleetgauge.llm.common import held_out_id, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(12)
    en = "the of and to in that was for with on his from this river house old went late again water stone small".split()
    de = "der die und das nicht mit sich auf für ist haus fluß alt ging spät wieder wasser stein klein über".split()
    passage = " ".join(r.choice(en) for _ in range(60))
    rows = []
    for i in range(160):
        w = en if i % 3 else de
        t = "\n".join(" ".join(r.choice(w) + str(r.randrange(9)) * (r.random() < 0.02) for _ in range(r.randint(4, 40))) for _ in range(r.randint(1, 5)))
        if i % 11 == 0:
            t = t + "\n" + passage
        if i % 7 == 3:
            t = " ".join(x.upper() + "!! %%%" for x in t.split())
        rows.append((i * 3, t, "en" if i % 3 else "de", f"s{i % 4}", len(t)))
    for i in range(40):  # copies and near copies
        k, t, lang, _, _ = rows[i]
        t = t if i % 2 else t.replace(" the ", " one ", 1)
        rows.append((1001 + i, t, lang, None, len(t)))
    return rows + [(5000, None, None, None, None), (5001, "", None, "x", 0), (5002, "12 34 !!", "en", "x", 8), (5003, rows[1][1], None, "y", rows[1][4])]


def plain(rows, labels):
    train = [r for r in rows if not held_out_id(r[0])]
    profiles = {}
    for k in ("de", "en"):
        g, n = np.unique(language_id.grams(language_id.normalised([r[1] for r in train if r[2] == k and r[1]])[0]), return_counts=True)
        profiles[k] = g[np.lexsort((g, -n))[:language_id.TOP]]
    learned = language_id.Profiles([(k, int(g), i) for k, p in profiles.items() for i, g in enumerate(p)])
    lang, near = learned.predict([r[1] for r in rows])
    rows = [r for r, k, s in zip(rows, lang, near, strict=True) if k != "und" and s >= C.MIN_NEARNESS]
    known = sorted((str(r[0]), labels[r[0]], r[1]) for r in rows if not held_out_id(r[0]) and r[0] in labels)
    f, _, at = quality_crf.line_features([t for _, _, t in known])
    field = quality_crf.Field.fit(f.astype(np.float32).astype(np.float64), at, np.array([y for _, y, _ in known]))
    rows = [r for r, s in zip(rows, field.score([r[1] for r in rows]), strict=True) if s >= C.MIN_QUALITY]
    group = near_groups([(r[0], r[1]) for r in rows], 5, 80)
    rows = sorted(r for r in rows if group[r[0]][1] == r[0])
    out = {}
    for (k, t, *_), c in zip(rows, repeated([(r[0], r[1].encode()) for r in rows]), strict=True):
        text, at = [], 0
        for ch in t:
            n = len(ch.encode())
            if not all(c[at:at + n]):
                text.append(ch)
            at += n
        text = "".join(text)
        if not any(c) or text.strip():
            out[k] = text
    return out


def test_pipeline_matches_the_plain_version(spark, tmp_path):
    rows = corpus()
    labels = {r[0]: int("!!" not in (r[1] or "")) for r in rows if r[0] % 2 == 0}
    os.makedirs(tmp_path / "t", exist_ok=True)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "t/documents.parquet"))
    spark.createDataFrame([(k, q, 0) for k, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "t/labels.parquet"))
    pieces = C.run(spark, str(tmp_path / "t")).collect()
    want = plain(rows, labels)
    lib, got = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        got.setdefault(p.doc_id, []).extend(np.frombuffer(p.tokens, "<u4").tolist())
    assert len(want) > 60 and got == {k: [*lib.encode(t, add_special_tokens=False).ids, 0] for k, t in want.items()}


def test_stages_keep_the_columns_and_take_any_rows(spark, tmp_path):
    assert [len(s) for s in C.STAGES] == [2] * 5
    p = "A passage of far more than fifty bytes that both of the documents hold."
    rows = [(None, p, "en", None, None), (1, p, "en", None, 3), (1, p, "en", None, 3), (2, f"{p} x", None, "y", None), (3, None, None, None, None), (4, "", "en", "z", 0), (5, "w " * 40000, "en", None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame([(1, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in C.STAGES[:4]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= d.count()
    assert sorted((r.doc_id or 0) for r in C.drop_near_copies(spark, docs, str(tmp_path)).collect()) == [0, 1, 3, 4, 5]  # 2 is near 1, the repeated row goes
    assert C.pack_sequences(spark, docs.limit(0), str(tmp_path)).count() == 0
