"""The registered queries of the text operators and, where SQL can express them, their twins."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import fingerprint_lz, language_id, neighbours, ngram_join, odd_minhash, packing, paragraph_dedup, periodic_runs, piece_bpe, quality_crf, suffix_dedup, target_resample, warc
from fleetgauge.llm.common import held_out, new_folder, small_batches, table, tokenizer_path

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def wrap(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run
    return wrap


@query("op1_piece_bpe")
def op1_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", piece_bpe.encode("text", path).alias("ids"))
    docs = docs.withColumn("decoded", piece_bpe.decode("ids", path))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_quality_crf")
def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = quality_crf.score(docs, quality_crf.fit(docs.filter(~F.col("held_out")), labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    learned = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, learned).select("doc_id", "held_out", "lang_pred", "score")


# base32 of a SHA-1 in hex: digit i is five of the bits in the three hex digits that start at 5 i / 4
_BASE32 = """list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex || '00', CAST(i * 5 // 4 AS BIGINT) + 1, 3) AS BIGINT) >> CAST(7 - i * 5 % 4 AS BIGINT)) & 31), 1)
 for i in range(32)], 'string_agg', '')"""


@query("op6_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> top THEN top END AS refers_to FROM t""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = f"{new_folder(spark)}/warc"
    warc.write_archives(warc.mark_revisits(pages, min_bytes=0), path)
    got = warc.read_archives(spark, path, warc.SCHEMA.replace(", payload binary", ""), verify="true").filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, f"^{warc.PAGE}(-?[0-9]+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return got.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=1024, closing=0)
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (g) WHERE first < doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY 1, 2),
t AS (SELECT s.*, h, n, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s JOIN d USING (doc_id)),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM t GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)""")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), span=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_fingerprint_lz")
def op7_fingerprint_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_lz.chain(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                      fingerprint_lz.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                      fingerprint_lz.likeness("fingerprint", "next_fingerprint").alias("near_next"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _groups_sql(n: int, num: int, more: str = "") -> str:
    """Components of all pairs of documents whose ``n``-word shingle sets reach a similarity of ``num`` per cent."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {n} THEN [array_to_string(w[i:i+{n - 1}], ' ') for i in range(1, len(w) - {n - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM u x JOIN u y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {num} * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n AS n_shingles, min(r.b) AS component_id{more} FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2"""


@query("op4_ngram_join", _groups_sql(4, 85))
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, num=85, den=100)


@query("op2_neighbours")
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=20, every=20)


@query("op8_paragraph_dedup")
def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paragraph_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)
    return out.select("doc_id", "n_paragraphs", (F.size("removed") + F.col("n_cut")).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _looped(text: str, h: Column) -> Column:
    """The text with its words from number a on replaced by those at a, a + 1, ... a + p - 1 over and over; a and p follow from ``h``."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    g = F.floor(h / 10)

    def loop(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int")))), " "))
    return F.when(h % 10 == 0, F.transform(F.array(words), loop)[0]).otherwise(F.col(text))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", _looped("text", F.crc32(F.col("doc_id").cast("string").cast("binary"))))
    out = periodic_runs.find_runs(docs, least=6, times=4)
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    out = out.withColumn("best", periodic_runs.longest("runs"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_target_resample")
def op13_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return target_resample.resample(docs, target, share=(5, 100), min_words=20)


@query("op12_odd_minhash", _groups_sql(2, 80, ", n.doc_id = min(r.b) AS kept"))
def op12_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_minhash.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), n=2, num=80, den=100)
