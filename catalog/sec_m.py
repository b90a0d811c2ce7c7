"""Provenance tables."""

from pyspark.sql import functions as F

from catalog import bind
from catalog.registry import R, query, rounded
from fleetgauge.operators import provenance as pv


@query("m01_source_fingerprint")
def m01(spark, d):
    """sha256 of the source files themselves (the path is not known to a fixed SQL text)."""
    f = pv.source_fingerprint(spark, d, "*.parquet")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query("m01_document_fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def m01_docs(spark, d):
    return bind.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


_CFG = "SELECT p_brand AS run_id, concat(CASE WHEN p_size%9=0 THEN '_' ELSE '' END, p_name, CAST(p_partkey AS STRING)) AS key, p_type AS value FROM {part}"


@query("m02_config_fingerprint", f"WITH c AS ({_CFG.format(part='part')}) SELECT run_id, sha256(string_agg(concat(key,'=',value), chr(10) ORDER BY concat(key,'=',value))) AS config_sha256 FROM c WHERE NOT starts_with(key,'_') GROUP BY 1")
def m02(spark, d):
    return pv.config_fingerprint(spark.sql(_CFG, part=bind.table(spark, d, "part")))


_RUN = "SELECT CAST(o_custkey AS STRING) AS run_id, o_orderkey, o_orderpriority AS config_sha256, CASE WHEN o_orderstatus='P' THEN '' ELSE o_orderstatus END AS revision FROM {orders}"


@query("m03_run_bind", f"""WITH r AS ({_RUN.format(orders='orders')}), f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY o_orderkey) AS o FROM r), j AS (SELECT n.run_id, n.o_orderkey, CASE WHEN e.config_sha256<>n.config_sha256 THEN 'run-id is already bound to a different project config'
 WHEN e.revision<>'' AND n.revision<>'' AND e.revision<>n.revision THEN 'run-id is already bound to a different code revision' END AS error FROM f n JOIN f e ON e.run_id=n.run_id AND e.o=1 WHERE n.o>1) SELECT run_id, error, count(*) AS attempts FROM j WHERE error IS NOT NULL GROUP BY 1,2""")
def m03(spark, d):
    r = spark.sql(_RUN, orders=bind.table(spark, d, "orders"))
    first = r.groupBy("run_id").agg(F.min("o_orderkey").alias("k0"), F.min_by(F.struct("config_sha256", "revision"), F.col("o_orderkey")).alias("f"))
    existing = first.select("run_id", "f.config_sha256", "f.revision")
    later = r.join(first.select("run_id", "k0"), "run_id").where("o_orderkey > k0")
    return pv.bind_conflicts(later, existing).groupBy("run_id", "error").agg(F.count(F.lit(1)).alias("attempts"))


@query("m04_latest_artifact", """SELECT run_id, path, sha256, epoch_us(wr)//1000000 AS at_s FROM (SELECT *, row_number() OVER (PARTITION BY run_id, path ORDER BY wr DESC, sha256 DESC) AS o FROM (SELECT CAST(o_custkey%50 AS STRING) AS run_id, o_orderpriority AS path,
 sha256(CAST(o_orderkey AS STRING)) AS sha256, o_orderdate AS wr FROM orders)) WHERE o=1""")
def m04(spark, d):
    a = bind.table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("run_id"), F.col("o_orderpriority").alias("path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"),
                                              F.col("o_orderdate").cast("timestamp").alias("at"))
    return pv.latest(a, ["run_id", "path"]).select("run_id", "path", "sha256", F.unix_seconds("at").alias("at_s"))


_ADP = "SELECT p_type AS site, p_brand AS device_id, p_name AS role, concat(p_name, '/', CAST(p_partkey AS STRING)) AS source, CASE WHEN p_size%3=0 THEN NULL ELSE p_size/1e1 END AS scale, CASE WHEN p_size%4=0 THEN NULL ELSE p_retailprice/1e3 END AS offset, CASE WHEN p_size%5=0 THEN NULL ELSE 'W' END AS unit FROM {part}"


@query("m05_mapping_provenance", f"WITH a AS ({_ADP.format(part='part').replace(' AS offset,', ' AS \"offset\",')}) SELECT site, device_id, role, source, {R('coalesce(scale,1)')} AS scale, {R('coalesce(\"offset\",0)')} AS \"offset\", coalesce(unit,'') AS unit FROM a")
def m05(spark, d):
    return rounded(pv.mapping_provenance(spark.sql(_ADP, part=bind.table(spark, d, "part"))))
