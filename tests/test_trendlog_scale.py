"""Trend-log documents are parsed once, with what XPath finds in them."""

from pyspark.sql import functions as F

from fleetgauge.sources import trendlog as tl

ODD = [("plain", '<O><P name="record-count" value="1"/><S name="timestamp-buffer"><U name="1" value="5"/></S><S name="data-buffer"><C><U name="1" value="7"/></C></S></O>'),
       ("entities", '<?xml version="1.0" encoding="UTF-8"?><O><!-- c --><P name="object-name" value="a &amp; &#233;&quot;&#10;b"/><P name="object-type" value="x\ty"/></O>'),
       ("first value counts", '<O><P name="object-name"/><P name="object-name" value="b"/><Q name="object-name" value="c"/><X><P name="object-type" value="deep"/></X></O>'),
       ("two buffers", '<O><S name="timestamp-buffer"><U name="1" value="5"/></S><T name="timestamp-buffer"><V name="2" value="6"/></T><S name="data-buffer"><C><U name="1" value="7"/></C><D><U name="9" value="9"/></D></S>'
                       '<S name="data-buffer"/><S name="data-buffer"><E><U name="2" value="8"/></E></S><S name="flags-buffer"><!-- c --><U name="2" value=""/></S></O>'),
       ("namespaces", '<n:O xmlns:n="urn:n" xmlns="urn:d"><n:P n:name="object-type" name="object-name" value="v"/></n:O>'),
       ("bare", "<O/>"), ("empty", ""), ("none", None)]


def _by_xpath(docs):
    def attr(name):
        return F.xpath_string("xml", F.lit(f"/*/*[@name='{name}']/@value"))

    def pairs(path):
        return F.map_from_arrays(F.transform(F.xpath("xml", F.lit(f"{path}/@name")), lambda x: x.cast("int")), F.xpath("xml", F.lit(f"{path}/@value")))
    return docs.select("doc", attr("object-type"), attr("object-name"), attr("record-count").try_cast("int"), pairs("/*/*[@name='timestamp-buffer']/*"),
                       pairs("/*/*[@name='flags-buffer']/*"), pairs("/*/*[@name='data-buffer']/*[1]/*"))


def test_headers_equal_xpath(spark):
    docs = spark.createDataFrame(ODD, "doc string, xml string")
    got = tl.headers(docs).select("doc", "object_type", "object_name", "record_count", "timers", "flags", "data")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, _by_xpath(docs).collect()))


def test_decode_parses_a_document_once(spark):
    docs = spark.createDataFrame(ODD, "doc string, xml string")
    plan = tl.decode(docs, "doc")._jdf.queryExecution().optimizedPlan().toString()
    assert "xpath" not in plan and plan.count("ArrowEvalPython") == 1
