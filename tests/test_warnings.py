"""CAP documents parsed in one pass."""

from pyspark.sql import functions as F

from attestra.sources.parsers import cap_alerts

_DOCS = [
    '<c:alert xmlns:c="u"><c:identifier> A </c:identifier><c:status>Actual</c:status><c:info><c:event>Flood</c:event><c:severity/><c:area><c:areaDesc>X &amp; Y</c:areaDesc><c:severity>Minor</c:severity></c:area></c:info><c:info><c:event>Fog</c:event></c:info></c:alert>',
    "<alert><event>outside</event><identifier>B<!-- x -->C</identifier><identifier>D</identifier><info><event><![CDATA[Wind]]></event><severity>Bad</severity></info></alert>",
    "<alert><identifier>E</identifier>",
    "",
    None,
]


def test_cap_alert_of_odd_documents(spark):
    """What the XPath `//info[1]//name[1]/text()` gives, for prefixes, empty and repeated elements, comments and CDATA; broken XML is null."""
    rows = spark.createDataFrame(list(enumerate(_DOCS)), "i int, xml string")
    rows = cap_alerts(rows, "xml", "a")
    got = [(r.a.identifier, r.a.status, r.a.event, r.a.severity, r.a.raw_severity, r.a.area) for r in rows.orderBy("i").collect()]
    assert got == [("A", "actual", "Flood", "Minor", "Minor", "X & Y"), ("B", None, "Wind", "Unknown", "Bad", None), *[(None, None, None, "Unknown", None, None)] * 3]
    whole = cap_alerts(spark.createDataFrame([(x,) for x in _DOCS[:2]], "xml string"), "xml", "a")
    for name in ("event", "severity", "areaDesc"):
        path = f"//*[local-name()='info'][1]//*[local-name()='{name}'][1]/text()"
        field = {"event": "event", "severity": "raw_severity", "areaDesc": "area"}[name]
        both = whole.select(F.xpath_string("xml", F.lit(path)).alias("x"), F.coalesce(F.col("a")[field], F.lit("")).alias("y")).collect()
        assert all(r.x == r.y for r in both)


def test_one_parse_a_document(spark):
    """However many fields are read, the plan parses each document once and calls no XPath."""
    a = cap_alerts(spark.createDataFrame([(x,) for x in _DOCS], "xml string"), "xml", "a").select("a.*")
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("stated(") == 1 and "xpath" not in plan
