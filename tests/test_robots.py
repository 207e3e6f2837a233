from talkgrain.sources.robots import outcomes, permitted


def test_robots(spark):
    p = spark.createDataFrame([("https://a.com/x", "1"), ("https://a.com/private/y", "2"), ("https://b.com/private", "3"), (None, "4"), ("https://a.com/blog/z", "5")], "url string, html string")
    r = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /private\n")], "host string, robots string")
    got = permitted(p, r, "bot")
    assert {x.html: x.allowed for x in got.collect()} == {"1": True, "2": False, "3": True, "4": True, "5": True}
    known = got.limit(0).selectExpr("sha2(html, 256) AS content_hash").unionByName(spark.sql("SELECT sha2('3', 256) AS content_hash"))
    assert {x.html: x.outcome for x in outcomes(got, known, ["/blog"]).collect()} == {"1": "ingested", "2": "skipped", "3": "unchanged", "4": "ingested", "5": "excluded"}
