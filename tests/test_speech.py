import pytest
from pyspark.sql import functions as F

from talkgrain.functions import spans
from talkgrain.functions import speech as sp


@pytest.mark.parametrize(
    ("raw", "spoken"),
    [
        ("## Features\n- Fast setup\n- Safe payments", "Features. Fast setup. Safe payments"),
        ("Use **it** — it is reliable.", "Use it, it is reliable."),
        ("Open [support](https://example.com/help).", "Open support."),
        ("Visit https://example.com/help for details.", "Visit the provided link for details."),
        ("Success is 99%.", "Success is 99 percent."),
        ("One two​ three", "One two three"),
        (None, ""),
        ("1. A & B\n\n\n2) C", "A and B. C"),
    ],
)
def test_speakable(spark, raw, spoken):
    assert spark.createDataFrame([(raw,)], "t string").select(sp.speakable(F.col("t"))).first()[0] == spoken


def test_lexicon(spark):
    df = spark.createDataFrame([("The POS and pos-x, posh",), (None,)], "t string")
    assert [r.s for r in df.select(sp.speakable(F.col("t"), [("pos", "P O S")]).alias("s")).collect()] == ["The P O S and P O S-x, posh", ""]


def test_digits(spark):
    texts = [
        "one two three four five six seven eight nine zero",
        "nine double zero four eight zero one eight zero six",
        "Customer C one two three four five six and mobile nine eight seven six five four three two one zero",
        "double", "double triple one", "ek do 34 teen", None, "to for", "triple 12 x double",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sp.digit_runs(F.col("t")).alias("r")).orderBy("i")
    got = [r.r for r in df.collect()]
    assert got == [["1234567890"], ["9004801806"], ["123456", "9876543210"], [], ["111"], ["12343"], [], [], ["121212"]]
    one = df.select(sp.only_of_length(F.col("r"), 10).alias("v")).collect()
    assert [r.v for r in one][:4] == ["1234567890", "9004801806", "9876543210", None]


@pytest.mark.parametrize(
    ("said", "address"),
    [
        ("john at example dot com", "john@example.com"),
        ("My mail is A.B@Example.com.", "a.b@example.com"),
        ("a@b.com or c@d.com", None),
        ("nothing here", None),
        (None, None),
        ("my email is kim at uh the domain example point co dot in", "kim@example.co.in"),
    ],
)
def test_email(spark, said, address):
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(spans.only_value(spans.addresses(F.col("t")))).first()[0] == address


#: A form of the test's own.
FIELDS = {
    "cust_id": sp.Field("identifier", "customer ID", prefix="C", digits=6),
    "email": sp.Field("email", "email address"),
    "mobile": sp.Field("phone", "mobile number", digits=10, first="6789"),
    "device_id": sp.Field("identifier", "device ID", prefix="DEV", digits=8),
    "description": sp.Field("text", "issue description", shortest=8),
}


def test_fields(spark):
    cases = [
        ("device_id", "dev 1234 5678", "unverified", "***5678"),
        ("cust_id", "c 12 34 56", "unverified", "***3456"),
        ("cust_id", "123", "incomplete_speech", "***C123"[:3] + "C123"),
        ("mobile", "98765 43210", "unverified", "***3210"),
        ("mobile", "1234567890", "invalid_format", "***7890"),
        ("mobile", "98765432101", "invalid_format", "***2101"),
        ("email", "A b@c.d", "unverified", "a***@c.d"),
        ("email", "nope", "invalid_format", "***"),
        ("description", "short", "incomplete_speech", "[provided]"),
        ("description", None, "missing", None),
        ("email", "", "missing", None),
    ]
    for name, value, state, mask in cases:
        f = FIELDS[name]
        r = spark.createDataFrame([(value,)], "v string").select(f.state(F.col("v")).alias("s"), f.masked(F.col("v")).alias("m")).first()
        assert (r.s, r.m) == (state, mask), name


def test_aliases(spark):
    pairs = [("noise maker", "Speaker"), ("box", "crate"), ("card unit", "Terminal")]
    assert sp.with_aliases("My  Noise Maker and card unit ABCDE12345box", pairs) == ("My Speaker and Terminal ABCDE12345box", ["Speaker", "Terminal"])
    assert sp.with_aliases(None, pairs) == ("", [])
    r = spark.createDataFrame([("a box",)], "t string").select(sp.aliases_udf(pairs)("t").alias("x")).first().x
    assert (r.text, r.used) == ("a crate", ["crate"])


def test_categories(spark):
    df = spark.createDataFrame([(1, "aB1 "), (2, None)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(sp.category_counts("t")).collect()] == [{"Ll": 1, "Lu": 1, "Nd": 1, "Zs": 1}, {}]
