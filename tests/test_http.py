from pyspark.sql import functions as F

from capweave.functions import http as H

HEADERS = "array<struct<name:string,value:string>>"


def one(spark, expr):
    return spark.range(1).select(expr).collect()[0][0]


def mime_of(spark, value):
    rows = [([("Server", "x")] + ([("CONTENT-type", value)] if value is not None else []),)]
    return spark.createDataFrame(rows, f"headers {HEADERS}").select(H.mime(F.col("headers"))).collect()[0][0]


def test_mime(spark):
    assert mime_of(spark, "Text/HTML; charset=utf-8") == "text/html"
    assert mime_of(spark, "text/css") == "text/css"
    assert mime_of(spark, 'a/b; x="1;2"') == "a/b"
    assert mime_of(spark, "nonsense") is None
    assert mime_of(spark, "text/html; charset") is None
    assert mime_of(spark, None) is None


def test_mime_range_truth_table(spark):
    cases = [
        ("text/html", ["text/html"], True),
        ("text/html", ["text/css"], False),
        ("text/html", ["text/*"], True),
        ("image/png", ["text/*", "image/png"], True),
        ("image/png", ["*/*"], True),
        ("image/png", [], False),
        (None, [], True),
        (None, ["text/css"], True),
    ]
    for value, ranges, want in cases:
        m = F.lit(value).cast("string")
        assert one(spark, H.mime_matches(m, ranges)) is want
        arr = F.array(*[F.lit(r) for r in ranges]).cast("array<string>")
        assert one(spark, H.mime_in(m, arr)) is want


def test_block_and_record(spark):
    rows = [([("Content-Type", "text/html"), ("Set-Cookie", "a"), ("set-cookie", "b")],)]
    df = spark.createDataFrame(rows, f"headers {HEADERS}")
    block = df.select(
        H.http_block(F.lit("HTTP/1.1"), F.lit(200), F.col("headers"), F.encode(F.lit("hü"), "UTF-8"))
    ).collect()[0][0]
    want = "HTTP/1.1 200 OK\r\ncontent-type: text/html\r\nset-cookie: a\r\nset-cookie: b\r\n\r\nhü"
    assert bytes(block) == want.encode()
    assert one(spark, H.status_line(F.lit("HTTP/2.0"), F.lit(799))) == "HTTP/2.0 799 <unknown status code>"


def test_address_and_protocol(spark):
    assert one(spark, H.ip_of(F.lit("10.0.0.1:443"))) == "10.0.0.1"
    assert one(spark, H.ip_of(F.lit("[2001:db8::1]:443"))) == "2001:db8::1"
    assert one(spark, H.ip_of(F.lit(None).cast("string"))) is None
    assert one(spark, H.protocol_label(F.lit("HTTP/2.0"))) == "h2"


def test_times(spark):
    ts = F.lit("2024-01-02 03:04:05.000007").cast("timestamp_ntz")
    assert one(spark, H.cdx_time(ts)) == "20240102030405"
    assert one(spark, H.rfc3339_time(ts)) == "2024-01-02T03:04:05.000007Z"


def test_any_number_of_parameters(spark):
    many = "text/html" + "".join(f"; p{k}=v" for k in range(5_000))
    assert mime_of(spark, many) == "text/html"
    assert mime_of(spark, many + "; broken") is None
