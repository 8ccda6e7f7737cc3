import pytest
from pyspark.sql import functions as F

from capweave.functions.urls import hop_cost, normalize_url, resolve_url, surt

SURT_VECTORS = [
    ("http://www.shop.test/a", "test,shop)/a"),
    ("http://www7.shop.test/a", "test,shop)/a"),
    ("http://web.www.shop.test/", "test,shop,www,web)/"),
    ("http://wwwshop.test/", "test,wwwshop)/"),
    ("https://shop.test:443/", "test,shop)/"),
    ("https://shop.test:8443/", "test,shop:8443)/"),
    ("http://shop.test/l?Z=Last&b=&Aa=First", "test,shop)/l?aa=first&b=&z=last"),
    ("http://shop.test/l?flag&n=2", "test,shop)/l?flag=&n=2"),
    ("HTTP://EXAMPLE.com", "com,example)/"),
    ("http://1.2.3.4:8080/x", "4,3,2,1:8080)/x"),
    ("http://[::1]/x", "[::1])/x"),
    ("http://u:p@www.example.com/#top", "com,example)/"),
    ("http://e.com/?", "com,e)/"),
    ("http://e.com/?b=2&a=x&b=1", "com,e)/?a=x&b=2&b=1"),
    ("http://e.com/?q=A+B%20C~*", "com,e)/?q=a+b+c%7E*"),
    ("http://e.com/?q=%zz%41", "com,e)/?q=%25zza"),
    ("http://e.com/?&&x=1&", "com,e)/?x=1"),
    ("http://e.com/?=v", "com,e)/?=v"),
    ("http://e.com/?q=ÄÖ", "com,e)/?q=%C3%A4%C3%B6"),
    ("http://www./", ",www)/"),
]

NORMAL_VECTORS = [
    ("  https://Example.COM/a b ", "https://example.com/a%20b"),
    ("http://e.com:0080/x", "http://e.com/x"),
    ("http://e.com:/x", "http://e.com/x"),
    ("http://e.com:99999/x", None),
    ("http://e.com/a/./b/../c", "http://e.com/a/c"),
    ("http://e.com/a/b/..", "http://e.com/a/"),
    ("http://e.com/a/%2E%2e/b", "http://e.com/b"),
    ("http://e.com/../../x", "http://e.com/x"),
    ("http://e.com/für?q='ü'#é", "http://e.com/f%C3%BCr?q=%27%C3%BC%27#%C3%A9"),
    ("http://e.com/😀", "http://e.com/%F0%9F%98%80"),
    ("http:\\\\e.com\\a", "http://e.com/a"),
    ("http:///e.com/a", "http://e.com/a"),
    ("http://e.com\n/a\tb", "http://e.com/ab"),
    ("http://a b.com/", None),
    ("http://", None),
    ("http://256.1.1.1/", None),
    ("http://1.2.3.4/", "http://1.2.3.4/"),
    ("ftp://e.com/", None),
    ("not a url", None),
    ("", None),
    ("http://e.com", "http://e.com/"),
    ("http://e.com?x=1", "http://e.com/?x=1"),
    ("http://e.com/a//b", "http://e.com/a//b"),
    ("http://@e.com/", "http://e.com/"),
]

# RFC 3986 section 5.4, with an http base.
BASE = "http://a/b/c/d;p?q"
RESOLVE_VECTORS = [
    ("g", "http://a/b/c/g"),
    ("./g", "http://a/b/c/g"),
    ("g/", "http://a/b/c/g/"),
    ("/g", "http://a/g"),
    ("//g", "http://g/"),
    ("http:g", "http://a/b/c/g"),
    ("http:/g", "http://a/g"),
    ("http://g", "http://g/"),
    ("?y", "http://a/b/c/d;p?y"),
    ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"),
    ("g#s", "http://a/b/c/g#s"),
    ("g?y#s", "http://a/b/c/g?y#s"),
    (";x", "http://a/b/c/;x"),
    ("g;x", "http://a/b/c/g;x"),
    ("g;x?y#s", "http://a/b/c/g;x?y#s"),
    ("", "http://a/b/c/d;p?q"),
    (".", "http://a/b/c/"),
    ("./", "http://a/b/c/"),
    ("..", "http://a/b/"),
    ("../", "http://a/b/"),
    ("../g", "http://a/b/g"),
    ("../..", "http://a/"),
    ("../../", "http://a/"),
    ("../../g", "http://a/g"),
    ("../../../g", "http://a/g"),
    ("/./g", "http://a/g"),
    ("/../g", "http://a/g"),
    ("g.", "http://a/b/c/g."),
    (".g", "http://a/b/c/.g"),
    ("g..", "http://a/b/c/g.."),
    ("..g", "http://a/b/c/..g"),
    ("./../g", "http://a/b/g"),
    ("./g/.", "http://a/b/c/g/"),
    ("g/./h", "http://a/b/c/g/h"),
    ("g/../h", "http://a/b/c/h"),
    ("g;x=1/./y", "http://a/b/c/g;x=1/y"),
    ("g;x=1/../y", "http://a/b/c/y"),
    ("g?y/./x", "http://a/b/c/g?y/./x"),
    ("g?y/../x", "http://a/b/c/g?y/../x"),
    ("g#s/./x", "http://a/b/c/g#s/./x"),
    ("http:g", "http://a/b/c/g"),
    ("https:g", "https://g/"),
    ("http://x/y", "http://x/y"),
    ("mailto:a@b", None),
    ("javascript:void(0)", None),
    ("  g  ", "http://a/b/c/g"),
    ("\\g", "http://a/g"),
]


def run(spark, rows, schema, expr):
    got = spark.createDataFrame(rows, schema).select("*", expr.alias("got")).collect()
    return [(r[0], r[1], r["got"]) for r in got if r[1] != r["got"]]


def test_surt_vectors(spark):
    expr = surt(normalize_url(F.col("url")))
    assert run(spark, SURT_VECTORS, "url string, want string", expr) == []


def test_normalize(spark):
    assert run(spark, NORMAL_VECTORS, "url string, want string", normalize_url(F.col("url"))) == []


def test_resolve(spark):
    expr = resolve_url(F.lit(BASE), F.col("ref"))
    assert run(spark, RESOLVE_VECTORS, "ref string, want string", expr) == []


@pytest.mark.parametrize(
    "a,b,cost",
    [
        ("http://x.com/a", "https://x.com:8443/b", 0),
        ("http://www.x.com/", "http://x.com/", 1),
        ("http://x.com/", "http://y.com/", 1),
    ],
)
def test_hop_cost(spark, a, b, cost):
    assert spark.range(1).select(hop_cost(F.lit(a), F.lit(b))).collect()[0][0] == cost


def test_normal_form_is_stable(spark):
    rows = [(w,) for _, w in NORMAL_VECTORS + RESOLVE_VECTORS if w]
    df = spark.createDataFrame(rows, "url string")
    assert df.filter(~normalize_url(F.col("url")).eqNullSafe(F.col("url"))).collect() == []
