from pyspark.sql import functions as F

from capweave.functions import markup as M


def links(spark, html):
    row = spark.createDataFrame([(html,)], "h string").select(M.html_links(F.col("h"))).collect()[0][0]
    return [(r["kind"], r["raw"]) for r in row]


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).collect()[0][0]


def test_kinds_and_quotes(spark):
    html = (
        "<A HREF=/up>x</A><a class='q' href='/single'><a title=\"a > b\" href=\"/gt\">"
        "<link rel=stylesheet href=/s.css><img alt='' src=\"i.png\"><script src=j.js></script><a href=''><a>"
    )
    assert links(spark, html) == [
        ("a", "/up"), ("a", "/single"), ("a", "/gt"), ("link", "/s.css"), ("img", "i.png"), ("script", "j.js"),
    ]


def test_not_links(spark):
    html = (
        '<!-- <a href="/c"> --><script>var s = \'<a href="/s">\'</script><abbr href="/ab"><a-b href="/x">'
        '<a data-href="/d"><a title="x href=/t">'
    )
    assert links(spark, html) == []


def test_unclosed(spark):
    assert links(spark, '<a href="/1"><!-- <a href="/2">') == [("a", "/1")]
    assert links(spark, '<script src="/s">var a; <a href="/2">') == [("script", "/s")]


def test_style(spark):
    html = "<style>a{background:url( 'x')} b{c:url(\"/q.png\")} d{e:url(data:image/png;base64,AA)}</style>"
    assert links(spark, html) == [("style", "/q.png")]


def test_many_attributes(spark):
    attrs = " ".join(f'd{i}="{i}"' for i in range(5000))
    assert links(spark, f'<a href="/first" {attrs}><img src="/next">') == [("a", "/first"), ("img", "/next")]


def test_long_text(spark):
    filler = "x" * 2_000_000
    assert links(spark, f"<script>{filler}</script><!--{filler}--><style>{filler}</style>{filler}<a href=/e>") == [
        ("a", "/e")
    ]


def test_entities(spark):
    assert one(spark, "a&amp;b&#38;c&#x26;d&lt;&amp;lt;&unknown;&", M.unescape_html) == "a&b&c&d<&lt;&unknown;&"
    assert one(spark, "&#128512;&#0;&#xD800;", M.unescape_html) == "😀��"


def test_script_escapes(spark):
    assert one(spark, r"/app\/x😀.png", M.unescape_script) == "/app/x😀.png"


def test_css(spark):
    css = "@import url(\"/b.css\");x{y:url('a.png')} z{w:url(c.png)} q{r:url(data:x)} s{t:url('data:y')} u{v:url()}"
    got = one(spark, css, M.css_url_links)
    assert [r["raw"] for r in got] == ["/b.css", "a.png", "c.png", ""]


def test_any_number_of_attributes(spark):
    for n in (201, 20_000):
        many = " ".join(f'data-{k}="a>b"' for k in range(n))
        got = one(spark, f'<a {many} href="/x">x</a>', M.html_links)
        assert [(r["kind"], r["raw"]) for r in got] == [("a", "/x")]


def test_character_references(spark):
    cases = {
        "&eacute;&copy;&NotEqualTilde;": "é©≂̸",
        "&#00000065;&#x000041;&#0;&#x110000;&#99999999999;": "AA���",
        "&#128;&#xD800;": "€�",
        "?a=1&copy=2&amp;b&ampx&amp": "?a=1&copy=2&b&ampx&",
        "&nosuch; & &;": "&nosuch; & &;",
    }
    for text, want in cases.items():
        assert one(spark, text, M.unescape_html) == want, text
