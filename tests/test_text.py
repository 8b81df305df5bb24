from html.entities import html5

from pyspark.sql import functions as F

from dupelens.functions import html, porter, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_html_is_marked_as_the_study_does(spark):
    source = '<p>See <a href="https://x.y/z">link</a> and <code>int\nx</code> <img src="q"> http://a.b/c end</p>'
    assert one(spark, text.mark_html, source) == "<p>see  url link</a> and  codesnippet   img   url end</p>"
    assert one(spark, text.process_html, source) == "see  url link and  codesnippet   img   url end"
    assert one(spark, html.html_text, source) == "see  url link and  codesnippet   img   url end"


def test_any_tag_that_begins_with_a_swallows_text_up_to_a_link(spark):
    assert one(spark, text.mark_html, "<article>kept? http://x.y >after") == " url after"


def test_scripts_comments_and_entities(spark):
    source = "a<!-- no --><script>var x;</script><style>p{}</style>b &amp; &lt;c&gt;"
    for f in (text.process_html, html.html_text):
        assert one(spark, f, source) == "ab & <c>"


def test_entities(spark):
    source = "&eacute;&Eacute; &hellip;&mdash; &#233;&#xe9; &amp;lt; &#38;gt; &lt;&nosuch; &nbsp;x &#0; &#x1f600; &amp"
    assert one(spark, text.process_html, source) == "éé …— éé &lt; &gt; <&nosuch;  x &#0; 😀 &amp"
    every = ["&" + name.lower() for name in html5 if name.endswith(";")]
    wanted = {e: {c for n, c in html5.items() if "&" + n.lower() == e} for e in every}
    got = one(spark, text.decode_entities, "\x03".join(every)).split("\x03")
    assert all(g in wanted[e] or e == "&nbsp;" for e, g in zip(every, got, strict=True))


def test_the_parser_decodes_what_the_native_text_does(spark):
    source = "<p>a &&&amp</p>b &amp; &copy &copy; &nbsp;x &#39;&amp;lt; &am<b></b>p; &eacute;&nosuch; &lt"
    for f in (text.process_html, html.html_text):
        assert one(spark, f, source) == "a &&&ampb & &copy ©  x '&lt; & é&nosuch; &lt"


def test_nulls_stay_null(spark):
    for f in (text.process_html, html.html_text, text.tokens):
        assert one(spark, f, None) is None


def test_tokens(spark):
    assert one(spark, text.tokens, "c#,unity3d,2d-games") == ["unityd", "games"]
    assert one(spark, text.tokens, "The <b>Größe</b> of\tthe x1y2z 12") == ["größe", "xyz"]
    assert one(spark, text.tokens, "") == []


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "games": "game"}
    assert {w: porter.stem(w) for w in pairs} == pairs


def test_stems_are_joined_back(spark):
    rows = spark.createDataFrame([("games", 1), ("game", 2), (None, 3)], "term string, n int")
    assert sorted(((r["term"], r["n"]) for r in porter.with_stems(rows).collect()), key=lambda x: x[1]) == [("game", 1), ("game", 2), (None, 3)]
