from dupelens.sources import catalog, xml

POSTS = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="1" PostTypeId="1" AcceptedAnswerId="3" AnswerCount="2" Title="How to A*?" Body="&lt;p&gt;text&lt;/p&gt;" Tags="&lt;unity3d&gt;&lt;c#&gt;" />
  <row Id="2" PostTypeId="1" AnswerCount="0" Title="Why?" Body="b" Tags="&lt;x&gt;" />
  <row Id="3" PostTypeId="2" ParentId="1" Score="4" CreationDate="2010-01-01T00:00:00.000" Body="answer" />
  <row Id="4" PostTypeId="2" ParentId="1" Score="5" CreationDate="2010-01-02T00:00:00.000" Body="other" />
</posts>
"""
LINKS = """<postlinks>
  <row Id="9" PostId="2" RelatedPostId="1" LinkTypeId="3" />
  <row Id="8" PostId="2" RelatedPostId="1" LinkTypeId="1" />
  <row Id="7" PostId="2" RelatedPostId="5" LinkTypeId="3" />
</postlinks>
"""


def test_dumps_are_read(spark, tmp_path):
    (tmp_path / "posts.xml").write_text(POSTS)
    (tmp_path / "links.xml").write_text(LINKS)
    questions = xml.read_questions(spark, str(tmp_path / "posts.xml"))
    assert sorted(map(tuple, questions.collect())) == [("1", 2, "How to A*?", "<p>text</p>", "unity3d,c#"), ("2", 0, "Why?", "b", "x")]
    answers = xml.read_answers(spark, str(tmp_path / "posts.xml"))
    assert sorted((r["id"], r["accepted"], r["score"]) for r in answers.collect()) == [("3", True, 4), ("4", False, 5)]
    assert xml.read_dup_pairs(spark, str(tmp_path / "links.xml")).count() == 2
    assert [tuple(r) for r in xml.read_dup_pairs(spark, str(tmp_path / "links.xml"), questions).collect()] == [("2", "1")]


def test_spaces_around_a_text_stay(spark, tmp_path):
    texts = [" lead", "trail ", "\ttab", "  ", "", "a\r", "null", "x />y <row> & \" z"]
    rows = spark.createDataFrame([(k, 0, t, t, "en,src1") for k, t in enumerate(texts)], "id long, n_answers long, title string, body string, tags string")
    xml.write_posts(rows, str(tmp_path / "posts"))
    back = {int(r["id"]): (r["title"], r["body"]) for r in xml.read_questions(spark, str(tmp_path / "posts")).collect()}
    assert back == {k: (t, t) for k, t in enumerate(texts)}


def test_catalog():
    c = catalog.Catalog("/data")
    assert c.path("embedding", dataset="a", model="tfidf") == "/data/embedding/dataset=a/model=tfidf"
    assert len(catalog.ARTEFACTS) > 20
