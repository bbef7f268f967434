from pyspark.sql import functions as F

from stackroom.operators import retrieval as R
from stackroom.sinks import writers as X
from stackroom.sources import markdown as M
from stackroom.sources import vcs as V
from tests.conftest import rows

GOOD = "---\ntitle: One\ntags: [a, b]\ndate: 2024-01-02\npart: 3\ncolour: red\n---\n\n# Head\n\nBody **bold**\n"
LITERAL = "---\n{'title': 'Two', 'date': datetime.date(2026, 1, 2), 'tags': ['x']}\n---\ntext"


def corpus(tmp_path):
    d = tmp_path / "kb"
    (d / "sub").mkdir(parents=True)
    for name, text in {"a.md": GOOD, "sub/b.md": LITERAL, "c.md": "no front matter", "d.md": "---\ntitle: [broken\n---\nx", "e.md": " \n", "empty.md": "", "INDEX.md": GOOD, "f.txt": "plain", "sub/g.html": "<p>x</p>"}.items():
        (d / name).write_text(text)
    return f"file://{d}"


def test_articles(spark, tmp_path):
    folder = corpus(tmp_path)
    got = {r.path.rsplit("/", 1)[1]: r for r in M.articles(spark, folder).collect()}
    assert sorted(got) == ["a.md", "b.md", "c.md", "d.md", "e.md"]
    a = got["a.md"]
    assert (a.title, a.tags, a.date, a.part, a.extra, a.fm_state) == ("One", ["a", "b"], "2024-01-02", 3, {"colour": "red"}, "yaml")
    assert a.body.startswith("\n# Head")
    assert (got["b.md"].title, got["b.md"].date, got["b.md"].fm_state) == ("Two", "2026-01-02", "literal")
    assert got["c.md"].fm_state == "none" and got["d.md"].fm_state == "malformed" and got["e.md"].body == " \n"
    assert {r.path.rsplit("/", 1)[1]: r.f for r in M.files(spark, folder).select("path", M.file_format(F.col("path")).alias("f")).collect()}["g.html"] == "html"


def test_naive_front_matter():
    assert M.naive("title: 'A b'\ntags:\n  - x\n  - y\nlist: [p, q]\n junk") == {"title": "A b", "tags": ["x", "y"], "list": ["p", "q"]}


LOG = """noise
aaaaaaa1|Ann|ann@x.org|2024-01-02 03:04:05|first | part
3\t1\tknow/a.md
-\t-\tpic.png
A\tknow/a.md
bbbbbbb2|Bob|bob@x.org|bad date|second

5\t0\tknow/a.md
"""


def test_commit_log(spark):
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate(LOG.split("\n"))], "file string, line int, text string")
    commits, files = V.commit_log(df)
    assert sorted((r.hash, r.author, r.message, r.at is None) for r in commits.collect()) == [("aaaaaaa1", "Ann", "first | part", False), ("bbbbbbb2", "Bob", "second", True)]
    assert rows(files.na.fill({"insertions": -1, "deletions": -1, "status": "?"})) == [("aaaaaaa1", "?", "pic.png", -1, -1), ("aaaaaaa1", "A", "know/a.md", 3, 1), ("bbbbbbb2", "?", "know/a.md", 5, 0)]
    h = {r.path: (r.n_commits, r.n_authors, r.added, r.removed) for r in V.file_history(commits, files).collect()}
    assert h["know/a.md"] == (2, 2, 8, 1)
    tags = spark.createDataFrame([("v1.2.10",), ("1.2.9",), ("v1.3.0-rc1",), ("v1.3.0",), ("latest",)], "tag string")
    assert [r.tag for r in V.versions(tags).collect()] == ["v1.3.0", "v1.3.0-rc1", "v1.2.10", "1.2.9"]


def test_renderings(spark):
    df = spark.createDataFrame([("a/b.md", "T & <x>", "c", ["p", "q&"], "# H\n\n**b** and *i* `c` [l](u)\n\n- x\n")], "path string, title string, category string, tags array<string>, body string")
    one = lambda c: df.select(c).first()[0]
    html = one(X.markdown_to_html(F.col("body")))
    for part in ("<h1>H</h1>", "<strong>b</strong>", "<em>i</em>", "<code>c</code>", '<a href="u">l</a>', "<li>x</li>"):
        assert part in html
    assert "T &amp; &lt;x&gt;" in one(X.html_page(F.col("title"), F.col("body")))
    assert one(X.xml_article(F.col("path"), F.col("title"), F.lit(None).cast("string"), F.col("tags"))) == "<article><path>a/b.md</path><title>T &amp; &lt;x&gt;</title><tags><tag>p</tag><tag>q&amp;</tag></tags></article>"
    assert '"position":2,"name":"b.md","item":"a/b.md"' in one(X.json_ld_breadcrumbs(F.col("path")))
    assert "**" not in one(X.markdown_to_text(F.col("body")))
    assert one(X.turtle_triple(F.lit("a b"), F.lit("rel"), F.lit("c"))) == "kb:a_b kb:rel kb:c ."
    assert one(X.latex_section(F.lit("a & b"), F.lit("x_y"))) == "\\section{a \\& b}\nx\\_y"


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q "x", y', ["p", "q"]), ("b", None, [])], "path string, title string, tags array<string>")
    base = str(tmp_path)
    X.write_json(df, f"{base}/j")
    assert rows(spark.read.json(f"{base}/j").select("path")) == [("a",), ("b",)]
    X.write_csv(df, f"{base}/c")
    back = spark.read.option("header", "true").option("escape", '"').csv(f"{base}/c")
    assert {r.path: (r.title, r.tags) for r in back.collect()}["a"] == ('q "x", y', "p;q")
    X.write_xml(df, f"{base}/x")
    assert spark.read.option("rowTag", "article").format("xml").load(f"{base}/x").count() == 2
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox")], "id long, text string")
    X.write_index(R.postings(docs, "id", "text"), f"{base}/i")
    assert rows(spark.read.parquet(f"{base}/i").where("word = 'red'").select("doc", "tf")) == [(1, 2)]
    X.write_text(df, F.col("path"), f"{base}/t", "gzip")
    assert spark.read.text(f"{base}/t").count() == 2
