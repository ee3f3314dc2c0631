"""Queries against their SQL on small tables of odd rows."""

import random

import duckdb
import pandas as pd

from dispensa.operators import corpus, links
from dispensa.plans import registry
from dispensa.sources import tables, writers


def agree(spark, folder, name, **tables):
    """The rows of a query over the tables, after they were compared with its SQL's."""
    con = duckdb.connect()
    for n, df in tables.items():
        df.to_parquet(f"{folder}/{n}.parquet", index=False, coerce_timestamps="us")
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet')")
    got = registry.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    plain = lambda rows: sorted((tuple(None if pd.isna(v) else v for v in r) for r in rows), key=repr)
    mine = plain(tuple(r) for r in got.select(*columns).collect())
    assert mine == plain(con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    return [dict(zip(columns, r, strict=True)) for r in mine]


def documents(*texts):
    return pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype="string"), "lang": "en", "source": "src0"})


def pages(*htmls):
    return pd.DataFrame({"page_id": range(len(htmls)), "url": [f"http://a.example/en/{k}?a=1&copy=2" for k in range(len(htmls))], "html": htmls})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NUMBERED = documents("a\n28.68.191.238 Den sch\n4.1. TITLE\nb\n|c\n\n7. x\n\n|", "a\n4.2 x", "a\n||\n\r|b", "a", None, "")


def test_doc01_lines_that_begin_with_a_number_stay(spark, tmp_path):
    assert len(agree(spark, tmp_path, "doc01_split_numbered", documents=NUMBERED)) == 7


def test_doc13_lines_that_begin_with_a_number_stay(spark, tmp_path):
    assert agree(spark, tmp_path, "doc13_document_record_text", documents=NUMBERED)[1]["sections"] == "4.1:16"


def test_doc02_lines_that_begin_with_a_number_stay(spark, tmp_path):
    texts = documents("a\n28.68.191.238 Den sch\n4.1. TITLE\nb\n 7. x\u00a0\n\u00a0", "a\n4.2 x\nANNEXE II\nb\nc", "1.\n1.\n4.1.\n\n|x", None, "")
    assert len(agree(spark, tmp_path, "doc02_split_outline_text", documents=texts)) == 7


def test_doc05_other_entities_than_amp_are_text(spark, tmp_path):
    got = agree(spark, tmp_path, "doc05_html_metadata", pages=pages("<title>a = &quot;b&amp;c&amp;lt; &nbsp; &#39; & d &amp</title>", "<title> </title><h1>x&gt;y</h1>", "<p>z</p>"))
    assert [r["title"] for r in got] == ["a = &quot;b&c&lt; &nbsp; &#39; & d &amp", "x&gt;y", None]


def test_doc07_entities_that_are_cut_are_text(spark, tmp_path):
    page = "<nav><ul><li><a href='/a'>a&lt;b &copy;</a></li></ul></nav><article><h1>the&amp;&amp</h1><p>x &#39;&nbsp;y&quot; &eacute &amp;lt; & z</p></article>"
    got = agree(spark, tmp_path, "doc07_contraindications", pages=pages(page))
    assert got[0]["level"] == "the&&amp x ' y\" &eacute &lt; & z" and got[0]["heading"].endswith("&copy=2")


def test_doc05_holders_of_five_digits_are_no_addresses(spark, tmp_path):
    keys = [0, 1, 2, 9998, 10000, 10001, 10002, 99998, 100001, 1234567]
    agree(spark, tmp_path, "doc05_regulatory_metadata", supplier=pd.DataFrame({"s_suppkey": keys, "s_name": [f"Supplier#{k:09d}" for k in keys]}))


def test_jn12_grams_are_not_broadcast_and_short_names_are_found(spark):
    items = [(0, "abc"), (1, "xabcx"), (2, "xab"), (3, "xéy"), (4, None), (5, ""), (6, "zz"), (7, "xabcx"), (8, "b")]
    dim = [("abc", 9), ("abc", 7), ("ab", 8), ("é", 3), ("", 1), (None, 2), ("zzz", 0), ("xé", None), ("b", 6)]
    left, names = spark.createDataFrame(items, "item long, value string"), spark.createDataFrame(dim, "name string, id long")
    want = {(0, 7), (1, 6), (2, 6), (3, 3), (4, None), (5, 1), (6, None), (7, 6), (8, 6)}
    assert {tuple(r) for r in links.inside_match(left, "item", "value", names).collect()} == want
    grams = links.gram_pairs(left.select("value"), names.where("name <> ''").groupBy("name").agg({"id": "min"}).toDF("name", "id"))
    assert "Broadcast" not in plan(grams)


def test_jn13_a_prefix_is_looked_up_by_equality(spark):
    items = [(0, "abcd"), (1, "abc"), (2, "abce"), (3, "ab"), (4, None), (5, "éàü"), (6, "abcdef"), (7, "abc"), (8, "")]
    dim = [("abcde", 5), ("abcd", 6), ("abcef", 4), ("ab", 8), ("éàüx", 3), (None, 2), ("abcefg", None), ("abcdef", 9)]
    left, names = spark.createDataFrame(items, "item long, value string"), spark.createDataFrame(dim, "name string, id long")
    found = links.prefix_match(left, "item", "value", names)
    assert {tuple(r) for r in found.collect()} == {(0, 6), (1, 4), (2, 4), (3, 8), (4, None), (5, 3), (6, 9), (7, 4), (8, None)}
    assert "StartsWith" not in plan(found)


MARKUP = """<a name="RcpDenomination">|<p class="DateNotif x">|<a name="RcpInstPrepRadioph"/>|<P class='AmmAnnexeTitre1 gras'>|<p class="AmmAnnexeTitre2">|<p class="AmmAnnexeTitre0"><a>|</p>|</P >|<div style="Text-Align : center">|</div>
<li class=AmmListePuces>|<li>|</li>|<ul>|</ul>|<ol>|</ol>|<table>|</table>|<tr>|</tr>|<td>|</td>|<th>|</th>|<thead>|</thead>|<caption>|</caption>|<b>|</b>|<em>|<strong >|<a href="x?a=1&copy=2" name=t>|</a>|<br/>|<p/>|<td colspan=2 />|<p CLASS="souligne" data-x>|x|y z|&amp;|&eacute|& b|1 > 2|\u00a0""".replace("\n", "|").split("|")
ODD = ["<", "<!-- c <p> -->", "<script>a<b</script>", '<p class="a>b">', '<p class="a"id=x>', "<Title>t<p></title>", "</", "<1", "<p", "</p x>", "<p class=a/>", '<p class = "gras">', "<style>p<b</style>"]


def test_doc04_plain_markup_is_read_as_the_parser_reads_it():
    rng, plain = random.Random(4), 0
    for _ in range(3000):
        tags = [rng.choice(MARKUP) for _ in range(rng.randint(0, 40))] + rng.choices(ODD, k=rng.random() < 0.3)
        rng.shuffle(tags)
        page = rng.choice(["", '<a name="RcpDenomination">']) + "".join(tags)
        parsed = corpus._Regulatory().parse(page)
        assert corpus._Regulatory().read(page) == parsed
        plain += bool(parsed)
    assert plain > 1000


def test_doc04_sections_need_no_shuffle(spark):
    html = '<p class="DateNotif">d</p><p>a</p><p class="AmmAnnexeTitre2">B</p><p>c</p><p class="AmmAnnexeTitre1">D</p><p class="AmmAnnexeTitre3">E</p><p class="AmmAnnexeTitre2">F</p><table><tr><td>g</table><p class="AmmAnnexeTitre1">H</p>'
    rows = corpus.regulatory_sections(spark.createDataFrame([(1, html), (1, html), (2, None), (3, "")], "k long, html string"), "k", "html")
    assert "Exchange" not in plan(rows)
    want = [("a", None, "unsectioned"), ("B", None, None), ("c", 1, "B"), ("D", None, None), ("E", 3, "D"), ("F", 3, "D"), (None, 5, "F"), ("H", None, None)]
    got = [(r.k, r.text, *(r.section or (None, None))) for r in rows.orderBy("k", "pos").collect()]
    assert got == [(1, *w) for w in want for _ in range(2)]
    assert rows.where("kind = 'heading' and level = 1").where("section is not null").count() == 0


def test_src09_many_small_files_take_few_tasks(spark, tmp_path):
    names = ["a", 'a "b", c', "a,b", "", " x ", "\\"] + [f"Supplier#{k:09d}" for k in range(300)]
    (tmp_path / "in").mkdir()
    agree(spark, tmp_path / "in", "src09_scan_binary_corpus", supplier=pd.DataFrame({"s_suppkey": range(306), "s_name": names}))
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k long, name string")
    writers.land_files(df, "k", "name", str(tmp_path / "a b%"), "pdf", 8)
    assert sorted(p.name for p in (tmp_path / "a b%").iterdir())[:2] == ["k=0", "k=1"]
    found = tables.scan_binary_corpus(spark, str(tmp_path / "a b%"), 8)
    assert found.rdd.getNumPartitions() <= 8 and found.count() == 306


def test_jn24_broadcasts_no_nodes(spark):
    assert "Broadcast" not in plan(registry.queries()["jn24_build_graph"](spark, "/root/testdata/sf0.001"))
