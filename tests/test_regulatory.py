"""Regulatory markup, record builders, ledgers and arrivals, on small inputs."""

from pyspark.sql import functions as F

from dispensa.operators import corpus, projections
from dispensa.sources import tables, writers
from dispensa.streaming import jobs

PAGE = """<html><body><p class="AmmAnnexeTitre1">lost <a name="RcpDenomination">1. NOM</a></p>
<p>first</p><p class="AmmAnnexeTitre1">2. A</p><div>out <p style="text-align: center"><i>in</i></p></div>
<p class="AmmAnnexeTitre3">deep<p class="AmmAnnexeTitre2">back<ol><li>one<li><p class="souligne">two</p></ol>
<table><caption>cap</caption><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr><tr><td></td></tr></table>
<p class="AmmAnnexeTitre1">3. B <a name="RcpInstPrepRadioph"></a>end</p><p>after</p></body></html>"""


def test_regulatory_rows_of_broken_markup(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<body><p>no start</p></body>"), (3, None), (4, '<p class="DateNotif">d</p><p>open'), (5, '<p class="DateNotif">d</p><table><tr><td>x')], "id long, html string")
    rows = corpus.regulatory_sections(pages, "id", "html").orderBy("id", "pos").collect()
    assert [(r.id, r.kind, r.level, r.text, r.section and r.section.text) for r in rows] == [
        (1, "text", None, "first", "unsectioned"),
        (1, "heading", 1, "2. A", None),
        (1, "text", None, "out", "2. A"),
        (1, "text", None, "in", "2. A"),
        (1, "heading", 3, "deep", "2. A"),
        (1, "heading", 2, "back", "2. A"),
        (1, "text", None, "one", "back"),
        (1, "text", None, "two", "back"),
        (1, "table", None, None, "back"),
        (1, "heading", 1, "3. B end", None),
        (4, "text", None, "open", "unsectioned"),
        (5, "table", None, None, "unsectioned"),
    ]
    by = {r.text: r for r in rows if r.id == 1}
    assert by["in"].italic and by["in"].alignment == "center" and not by["out"].italic
    assert by["one"].list_type == "numbered" and by["two"].underline
    assert by[None].caption == "cap" and by[None].cells == [["ab", "c"]] and by[None].headers == []


def test_regulatory_rows_without_pages(spark):
    assert corpus.regulatory_sections(spark.createDataFrame([], "id long, html string"), "id", "html").count() == 0


def test_metadata_strategies(spark):
    pages = [
        (1, '<h1 class="textedeno">NAME 5 mg, gel, tube - Sheet</h1><p class="AmmCorpsTexteGras">longer title</p>', "NAME 5 mg, gel, tube", None, "gel, tube"),
        (2, '<p class="AmmDenomination">tiny</p><p class="AmmDenomination">Big enough</p><a name="RcpTitulaireAmm"></a><p>12 avenue Y</p><p>Firm</p>', "Big enough", "Firm", None),
        (3, "", None, None, None),
        (4, None, None, None, None),
    ]
    got = corpus.html_metadata(spark.createDataFrame([p[:2] for p in pages], "id long, html string"), "id", "html").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(p[0], *p[2:]) for p in pages]


def test_document_links(spark):
    html = '<div id="tab-a"><a href="b/rcp.html">RCP</a></div><div id="tab-b"><a href="z.pdf">z</a></div>'
    pages = spark.createDataFrame([(1, html, "https://h.example/m/1?x=/y"), (2, '<a href="q.PDF">q</a>', "https://h.example"), (3, "", "https://h.example/"), (4, None, None)], "id long, html string, url string")
    got = corpus.document_links(pages, "id", "html", "url", "tab-a", ("rcp",)).orderBy("id").collect()
    assert [r.links for r in got] == [["https://h.example/m/b/rcp.html"], ["https://h.example/q.PDF"], [], None]


def test_a_block_without_a_table_takes_no_other(spark):
    html = '<div id="a">none</div><div id="b"><table id="t"><tr><td>x</td></tr></table></div>'
    got = corpus.html_monograph(spark.createDataFrame([(1, html)], "id long, html string"), "id", "html").collect()
    assert [(r.rubric, r.cells) for r in got] == [("b", ["x"])]


def test_sections_of_two_levels_and_of_strings(spark):
    raw = spark.createDataFrame([(1, [(None, ["a", " ", None], [("t ", ["b"])]), None, ("u", None, None)]), (2, None)], "id long, raw array<struct<title:string,content:array<string>,subsections:array<struct<title:string,content:array<string>>>>>")
    got = raw.select("id", projections.normalise_sections(F.col("raw"), lambda x: x).alias("s")).orderBy("id").collect()
    plain = [(x.title, [c.text for c in x.content], [(y.title, [c.text for c in y.content]) for y in x.subsections]) for x in got[0].s]
    assert plain == [("", ["a"], [("t", ["b"])]), ("u", [], [])] and got[1].s is None


def test_ledger_counts_what_was_written(spark):
    folder = jobs.work_dir(spark)
    df = spark.range(10).withColumn("ok", F.col("id") < 7)
    row = writers.run_ledger(df, "run", F.col("ok"), lambda x: x.write.parquet(f"{folder}/a")).first()
    assert (row.processed, row.written, row.errors, row.status) == (10, 7, 3, "finished") and row.started_at <= row.finished_at
    none = writers.run_ledger(df.where("id < 0"), "run", F.col("ok"), lambda x: x.write.parquet(f"{folder}/b")).first()
    assert (none.processed, none.written, none.errors) == (0, 0, 0)


def test_json_array_without_records(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    assert tables.import_json_array(spark, str(tmp_path / "a.json"), "id long").collect() == []


def test_arrivals_are_numbered_over_micro_batches(spark, tmp_path):
    for k, ids in enumerate(([(1, 10), (1, 11), (2, 12)], [(1, 13), (None, 14)])):
        spark.createDataFrame(ids, "user_id long, event_id long").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema("user_id long, event_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = jobs.stream_append(jobs.running_count_stream(stream, "user_id", "event_id"), jobs.work_dir(spark)).collect()
    assert sorted((r.event_id, r.so_far) for r in got if r.user_id == 1)[-1] == (13, 3)
    assert sorted((r.user_id or 0, r.so_far) for r in got) == [(0, 1), (1, 1), (1, 2), (1, 3), (2, 1)]


TERRAINS = """<table class="table_mono"><tr><td>other</td></tr></table><table class="x"><tr><td>Terrain N°9</td></tr></table>
<TABLE class="a table_mono"><tr><td>Terrain N° <i>12</i></td><td>x <b>HYPER<br>S</b><ul><li>one</li><li> </li><li>two&nbsp;&amp; <i>3</i></li></ul></td></tr>
<tr><td>Niveau(x)</td><td><ul><li><b>OLD</b></li></ul></td></tr><tr><td>Niveau(x)</td><td><ul><li><b>ABSOLUE</b></li></ul></td></tr><tr><td>lone</td></tr>
<tr><td>Référence(s)</td><td>plain  text</td></tr><tr><td>CIM 10</td><td><ul><li>Allergie Z88 T784</li><li>again T784</li><li>Non concerné .</li><li>K90 b</li><li>rare</li></ul></td></tr></table>
<table class="table_mono"><tr><td>terrain no3</td></tr></table><table class="table_mono"><tr><td>Terrain N°4</td><td>bare</td></tr>"""


def test_contraindications(spark):
    pages = spark.createDataFrame([(1, TERRAINS), (2, None), (3, ""), (4, "<p>none</p>")], "id long, html string")
    rows = corpus.contraindications(pages, "id", "html").orderBy("id", "pos").collect()
    assert [tuple(r) for r in rows] == [
        (1, 2, 12, "HYPER S", ["one", "two & 3"], ["ABSOLUE"], ["plain text"], ["T784", "K90", "rare"]),
        (1, 3, 3, "", [], [], [], []),
        (1, 4, 4, "bare", [], [], [], []),
    ]
    assert corpus.contraindications(pages.where("id > 4"), "id", "html").count() == 0


NESTED = """<p>Commentaires du RCP are below</p><table class="table_mono"><tr><td>Terrain No 3</td><td>plain <b>BOLD</b><ul><li>one</li><li> </li></ul></td></tr>
<tr><td>Niveau</td><td>outer<table><tr><td>Code CIM</td><td>K90 &amp; <ul><li>T784</li></ul></td></tr></table></td></tr><tr><td>Référence</td></tr></table>
<table><tr><td>Terrain No 4</td><td>x</td></tr></table><table class="table_mono"></table>"""


def test_nested_tables_are_rows_of_the_outer_one(spark):
    pages = spark.createDataFrame([(1, NESTED), (2, None), (3, "<table><tr><td>open")], "id long, html string")
    rows = corpus.table_rows(pages, "id", "html", "Commentaires").orderBy("id", "pos", "row").collect()
    assert [(r.id, r.pos, r["row"], [x.text for x in r.cells]) for r in rows] == [
        (1, 0, 0, ["Terrain No 3", "plain BOLD one"]), (1, 0, 1, ["Niveau", "outer Code CIM K90 & T784", "Code CIM", "K90 & T784"]), (1, 0, 2, ["Code CIM", "K90 & T784"]), (1, 0, 3, ["Référence"]),
        (1, 1, 0, ["Code CIM", "K90 & T784"]), (1, 2, 0, ["Terrain No 4", "x"]), (1, 3, 0, []), (3, 0, 0, ["open"]),
    ]
    assert all(r.marked == (r.id == 1) for r in rows)
    assert [tuple(r) for r in corpus.contraindications(pages, "id", "html").collect()] == [(1, 0, 3, "BOLD", ["one"], ["T784"], [], ["T784"])]


def test_contraindication_notes(spark):
    block = '<table class="table_mono"><tr><td>1</td></tr></table><b>Commentaires du RCP</b><table><tr><td>no</td></tr></table><table class="table_mono"><tr><td>{}</td></tr><tr><td>La Référence</td><td>{}</td></tr></table>'
    cases = [(1, block.format('<div class="a text">the <b>note</b></div>', "<ul><li>first</li><li>second</li></ul>")), (2, block.format("all of it", "")), (3, block.split("<b>")[0]), (4, None), (5, "")]
    got = corpus.contraindication_notes(spark.createDataFrame(cases, "id long, html string"), "id", "html").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "the note", "first"), (2, "all of it La Référence", ""), (3, "", ""), (4, "", ""), (5, "", "")]
