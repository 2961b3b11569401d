"""Rows out of texts and pages."""

from pyspark.sql import functions as F

from spreadlake.sources import corpus


def test_lines_say_why_they_are_no_rows(spark):
    body = "Gas oil (2%s) 12.5 13\n\n 1 2 3\nup 4 points\nno figures\n naphtha −3R"
    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc int, body string")
    kinds = {(r.doc, r.line): r.kind for r in corpus.printed_lines(docs, "doc", "body").collect()}
    assert [kinds[1, i] for i in range(6)] == ["row", "blank", "no_label", "number_inside", "no_number", "row"]
    assert kinds[3, 0] == "blank" and (2, 0) not in kinds
    rows = {r.line: r for r in corpus.table_rows(docs, "doc", "body").collect()}
    assert sorted(rows) == [0, 5]
    assert rows[0]["values"] == [12.5, 13.0] and rows[0].label_key == "gasoil(2%s)" and not rows[0].revised
    assert rows[5]["values"] == [-3.0] and rows[5].revised


def test_tokens_of_a_line_are_made_once(spark):
    docs = spark.createDataFrame([(1, "Oil 1 –2.5R\nOil +3R ‐4\nFuel\u20113 7\n–5 6")], "doc int, body string")
    rows = corpus.table_rows(docs, "doc", "body").filter("numbers = 2")
    assert [r["values"] for r in rows.orderBy("line").collect()] == [[1.0, -2.5], [3.0, -4.0]]
    plan = rows.groupBy("label_key").agg(F.sum(F.col("values")[0]), F.count_if("revised"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # lines, and tokens of a line


def test_html_tables(spark):
    page = """<table><!-- <tr><td>hidden</td><td>1</td></tr> --><TR class="h"><th>Grade<th>May<th>June
      <tr><td>Gas&nbsp;oil <b>&amp; co</b></td><td> 1,200.5</td><td>-3</td></tr>
      <tr></tr><tr><td>7</td><td>8</td></tr></table><script>var x = "<tr><td>no</td></tr>"</script><ul><li>a</li></ul>"""
    docs = spark.createDataFrame([(1, page), (2, None), (3, "plain")], "page int, html string")
    got = corpus.html_rows(docs, "page", "html").orderBy("page", "row").collect()
    assert [(r.page, r.kind) for r in got] == [(1, "no_number"), (1, "row"), (1, "no_cells"), (1, "no_label")]
    assert got[0].cells == ["Grade", "May", "June"]
    assert got[1].label == "Gas oil & co" and got[1]["values"] == [1200.5, -3.0]
    lists = corpus.html_rows(docs, "page", "html", ("ul",), ("li",)).select(F.col("cells")[0]).collect()
    assert [r[0] for r in lists] == ["a"]
