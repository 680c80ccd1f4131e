"""Line dedup against SQL and brute force."""

from pyspark.sql import functions as F

from bibflow.llm import line_dedup
from bibflow.llm.queries import QUERIES, SQL
from tests.oracle import database, differences


def test_query_equals_sql(spark, sf_dir):
    df = QUERIES["op4_line_dedup"](spark, sf_dir)
    assert differences(df, database(sf_dir), SQL["op4_line_dedup"]) == []
    assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def brute(rows, ratio, least):
    out = []
    for site, text in rows:
        mine = [t for s, t in rows if s == site and s is not None]
        lines = None if text is None else text.split("\n")
        bare = lambda x: x.strip(" \t\r")
        gone = set()
        for line in {bare(x) for x in lines or []} - {""}:
            n = sum(line in {bare(x) for x in (t or "").split("\n")} for t in mine)
            if n >= least and n > ratio * len(mine):
                gone.add(line)
        left = None if text is None else [x for x in lines if bare(x) not in gone]
        kept = text if text is None else "\n".join(left)
        out.append((site, kept, sum(bare(x) != "" for x in lines or []), 0 if text is None else len(lines) - len(left)))
    return sorted(out, key=repr)


ROWS = (
    [("a", f"Menu\n\nstory {k}\n  Menu\t\nAll rights reserved") for k in range(30)]
    + [("a", "Menu"), ("a", None), ("a", ""), ("a", "x\n" * 20_000 + "Menu"), ("b", "Menu"), ("b", "Menu\nown"), (None, "Menu"), (None, "Menu")]
    + [("c", "same\ntext")] * 6 + [("d", f"half\n{k}" if k % 2 else f"{k}") for k in range(8)]
)


def test_odd_rows(spark):
    df = spark.createDataFrame([(s, t, 7, "x") for s, t in ROWS], "site string, text string, n_lines int, _keys string")
    done = line_dedup.drop_boilerplate(df, "site", "text", ratio=0.5, min_pages=4)
    assert done.columns == ["site", "text", "_keys", "n_lines", "n_dropped"]
    found = sorted((tuple(r) for r in done.select("site", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert found == brute(ROWS, 0.5, 4)


def test_empty_table(spark):
    df = spark.createDataFrame([], "site string, text string")
    assert line_dedup.drop_boilerplate(df, "site", "text").collect() == []


def test_page_text_and_host(spark):
    html = '<head><title>T &amp;lt; x</title><script>a<b</script></head><!-- <p>no</p> --><p>One <b>two</b>&nbsp;</p><ul><li>3<li>4</ul>\r\n\n end'
    urls = {"HTTP://User@Example.ORG:80/x": "example.org", "https://a.b?q": "a.b", "nothing": None, "": None}
    row = spark.range(1).select(line_dedup.page_text(F.lit(html)), line_dedup.page_text(F.lit(None).cast("string"))).first()
    assert row[0] == "T &lt; x\nOne two\n3\n4\nend" and row[1] is None
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", line_dedup.host_of(F.col("u")).alias("h")).collect()} == urls
