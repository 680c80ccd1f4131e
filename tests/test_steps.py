"""The command line from landed files to a comparison."""

from bibflow.__main__ import main
from bibflow.sources.delimited import read_table
from tests.test_sources import ARTICLES, CONFIG, INI, export


def test_build_screen_compare_render_search(spark, tmp_path, capsys):
    path = lambda name: str(tmp_path / name)
    (tmp_path / "ieee").mkdir()
    (tmp_path / "pubmed").mkdir()
    export(tmp_path / "ieee" / "a.csv", [{"Document Title": f"Gait {i}", "Publication Year": 2015 + i, "DOI": f"10.1/{i % 2}"} for i in range(3)])
    (tmp_path / "pubmed" / "a.xml").write_text(ARTICLES, encoding="utf-8")
    (tmp_path / "pubmed" / "b.xml").write_text("<E>An error occurred while processing request. Details: no backend</E>")
    (tmp_path / "p.ini").write_text(INI.replace("start_year = 2014", "start_year = 2016") + "manual_database = pubmed\n[pilot]\nscreening = Pilot\nnr_randomizations = 2\n")
    (tmp_path / "gait.xml").write_text(CONFIG.replace(
        '<Syntax name = "Title"><Term position = "After">[Title]',
        '<Syntax name = "FullText"><Term position = "After">[All Fields]</Term></Syntax><Syntax name = "Title"><Term position = "After">[Title]', 1))
    params = ["--params", path("p.ini")]

    main(["build", *params, "--ieee", path("ieee"), "--pubmed", path("pubmed"), "--table", path("runs"), "--export", path("out"), "--rejected", path("rejected")])
    exported = capsys.readouterr().out.strip()
    rows = sorted(read_table(spark, exported, sep=";").collect(), key=lambda r: int(r["article_id"]))
    assert [(r["article_id"], r["source"], r["title"], r["year"]) for r in rows] == [
        ("0", "IEEE", "Gait 1", "2016"), ("1", "IEEE", "Gait 2", "2017"), ("2", "PubMed", "A b 2 c d", "2019"),
        ("3", "PubMed", "T", None), ("4", "PubMed", "U", "2017"), ("5", "PubMed", "V", None)]

    assert [r["details"] for r in spark.read.parquet(path("rejected")).collect()] == ["no backend"]

    main(["screen", *params, "--table", path("runs"), "--out", path("screened")])
    marked = spark.read.parquet(path("screened"))
    assert marked.where("pilot = 'x'").count() == 2
    assert {r["title"] for r in marked.where("duplicate = 'x'").collect()} == {"T", "U", "V"}

    (tmp_path / "old.csv").write_text("article_id;title;Notes\n0;U;mine\n1;Gone;mine\n")
    main(["compare", *params, "--old", path("old.csv"), "--new", exported, "--out", path("out")])
    combined = read_table(spark, capsys.readouterr().out.strip(), "csv", ";")
    notes = {r["title"]: r["Notes"] for r in combined.collect()}
    assert notes == {"U": "mine", "Gone": "Remove", "T": "Add", "V": "Add", "A b 2 c d": "Add", "Gait 1": "Add", "Gait 2": "Add"}

    main(["render", *params, "--strategy", path("gait.xml")])
    assert capsys.readouterr().out.strip() == 'PubMed: (Gait[All Fields] OR "motor control"[All Fields]) NOT (robot*[Title])'

    main(["search", *params, "--table", path("runs"), "--strategy", path("gait.xml"), "--out", path("found")])
    assert {r["title"] for r in spark.read.parquet(path("found")).collect()} == {"Gait 1", "Gait 2"}
