"""Queries on odd or larger tables of their own against their SQL."""

import duckdb
import pandas as pd

from quirefold.plans import registry
from test_queries import norm


def same(spark, base, name, **tables):
    """The query's rows and those of its SQL on tables of its own."""
    con = duckdb.connect()
    for t, df in tables.items():
        path = f"{base}/{t}.parquet"
        df.to_parquet(path, index=False)
        con.execute(f"create view {t} as select * from '{path}'")
    got, want = registry.QUERIES[name](spark, str(base)).toPandas(), con.sql(registry.SQL[name]).df()
    pd.testing.assert_frame_equal(norm(got), norm(want))
    return got


def test_headings_end_before_letters_beyond_ascii(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": [1, 2], "text": ["EINSSACHÖ!! DER\nsee\nAN ENDx\nAN END_\nAN END.", "A B\nLADOESÓGA!! LAS"], "lang": "de", "source": "s"})
    got = same(spark, tmp_path, "section_carry", documents=docs)
    assert {"EINSSACH", "LADOES", "AN END"} <= set(got.section.dropna())


def test_expressions_of_sources_are_taken_once(spark):
    """Comments are dropped once a source, not for each element of the map of environments."""
    from quirefold.operators import tex

    docs = spark.createDataFrame([("a", "\\begin{document}\\section{One}" + "words " * 30 + "\\end{document}")], "doc string, tex string")
    plan = tex.tex_units(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<!\\\\)%") == 1


def test_branches_take_polynomials_once_and_whole_numbers(spark, sf):
    """No join of polynomials with their own starts or edges, and no fractions where numbers are whole."""
    from quirefold.operators import branches

    for name in ("lifted_roots", "refused_roots", "characteristic_roots", "puiseux_branches"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("parquet") == 1, name
    y = branches.lifted([[0, 5, 7], [-1, 0, 0], [1, 0, 0]], 0, 2)
    assert y == [0, 5, 32] and all(isinstance(x, int) for x in y)
    third = branches.lifted([[0, -1, -4], [3, 0, 0], [3, 0, 0], [1, 0, 0]], 0, 2)  # (1 + y)^3 = 1 + z + 4 z^2
    assert [str(x) for x in third] == ["0", "1/3", "11/9"]


def test_equal_series_are_worked_on_once(spark, sf):
    """Gathered series have the approximants that long ones have, and an order's lines are read once for them."""
    from quirefold.operators import borel
    from quirefold.plans import algebra_queries

    made = {1: [1, 1, 2, 3, 5, 8, 13, 21], 2: [1, 1, 2, 3, 5, 8, 13, 21], 3: [1, 1, 2, 6, 24, 120, 720]}
    long = spark.createDataFrame([(k, n, str(x), "1") for k, c in made.items() for n, x in enumerate(c)], "series_id long, n int, num string, den string")
    rows = spark.createDataFrame([(k, [str(x) for x in c]) for k, c in made.items()], "series_id long, c array<string>")
    assert sorted(borel.minimal(rows).collect()) == sorted(borel.minimal(long).collect()) != []
    before = borel.least.cache_info().hits
    assert borel.least(("1", "1", "1"), 12) == borel.least(("1", "1", "1"), 12) and borel.least.cache_info().hits == before + 1
    assert algebra_queries._rational(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_own_text_takes_its_field_once(spark):
    from pyspark.sql import functions as F
    from quirefold.operators import notes

    rows = spark.createDataFrame([("### Lema clave\n(pista) algo propio\nIntentos:\n- 2026-01-02 | nivel 2 | 3.5 min | s1\n",)], "body string")
    own = notes.own_text(notes.subsection(F.col("body"), "Lema clave"), F.array(F.lit("(pista)")))
    made = rows.select(own.alias("own"), notes.attempts(F.concat(F.lit("### Reconstruccion\n"), "body")).alias("tries"))
    assert [(r.own, r.tries[0] if r.tries else None) for r in made.collect()] == [("algo propio", None)]
    assert rows.select(own.alias("own"))._jdf.queryExecution().optimizedPlan().toString().count("Lema") == 1


def test_equal_titles_are_compared_once(spark, tmp_path):
    """Titles of equal words are paired without a row for each of their common words."""
    lines = ["Alpha beta gamma delta epsilon zeta eta"] * 30 + ["eta zeta epsilon delta gamma beta alpha!"] * 3 + ["alpha beta gamma delta epsilon zeta theta"] * 2 + ["alpha beta gamma delta epsilon zeta eta iota", "kappa lambda", "a b"]
    docs = pd.DataFrame({"doc_id": range(len(lines)), "text": [x + "\nbody" for x in lines], "lang": "en", "source": "s"})
    got = same(spark, tmp_path, "title_jaccard", documents=docs)
    assert len(got) == 33 * 32 // 2 + 33 + 1
    plan = registry.QUERIES["title_jaccard"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index" not in plan  # words are stored once, not taken anew for each side
