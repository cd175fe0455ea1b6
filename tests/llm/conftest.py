import pytest

from waymeld.llm.common import table


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with the cases every operator must stand: nulls, empty and long texts, ties, repeats, a clashing extra column."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, base, "x"), (2, base, "x"), (3, base + " end", "y"), (3, base + " end", "y"), (4, None, None), (5, "", "z"),
            (None, "a b", "n"), (6, "one two", "q"), (7, " \n\t ", "q"), (8, ("long words here " * 4000).strip(), "q"),
            (9, "première ligne ici\nzweite Zeile dort\nlast one\nünï 😀 漢字", "q"),
            (10, "première ligne ici\nzweite Zeile dort\nother", "q"), (11, "x" * 5000, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


@pytest.fixture(scope="session")
def real(spark):
    return table(spark, "/root/testdata/sf0.001", "documents")
