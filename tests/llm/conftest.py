import pytest

NOTES = "run_id long, notes string, lang string, dataset string, k string, fp long, part int"


@pytest.fixture(scope="session")
def make(spark):
    """Runs with columns whose names clash with those that operators use inside."""
    def rows(notes, first=0):
        return spark.createDataFrame(
            [(i, t, None, None, "x", 1, 2) for i, t in enumerate(notes, first)], NOTES)
    return rows


@pytest.fixture(scope="session")
def awkward(make):
    """NULL, empty, blank, one word, very long, copies, a repeated row and a NULL key."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    df = make([None, "", " \t\n ", "One", long, long, "a b c d e f", "A  b\tc d e f", "ünï çödé \U0001f600 x"])
    again = make(["a b c d e f"], 6)
    return df.union(again).union(make(["a b c d e f"]).selectExpr("cast(null as long)", "notes", "lang", "dataset", "k", "fp", "part"))
