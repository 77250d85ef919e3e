import pytest

from compare import compare, duck
from eralex.llm import queries as Q


@pytest.mark.parametrize("name", ["p4_found", "p4_coverage", "p6_found", "p6_clean", "p6_templates", "p7_found", "p8_coverage", "p9_found", "p9_matches"])
def test_query_equals_sql(spark, sf, name):
    ok, said = compare(spark, duck(sf), sf, name, Q.QUERIES[name], Q.SQL[name])
    assert ok, said


@pytest.mark.parametrize(("name", "columns"), [("p2_found", ["ord"]), ("p3_found", ["table_name", "row_key", "field_name", "pii_type"]), ("p5_found", ["ord", "field_name"]), ("p10_found", ["doc_id"])])
def test_columns(spark, sf, name, columns):
    df = Q.QUERIES[name](spark, sf)
    assert df.columns == columns and df.count() >= 0


def test_training_text_is_not_the_tables_own(sf):
    """No sentence of the invented documents stands in the test tables, apart from conventions such texts share."""
    import re

    import duckdb

    from eralex.llm import synthetic as S

    con = duckdb.connect()
    big = []
    for name, columns in {"dense_docs": ["text", "case_name"], "metadata": ["petitioner", "respondent", "title", "description"], "judgments": ["text"], "documents": ["text"], "citations": ["context"]}.items():
        for c in columns:
            big += [r[0] for r in con.execute(f"SELECT DISTINCT {c} FROM read_parquet('{sf}/{name}.parquet') WHERE {c} IS NOT NULL").fetchall()]
    big = re.sub(r"\s+", " ", " ".join(big)).lower()
    shared = {"resident of", "v. state of", "high court of"}
    for pool in (S.PERSONS, S.EITHER, S.THINGS, S.PLACES_OF, S.PHONES, S.MAILS, S.NUMBERS, S.NONE, S._SUBJECTS, S._OBJECTS, S._LEADS):
        for frame in pool:
            for part in re.split(r"\{\w+\}", frame):
                words = re.sub(r"\s+", " ", part).lower().strip(" ,.:;()").split(" ")
                for i in range(max(1, len(words) - 2)):
                    piece = " ".join(words[i : i + 3])
                    assert len(words) < 2 or piece in shared or piece not in big, (frame, piece)
