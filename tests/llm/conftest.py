from __future__ import annotations

import pytest

#: Null in every column, empty and odd texts, repeats, ties; the extra columns clash with names that operators use.
ROWS = [
    (1, "the same text of a few words", "en", "s1", 5, "x", 1),
    (2, "the same text of a few words", "en", "s1", 5, "x", 2),
    (2, "the same text of a few words", "en", "s1", 5, "x", 2),
    (3, None, None, None, None, None, None),
    (4, "", "en", "s2", 0, "", 4),
    (None, "nobody's text", "de", "s2", 3, "y", 5),
    (None, None, "de", None, 3, "y", 5),
    (5, "ünïcödé 漢字 🙂 \t\n a@b.example +1 (743) 555-3824 4111 1111 1111 1111 10.0.0.255", "fr", "s3", 9, "z", 6),
    (6, "word " * 30_000, "en", "s1", 9, "z", 7),
    (7, "a" * 100_000, "en", "s1", 9, "z", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, ah long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


#: Names that operators use inside; each comes as an extra column of a fixture.
NAMES = """whole inside last blocks _s _b _times _order good label_id _sha _row _h _id _hot _salt block band mark signature bands ah ch a b h run start end
 row_id local_id class_id n sha key size upto left token_ids decoded pass_no_ read_text kinds example spans removed instance pattern score trust doubt root node _gone component_id
 _text _some _m _p _l _o candidates email ip card phone base found hit listed url_ rank""".split()


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with a column of every name that operators use inside, each holding the row's place."""
    from pyspark.sql import functions as F

    return odd.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"{i} {n}").alias(n) for i, n in enumerate(NAMES)))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables given as name=DataFrame to a new folder."""

    def write(**tables):
        at = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return write
