import pytest
from oracle import same

from tessera.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert same(df, ORACLE_SQL[name], SF) > 0
    else:
        assert df.count() > 0


def test_groundedness_word_bounds(spark, tmp_path):
    """Words of negation end before letters beyond ASCII, as in SQL; and SQL folds the long s."""
    texts = ["El noñdo es así. Tres.", "Otra cosa.", "Es asíno de eso. Dos uno.", "Nada.", "Is unſafe here.", "Nope x1_no y."]
    spark.createDataFrame([(1, k, "user", x) for k, x in enumerate(texts)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    assert same(QUERIES["groundedness"](spark, str(tmp_path)), ORACLE_SQL["groundedness"], str(tmp_path)) == len(texts) - 1


def test_text_signals_odd_texts(spark, tmp_path):
    """Null texts have no signals, only line feeds begin a line, and words end before letters beyond ASCII: as in SQL."""
    texts = [None, "", "1. a\r2. b\r3. c", "1. a\n2. b\n3) c", "noñdo 1,5", "anoñ"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert same(QUERIES["text_signals"](spark, str(tmp_path)), ORACLE_SQL["text_signals"], str(tmp_path)) == len(texts)
