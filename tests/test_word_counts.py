"""First sights are the same however orders are packed, and no text is counted twice for one model."""

from decimal import Decimal

from lexivane.functions import text
from lexivane.operators import vocab
from lexivane.plans import views, vocabulary
from pyspark.sql import functions as F

ORDERS = [-5, -1, 0, 7, (1 << 32) - 1, 1 << 32, (1 << 63) - 1, -(1 << 63), None]


def test_first_sight_of_any_order(spark):
    rows = [(o, f"a{i} b a{i} c{i % 3}") for i, o in enumerate(ORDERS)] + [(9, None), (9, "z  zz z")]
    texts = spark.createDataFrame(rows, "ord bigint, text string")
    wide = texts.withColumn("ord", F.col("ord").cast("decimal(20,0)"))
    got, want = ({r["token"]: (r["n"], r["first"]) for r in vocab.word_counts(t).collect()} for t in (texts, wide))
    assert got == want
    assert got["b"] == (9, Decimal(-(1 << 94) + 1)) and got["zz"] == (1, Decimal((9 << 31) + 1))
    plain = vocab.word_counts(texts.filter("ord between 0 and 100"))._jdf.queryExecution().executedPlan().toString()
    assert "shiftleft" in plain


def test_strip_of_ends(spark):
    texts = ["", " ", "a", " a", "a ", "\x1c a b \n", " ", "a b", "😀 ", " 😀", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == [None if t is None else t.strip("\x1c\x1d\x1e\x1f \t\n\r\f\v  ") for t in texts]


def test_weighted_vectors_count_the_vocabulary_once(spark, tmp_path, monkeypatch):
    made, vocabulary_of = [], views.vocabulary
    monkeypatch.setattr(views, "vocabulary", lambda *a, **k: made.append(a) or vocabulary_of(*a, **k))
    spark.createDataFrame([(1, "en", "s", "a b"), (2, "en", "s", "b c")], "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vocabulary.weighted_vectors(spark, str(tmp_path)).count() == 6
    assert len(made) == 1
