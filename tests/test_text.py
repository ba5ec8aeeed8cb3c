import pytest
from pyspark.sql import functions as F

from lexivane import config
from lexivane.functions import text, vectors


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("s"))).collect()]


# The tokens every removal rule must and must not match.
UPPER = (["kfaK", "KKK", "Mkjl", "ĠkfaK"], ["Ġkfa", "kkk", "æ"])
EXOTIC = (
    ["hello!", "test@email", "café™", "Ġhello!", "Ġtest@email", "#unlikelytoken___", "#en"],
    ["<|end_of_text|>", "Ġhello", "hello", "hello world", "hello123", "æøå"],
)
UNCOMMON = (
    "11 090 4200 999999 ĠĠ4200 ĠĠhello ĠĠĠtest .pdf .txt .config test123 a11 hello123world Ġ4200 Ġ1test2 Ġ123".split(),
    "1 9 Ġ4 Ġhello hello pdf test".split(),
)


@pytest.mark.parametrize(
    "switches,cases",
    [
        ({}, (["[unused12]"], ["unused", "[unused]"])),
        ({"strip_upper_case": True}, UPPER),
        ({"strip_upper_case": True, "strip_exotic": True}, EXOTIC),
        ({"strip_upper_case": True, "strip_exotic": True, "strip_uncommon": True}, UNCOMMON),
    ],
)
def test_removal_rules(spark, switches, cases):
    pattern = text.removal_pattern(**switches)
    match, other = cases
    assert all(column(spark, match, lambda c: text.is_removed(c, pattern)))
    assert not any(column(spark, other, lambda c: text.is_removed(c, pattern)))


def test_removal_is_anchored_at_the_start(spark):
    pattern = text.removal_pattern()
    assert column(spark, ["x[unused1]", "[unused1]x"], lambda c: text.is_removed(c, pattern)) == [False, True]


def test_validation():
    pattern = text.removal_pattern(strip_upper_case=True)
    assert text.validate_parameters(False, 1e-3, pattern) == (None, pattern)
    assert text.validate_parameters(True, None, None) == (1e-4, None)
    assert text.validate_parameters(None, 1e-3, None) == (1e-3, None)
    for bad in (0.0, 1.0, -1.0):
        with pytest.raises(ValueError):
            text.validate_parameters(None, bad, None)
    with pytest.raises(ValueError):
        text.validate_parameters(None, None, "(")


def test_words_keep_accents(spark):
    assert column(spark, ["Blåbær og ÉTÉ_2, x-y", None], text.words) == [["blåbær", "og", "été_2", "x", "y"], None]


def test_normalisers_run_in_order(spark):
    steps = text.compose(text.lower_case, None, text.remove_accents, text.prepend_instruction("Søg"))
    assert column(spark, ["ÁCCENT Ærlig å"], steps) == ["Søg accent ærlig å"]


def test_strip_and_blank(spark):
    values = ["   a b\n", "\t ", "", None, "\x1c"]
    assert column(spark, values, text.strip) == ["a b", "", "", None, ""]
    assert column(spark, values, text.not_blank) == [True, False, False, False, False]


def test_instruction_format(spark):
    df = spark.createDataFrame([("test text", "query"), ("another text", "positive")], "d string, c string")
    given = [r[0] for r in df.select(text.add_instruction(F.col("c"), F.col("d"), f" {config.DANISH_INSTRUCTION} ")).collect()]
    assert given == [f"{config.DANISH_INSTRUCTION} !@#$%^&*()test text", "!@#$%^&*()another text"]
    none = [r[0] for r in df.select(text.add_instruction(F.col("c"), F.col("d"), "")).collect()]
    assert none == ["!@#$%^&*()test text", "!@#$%^&*()another text"]
    pairs = [tuple(r[0]) for r in df.select(text.encoding_pair(F.col("c"), F.col("d"), "Find")).collect()]
    assert pairs == [("Find", "test text"), ("", "another text")]


def test_prompts(spark):
    body = f"Instruct: {config.EMBED_INSTRUCTION}\nQuery: q"
    assert column(spark, ["q"], text.detailed_instruct) == [f"'{body}'"]
    assert column(spark, ["q"], lambda c: text.detailed_instruct(c, quoted=False)) == [body]
    assert column(spark, ["q"], text.danish_detailed_instruct) == [f"{config.DANISH_INSTRUCTION} q"]


def test_length_and_label(spark):
    df = spark.createDataFrame([(1000,), (400,), (3,)], "n int")
    fits = [r[0] for r in df.select(text.fits_length(F.col("n"), 800, 400)).collect()]
    assert fits == [False, True, True]
    # Truncation hides the excess when it cuts at or below the limit.
    assert [r[0] for r in df.select(text.fits_length(F.col("n"), 400, 400)).collect()] == [True, True, True]
    assert column(spark, ["a" * 30, "a" * 31], text.legend_label) == ["a" * 30, "a" * 30 + "..."]


def test_token_input(spark):
    rows = [(".", True, "."), ("ODD", True, "[UNK]"), ("[UNK]", True, "[UNK]"), ("new", False, "[UNK]")]
    df = spark.createDataFrame(rows, "t string, internal boolean, r string")
    flags = df.select(text.resolved_to_unknown(F.col("internal"), F.col("t"), F.col("r"))).collect()
    assert [r[0] for r in flags] == [False, True, False, False]
    pairs = df.select(text.token_input(F.col("t"), "Here")).collect()
    assert [len(r[0]) for r in pairs] == [2, 2, 2, 2]


def test_run_label(spark):
    df = spark.createDataFrame(
        [("256", 150000, 0.001, False), ("None", 200000, 0.005, True)],
        "output_dim string, vocab_size int, sif_coefficient double, focus_pca boolean",
    )
    names = [r[0] for r in df.select(text.run_label(F.col("output_dim"), df.columns)).collect()]
    assert names == ["dim256", "dimNone_vocab200000_sif0.005_focus_pca"]


def test_vector_functions(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [nan, -inf]), ([1.0, 0.0], [1.0, 1.0], [nan, nan])], "a array<double>, b array<double>, c array<double>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = df.select(
        vectors.dot(a, b), vectors.l2_norm(a), vectors.euclidean(a, b), vectors.cosine(a, b),
        vectors.unit(a), vectors.unit(b), vectors.scale(a, F.lit(2.0)), vectors.repair_nan(c, 9.0), vectors.all_nan(c),
    ).collect()
    assert got[0][:4] == (0.0, 5.0, 5.0, None)
    assert got[0][4] == pytest.approx([0.6, 0.8]) and got[0][5] == [0.0, 0.0]
    assert got[0][6] == [6.0, 8.0] and got[0][7] == [0.0, -9.0] and got[0][8] is False
    assert got[1][3] == pytest.approx(0.5**0.5) and got[1][8] is True
