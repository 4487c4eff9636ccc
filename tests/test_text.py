import unicodedata

from pyspark.sql import functions as F

from firmlens.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers_and_booleans(spark):
    rows = spark.createDataFrame(
        [("５", "はい"), (" 12 ", "ＮＯ"), ("0", "対象外"), ("-3", "?"), ("1.5", ""), ("+7", "1")], "n string, b string"
    )
    got = rows.select(text.positive_int(F.col("n")), text.jp_boolean(F.col("b"))).collect()
    assert [tuple(row) for row in got] == [
        (5, True), (12, False), (None, False), (None, None), (None, None), (7, True)
    ]


def test_numbers_in_any_script(spark):
    chars = [chr(code) for code in range(1, 0x20000) if not 0xD800 <= code < 0xE000]
    given = [char for char in chars if unicodedata.normalize("NFKC", char).isdecimal()]
    rows = spark.createDataFrame([(char,) for char in given], "n string")
    got = {row.n: row.v for row in rows.select("n", text.positive_int(F.col("n")).alias("v")).collect()}
    expected = {char: int(unicodedata.normalize("NFKC", char)) for char in given}
    assert got == {char: value or None for char, value in expected.items()}
    assert one(spark, text.jp_boolean(F.lit("𝐓ｒⓤⅇ"))) is True


def test_json_list(spark):
    rows = spark.createDataFrame(
        [(None,), ("",), ('["a", 1]',), ('"x"',), ("5",), ("broken [",), ("[]",)], "j string"
    )
    got = [row[0] for row in rows.select(text.json_list(F.col("j"))).collect()]
    assert got == [[], [], ["a", "1"], ["x"], ["5"], ["broken ["], []]


def test_scores_round_half_to_even(spark):
    rows = spark.createDataFrame([(87.5,), (88.5,), (-3.0,), (100.6,)], "s double")
    assert [r[0] for r in rows.select(text.bounded_score(F.col("s"))).collect()] == [88, 88, 0, 100]


def test_cells(spark):
    assert one(spark, text.csv_cell(F.lit("=1+1"), "string")) == "'=1+1"
    assert one(spark, text.csv_cell(F.lit(True), "boolean")) == "はい"
    assert one(spark, text.csv_cell(F.lit(None).cast("int"), "int")) == ""
    assert len(one(spark, text.csv_cell(F.repeat(F.lit("x"), 40000), "string"))) == 40000


def test_durations(spark):
    def spent(start, finish):
        return one(spark, text.iso_duration(F.lit(start), F.lit(finish)))

    assert spent("2024-01-01T00:00:00+00:00", "2024-01-01T01:02:03+00:00") == "1:02:03"
    assert spent("2024-01-01T00:00:00", "2024-01-03T00:00:01.500000") == "2 days, 0:00:01.500000"
    assert spent("2024-01-01T00:00:00", "bad") == ""


def test_text_key_drops_every_blank(spark):
    assert one(spark, text.entity_text_key(F.lit("株式会社　A B\tc"))) == "株式会社abc"
