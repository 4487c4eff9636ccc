"""Search-condition files: decoded, validated row by row, duplicates reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.text import jp_boolean, keyword_list, positive_int
from firmlens.sources.csv_files import CsvFiles, read_csv_files

# Column headers and messages of a condition file.
PREFECTURE, MUNICIPALITY, INDUSTRY = "都道府県", "市区町村", "検索業種"
MAX_RESULTS, ENABLED = "最大取得件数", "有効"
MAX_CANDIDATES, COUNT_NO_PHONE = "最大候補処理件数", "電話番号なしを件数に含める"
MORE_KEYWORDS, LESS_KEYWORDS, NOTE = "検索キーワード追加", "除外キーワード", "備考"
REQUIRED = (PREFECTURE, MUNICIPALITY, INDUSTRY, MAX_RESULTS, ENABLED)
BAD_ENCODING = "UTF-8またはCP932として読めません"
MISSING_COLUMNS = "必須列がありません: "
BAD_NUMBER = "は正の整数で指定してください"
BAD_BOOLEAN = "の真偽値が不正です: "
DUPLICATE = "重複した検索条件です"
EMPTY_FIELDS = {
    PREFECTURE: "prefecture must not be empty",
    MUNICIPALITY: "municipality must not be empty",
    INDUSTRY: "industry must not be empty",
}
SHOWN_ISSUES = 20

class FileIssues(ValueError):
    """A strict read met issues: the message has their count and the first ones, ``issues`` is the whole table."""

    def __init__(self, issues: DataFrame, label: str = "row %d: %s") -> None:
        self.issues = issues
        first = issues.orderBy("path", "row_number").limit(SHOWN_ISSUES).collect()
        shown = "; ".join(label % (row.row_number, row.message) for row in first)
        super().__init__(f"{shown} ({issues.count()} issues)")


class ConditionFileError(FileIssues):
    """A strict read of condition files met at least one issue."""


def _cell(name: str) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(name)), F.lit(""))


def _row_message() -> Column:
    """First complaint about a row, NULL for a valid one."""

    def number_bad(name: str) -> Column:
        return positive_int(_cell(name)).isNull()

    def boolean_message(name: str) -> Column:
        return F.concat(F.lit(f"{name}{BAD_BOOLEAN}"), _cell(name))

    message = F.when(number_bad(MAX_RESULTS), f"{MAX_RESULTS}{BAD_NUMBER}").when(
        jp_boolean(_cell(ENABLED)).isNull(), boolean_message(ENABLED)
    )
    for name, text in EMPTY_FIELDS.items():
        message = message.when(_cell(name) == "", text)
    message = message.when(
        (_cell(MAX_CANDIDATES) != "") & number_bad(MAX_CANDIDATES), f"{MAX_CANDIDATES}{BAD_NUMBER}"
    )
    return message.when(
        (_cell(COUNT_NO_PHONE) != "") & jp_boolean(_cell(COUNT_NO_PHONE)).isNull(),
        boolean_message(COUNT_NO_PHONE),
    )


def split_conditions(files: CsvFiles) -> tuple[DataFrame, DataFrame]:
    """Valid conditions and row-numbered issues of read files.

    A repeated (prefecture, municipality, industry) is an issue; the first valid row wins. The first
    row per key comes from an aggregate, so a key repeated without end is not gathered anywhere.
    """
    key = "path"
    missing = F.array_except(F.array(*[F.lit(name) for name in REQUIRED]), F.col("columns"))
    checked = files.headers.select(
        "*",
        F.when(F.col("encoding").isNull(), F.struct(F.lit(0).alias("row_number"), F.lit(BAD_ENCODING).alias("message")))
        .when(
            F.size(missing) > 0,
            F.struct(
                F.lit(1).alias("row_number"),
                F.concat(F.lit(MISSING_COLUMNS), F.array_join(missing, ", ")).alias("message"),
            ),
        )
        .alias("file_issue"),
    )
    broken = checked.filter(F.col("file_issue").isNotNull()).select(key, "file_issue.*")
    rows = files.rows(checked.filter(F.col("file_issue").isNull())).withColumn("message", _row_message())
    fields = {
        "prefecture": _cell(PREFECTURE),
        "municipality": _cell(MUNICIPALITY),
        "industry": _cell(INDUSTRY),
        "max_results": positive_int(_cell(MAX_RESULTS)),
        "enabled": jp_boolean(_cell(ENABLED)),
        "max_candidates": positive_int(_cell(MAX_CANDIDATES)),
        "count_no_phone_as_target": jp_boolean(_cell(COUNT_NO_PHONE)),
        "additional_keywords": keyword_list(_cell(MORE_KEYWORDS)),
        "excluded_keywords": keyword_list(_cell(LESS_KEYWORDS)),
        "note": _cell(NOTE),
    }
    typed = rows.filter(F.col("message").isNull()).select(
        key, "encoding", "row_number", *[value.alias(name) for name, value in fields.items()]
    )
    identity = [key, "prefecture", "municipality", "industry"]
    firsts = typed.groupBy(*identity).agg(F.min("row_number").alias("_first"))
    compared = typed.join(firsts, identity)
    valid = compared.filter(F.col("row_number") == F.col("_first")).select(*typed.columns)
    repeated = compared.filter(F.col("row_number") > F.col("_first")).select(
        key, "row_number", F.lit(DUPLICATE).alias("message")
    )
    wrong = rows.filter(F.col("message").isNotNull()).select(key, "row_number", "message")
    return valid, broken.unionByName(wrong).unionByName(repeated)


def read_conditions(
    spark: SparkSession, path: str, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Conditions and issues of one or more CSV files; a strict read refuses any issue."""
    valid, issues = split_conditions(read_csv_files(spark, path))
    if strict:
        if not issues.isEmpty():
            raise ConditionFileError(issues)
    return valid, issues


def enabled_conditions(conditions: DataFrame) -> DataFrame:
    return conditions.filter("enabled")
