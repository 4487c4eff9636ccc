"""Page type from URL, title, description, heading and body words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.text import mentions
from firmlens.functions.urls import path_of
from firmlens.operators.pages import page_text

# Type rules, in the order they are tested. The evidence is lower case, so plain word
# searches give the case-insensitive result.
HARMFUL_RULES = (
    ("portal", ("ポータル", "ランキング", "まとめ", "比較サイト"), r"(?d)おすすめ.*一覧"),
    ("job", ("求人", "採用情報", "recruit", "/job"), None),
    ("directory", ("電話帳", "企業一覧", "店舗一覧", "directory"), None),
    ("article", ("/article", "/blog", "ニュース", "コラム", "記事"), None),
)
PATH_RULES = (
    ("contact", r"/contact(?:/|$)"),
    ("access", r"/access(?:/|$)"),
    ("company", r"/(?:company|about)(?:/|$)"),
    ("store", r"/(?:stores?|shop)(?:/|$)"),
)
HOME_PATHS = ("", "/", "/index.html", "/index.htm")
CONTENT_RULES = (
    ("contact", ("お問い合わせ", "問合せ"), None),
    ("access", ("アクセス", "交通案内"), None),
    ("company", ("会社概要", "法人概要"), None),
    ("store", ("店舗情報",), r"(?U)\w+店"),
)
PAGE_TYPE_FEATURES = ("title", "h1", "description", "tokens")


def with_page_type(df: DataFrame, url: str = "url", body_chars: int | None = None) -> DataFrame:
    """Add page_type, the first matching rule; needs the parsed feature columns.

    The whole body counts as evidence; ``body_chars`` narrows it to its first characters where a user asks for that.
    """
    blank = F.lit("")
    path = F.lower(path_of(F.col(url)))
    title, h1 = F.coalesce("title", blank), F.coalesce("h1", blank)
    description = F.coalesce("description", blank)
    body = page_text() if body_chars is None else F.left(page_text(), F.lit(body_chars))
    # The evidence texts are columns of their own, so each is built once and not once per rule.
    prepared = df.withColumns(
        {
            "_path": path,
            "_evidence": F.lower(F.concat_ws(" ", path, title, description, h1, body)),
            "_primary": F.concat_ws(" ", title, description, h1),
        }
    )
    result = None
    for name, words, pattern in HARMFUL_RULES:
        hit = mentions(F.col("_evidence"), words, pattern)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    for name, pattern in PATH_RULES:
        result = result.when(F.col("_path").rlike(pattern), name)
    result = result.when(F.col("_path").isin(*HOME_PATHS), "official_home")
    for name, words, pattern in CONTENT_RULES:
        result = result.when(mentions(F.col("_primary"), words, pattern), name)
    typed = prepared.withColumn("page_type", result.otherwise("unknown"))
    return typed.drop("_path", "_evidence", "_primary")
