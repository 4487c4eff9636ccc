"""Company name, address, phones and industry from parsed pages, each with the source that won."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.text import (
    blank_to_null,
    contains_any,
    count_literal,
    let,
    lookup,
    py_strip,
)
from firmlens.operators.pages import HEADING_TAGS, page_text, span_text

# Patterns, word lists and lookup tables of the extraction rules.
LEGAL_NAME = (
    r"(?U)(?:株式会社|有限会社|合同会社|医療法人(?:社団|財団)?|学校法人|社会福祉法人)"
    r"[\w\u3000-\u30ff\u3400-\u9fff・ー]{1,40}"
)
GENERIC_NAMES = ("アクセス", "会社概要", "お問い合わせ", "店舗情報", "ホーム")
COMPANY_HEADING = r"会社概要|法人概要|運営会社|店舗情報"
COPYRIGHT_MARKERS = ("©", "Copyright", "copyright")
TITLE_SEPARATOR = r"(?U)\s*[|｜]\s*"
STORE_TYPES = ("LocalBusiness", "HairSalon", "MedicalBusiness", "Restaurant")
POSTAL = r"(?U)(?:〒\s*)?(\d{3})[-ー−]?\s*(\d{4})"
ADDRESS = (
    r"(?U)(北海道|東京都|(?:京都|大阪)府|[^\n]{2,3}県)"
    r"([^\s,、。]{1,12}?[市区町村])"
    r"([^\s,、。<>]{1,60})"
)
PREFECTURE_WORDS = ("北海道", "東京都", "京都府", "大阪府", "県")
NARRATIVE_SIGNALS = ("。", "です", "ます", "属する", "周囲")
LOCATION_DETAIL = r"(?U)(?:\d|[一二三四五六七八九十]+丁目|番地|番\b|号)"
ADDRESS_SECTIONS = (("company", "company|会社概要|法人概要"), ("access", "access|アクセス"))
_GAP = r"[-ー‐−\s\p{Z}]?"
PHONE = (
    rf"(?<!\p{{Nd}})(0(?:[789]0|\p{{Nd}}{{1,4}})){_GAP}"
    rf"(\p{{Nd}}{{1,4}}){_GAP}(\p{{Nd}}{{4}})(?!\p{{Nd}})"
)
FAX_WORDS = ("FAX", "ファックス", "ファクス")
FAX = r"(?U)(?:FAX|ファックス|ファクス)\s*[:：]?\s*$"
MOBILE_PREFIXES = ("070", "080", "090")
USAGE_RULES = (
    ("reservation", ("予約",)),
    ("recruiting", ("採用", "求人")),
    ("emergency", ("緊急", "夜間")),
    ("contact", ("問い合わせ", "問合せ", "連絡")),
    ("main", ("代表", "本社", "TEL", "電話")),
)
WEAK_USAGES = ("unknown", "main")
TYPE_INDUSTRIES = {"HairSalon": "美容業", "MedicalBusiness": "医療", "Restaurant": "飲食店"}
EVIDENCE_KEYWORDS = {
    "飲食店": ("レストラン", "飲食店", "居酒屋", "食堂"),
    "美容業": ("美容室", "理容室", "ヘアサロン", "エステ"),
    "医療": ("クリニック", "医院", "病院", "診療"),
}
ARTICLE_SIGNALS = ("観光", "旅行", "ニュース", "ランキング", "まとめ", "記事")
BUSINESS_SECTION = "会社概要|店舗情報|サービス|事業内容|service|company"

FAX_CHARS, USAGE_CHARS = 15, 25
# A number with the text before and after its start: the look-behind takes 25 characters, or what there
# is from the start of the line.
_BEFORE = rf"(?<=(^.{{0,{USAGE_CHARS - 1}}}|.{{{USAGE_CHARS}}}))"
_PHONE_IN_CONTEXT = rf"(?s)(?=0){_BEFORE}(?=(.{{0,{USAGE_CHARS}}})){PHONE}"
_MARK, _FIELD = "\x01", "\x02"


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _first_value(items: Column) -> Column:
    return _first(F.filter(items, lambda item: item.isNotNull()))


def _valued(value: Column, source: str) -> Column:
    return let(
        value,
        lambda found: F.when(
            found.isNotNull(), F.struct(found.alias("value"), F.lit(source).alias("source"))
        ),
    )


def _is_generic(text: Column) -> Column:
    return py_strip(text).isin(*GENERIC_NAMES)


def _specific(text: Column) -> Column:
    """The text unless it is empty or a generic page label."""
    return F.when((text != "") & ~_is_generic(text), text)


def legal_name(text: Column) -> Column:
    """First legal company name in a text, NULL when there is none."""
    return blank_to_null(F.regexp_extract(text, LEGAL_NAME, 0))


def title_head(title: Column) -> Column:
    """Title up to the first bar."""
    return F.nullif(F.get(F.split(title, TITLE_SEPARATOR, 2), F.lit(0)), F.lit(""))


def first_footer_text() -> Column:
    footers = F.filter("sections", lambda item: item["tag"] == "footer")
    return F.get(F.transform(footers, lambda item: span_text(item["lo"], item["hi"])), F.lit(0))


def footer_and_small_text() -> Column:
    """All footer and small-print texts."""
    kept = F.filter("sections", lambda item: item["tag"].isin("footer", "small"))
    return F.array_join(F.transform(kept, lambda item: span_text(item["lo"], item["hi"])), " ")


def _company_section(text: Column) -> Column:
    """Legal name, or the element after a company-name label, in the first telling section."""

    def telling(item: Column) -> Column:
        heading = item["tag"].isin(*sorted(HEADING_TAGS))
        return heading & span_text(item["lo"], item["hi"]).rlike(COMPANY_HEADING)

    def named(item: Column) -> Column:
        lo = F.when(item["has_box"], item["box_lo"]).otherwise(item["parent_lo"])
        hi = F.when(item["has_box"], item["box_hi"]).otherwise(item["parent_hi"])
        label = _first(F.filter("labels", lambda mark: (mark["at"] >= lo) & (mark["at"] < hi)))
        return F.coalesce(
            legal_name(span_text(lo, hi)), _specific(span_text(label["lo"], label["hi"]))
        )

    return _first_value(F.transform(F.filter("sections", telling), named))


def _copyright(text: Column) -> Column:
    """Legal name anywhere after the first copyright marker that occurs."""
    result = None
    for marker in COPYRIGHT_MARKERS:
        after = F.substring(text, F.instr(text, marker) + len(marker), F.length(text))
        found = F.contains(text, F.lit(marker))
        if result is None:
            result = F.when(found, legal_name(after))
        else:
            result = result.when(found, legal_name(after))
    return result


def _schema_legal_name() -> Column:
    def candidate(item: Column) -> Column:
        legal = blank_to_null(F.try_element_at(item["props"], F.lit("legalName")))
        name = blank_to_null(F.try_element_at(item["props"], F.lit("name")))
        organization = F.array_contains(item["types"], "Organization")
        return _specific(F.coalesce(legal, F.when(organization, name)))

    return _first_value(F.transform("microdata", candidate))


def company_name() -> Column:
    """Legal company name by source priority."""
    text = F.col("_text")
    footer = F.substring_index(first_footer_text(), COPYRIGHT_MARKERS[0], 1)
    return F.coalesce(
        _valued(
            _first_value(F.transform("jsonld", lambda item: item["legal_name"])),
            "jsonld_legal_name",
        ),
        _valued(_schema_legal_name(), "schema"),
        _valued(_company_section(text), "company"),
        _valued(_first_value(F.transform("jsonld", lambda item: item["name"])), "jsonld"),
        _valued(_copyright(text), "copyright"),
        _valued(legal_name(footer), "footer"),
        _valued(F.col("og_site_name"), "ogp"),
        _valued(title_head(_specific(F.col("title"))), "title"),
        _valued(_specific(F.col("h1")), "h1"),
    )


def _first_store() -> Column:
    stores = F.array(*[F.lit(name) for name in STORE_TYPES])
    return _first(F.filter("jsonld", lambda item: F.arrays_overlap(item["types"], stores)))


def store_name() -> Column:
    """Name of the first store-like entity, else the first specific microdata name."""
    named = F.transform(
        "microdata",
        lambda item: _specific(blank_to_null(F.try_element_at(item["props"], F.lit("name")))),
    )
    return F.coalesce(
        _valued(_specific(_first_store()["name"]), "jsonld"), _valued(_first_value(named), "schema")
    )


def display_name() -> Column:
    """Alternate name of the first store-like entity, else the store name."""
    return F.coalesce(
        _valued(_specific(_first_store()["alternate_name"]), "jsonld"), F.col("store_name")
    )


def postal_code(text: Column) -> Column:
    """Postal code as ddd-dddd, NULL when there is none."""

    def hyphenated(found: Column) -> Column:
        parts = [F.regexp_extract(found, POSTAL, group) for group in (1, 2)]
        return F.when(found != "", F.concat_ws("-", *parts))

    return let(F.regexp_extract(text, POSTAL, 0), hyphenated)


def address_in_text(text: Column, source: Column) -> Column:
    """Address struct found in free text; prose and vague footer or body mentions are rejected."""

    def describe(found: Column) -> Column:
        postal = postal_code(text)
        vague = source.isin("body", "footer") & ~found.rlike(LOCATION_DETAIL) & postal.isNull()
        return F.when(
            (found != "") & ~contains_any(found, NARRATIVE_SIGNALS) & ~vague,
            F.struct(
                py_strip(found).alias("address"),
                postal.alias("postal_code"),
                F.regexp_extract(found, ADDRESS, 1).alias("prefecture"),
                F.regexp_extract(found, ADDRESS, 2).alias("municipality"),
                source.alias("source"),
            ),
        )

    # A plain search for a prefecture word skips the costly pattern on pages without any.
    likely = contains_any(text, PREFECTURE_WORDS)
    return let(F.when(likely, F.regexp_extract(text, ADDRESS, 0)), describe)


def _structured_address(item: Column) -> Column:
    joined = F.concat_ws("", item["region"], item["locality"], item["street"])
    fields = F.struct(
        joined.alias("address"),
        postal_code(item["postal_code"]).alias("postal_code"),
        item["region"].alias("prefecture"),
        item["locality"].alias("municipality"),
        F.lit("jsonld").alias("source"),
    )
    return F.when(
        item["address_text"].isNotNull(), address_in_text(item["address_text"], F.lit("jsonld"))
    ).when(joined != "", fields)


def _section_text(pattern: str, heading_alone: bool) -> Column:
    """Text of the first section whose id, else class, else heading matches the pattern."""
    regex = f"(?iu){pattern}"
    outer_lo, outer_hi = ("lo", "hi") if heading_alone else ("parent_lo", "parent_hi")

    def span(lo: Column, hi: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    def first_where(field: str) -> Column:
        found = F.filter("sections", lambda item: item[field].rlike(regex))
        return _first(F.transform(found, lambda item: span(item["lo"], item["hi"])))

    headings = F.filter("sections", lambda item: item["sole"].rlike(regex))
    around = F.transform(
        headings,
        lambda item: F.when(item["has_box"], span(item["box_lo"], item["box_hi"])).otherwise(
            span(item[outer_lo], item[outer_hi])
        ),
    )
    chosen = F.coalesce(first_where("id"), first_where("css"), _first(around))
    return let(chosen, lambda found: F.when(found.isNotNull(), span_text(found["lo"], found["hi"])))


def _place(text: Column, source: str) -> Column:
    return F.struct(text.alias("text"), F.lit(source).alias("source"))


def address() -> Column:
    """Best address by source priority; a source without a usable address falls through."""
    places = F.array(
        *[
            _place(_section_text(pattern, heading_alone=False), source)
            for source, pattern in ADDRESS_SECTIONS
        ],
        _place(first_footer_text(), "footer"),
        _place(F.col("_text"), "body"),
    )
    structured = _first_value(F.transform("jsonld", _structured_address))
    return F.aggregate(
        places,
        structured,
        lambda best, place: F.coalesce(best, address_in_text(place["text"], place["source"])),
    )


def phone_usage(context: Column) -> Column:
    """Purpose of a number by the words around it."""

    def rules(text: Column) -> Column:
        result = None
        for name, words in USAGE_RULES:
            hit = contains_any(text, words)
            result = F.when(hit, name) if result is None else result.when(hit, name)
        return result.otherwise("unknown")

    return let(F.upper(context), rules)


def phone_kind(number: Column) -> Column:
    prefix = F.substring_index(number, "-", 1)
    return F.when(prefix.isin(*MOBILE_PREFIXES), "mobile").otherwise("fixed")


def phone_number(match: Column) -> Column:
    """Groups of one matched number joined by hyphens."""
    return F.regexp_replace(match, PHONE, "$1-$2-$3")


def _is_fax(before: Column) -> Column:
    near = F.upper(F.right(before, F.lit(FAX_CHARS)))
    return contains_any(near, FAX_WORDS) & near.rlike(FAX)


def line_phones(line: Column) -> Column:
    """Numbers of one text line with their usage; FAX numbers are left out.

    One pattern pass marks every number together with the text around it.
    """
    plain = F.translate(line, _MARK + _FIELD, "")
    marked = F.regexp_replace(
        plain, _PHONE_IN_CONTEXT, f"{_MARK}$3-$4-$5{_FIELD}$1{_FIELD}$2{_MARK}"
    )
    found = F.filter(F.split(marked, _MARK, -1), lambda piece: F.contains(piece, F.lit(_FIELD)))
    split = F.transform(found, lambda piece: F.split(piece, _FIELD, -1))
    kept = F.filter(split, lambda piece: ~_is_fax(piece[1]))
    return F.transform(
        kept,
        lambda piece: F.struct(
            piece[0].alias("number"),
            phone_kind(piece[0]).alias("kind"),
            phone_usage(F.concat(piece[1], piece[2])).alias("usage"),
        ),
    )


def _structured_phones(texts: Column, usage: Column, source: str) -> Column:
    """First number of each text."""
    matches = F.filter(
        F.transform(texts, lambda text: F.regexp_extract(text, PHONE, 0)),
        lambda match: match != "",
    )
    return F.transform(
        F.transform(matches, phone_number),
        lambda number: F.struct(
            number.alias("number"), phone_kind(number).alias("kind"), usage.alias("usage"),
            F.lit(source).alias("source"),
        ),
    )


def phone_candidates() -> Column:
    """All numbers of a page in discovery order: JSON-LD, microdata, then text lines."""

    def of_entity(item: Column) -> Column:
        points = F.transform(
            item["contacts"],
            lambda point: _structured_phones(
                point["telephones"],
                phone_usage(F.right(point["kind"], F.lit(USAGE_CHARS))),
                "jsonld",
            ),
        )
        return F.concat(
            _structured_phones(item["telephones"], F.lit("main"), "jsonld"), F.flatten(points)
        )

    schema_texts = F.filter(
        F.transform("microdata", lambda item: F.try_element_at(item["props"], F.lit("telephone"))),
        lambda text: text.isNotNull(),
    )
    body = F.transform(
        F.flatten(F.transform("digit_lines", line_phones)),
        lambda phone: F.struct(
            phone["number"].alias("number"),
            phone["kind"].alias("kind"),
            phone["usage"].alias("usage"),
            F.lit("body").alias("source"),
        ),
    )
    return F.concat(
        F.flatten(F.transform("jsonld", of_entity)),
        _structured_phones(schema_texts, F.lit("main"), "schema"),
        body,
    )


def _weak(usage: Column) -> Column:
    return F.when(usage.isin(*WEAK_USAGES), 1).otherwise(0)


def with_phones(df: DataFrame, candidates: str, name: str = "phones") -> DataFrame:
    """One winner per number: a specific usage beats a weak one, then the earlier candidate; mobiles first."""
    ranked = F.transform(
        F.col(candidates),
        lambda phone, at: F.struct(
            phone["number"].alias("number"), _weak(phone["usage"]).alias("weak"), at.alias("at"),
            phone["kind"].alias("kind"), phone["usage"].alias("usage"),
            phone["source"].alias("source"),
        ),
    )
    ordered = df.withColumn("_ranked", F.array_sort(ranked))
    winners = F.filter(
        "_ranked",
        lambda phone, at: (at == 0)
        | (phone["number"] != F.get(F.col("_ranked"), at - 1)["number"]),
    )
    sorted_winners = F.array_sort(
        F.transform(
            winners,
            lambda phone: F.struct(
                F.when(phone["kind"] == "mobile", 0).otherwise(1).alias("fixed"),
                phone["at"].alias("at"), phone["number"].alias("number"),
                phone["kind"].alias("kind"), phone["usage"].alias("usage"),
                phone["source"].alias("source"),
            ),
        )
    )
    plain = F.transform(
        sorted_winners,
        lambda phone: F.struct(
            phone["number"].alias("number"), phone["kind"].alias("kind"),
            phone["usage"].alias("usage"), phone["source"].alias("source"),
        ),
    )
    return ordered.withColumn(name, plain).drop("_ranked")


def keyword_industry(
    text: Column, minimum: Column | int, keywords: Mapping[str, Sequence[str]] | None = None
) -> Column:
    """Industry with the most keyword occurrences, the earlier one on ties, NULL below the minimum."""
    table = EVIDENCE_KEYWORDS if keywords is None else keywords
    scored = []
    for position, (name, words) in enumerate(table.items()):
        total = F.lit(0)
        for word in words:
            total = total + count_literal(text, word)
        # array_max takes the largest struct, so an earlier industry gets the larger second field.
        scored.append(
            F.struct(total.alias("n"), F.lit(-position).alias("order"), F.lit(name).alias("name"))
        )
    best = F.array_max(F.array(*scored))
    return let(best, lambda top: F.when(top["n"] >= minimum, top["name"]))


def industry(keywords: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Industry from structured types, then from keyword evidence of ever weaker places."""

    def typed(item: Column) -> Column:
        return _first_value(F.transform(item["types"], lambda name: lookup(name, TYPE_INDUSTRIES)))

    def place(text: Column, source: str, minimum: int) -> Column:
        return F.struct(
            text.alias("text"), F.lit(source).alias("source"), F.lit(minimum).alias("minimum")
        )

    def weaker(best: Column, at: Column) -> Column:
        value = keyword_industry(at["text"], at["minimum"], keywords)
        valued = let(
            value,
            lambda found: F.when(
                found.isNotNull(), F.struct(found.alias("value"), at["source"].alias("source"))
            ),
        )
        return F.coalesce(best, valued)

    heading_text = F.concat_ws(" ", "title", "h1")
    body = F.when(~contains_any(heading_text, ARTICLE_SIGNALS), F.col("_text"))
    places = F.array(
        place(F.col("title"), "title", 1),
        place(F.col("h1"), "h1", 1),
        place(_section_text(BUSINESS_SECTION, heading_alone=True), "business_section", 1),
        place(body, "body", 2),
    )
    structured = F.coalesce(
        _valued(_first_value(F.transform("jsonld", typed)), "jsonld"),
        _valued(_first_value(F.transform("microdata", typed)), "schema"),
    )
    return F.aggregate(places, structured, weaker)


def extract_companies(
    features: DataFrame, keywords: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Add company_name, store_name, display_name, address, phones and industry to parsed pages."""
    texted = features.withColumn("_text", page_text())
    named = texted.withColumns({"company_name": company_name(), "store_name": store_name()})
    full = named.withColumns(
        {
            "display_name": display_name(),
            "address": address(),
            "industry": industry(keywords),
            "_candidates": phone_candidates(),
        }
    )
    return with_phones(full, "_candidates").drop("_candidates", "_text")


def company_rows(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    return extracted.select(
        key,
        F.col("company_name.value").alias("company_name"),
        F.col("store_name.value").alias("store_name"),
        F.col("display_name.value").alias("display_name"),
        F.col("industry.value").alias("industry"),
    )


def phone_rows(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page and number, in display order."""
    return extracted.select(key, F.posexplode("phones").alias("pos", "phone")).select(
        key, "pos", "phone.*"
    )


def address_rows(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    return extracted.filter(F.col("address").isNotNull()).select(key, "address.*")
