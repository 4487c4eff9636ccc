"""Parse each stored page once; everything later works on these columns with native expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from firmlens.functions.html_tree import HIDDEN, Element, parse_html
from firmlens.functions.urls import hostname

# Supported business types of structured data.
BUSINESS_TYPES = ("Organization", "LocalBusiness", "HairSalon", "MedicalBusiness", "Restaurant")
# Words in ids, classes or headings that can open a section, and company-name labels.
SECTION_WORDS = "company|会社概要|法人概要|access|アクセス|店舗情報|運営会社|サービス|事業内容|service"
LABEL_WORDS = "法人名|会社名|運営会社"
# Attributes that carry an item's value; other elements, and empty attributes, give their text.
VALUE_ATTRIBUTES = {"meta": "content", "a": "href", "link": "href", "img": "src", "source": "src"}
BOX_TAGS = frozenset({"section", "article", "div"})
HEADING_TAGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

_SECTION = re.compile(SECTION_WORDS, re.IGNORECASE)
_LABEL = re.compile(LABEL_WORDS)
_DESCRIPTION = re.compile("description", re.IGNORECASE)
_TEL = re.compile("tel:", re.IGNORECASE)
_SURROGATE = re.compile("[\ud800-\udfff]")

# lo and hi are a half-open range of token positions; parse_error is NULL for a page that was read whole.
FEATURES = """
    parse_error string,
    title string, h1 string, description string, og_site_name string,
    tokens array<string>,
    noscript array<struct<lo:int,hi:int>>,
    sections array<struct<tag:string,id:string,css:string,sole:string,lo:int,hi:int,
                          has_box:boolean,box_lo:int,box_hi:int,parent_lo:int,parent_hi:int>>,
    labels array<struct<at:int,lo:int,hi:int>>,
    links array<string>,
    digit_lines array<string>,
    jsonld array<struct<types:array<string>,name:string,legal_name:string,alternate_name:string,
                        telephones:array<string>,
                        contacts:array<struct<kind:string,telephones:array<string>>>,
                        address_text:string,postal_code:string,region:string,locality:string,
                        street:string>>,
    microdata array<struct<types:array<string>,props:map<string,string>,
                           nested:map<string,map<string,string>>>>
    """

# Feature columns nobody needs once extraction and scoring are done.
PARSED_ONLY = (
    "tokens", "noscript", "sections", "labels", "links", "digit_lines", "jsonld", "microdata"
)


def _sound(text: str) -> str:
    """JSON escapes can spell half a surrogate pair, which no column can hold."""
    return _SURROGATE.sub("\ufffd", text)


def _clean(value: Any) -> str | None:
    return _sound(value).strip() or None if isinstance(value, str) else None


def _strings(value: Any) -> list[str]:
    return [_sound(item) for item in (value if isinstance(value, list) else [value]) if isinstance(item, str)]


def _lay_out(root: Element) -> tuple[list[str], dict[int, Element]]:
    """Number the text pieces in document order and note the range below every element."""
    tokens: list[str] = []
    owners: dict[int, Element] = {}
    stack: list[tuple[Element, Iterator]] = [(root, iter(root.children))]
    holders: list[Element] = []
    hidden = 0
    while stack:
        element, children = stack[-1]
        for child in children:
            if isinstance(child, Element):
                child.start = len(tokens)
                hidden += child.tag in HIDDEN
                stack.append((child, iter(child.children)))
                break
            piece = "" if hidden else child.strip()
            if piece:
                tokens.append(piece)
                holders.append(element)
        else:
            element.end = len(tokens)
            hidden -= element.tag in HIDDEN
            stack.pop()
    for index, (token, holder) in enumerate(zip(tokens, holders)):
        if _LABEL.search(token):
            owners[index] = holder
    return tokens, owners


def _next_element(element: Element) -> Element | None:
    siblings = iter(element.parent.children) if element.parent is not None else iter(())
    for child in siblings:
        if child is element:
            break
    return next((child for child in siblings if isinstance(child, Element)), None)


def _sole_string(element: Element) -> str | None:
    node: Element | str = element
    while isinstance(node, Element):
        if len(node.children) != 1:
            return None
        node = node.children[0]
    return node


def _section(element: Element) -> dict[str, Any]:
    box = element.parent
    while box is not None and box.tag not in BOX_TAGS:
        box = box.parent
    parent = element.parent or element
    return {
        "tag": element.tag,
        "id": element.attrs.get("id", ""),
        "css": element.attrs.get("class", ""),
        "sole": _sole_string(element) if element.tag in HEADING_TAGS else None,
        "lo": element.start,
        "hi": element.end,
        "has_box": box is not None,
        "box_lo": (box or element).start,
        "box_hi": (box or element).end,
        "parent_lo": parent.start,
        "parent_hi": parent.end,
    }


def _flatten(value: Any) -> Iterator[dict]:
    """Objects of a JSON-LD block: lists and @graph lists are opened, at any depth, in order."""
    pending = [value]
    while pending:
        item = pending.pop()
        if isinstance(item, dict) and isinstance(item.get("@graph"), list):
            item = item["@graph"]
        if isinstance(item, list):
            pending.extend(reversed(item))
        elif isinstance(item, dict):
            yield item


def _numbers(value: Any) -> list[str]:
    return [unicodedata.normalize("NFKC", item) for item in _strings(value)]


def _entity(data: dict) -> dict[str, Any]:
    address = data.get("address")
    fields = address if isinstance(address, dict) else {}
    points = data.get("contactPoint")
    points = points if isinstance(points, list) else [points]
    postal = fields.get("postalCode")
    return {
        "types": _strings(data.get("@type")),
        "name": _clean(data.get("name")),
        "legal_name": _clean(data.get("legalName")),
        "alternate_name": _clean(data.get("alternateName")),
        "telephones": _numbers(data.get("telephone")),
        "contacts": [
            {
                "kind": _sound(str(point.get("contactType", ""))),
                "telephones": _numbers(point.get("telephone")),
            }
            for point in points
            if isinstance(point, dict)
        ],
        "address_text": _sound(address) if isinstance(address, str) else None,
        "postal_code": _sound(postal) if isinstance(postal, str) else None,
        "region": _clean(fields.get("addressRegion")),
        "locality": _clean(fields.get("addressLocality")),
        "street": _clean(fields.get("streetAddress")),
    }


def _jsonld(blocks: list[str]) -> list[dict[str, Any]]:
    entities = []
    for block in blocks:
        try:
            value = json.loads(block)
        except (ValueError, RecursionError):
            continue
        entities.extend(_entity(data) for data in _flatten(value) if "@type" in data)
    return entities


def _item_text(element: Element) -> str:
    """Value of an item property that is no item itself."""
    source = VALUE_ATTRIBUTES.get(element.tag, "")
    value = element.attrs.get(source, "") or element.text()
    return (_TEL.sub("", value, count=1) if source == "href" and _TEL.match(value) else value).strip()


def _note_item(element: Element, items: list[dict[str, Any]]) -> None:
    """Enter one element of a walk in document order into the item it lies in, and open the item it starts.

    Outermost items with a type go to ``items``. The last property of a name wins; of a nested item its own texts count.
    """
    attrs, around = element.attrs, element.parent.scope
    element.scope = around
    if "itemscope" in attrs:
        element.scope = {"types": [attrs.get("itemtype", "")], "texts": {}, "items": {}}
        if around is None and "itemtype" in attrs:
            items.append(element.scope)
    if around is None or "itemprop" not in attrs:
        return
    name = attrs["itemprop"]
    around["texts"].pop(name, None)
    around["items"].pop(name, None)
    if element.scope is not around:
        around["items"][name] = element.scope
    else:
        value = _item_text(element)
        around["texts"][name] = unicodedata.normalize("NFKC", value) if name == "telephone" else value


def _item_row(item: dict[str, Any]) -> dict[str, Any]:
    nested = {name: inner["texts"] for name, inner in item["items"].items()}
    return {"types": item["types"], "props": item["texts"], "nested": nested}


def page_record(html: str, with_lines: bool = True) -> dict[str, Any]:
    """All features of one page; the normalised text lines only when asked for."""
    root = parse_html(html)
    tokens, label_owners = _lay_out(root)
    record: dict[str, Any] = {"title": None, "h1": None, "description": None, "og_site_name": None}
    record["parse_error"] = root.attrs.get("parse_error")
    seen_meta: set[str] = set()
    sections, links, noscript, blocks, items = [], [], [], [], []
    for element in root.walk():
        tag, attrs = element.tag, element.attrs
        if tag in ("title", "h1") and record[tag] is None:
            record[tag] = " ".join(tokens[element.start : element.end])
        elif tag == "meta":
            if "description" not in seen_meta and _DESCRIPTION.search(attrs.get("name", "")):
                seen_meta.add("description")
                record["description"] = attrs.get("content", "")
            if "og" not in seen_meta and attrs.get("property") == "og:site_name":
                seen_meta.add("og")
                record["og_site_name"] = _clean(attrs.get("content"))
        elif tag == "a" and attrs.get("href"):
            links.append(attrs["href"])
        elif tag == "noscript":
            noscript.append({"lo": element.start, "hi": element.end})
        elif tag == "script" and attrs.get("type") == "application/ld+json":
            blocks.append(element.raw_text())
        _note_item(element, items)
        marked = _SECTION.search(attrs.get("id", "")) or _SECTION.search(attrs.get("class", ""))
        if marked or tag in HEADING_TAGS or tag in ("footer", "small"):
            sections.append(_section(element))
    labels = []
    for index, owner in label_owners.items():
        after = _next_element(owner)
        span = (after.start, after.end) if after is not None else (0, 0)
        labels.append({"at": index, "lo": span[0], "hi": span[1]})
    text = "\n".join(tokens) if with_lines else ""
    lines = unicodedata.normalize("NFKC", text).splitlines()
    record.update(
        tokens=tokens, noscript=noscript, sections=sections, labels=labels, links=links,
        # A Japanese number starts with 0: lines without one cannot hold a phone number.
        digit_lines=[line for line in lines if "0" in line],
        jsonld=_jsonld(blocks), microdata=[_item_row(item) for item in items],
    )
    return record


def _guarded_record(html: str, with_lines: bool) -> dict[str, Any]:
    """Features of one page; a page that cannot be parsed has empty ones and says why."""
    try:
        return page_record(html, with_lines)
    except Exception as error:  # whatever one page does, the others go on
        return {**page_record(""), "parse_error": f"{type(error).__name__}: {error}"}


def _business_only(entities: str) -> Column:
    """Entities of a supported type, their types without the vocabulary's address."""
    named = F.transform(
        entities,
        lambda item: item.withField(
            "types",
            F.transform(
                item["types"], lambda kind: F.substring_index(F.rtrim(kind, F.lit("/")), "/", -1)
                if entities == "microdata" else F.substring_index(kind, "/", -1),
            ),
        ),
    )
    supported = F.array(*[F.lit(name) for name in BUSINESS_TYPES])
    return F.filter(named, lambda item: F.arrays_overlap(item["types"], supported))


def page_features(
    pages: DataFrame, html: str = "html", wanted: Sequence[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Replace the body column by the parsed features; the other columns pass through untouched.

    This is the only step of extraction and scoring that leaves the JVM. Rows are independent, so nothing is shuffled
    (``partitions`` spreads an input with too few splits), and batches travel as Arrow without a pandas copy. ``wanted``
    names the features a job needs; the others are not sent back. No page ends the job: ``parse_error`` says what was wrong
    with one.
    """
    kept = [name for name in pages.columns if name != html]
    fields = T.StructType.fromDDL(FEATURES).fields
    features_type = T.StructType([f for f in fields if wanted is None or f.name in (*wanted, "parse_error")])
    arrow_features = to_arrow_schema(features_type)
    schema = T.StructType([pages.schema[name] for name in kept] + features_type.fields)
    names = schema.names
    with_lines = "digit_lines" in names

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(html)
            records = [_guarded_record(body.as_py() or "", with_lines) for body in bodies]
            features = pa.RecordBatch.from_pylist(records, schema=arrow_features)
            columns = [batch.column(name) for name in kept] + features.columns
            yield pa.RecordBatch.from_arrays(columns, names=names)

    bodies = pages.select(*kept, html)
    parsed = (bodies if partitions is None else bodies.repartition(partitions)).mapInArrow(parse, schema)
    entities = [name for name in ("jsonld", "microdata") if name in features_type.names]
    return parsed.withColumns({name: _business_only(name) for name in entities}) if entities else parsed


def span_text(lo: Column, hi: Column) -> Column:
    """Text of a token range."""
    return F.array_join(F.slice("tokens", lo + 1, hi - lo), " ")


def page_text() -> Column:
    """Whole page text."""
    return F.array_join("tokens", " ")


def visible_text() -> Column:
    """Lower-case page text without noscript fallbacks."""
    kept = F.filter(
        "tokens",
        lambda token, at: ~F.exists("noscript", lambda span: (at >= span["lo"]) & (at < span["hi"])),
    )
    text = F.when(F.size("noscript") == 0, F.col("tokens")).otherwise(kept)
    return F.lower(F.array_join(text, " "))


def jsonld_entities(features: DataFrame, key: str) -> DataFrame:
    """One row per supported JSON-LD entity of a page, in document order."""
    return features.select(key, F.posexplode("jsonld").alias("pos", "entity")).select(
        key, "pos", "entity.*"
    )


def microdata_entities(features: DataFrame, key: str) -> DataFrame:
    """One row per supported top-level microdata item of a page, in document order."""
    return features.select(key, F.posexplode("microdata").alias("pos", "entity")).select(
        key, "pos", "entity.*"
    )


def external_hosts(url_host: Column) -> Column:
    """Distinct link hosts other than the page's own."""
    hosts = F.transform("links", hostname)
    return F.array_distinct(F.filter(hosts, lambda host: (host != "") & (host != url_host)))
