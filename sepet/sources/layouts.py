"""One declared layout per shop: where the product array lies and how an item becomes a listing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import stable_key_md5
from ..functions.text import slug
from .tree import NOT_JSON, find_list

PRICE = "decimal(18,2)"
FIELDS = [
    "external_id",
    "title",
    "brand",
    "barcode",
    "image_url",
    "price",
    "regular_price",
    "source_category",
    "product_url",
]


@dataclass(frozen=True)
class Envelope:
    """How a payload is opened: parsed once, into one struct that gives the item texts and tells whether it could be read."""

    parse: Callable[[Column], Column]
    items: Callable[[Column], Column]
    readable: Callable[[Column], Column]


@dataclass(frozen=True)
class Layout:
    """A feed layout.

    ``envelope`` opens a payload to an array of item texts; ``item`` is the item's schema; ``columns`` maps the parsed item to listing
    columns, the ones left out being null. Items without ``required`` columns go to quarantine.
    ``keep`` drops items that are no products. ``missing_is_error`` tells apart shops whose missing
    list is an empty answer from those where it is a failure. Where the place of the list varies,
    ``search`` finds it, and the envelope is what it found.
    """

    source: str
    envelope: Envelope
    item: str
    columns: Callable[[Column], dict[str, Column]]
    required: tuple[str, ...] = ("external_id", "price")
    keep: Callable[[Column], Column] | None = None
    missing_is_error: bool = False
    active: bool = True
    search: Callable[[DataFrame, str, str], DataFrame] | None = None


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _at_path(*path: str) -> Envelope:
    """An array of items at a fixed path. Items stay text, so that a bad one spoils no other."""
    shape = "array<string>"
    for name in reversed(path[1:]):
        shape = f"struct<{name}:{shape}>"
    schema = f"{path[0]} {shape}, _bad string"

    def items(doc: Column) -> Column:
        col = doc
        for name in path:
            col = col[name]
        return col

    return Envelope(
        lambda payload: F.from_json(payload, schema, {"columnNameOfCorruptRecord": "_bad"}), items, lambda doc: doc["_bad"].isNull()
    )


def _minor(col: Column) -> Column:
    """Integer minor units to a price; missing means 0."""
    return F.coalesce((col.cast("decimal(16,0)") / F.lit(100).cast("decimal(3,0)")).cast(PRICE), F.lit(0).cast(PRICE))


def _first_image(item: Column) -> Column:
    return F.get(item["images"], F.lit(0))["urls"]["PRODUCT_DETAIL"]


def _prefixed(prefix: str, part: Column) -> Column:
    """Shop prefix and slug; empty when the slug is missing."""
    return F.coalesce(F.concat(F.lit(prefix), part), F.lit(""))


_STORE_ITEM = (
    "id bigint, name string, brand struct<name:string>, category struct<name:string>, "
    "images array<struct<urls:struct<PRODUCT_DETAIL:string>>>, shownPrice int, regularPrice int, prettyName string"
)


def _store(prefix: str) -> Callable[[Column], dict[str, Column]]:
    return lambda item: {
        "external_id": item["id"],
        "title": _text(item["name"]),
        "brand": item["brand"]["name"],
        "image_url": _first_image(item),
        "price": _minor(item["shownPrice"]),
        "regular_price": _minor(item["regularPrice"]),
        "source_category": item["category"]["name"],
        "product_url": _prefixed(prefix, item["prettyName"]),
    }


def _mion(item: Column) -> dict[str, Column]:
    return {
        "external_id": item["id"],
        "title": _text(item["name"]),
        "image_url": _first_image(item),
        "price": F.when(item["shownPrice"].isNotNull(), _minor(item["shownPrice"])),
        "regular_price": F.when(item["regularPrice"].isNotNull(), _minor(item["regularPrice"])),
        "product_url": _prefixed("https://www.mion.com.tr/urun/", _text(item["prettyName"])),
    }


def _marketfiyati(item: Column) -> dict[str, Column]:
    depots = F.coalesce(item["productDepotInfoList"], F.array().cast("array<struct<price:decimal(18,2)>>"))
    price = F.when(F.size(depots) == 0, F.lit(0).cast(PRICE)).otherwise(F.get(depots, F.lit(0))["price"])
    return {
        "external_id": stable_key_md5(item["id"]),
        "title": _text(item["title"]),
        "brand": item["brand"],
        "image_url": item["imageUrl"],
        "price": price,
        "regular_price": price,
        "source_category": item["main_category"],
        "product_url": F.concat_ws(
            "/", F.lit("https://marketfiyati.org.tr/detay"), item["id"], slug(_text(item["title"]))
        ),
    }


def _hakmarexpress(card: Column) -> dict[str, Column]:
    item = card["product"]
    return {
        "external_id": item["id"],
        "title": _text(item["name"]),
        "brand": item["brand"]["name"],
        "barcode": item["barcode"],
        "image_url": item["imageUrl"],
        "price": item["price"],
        "regular_price": F.coalesce(item["oldPrice"], item["price"]),
        "source_category": F.try_element_at(item["categories"], F.lit(-1))["name"],
        "product_url": _prefixed("https://www.hakmarexpress.com.tr/", _text(item["slug"])),
    }


def _cagri(item: Column) -> dict[str, Column]:
    price = F.coalesce(item["price"], F.lit(0).cast(PRICE))
    return {
        "external_id": F.coalesce(item["id"], F.lit(0)),
        "title": _text(item["name"]),
        "image_url": item["image"],
        "price": price,
        "regular_price": F.coalesce(item["oldPrice"], price),
        "product_url": _text(item["url"]),
    }


def _evidea(item: Column) -> dict[str, Column]:
    key = F.get(F.filter(item["attributes"], lambda a: a["name"] == "pk"), F.lit(0))["value"]
    return {
        "external_id": F.coalesce(key.try_cast("bigint"), F.lit(0)),
        "title": _text(item["name"]),
        "image_url": F.get(item["images"], F.lit(0)),
        "price": item["price"],
        "regular_price": F.coalesce(item["oldPrice"], item["price"]),
        "product_url": _text(item["url"]),
    }


def _root_or_data() -> Envelope:
    """The root when it is an array, else the array under ``data``."""
    under_data = _at_path("data")

    def parse(payload: Column) -> Column:
        is_array = F.startswith(F.ltrim(payload), F.lit("["))
        return F.struct(
            is_array.alias("is_array"),
            F.when(is_array, F.from_json(payload, "array<string>")).alias("root"),
            F.when(~is_array, under_data.parse(payload)).alias("under"),
        )

    return Envelope(
        parse,
        lambda doc: F.when(doc["is_array"], doc["root"]).otherwise(under_data.items(doc["under"])),
        lambda doc: F.when(doc["is_array"], doc["root"].isNotNull()).otherwise(under_data.readable(doc["under"])),
    )


_found = Envelope(
    lambda found: F.struct((found == NOT_JSON).alias("bad"), F.from_json(found, "array<string>").alias("root")),
    lambda doc: doc["root"],
    lambda doc: ~F.coalesce(doc["bad"], F.lit(False)),
)

LAYOUTS = {
    layout.source: layout
    for layout in (
        Layout("migros", _at_path("data", "storeProductInfos"), _STORE_ITEM, _store("https://www.migros.com.tr/")),
        Layout("macrocenter", _at_path("data", "storeProductInfos"), _STORE_ITEM, _store("https://www.macrocenter.com.tr/")),
        Layout(
            "marketfiyati",
            _at_path("content"),
            "id string, title string, brand string, imageUrl string, main_category string, "
            "productDepotInfoList array<struct<price:decimal(18,2)>>",
            _marketfiyati,
            missing_is_error=True,
        ),
        Layout(
            "hakmarexpress",
            _found,
            "product struct<id:bigint,name:string,imageUrl:string,brand:struct<name:string>,barcode:string,"
            "categories:array<struct<name:string>>,price:decimal(18,2),oldPrice:decimal(18,2),slug:string>",
            _hakmarexpress,
            keep=lambda card: card["product"].isNotNull(),
            search=find_list,
        ),
        Layout(
            "mion",
            _at_path("data", "searchInfo", "storeProductInfos"),
            "id bigint, name string, images array<struct<urls:struct<PRODUCT_DETAIL:string>>>, "
            "shownPrice int, regularPrice int, prettyName string",
            _mion,
            required=("external_id", "price", "regular_price"),
            missing_is_error=True,
            active=False,
        ),
        Layout(
            "cagrimarket",
            _root_or_data(),
            "id bigint, name string, url string, price decimal(18,2), oldPrice decimal(18,2), image string",
            _cagri,
            active=False,
        ),
        Layout(
            "evidea",
            _at_path("results", "products", "data"),
            "code string, name string, url string, price decimal(18,2), oldPrice decimal(18,2), images array<string>, "
            "attributes array<struct<name:string,value:string>>",
            _evidea,
            active=False,
        ),
    )
}
ACTIVE = tuple(name for name, layout in LAYOUTS.items() if layout.active)
