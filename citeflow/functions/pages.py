"""Records from page text: titles, links, cleaned listing fields."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    inner = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]*>", "")
    return F.nullif(F.substring(F.trim(F.regexp_replace(inner, r"\s+", " ")), 1, 512), F.lit(""))


def links(html: Column) -> Column:
    """array of struct(href, text), in order."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(2)).alias("text"))
    return F.transform(both, lambda x: F.struct(x["href"].alias("href"), F.trim(F.regexp_replace(x["text"], "<[^>]*>", "")).alias("text")))


def clean_html(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    return F.regexp_replace(bare, r'(?is)\sstyle="[^"]*"', "")


def rating(text: Column) -> Column:
    """struct(rating, reviews) of '4.5 stars 12 Reviews'; UNKNOWN where absent."""
    shape = r"(\d+\.?\d*) stars (\d+) Reviews"
    told = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, shape, i), F.lit("")), F.lit("UNKNOWN"))
    return F.struct(told(1).alias("rating"), told(2).alias("reviews"))


def _text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", ""), r"\s+", " "))


def _blocks(html: Column, tag: str, css: str) -> Column:
    """What follows the start of each element of a class, up to the next such start."""
    parts = F.split(html, rf'(?i)<{tag}\b[^>]*class="[^"]*\b{css}\b[^"]*"[^>]*>')
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def _anchors(html: Column, css: str | None = None) -> Column:
    """array of struct(href, text) of the anchors, of a class if one is given, that have a target."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?)</a>"), F.lit(1))
    kept = F.filter(tags, lambda t: t.rlike(r'(?is)^<a\b[^>]*\bhref="')) if css is None else F.filter(tags, lambda t: t.rlike(rf'(?is)^<a\b[^>]*class="[^"]*\b{css}\b'))
    return F.transform(kept, lambda t: F.struct(F.regexp_extract(t, r'(?is)^<a\b[^>]*\bhref="([^"]*)"', 1).alias("href"), _text(t).alias("text")))


def part_list(html: Column) -> Column:
    """array of struct(number, name, url): each block of a parts list that has two links, the second naming the part."""
    two = lambda b: _anchors(b, "pl-pat-im-link")
    told = F.transform(_blocks(html, "div", "pl-pat-im-sub"), lambda b: F.struct(F.get(two(b), 0).alias("a"), F.get(two(b), 1).alias("b")))
    return F.transform(F.filter(told, lambda x: x["b"].isNotNull()), lambda x: F.struct(x["a"]["text"].alias("number"), x["b"]["text"].alias("name"), x["b"]["href"].alias("url")))


def category_list(html: Column, base: Column | None = None) -> Column:
    """array of struct(name, url) of the links of a category's list; base goes before each URL."""
    whole = F.concat_ws("", _blocks(html, "[a-z]+", "category-part-list"))
    full = lambda u: u if base is None else F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(u, "^/+", ""))
    return F.transform(_anchors(whole), lambda a: F.struct(a["text"].alias("name"), full(a["href"]).alias("url")))


def deals(html: Column) -> Column:
    """array of struct(name, url): the first link of each news block."""
    first = F.transform(_blocks(html, "div", "newstitleblock"), lambda b: F.get(_anchors(b), 0))
    return F.transform(F.filter(first, lambda a: a.isNotNull()), lambda a: F.struct(a["text"].alias("name"), F.trim(a["href"]).alias("url")))


#: The field that a specification's row fills: the first whose word its key holds.
PART_FIELDS = (("part number", "part_number"), ("dimensions", "dimensions"), ("size", "dimensions"), ("weight", "weight"), ("brand", "brand"), ("manufacturer", "manufacturer"), ("condition", "condition"), ("description", "description"), ("position", "position"), ("other names", "other_names"), ("warranty", "warranty"))


def part_details(html: Column) -> Column:
    """struct of a part's page: name, price, msrp, amount and percent saved, the PART_FIELDS (of rows for one field the last counts; part_number is else what
    follows the maker's name in the title), and specifications, the map of all rows.
    """
    clean = lambda c: F.nullif(F.trim(F.replace(c, F.lit("$"))), F.lit(""))
    of_class = lambda css: _text(F.regexp_extract(html, rf'(?is)class="[^"]*\b{css}\b[^"]*"[^>]*>(.*?)</(?:span|div|p)>', 1))
    name = _text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    table = F.regexp_extract(html, r'(?is)<table\b[^>]*class="[^"]*\bpn-spec-list\b[^"]*"[^>]*>(.*?)</table>', 1)
    cells = F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), _text))
    rows = F.transform(F.filter(cells, lambda c: F.size(c) == 2), lambda c: F.struct(F.lower(c[0]).alias("key"), c[1].alias("value")))

    def routed(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for word, field in reversed(PART_FIELDS):
            out = F.when(key.contains(word), field).otherwise(out)
        return out

    last = lambda field: F.try_element_at(F.filter(rows, lambda r: routed(r["key"]) == field), F.lit(-1))["value"]
    titled = F.when(name.contains("Toyota"), F.trim(F.element_at(F.split(name, "Toyota"), -1)))
    fields = [F.coalesce(last(f), titled if f == "part_number" else F.lit(None).cast("string")).alias(f) for f in dict(map(reversed, PART_FIELDS))]
    saved = savings(of_class("price-section-save"))
    specs = F.aggregate(rows, F.create_map().cast("map<string,string>"), lambda m, r: F.map_concat(F.map_filter(m, lambda k, _: k != r["key"]), F.create_map(r["key"], r["value"])))
    return F.struct(name.alias("name"), clean(of_class("price-section-price")).alias("price"), clean(F.regexp_extract(html, r'(?is)class="[^"]*\bprice-section-retail\b[^"]*"[^>]*>.*?<span\b[^>]*>(.*?)</span>', 1)).alias("msrp"), saved["amount"].alias("saved"), saved["percent"].alias("saved_percent"), *fields, specs.alias("specifications"))


def map_card(html: Column) -> Column:
    """struct(name, rating, reviews, type, address, phone, website, maps_url) of a map's result card; UNKNOWN where absent."""
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("UNKNOWN"))
    name = _text(F.regexp_extract(html, r'(?is)<div\b[^>]*class="[^"]*fontHeadlineSmall[^"]*"[^>]*>(.*?)</div>', 1))
    stars = rating(F.regexp_extract(html, r'(?is)<span\b[^>]*class="[^"]*ZkP5Je[^"]*"[^>]*aria-label="([^"]*)"', 1))
    spans = F.transform(F.regexp_extract_all(F.concat_ws("", _blocks(html, "div", "W4Efsd")), F.lit(r"(?is)<span\b[^>]*>([^<]*)</span>"), F.lit(1)), lambda s: F.trim(s))
    kind = F.try_element_at(F.filter(spans, lambda s: s.isin("Bakery", "Coffee shop", "Donuts")), F.lit(-1))
    street = F.try_element_at(F.filter(spans, lambda s: s.rlike("Rd|St|Ave|Blvd")), F.lit(-1))
    link = F.when(name != "", F.concat(F.lit("https://www.google.com/maps/search/"), F.replace(name, F.lit(" "), F.lit("+"))))
    return F.struct(known(name).alias("name"), stars["rating"].alias("rating"), stars["reviews"].alias("reviews"), known(kind).alias("type"), known(street).alias("address"), F.lit("UNKNOWN").alias("phone"), F.lit("UNKNOWN").alias("website"), known(link).alias("maps_url"))


_UI = ("call", "directions", "hotels", "load more", "more places", "nearby", "results", "save", "search this area", "see more results", "share", "show more results", "sort by", "sponsored", "vacation rentals are also available", "view all", "website")
_NOT_NAMES = (r"^\d+\s*(km|kilometers|mi|miles)$", r"^\d+\s*min$", "^[★☆]+$", r"^\$+$", "^open|^closed$", r"^\d+:\d+\s*(am|pm)?$", r"^rating:\s*\d", r"^\(\d+\)$")


def valid_business_name(name: Column) -> Column:
    low = F.lower(F.trim(name))
    bad = F.length(low) < 3
    for x in _UI:
        bad = bad | low.contains(x)
    for x in _NOT_NAMES:
        bad = bad | low.rlike(x)
    bad = bad | low.rlike(r"^\d+$") | ~name.rlike("[a-zA-Z]") | low.isin("business", "hotel", "location", "motel", "place", "restaurant")
    return F.coalesce(~bad, F.lit(False))


def first_business_name(text: Column) -> Column:
    return F.get(F.filter(F.slice(F.split(text, "\n"), 1, 5), valid_business_name), 0)


def phone(text: Column) -> Column:
    kept = F.trim(F.regexp_replace(text, r"[^0-9()+\- ]", ""))
    return F.when(F.length(kept) >= 7, kept)


def address(text: Column) -> Column:
    kept = F.trim(text)
    return F.when(F.length(kept) > 5, kept)


def website(href: Column) -> Column:
    return F.when(href.startswith("http"), href)


def reviews(text: Column) -> Column:
    """The digits of a count of reviews."""
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit(""))


def price(text: Column) -> Column:
    return F.nullif(F.trim(F.replace(text, F.lit("$"))), F.lit(""))


def mail(href: Column) -> Column:
    """The address of a mailto link, without what follows a question mark."""
    return F.when(F.lower(href).startswith("mailto:"), F.nullif(F.trim(F.split_part(F.substr(href, F.lit(8)), F.lit("?"), F.lit(1))), F.lit("")))


def nearest_heading(lines, article: str, number: str, line: str):
    """lines (article, number, line) with section, the heading that is nearest above each, '(lead)' before the first."""
    name = F.nullif(F.regexp_extract(line, r"^(={2,6})\s*(\S.*?)\s*\1\s*$", 2), F.lit(""))
    w = Window.partitionBy(article).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit("(lead)")))


def savings(text: Column) -> Column:
    """struct(amount, percent) of 'You Save: $12 (10%)'."""
    shape = r"\$?([\d.,]+)\s*\(([\d.]+)%\)"
    return F.struct(F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).alias("amount"), F.nullif(F.regexp_extract(text, shape, 2), F.lit("")).alias("percent"))


def flatten_map(df, column: str, keys: list[str] | None = None):
    """Each key of a map column becomes a column. Keys not given are found over the whole table."""
    if keys is None:
        keys = sorted(r[0] for r in df.select(F.explode(F.map_keys(column))).distinct().collect())
    return df.select("*", *(F.try_element_at(column, F.lit(k)).alias(k) for k in keys)).drop(column)
