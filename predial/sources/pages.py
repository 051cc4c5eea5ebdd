"""Listing pages and search results as sources of listing rows."""

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import PRICES, any_of, card_rooms, comuna_in_text, labelled_area, price_amounts, price_in_text
from ..functions.text import clean_text, collapse, last_number_or_slug, locale_number, match_key, normal_url
from ..operators.validation import card_title

#: Texts of pages without results.
EMPTY_PAGES = ("sin resultados", "no se encontraron resultados", "no encontramos resultados", "error", "err_internet_disconnected", "site cannot be reached", "no internet")
CARDS = "page_id long, url string, link string, title string, price_text string, raw_text string"
VOID = frozenset(("br", "img", "input", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr"))
#: Elements that are cards, and titles inside one, by (tag, attribute, part of its value), the first first.
CARD_SELECTORS = (
    ("", "data-testid", "ad"), ("", "data-testid", "listing"), ("", "data-testid", "Listing"), ("", "class", "AdCard"), ("", "class", "ad-card"), ("", "class", "ui-search-result"), ("", "class", "ui-search-layout__item"),
    ("article", "", ""), ("li", "", ""), ("li", "class", "listing"), ("li", "class", "Listing"), ("div", "class", "listing"), ("div", "class", "Listing"), ("div", "class", "card"), ("div", "class", "Card"),
)
TITLE_SELECTORS = (("h1", "", ""), ("h2", "", ""), ("h3", "", ""), ("", "class", "title"), ("", "class", "Title"))
_PRICED = tuple(re.compile(pattern, re.ASCII) for pattern, _ in PRICES)
#: Fields of a search result's attributes, in order of preference.
ATTRIBUTES = {"m2_construidos": ("COVERED_AREA", "TOTAL_AREA"), "dormitorios": ("BEDROOMS", "ROOMS"), "banos": ("FULL_BATHROOMS", "BATHROOMS"), "estacionamientos": ("PARKING_LOTS",)}
ITEM = "id:string,title:string,price:double,currency_id:string,permalink:string,address:struct<city_name:string>,location:struct<latitude:double,longitude:double>,attributes:array<struct<id:string,value_name:string,value_struct:struct<number:double>>>"


class _Tree(HTMLParser):
    """The elements of a page (parent, tag, class and test id) with their positions in one text, and its links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents, self.spans, self.links, self.text, self.size = [-1], [[0, 0]], [], [], 0
        self.names: list[tuple[str, dict]] = [("#", {})]
        self.open, self.tags, self.muted = [0], ["#"], 0

    def handle_starttag(self, tag, attrs):
        self.parents.append(self.open[-1])
        self.spans.append([self.size, self.size])
        self.names.append((tag, attrs := dict(attrs)))
        node = len(self.parents) - 1
        if tag == "a" and attrs.get("href"):
            self.links.append((node, attrs["href"]))
        if tag not in VOID:
            self.open.append(node)
            self.tags.append(tag)
            self.muted += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in self.tags[1:]:
            while True:
                last = self.tags.pop()
                self.muted -= last in ("script", "style")
                self.spans[self.open.pop()][1] = self.size
                if last == tag:
                    break

    def handle_data(self, data):
        data = " ".join(data.split())
        if data and not self.muted:
            self.text.append(data)
            self.size += len(data) + 1

    def matches(self, node: int, selector: tuple[str, str, str]) -> bool:
        tag, attribute, part = selector
        own, attrs = self.names[node]
        return tag in ("", own) and (not attribute or part in (attrs.get(attribute) or ""))

    def cards(self, is_listing, url: str | None, priced: bool):
        """(link, title, text) per listing link, links absolute.

        The smallest element among those that CARD_SELECTORS choose, of 35 to 2,500 characters with a price and one or
        two listings, stands for its first listing. Where a page has none, each listing link with a price in its own
        text or in that of the nearest element around it, of at most 1,500 characters and inside the body.
        """
        self.close()
        for node in self.open:
            self.spans[node][1] = self.size
        whole = " ".join(self.text) + " "
        of = lambda node: whole[slice(*self.spans[node])].strip()
        links = [(n, urljoin(url or "", h)) for n, h in self.links if is_listing(h)]
        inside: dict[int, list] = {}
        for node, link in links:
            while node >= 0:
                inside.setdefault(node, []).append(link)
                node = self.parents[node]
        anchors = {link: node for node, link in reversed(links)}
        best: dict[str, tuple] = {}
        for node in sorted(inside):
            a, b = self.spans[node]
            if not 35 <= b - 1 - a <= 2500 or len({bare(h) for h in inside[node]}) > 2:
                continue
            rank = next((i for i, x in enumerate(CARD_SELECTORS) if self.matches(node, x)), None)
            link = inside[node][0]
            if rank is not None and (has_price(text := of(node)) or not priced) and (link not in best or (len(text), rank) < best[link][:2]):
                best[link] = (len(text), rank, self.title(node) or of(anchors[link]), text)
        if best:
            return [(link, title, text) for link, (*_, title, text) in best.items()]
        found = {}
        for node, link in links:
            around, text = self.parents[node], of(node)
            while around > 0 and self.names[around][0] not in ("main", "body", "html"):
                if of(around) and len(of(around)) <= 1500:
                    text = f"{text} {of(around)}".strip()
                    break
                around = self.parents[around]
            if bare(link) not in found and (has_price(text) or not priced):
                found[bare(link)] = (link, self.title(node) or of(node), text)
        return list(found.values())

    def title(self, node: int) -> str | None:
        """The first heading or title inside an element, by TITLE_SELECTORS."""
        for selector in TITLE_SELECTORS:
            for other in range(node, len(self.parents)):
                a, b = self.spans[other]
                if a >= self.spans[node][1] > self.spans[node][0]:
                    break
                if b > a and b <= self.spans[node][1] and self.matches(other, selector) and other != node:
                    return " ".join(self.text)[a:b].strip()
        return None


def bare(link: str) -> str:
    """A link without query, fragment and last slashes, to tell links apart."""
    return re.split(r"[?#]", link)[0].rstrip("/").lower()


def has_price(text: str) -> bool:
    return any(p.search(text) for p in _PRICED)


def usable_page(html: Column) -> Column:
    """At least 500 characters, and none of the phrases of an empty page in the text outside tags."""
    text = match_key(F.regexp_replace(html, r"(?s)<[^>]*>", " "))
    return F.coalesce((F.length(F.trim(html)) >= 500) & ~any_of(text, EMPTY_PAGES), F.lit(False))


def cards(pages: DataFrame, pattern: str = r"/[^?#]*\d", priced: bool = True) -> DataFrame:
    """A row per listing link of each page, if ``priced`` only of those that show a price: the link, its title, the price text and the card's text.

    ``pattern`` says which links are listings; relative ones are resolved against the page's url. A null or broken page
    gives no row.
    """
    wanted = re.compile(pattern)

    def parse(batches):
        for batch in batches:
            out = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                tree = _Tree()
                tree.feed(html or "")
                out += [(page, url, href, title, None, text) for href, title, text in tree.cards(lambda h: bool(wanted.search(h)), url, priced)]
            if out:
                names = [f.split()[0] for f in CARDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*out))], names)

    found = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(parse, CARDS)
    return found.withColumn("price_text", price_in_text(F.col("raw_text")))


def card_rows(found: DataFrame, least_clp: int = 10_000_000) -> DataFrame:
    """Cards as listing rows: the smallest card of each link, with price, area, commune and rooms read from its text.

    Without title or sale price a card gives no row. Without an area it has the flag missing_m2 and quality 'low', and
    stays only if title, link, price, commune and a number of rooms are there.
    """
    once = F.row_number().over(Window.partitionBy("link").orderBy(F.length("raw_text"), "page_id"))
    rows = found.withColumn("link", normal_url(F.col("link"))).where("link is not null").withColumn("__n", once).where("__n = 1").drop("__n")
    clp, uf = price_amounts(F.col("price_text"))
    text = F.concat_ws(" ", "titulo", "raw_text")
    rows = rows.select("page_id", "link", clean_text(F.col("title")).alias("titulo"), "price_text", clp.alias("precio_clp"), uf.alias("precio_uf"), collapse(F.col("raw_text")).alias("raw_text"), last_number_or_slug(F.col("link")).alias("source_listing_id"))
    rows = rows.where("titulo is not null").where(F.coalesce(F.col("precio_uf") > 0, F.col("precio_clp") >= least_clp, F.lit(False)))
    # A generator's columns are worked out once; the condition below would be pushed under a projection's and work them out again.
    read = F.struct(labelled_area(text).alias("m2_construidos"), comuna_in_text(text).alias("comuna"), card_rooms(text).alias("__rooms"))
    rows = rows.select("*", F.inline(F.array(read))).select("*", "__rooms.*").drop("__rooms")
    rows = rows.withColumn("quality_flags", F.array_compact(F.array(F.when(F.col("m2_construidos").isNull(), "missing_m2"))))
    strong = card_title(F.col("titulo")) & F.col("comuna").isNotNull() & F.coalesce("dormitorios", "banos").isNotNull()
    return rows.withColumn("quality", F.when(F.size("quality_flags") > 0, "low").otherwise("standard")).where((F.col("quality") == "standard") | strong)


def fallback_rows(found: DataFrame, comuna: Column) -> DataFrame:
    """Rows of a search page whose cards say too little: the first card of each link with any title and price; the commune is that of the request."""
    once = F.row_number().over(Window.partitionBy("link").orderBy("page_id", F.length("raw_text")))
    clp, uf = price_amounts(F.col("price_text"))
    rows = found.withColumn("link", normal_url(F.col("link"))).where("link is not null").withColumn("__n", once).where("__n = 1")
    rows = rows.select("page_id", "link", F.coalesce(clean_text(F.col("title")), F.substring(clean_text(F.col("raw_text")), 1, 80)).alias("titulo"), clp.alias("precio_clp"), uf.alias("precio_uf"), comuna.alias("comuna"), last_number_or_slug(F.col("link")).alias("source_listing_id"), "raw_text")
    return rows.where("titulo is not null and (precio_clp is not null or precio_uf is not null)")


def search_rows(results: DataFrame, column: str = "json") -> DataFrame:
    """Listing rows of a search API's JSON: attribute priorities, currency, address and place."""
    items = results.select(F.explode(F.from_json(column, f"results array<struct<{ITEM}>>")["results"]).alias("i")).select("i.*")
    by_id = F.map_from_entries(F.transform(F.array_distinct(F.transform("attributes", lambda a: a["id"])), lambda k: F.struct(k, F.element_at(F.filter("attributes", lambda a: a["id"] == k), 1))))
    items = items.withColumn("__a", F.when(F.col("attributes").isNotNull(), by_id))

    def number(names):
        values = []
        for name in names:
            entry = F.try_element_at("__a", F.lit(name))
            values.append(F.coalesce(entry["value_struct"]["number"], locale_number(entry["value_name"])))
        return F.coalesce(*values)

    uf = F.col("currency_id") == "CLF"
    columns = [number(names).cast("double" if field == "m2_construidos" else "int").alias(field) for field, names in ATTRIBUTES.items()]
    return items.select(F.col("id").alias("source_listing_id"), F.col("title").alias("titulo"), normal_url(F.col("permalink")).alias("link"), F.when(~uf, F.col("price")).cast("bigint").alias("precio_clp"), F.when(uf, F.col("price")).alias("precio_uf"), F.col("address.city_name").alias("comuna"), F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lon"), *columns)
