"""Jobs over landed web pages (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import exprs as X
from shelfmark.functions import html as H

#: Hosts below which every shop has its own name (fixed values).
PLATFORM_HOSTS = ["myshopify.com", "mybigcommerce.com"]


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def domain_of(url: Column) -> Column:
    """The host of a platform's shop, else the last two labels."""
    host = host_of(url)
    shop = F.lit(False)
    for suffix in PLATFORM_HOSTS:
        shop = shop | host.endswith("." + suffix)
    return F.when(shop, host).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))


def domain_normalize(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", domain_of(F.col("url")).alias("domain"))


def platform_detect(pages: DataFrame) -> DataFrame:
    """Platform by domain, then by marks in the page."""
    host, html = host_of(F.col("url")), F.lower("html")
    platform = (
        F.when(host.endswith("myshopify.com") | F.contains(html, F.lit("cdn.shopify.com")), "shopify")
        .when(host.endswith("mybigcommerce.com") | F.contains(html, F.lit("bigcommerce")), "bigcommerce")
        .when(F.contains(html, F.lit("woocommerce")), "woocommerce")
        .when(F.contains(html, F.lit("magento")), "magento")
        .otherwise("custom")
    )
    return pages.select("page_id", platform.alias("platform"))


def html_clean(pages: DataFrame, keep: int | None = 15_000) -> DataFrame:
    """Pages without comments, scripts, styles, navigation and event attributes, cut to ``keep`` characters (None: whole)."""
    html = H.cleaned(F.col("html"))
    return pages.select("page_id", (html if keep is None else F.substring(html, 1, keep)).alias("html"))


def absolute(href: Column, url: Column) -> Column:
    """A link as seen from the page at ``url``; null for other schemes than http and for marks within the page."""
    href = F.regexp_replace(F.trim(href), "#.*$", "")
    scheme, root = F.regexp_extract(url, r"^([a-zA-Z]+:)//", 1), F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)?", 1))
    return (
        F.when(href.rlike("^(?i)https?://"), href).when((href == "") | href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, F.when(path == "", "/").otherwise(path), href)).otherwise(F.concat(root, folder, href))
    )


def attribute(element: Column, name: str) -> Column:
    """An attribute of one of a page's elements; null if it is missing or empty."""
    return X.unescape(F.nullif(F.trim(element[name]), F.lit("")))


def link_extract(pages: DataFrame) -> DataFrame:
    """Distinct links of each page to its own host, made absolute."""
    hrefs = F.transform(H.of_kind(H.elements(F.col("html")), "a"), lambda a: attribute(a, "href"))
    links = pages.select("page_id", "url", F.explode(hrefs).alias("href"))
    linked = links.select("page_id", "url", absolute(F.col("href"), F.col("url")).alias("link")).where("link is not null")
    return linked.where(host_of(F.col("link")) == host_of(F.col("url"))).select("page_id", "link").distinct()


def product_links(pages: DataFrame) -> DataFrame:
    """Those links of each page that look like product pages."""
    return link_extract(pages).where(X.is_product_url(F.col("link")))


def store_discover(pages: DataFrame, stores: DataFrame) -> DataFrame:
    """A new store for every domain that no store has."""
    found = pages.select(domain_of(F.col("url")).alias("domain")).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("pages"))
    return found.join(stores.select("domain"), "domain", "left_anti").withColumn("id", X.store_id_hash(F.col("domain")))


FIELDS = ("title", "price", "currency", "brand", "description", "category", "sku", "availability", "images")


def meta_tag(metas: Column, *names: str) -> Column:
    """The content of the first of these meta tags that has one, by property or else by name."""
    first = lambda name, key: F.get(F.filter(metas, lambda m: m[key] == name), 0)["content"]
    return F.coalesce(*[first(name, key) for name in names for key in ("property", "name")])


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once each; otherwise they would be written out wherever they are named."""
    own = [c for c in rows.columns if c not in columns]
    made = rows.select(*own, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made"))
    return made.select(*own, *[F.col(f"_made.{n}").alias(n) for n in columns])


def priced(rows: DataFrame, *ways: str) -> DataFrame:
    """``rows`` whose structs of FIELDS have the price text as an amount, and the currency that is named, else that of the text."""
    rows = computed(rows, **{f"_{way}": X.price_normalize(F.col(f"{way}.price")) for way in ways})

    def read(way: str) -> Column:
        row, said = F.col(way), F.col(f"_{way}")
        new = {
            "price": said["amount"], "currency": F.when(said["amount"].isNotNull(), F.coalesce(row["currency"], said["currency"])),
            "availability": X.availability_normalize(row["availability"]),
        }
        return F.struct(*[new.get(f, row[f]).alias(f) for f in FIELDS])

    return computed(rows, **{way: read(way) for way in ways}).drop(*[f"_{way}" for way in ways])


def fields(**given: Column) -> Column:
    """A struct of FIELDS as found, unnamed ones null."""
    none = {f: F.lit(None).cast("array<string>" if f == "images" else "string") for f in FIELDS}
    return F.struct(*[given.get(f, none[f]).alias(f) for f in FIELDS])


def opengraph_struct(found: Column) -> Column:
    """The OpenGraph fields among a page's elements."""

    def read(metas: Column) -> Column:
        image = meta_tag(metas, "og:image")
        return fields(
            title=meta_tag(metas, "og:title"), price=meta_tag(metas, "product:price:amount", "og:price:amount"),
            currency=meta_tag(metas, "product:price:currency", "og:price:currency"), brand=meta_tag(metas, "product:brand"),
            description=meta_tag(metas, "og:description"), availability=meta_tag(metas, "product:availability", "og:availability"),
            images=F.when(image.isNotNull(), F.array(image)),
        )

    described = lambda t: F.struct(*[attribute(t, a).alias(a) for a in ("property", "name", "content")])
    return let(F.transform(H.of_kind(found, "meta"), described), read)


def _flat(pages: DataFrame, found: Column) -> DataFrame:
    return priced(computed(pages, _p=found).select("page_id", F.col("_p").alias("product")), "product").select("page_id", "product.*")


def opengraph_fields(pages: DataFrame) -> DataFrame:
    found = pages.select("page_id", H.elements(F.col("html")).alias("el"))
    return _flat(found, opengraph_struct(F.col("el")))


def extract_opengraph(pages: DataFrame) -> DataFrame:
    """Title, price, currency and brand of a page's OpenGraph tags."""
    return opengraph_fields(pages).select("page_id", "title", "price", "currency", "brand")


def json_entries(text: Column) -> Column:
    """A JSON text as an array of texts: a list's entries, else itself."""
    return F.when(F.ltrim(text).startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(text))


def json_text(body: Column, *paths: str) -> Column:
    """The first of the paths that holds a value; null for a blank one."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(body, path)), F.lit("")) for path in paths])


def jsonld_product(found: Column) -> Column:
    """The first product, as JSON text, of a page's JSON-LD scripts: an object, a list's entry or one of a graph."""
    bodies = F.transform(H.of_kind(found, "script"), lambda e: F.trim(e["text"]))
    bodies = F.filter(bodies, lambda b: F.try_parse_json(b).isNotNull())
    entries = F.flatten(F.transform(bodies, json_entries))
    for _ in range(2):  # a graph's entries may be lists or graphs themselves
        inner = lambda e: F.coalesce(json_entries(F.get_json_object(e, "$['@graph']")), F.array().cast("array<string>"))
        entries = F.flatten(F.transform(entries, lambda e: F.concat(F.array(e), F.filter(inner(e), lambda x: x.isNotNull()))))
    kinds = lambda e: F.transform(json_entries(json_text(e, "$['@type']", "$.type")), lambda k: F.lower(k))
    return F.get(F.filter(entries, lambda e: F.coalesce(F.array_contains(kinds(e), "product"), F.lit(False))), 0)


def jsonld_struct(found: Column) -> Column:
    """The fields of the JSON-LD product among a page's elements."""

    def read(p: Column, o: Column, brand: Column, images: Column) -> Column:
        return fields(
            title=F.get_json_object(p, "$.name"), price=json_text(o, "$.price", "$.priceSpecification.price"),
            currency=json_text(o, "$.priceCurrency", "$.priceSpecification.priceCurrency"),
            brand=F.when(brand.startswith("{"), F.get_json_object(p, "$.brand.name")).when(~brand.startswith("["), brand),
            description=json_text(p, "$.description"), category=json_text(p, "$.category"), sku=F.coalesce(json_text(p, "$.sku"), json_text(o, "$.sku"), json_text(p, "$.productID")),
            availability=F.coalesce(json_text(o, "$.availability"), json_text(p, "$.availability")),
            images=F.array_distinct(F.filter(images, lambda i: i.isNotNull() & (i != ""))),
        )

    def parts(p: Column) -> Column:
        images = let(json_text(p, "$.image", "$.images"), json_entries)
        located = F.transform(images, lambda i: F.trim(F.when(F.ltrim(i).startswith("{"), F.get_json_object(i, "$.url")).otherwise(i)))
        offer = F.get(let(F.get_json_object(p, "$.offers"), json_entries), 0)
        return F.struct(offer.alias("o"), F.get_json_object(p, "$.brand").alias("b"), located.alias("i"))

    return let(jsonld_product(found), lambda p: let(parts(p), lambda x: read(p, x["o"], x["b"], x["i"])))


def jsonld_fields(pages: DataFrame) -> DataFrame:
    found = pages.select("page_id", H.elements(F.col("html")).alias("el"))
    return _flat(found, jsonld_struct(F.col("el")))


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """Title, price, currency and brand of a page's first JSON-LD product."""
    return jsonld_fields(pages).select("page_id", "title", "price", "currency", "brand")


#: Rules up to this number are broadcast; more are joined by domain.
FEW_RULES = 100_000
RULED = ("title", "price", "availability", "images")


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with url and html) and a column rules, the fields that the rules of each page's domain find.

    ``rules``: domain, field, pattern with one group; of several values for a field the smallest counts. One row holds all
    rules of a domain, so no page is repeated.
    """
    of = lambda f: F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("pattern")))).alias(f)
    by_domain = rules.groupBy("domain").agg(*[of(f) for f in RULED]).select("domain", F.struct(*RULED).alias("patterns"))
    by_domain = F.broadcast(by_domain) if rules.limit(FEW_RULES + 1).count() <= FEW_RULES else by_domain
    joined = pages.withColumn("domain", domain_of(F.col("url"))).join(by_domain, "domain", "left")
    value = lambda f: F.array_min(F.expr(f"transform(patterns.{f}, p -> nullif(regexp_extract(html, p, 1), ''))"))
    image = value("images")
    found = fields(title=value("title"), price=value("price"), availability=value("availability"), images=F.when(image.isNotNull(), F.array(image)))
    return computed(joined, rules=found).select(*pages.columns, "rules")


def rule_fields(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Fields by the rules of each page's domain (see ``with_rules``), for pages of which a rule finds something."""
    found = with_rules(pages.select("page_id", "url", "html"), rules)
    return _flat(found.where(" or ".join(f"rules.{f} is not null" for f in RULED)), F.col("rules"))


def likely(product: Column) -> Column:
    """Whether extracted fields look like a product: a price, and a title that is no general phrase."""
    plain = lambda f: F.trim(F.regexp_replace(F.lower(F.coalesce(product[f], F.lit(""))), r"\s+", " "))
    general = lambda text: F.exists(F.array(*[F.lit(p) for p in X.GENERIC_PHRASES]), lambda p: F.contains(text, p))
    named = let(plain("title"), lambda text: (F.length(text) >= 5) & ~general(text))
    return F.coalesce(product["price"].isNotNull() & named & ~let(plain("description"), general), F.lit(False))


def extract_cascade(pages: DataFrame, rules: DataFrame | None = None, fields: tuple[str, ...] = FIELDS[:4]) -> DataFrame:
    """Per page the first likely product of JSON-LD, OpenGraph and the domain's rules; pages without one are left out.

    All three are found in one pass over the rows, so repeated pages give a row each.
    """
    row, ways = pages.select("page_id", "html", *(["url"] if rules is not None else [])), ["jsonld", "opengraph"]
    if rules is not None:
        row, ways = with_rules(row, rules), [*ways, "rules"]
    row = row.select("page_id", H.elements(F.col("html")).alias("el"), *ways[2:])
    row = priced(computed(row, jsonld=jsonld_struct(F.col("el")), opengraph=opengraph_struct(F.col("el"))), *ways)
    chosen = F.coalesce(*[F.when(likely(F.col(way)), F.struct(F.lit(way).alias("via"), *[F.col(f"{way}.{f}").alias(f) for f in fields])) for way in ways])
    return computed(row, c=chosen).where("c is not null").select("page_id", "c.*")


def extraction_coverage(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("via").agg(F.count("*").alias("pages"), *[F.count(c).alias(f"with_{c}") for c in ("title", "price", "currency", "brand")])


def missing_fields(extracted: DataFrame) -> DataFrame:
    """Per way and field, how many extracted products lack it; ``extracted`` has all fields."""
    lacks = lambda f: (F.col(f).isNull() | (F.size(f) < 1)) if f == "images" else F.col(f).isNull()
    names = F.array(*[F.when(lacks(f), F.lit(f)) for f in FIELDS])
    each = extracted.select("via", F.explode(names).alias("field")).where("field is not null")
    return each.groupBy("via", "field").agg(F.count("*").alias("missing"))


def counted_up(digits: Column) -> Column:
    """A page number plus one, as text; null beyond what a number holds."""
    return F.try_add(digits.try_cast("decimal(38,0)"), F.lit(1)).cast("string")


def next_page(pages: DataFrame) -> DataFrame:
    """The page that follows each page.

    In this order: a rel=next link, a link whose text says next, the page number of the query plus one, that of the
    path, and the link after the current one of a numbered pager.
    """
    url, el = F.col("url"), F.col("el")
    found = pages.select("page_id", "url", H.elements(F.col("html")).alias("el"))
    with_rel = lambda kind: F.get(F.filter(H.of_kind(el, kind), lambda t: F.lower(attribute(t, "rel")) == "next"), 0)
    rel = absolute(F.coalesce(attribute(with_rel("link"), "href"), attribute(with_rel("a"), "href")), url)
    links = F.transform(H.of_kind(el, "a"), lambda a: F.struct(
        X.unescape(a["text"]).alias("text"), attribute(a, "href").alias("href"),
        ((F.coalesce(attribute(a, "current"), F.lit("")) == "page") | F.coalesce(attribute(a, "class"), F.lit("")).rlike(r"(?i)(^|\s)(active|current)(\s|$)")).alias("current"),
    ))
    row = found.select("page_id", "url", rel.alias("rel"), F.filter(links, lambda a: a["href"].isNotNull()).alias("links"))
    said = F.filter("links", lambda a: F.lower(a["text"]).rlike(X.NEXT_TEXT))
    by_text = absolute(F.try_element_at(said, F.lit(-1))["href"], url)
    number = F.nullif(F.regexp_extract(url, r"[?&]page=([0-9]+)", 1), F.lit(""))
    query = F.concat(F.regexp_extract(url, r"^(.*?[?&]page=)", 1), counted_up(number), F.regexp_extract(url, r"[?&]page=[0-9]+(.*)$", 1))
    place = F.nullif(F.regexp_extract(url, r"(?i)/page/([0-9]+)(?:/|$)", 1), F.lit(""))
    path = F.concat(F.regexp_extract(url, r"(?i)^(.*?/page/)[0-9]+(?:/|$)", 1), counted_up(place), F.lit("/"), F.regexp_extract(url, r"(?i)/page/[0-9]+/(.*)$", 1))
    pager = F.filter("links", lambda a: a["text"].rlike("^[0-9]+$"))
    now = counted_up(F.get(F.filter(pager, lambda a: a["current"]), 0)["text"])
    after = absolute(F.get(F.filter(pager, lambda a: F.regexp_replace(a["text"], "^0+(?=.)", "") == now), 0)["href"], url)
    return row.select("page_id", F.coalesce("rel", by_text, query, path, after).alias("next")).where("next is not null")


def extract_domain_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Fields by the patterns of each page's domain; ``rules``: domain, field, pattern with one group."""
    by_domain = pages.withColumn("domain", domain_of(F.col("url"))).join(rules, "domain")
    value = F.nullif(F.expr("regexp_extract(html, pattern, 1)"), F.lit(""))
    return by_domain.select("page_id", "field", value.alias("value")).where("value is not null")
