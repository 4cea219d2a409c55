"""Listings from pages, search results, e-mails and plain text; cross-checks and advice."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.operators import elements, listings

# Where each shop's pages hold a listing's fields, in order of preference.
CASCADES = {
    "ebay": {
        "title": [".x-item-title__mainTitle", "h1.it-ttl", "#itemTitle"],
        "price": [".x-price-primary", "#prcIsum", 'meta[itemprop="price"]@content'],
        "condition": [".x-item-condition-text", "#vi-itm-cond"],
        "item_id": ['[data-testid="ux-item-number"]'],
        "seller": [".x-sellercard-atf__info__about-seller a"],
    },
    "amazon": {
        "title": ["#productTitle", "#title"],
        "price": [".a-price .a-offscreen", "#priceblock_ourprice", "#price_inside_buybox"],
        "condition": ["#condition-text"],
        "item_id": ['input[name="ASIN"]@value'],
        "seller": ["#sellerProfileTriggerId", "#bylineInfo"],
    },
    "walmart": {
        "title": ['h1[itemprop="name"]', "h1.prod-ProductTitle"],
        "price": ['[itemprop="price"]', ".price-characteristic"],
        "condition": ['[data-testid="condition"]'],
        "item_id": ['meta[name="product.itemId"]@content'],
        "seller": ['[data-testid="seller-name"]'],
    },
}
# What each field found adds to a listing's confidence.
WEIGHTS = {
    "ebay": {"title": 0.2, "price": 0.4, "sold_date": 0.2, "condition": 0.1, "item_id": 0.1},
    "amazon": {"title": 0.25, "price": 0.25, "available": 0.2, "item_id": 0.2, "seller": 0.1},
    "walmart": {"title": 0.3, "price": 0.35, "available": 0.15, "item_id": 0.2},
    "search": {"title": 0.3, "price": 0.4, "url": 0.2, "item_id": 0.1},
}
# Senders and the patterns of their order mails; patterns ignore case.
MAILS = {
    "amazon": (
        r"@amazon\.(com|co\.uk|de|fr|ca|com\.au)",
        {
            "order_id": r"order\s*#?\s*(\d{3}-\d{7}-\d{7})",
            "order_date": r"ordered\s+on\s+(\w+\s+\d{1,2},?\s+\d{4})",
            "total": r"order\s+total[:\s]*\$?\s*([\d,]+\.?\d*)",
            "shipping": r"shipping[:\s]*\$?\s*([\d,]+\.?\d*)",
            "tracking": r"tracking\s*(?:number|#)?[:\s]*([A-Z0-9]{10,30})",
        },
    ),
    "ebay": (
        r"@ebay\.(com|co\.uk|de|fr|ca|com\.au)",
        {
            "order_id": r"(?:order|transaction)\s*(?:number|#|id)?[:\s]*(\d{12,15})",
            "order_date": r"(?:purchased|ordered|sold)\s+(?:on\s+)?(\w+\s+\d{1,2},?\s+\d{4})",
            "total": r"(?:order\s+)?total[:\s]*\$?\s*([\d,]+\.?\d*)",
            "shipping": r"shipping[:\s]*\$?\s*([\d,]+\.?\d*)",
            "tracking": r"tracking\s*(?:number|#)?[:\s]*([A-Z0-9]{10,30})",
        },
    ),
    "walmart": (
        r"@walmart\.com",
        {
            "order_id": r"order\s*#?\s*(\d{10,15})",
            "order_date": r"ordered\s+(?:on\s+)?(\w+\s+\d{1,2},?\s+\d{4})",
            "total": r"total[:\s]*\$?\s*([\d,]+\.?\d*)",
            "shipping": r"shipping[:\s]*\$?\s*([\d,]+\.?\d*)",
            "tracking": r"tracking\s*(?:number|#)?[:\s]*([A-Z0-9]{10,30})",
        },
    ),
    "etsy": (
        r"@etsy\.com",
        {
            "order_id": r"order\s*#?\s*(\d{8,12})",
            "order_date": r"(?:ordered|purchased)\s+(?:on\s+)?(\w+\s+\d{1,2},?\s+\d{4})",
            "total": r"(?:order\s+)?total[:\s]*\$?\s*([\d,]+\.?\d*)",
            "shipping": r"shipping[:\s]*\$?\s*([\d,]+\.?\d*)",
        },
    ),
}
MAIL_CONFIDENCE = 0.85
SOLD = r"(?i)Sold\s+([A-Za-z]{3}\s+\d{1,2},?\s+\d{4})"
# Conditions by number.
CONDITION_IDS = {"1000": "new", "1500": "new", "2000": "refurbished", "3000": "used_good", "4000": "used_very_good"}


def shop(url: Column) -> Column:
    """The first shop whose host a URL has, or null: which cascade reads a page before any general extractor."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    out = F
    for name in CASCADES:
        out = out.when(host.contains(f"{name}."), name)
    return out.otherwise(F.lit(None).cast("string"))


def found_weight(kind: str, **has: Column) -> Column:
    """The confidence that the fields found are worth."""
    return sum((F.when(F.coalesce(has[f], F.lit(False)), w).otherwise(0.0) for f, w in WEIGHTS[kind].items() if f in has), F.lit(0.0))


def _day(text: Column) -> Column:
    """A date written `Mar 7, 2024`, the month in full or not, the comma or not."""
    plain = F.regexp_replace(text, r",?\s+", " ")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in ("MMM d yyyy", "MMMM d yyyy")]).cast("date")


def sold_date(text: Column) -> Column:
    return _day(F.regexp_extract(text, SOLD, 1))


def parse_listings(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep..., marketplace, title, amount, currency, condition, item_id, seller, sold_on, confidence) of each page of a
    known shop: all fields by that shop's cascade, in one projection."""
    rows = elements.with_elements(pages.withColumn("_shop", shop(F.col("url"))).filter("_shop IS NOT NULL"))

    def field(name: str) -> Column:
        out = F
        for s, fields in CASCADES.items():
            out = out.when(F.col("_shop") == s, elements.first_of(fields[name]))
        return out

    names = ["title", "price", "condition", "item_id", "seller"]
    rows = rows.select(*keep, "_shop", "html", *[field(n).alias(f"_{n}") for n in names])
    rows = rows.withColumns({"_p": listings.price(F.col("_price")), "sold_on": sold_date(F.col("html"))})
    has = {
        "title": F.col("_title").isNotNull(), "price": F.col("_p.amount").isNotNull(), "condition": F.col("_condition").isNotNull(),
        "item_id": F.col("_item_id").isNotNull(), "seller": F.col("_seller").isNotNull(), "sold_date": F.col("sold_on").isNotNull(),
        "available": F.coalesce(F.lower("html").contains("add to cart"), F.lit(False)),
    }
    sure = F
    for s in CASCADES:
        sure = sure.when(F.col("_shop") == s, found_weight(s, **has))
    return rows.select(
        *keep,
        F.col("_shop").alias("marketplace"),
        F.col("_title").alias("title"),
        F.col("_p.amount").alias("amount"),
        F.when(F.col("_p.amount").isNotNull(), F.col("_p.currency")).alias("currency"),
        listings.condition(F.col("_condition")).alias("condition"),
        F.regexp_extract("_item_id", r"[A-Z0-9]{6,}", 0).alias("item_id"),
        F.col("_seller").alias("seller"),
        "sold_on",
        F.round(sure, 6).alias("confidence"),
    )


def parse_search_results(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep..., place, title, amount, currency, sold_on, shipping, url, item_id, confidence): the entries of a page of
    search results, cards of the newer kind or else of the older one; those without title, price or link are left out."""
    rows = elements.with_elements(pages, texts=["li"]).withColumns({"_cards": elements.select("li.s-card"), "_older": elements.select("li.s-item")})
    found = elements.apart(F.when(F.size("_cards") > 0, F.col("_cards")).otherwise(F.col("_older")))
    rows = rows.select(*keep, F.explode(found).alias("_e")).select(*keep, "_e.*")
    link = F.get(F.filter("elements", lambda e: (e["tag"] == "a") & e["attrs"]["href"].contains("/itm/")), F.lit(0))["attrs"]["href"]
    rows = elements.settled(
        rows, [*keep, "place", F.col("flow").alias("text")],
        title=elements.first_of([".s-card__title span", ".s-card__title", ".s-item__title", '[role="heading"]']),
        price=elements.first_of([".s-card__price", ".s-item__price"]), shipping=elements.first_of([".s-card__shipping", ".s-item__shipping"]),
        url=F.coalesce(elements.first_of(["a.s-item__link@href"]), link),
    )
    rows = elements.settled(rows, [*keep, "place", "title", "url"], _p=listings.price(F.col("price")), sold_on=sold_date(F.col("text")), shipping=listings.shipping(F.col("shipping")))
    rows = rows.filter(F.col("title").isNotNull() & ~F.lower("title").contains("shop on ebay") & F.col("_p.amount").isNotNull() & F.col("url").isNotNull())
    item = F.nullif(F.regexp_extract("url", r"/itm/(\d+)", 1), F.lit(""))
    always = F.lit(True)
    return rows.select(
        *keep, "place", "title", F.col("_p.amount").alias("amount"), F.col("_p.currency").alias("currency"), "sold_on", "shipping", "url",
        item.alias("item_id"), F.round(found_weight("search", title=always, price=always, url=always, item_id=item.isNotNull()), 6).alias("confidence"),
    )


def parse_mails(mails: DataFrame, *keep: str) -> DataFrame:
    """(keep..., marketplace, order_id, order_date, total, shipping, tracking, confidence) of order mails (sender, body)
    of known senders; other mails are left out."""
    out = F
    for name, (sender, _) in MAILS.items():
        out = out.when(F.col("sender").rlike(f"(?i){sender}"), name)
    rows = mails.withColumn("marketplace", out.otherwise(F.lit(None).cast("string"))).filter("marketplace IS NOT NULL")

    def field(name: str) -> Column:
        got = F
        for shop_, (_, patterns) in MAILS.items():
            if name in patterns:
                got = got.when(F.col("marketplace") == shop_, F.nullif(F.regexp_extract("body", f"(?i){patterns[name]}", 1), F.lit("")))
        return got.otherwise(F.lit(None).cast("string"))

    def amount(name: str) -> Column:
        return F.replace(field(name), F.lit(","), F.lit("")).try_cast("double")

    day = _day(field("order_date"))
    return rows.select(
        *keep, "marketplace", field("order_id").alias("order_id"), day.alias("order_date"), amount("total").alias("total"),
        amount("shipping").alias("shipping"), field("tracking").alias("tracking"), F.lit(MAIL_CONFIDENCE).alias("confidence"),
    )


def items_from_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, item, title, amount, condition, shipping, sold_on) from (key, line_no, line): a line of more than 20
    characters that isn't a price begins an item; of the lines below it the first price, and the last of all else count.

    Items are runs of a running count, so a text of any length needs no loop; items without a price are left out.
    """
    x = F.trim("line")
    begins = (F.length(x) > 20) & ~x.startswith("$")
    rows = lines.filter(F.length(x) > 0).select(key, "line_no", x.alias("x"), begins.alias("b"))
    rows = rows.withColumn("item", F.sum(F.col("b").cast("int")).over(W.partitionBy(key).orderBy("line_no"))).filter("item > 0")
    dollars = F.nullif(F.regexp_extract("x", r"\$([\d,]+\.?\d*)", 1), F.lit(""))
    amount = F.nullif(F.replace(dollars, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
    word = F
    for w in ("new", "used", "refurbished", "parts"):
        word = word.when(F.col("x").rlike(rf"(?i)\b{w}\b"), w)
    ship = F.nullif(F.regexp_extract("x", r"(?i)\$([\d.]+)\s*shipping", 1), F.lit("")).try_cast("double")

    def pick(value: Column, by) -> Column:
        return by(F.when(~F.col("b"), value), F.when(~F.col("b") & value.isNotNull(), F.col("line_no")))

    items = rows.groupBy(key, "item").agg(
        F.max(F.when(F.col("b"), F.col("x"))).alias("title"),
        pick(amount, F.min_by).alias("amount"),
        F.coalesce(pick(word.otherwise(F.lit(None).cast("string")), F.max_by), F.lit("unknown")).alias("condition"),
        pick(ship, F.max_by).alias("shipping"),
        pick(sold_date(F.col("x")), F.max_by).alias("sold_on"),
    )
    return items.filter("amount > 0")


def _plain(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def cross_check(rows: DataFrame, scraped: dict[str, str], structured: dict[str, str]) -> dict[str, Column]:
    """Fields (title, price, seller) that a listing and the page's structured data agree on, those they don't, and what
    that does to its confidence: 0.05 for each of the first, minus 0.03 for each of the second, 0.15 at most."""

    def pair(name: str) -> tuple[Column, Column]:
        return F.col(scraped[name]), F.col(structured[name])

    (t, u), (p, q), (s, r) = pair("title"), pair("price"), pair("seller")
    alike = _plain(t).contains(_plain(u)) | _plain(u).contains(_plain(t))
    near = F.abs(p - q) <= F.greatest(p * 0.01, F.lit(0.01))
    agreed = F.array_compact(F.array(F.when(alike, "title"), F.when(near, "price"), F.when(_plain(s) == _plain(r), "seller")))
    against = F.array_compact(F.array(F.when(~alike, "title"), F.when(~near, "price")))
    change = F.least(F.size(agreed) * 0.05 - F.size(against) * 0.03, F.lit(0.15))
    return {"agreed": F.array_join(agreed, ","), "conflicts": F.array_join(against, ","), "change": change}


def advice(p25: Column, p75: Column, median: Column, mean: Column, new: Column, used: Column, deals: Column, trend: Column, change: Column) -> Column:
    """What a buyer is told, in order: the usual range, skew, what used saves, deals, and where prices go."""

    def money(x: Column) -> Column:
        return F.format_string("%.2f", x)

    saves = (new - used) / new * 100
    return F.array_compact(
        F.array(
            F.concat(F.lit("Typical price range: $"), money(p25), F.lit(" - $"), money(p75)),
            F.when(F.abs(median - mean) > mean * 0.1, F.concat(F.lit("Price distribution is skewed. Focus on median ($"), money(median), F.lit(") rather than average."))),
            F.when(new.isNotNull() & used.isNotNull(), F.concat(F.lit("Buying used saves ~"), F.format_string("%.0f", saves), F.lit("% (avg $"), money(used), F.lit(" vs $"), money(new), F.lit(" new)"))),
            F.when(deals > 0, F.concat(F.lit("Found "), deals.cast("string"), F.lit(" deals below market average!"))),
            F.when(trend == "up", F.concat(F.lit("Prices trending UP (+"), F.format_string("%.1f", change), F.lit("%). Consider buying soon."))).when(
                trend == "down", F.concat(F.lit("Prices trending DOWN ("), F.format_string("%.1f", change), F.lit("%). May be worth waiting."))
            ),
        )
    )
