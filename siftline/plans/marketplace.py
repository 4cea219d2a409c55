"""Queries on listings as shops show them. Pages, search results, mails and texts are written from `part`, `lineitem` and
`orders`, read back by the operators, and held against the tables themselves by the SQL."""

from pyspark.sql import functions as F

from siftline.functions import running
from siftline.operators import listings, marketplace as market, pricing
from siftline.plans.extraction import dealt, table

#: Entries on a page of results.
PAGE = 500


def _k():
    return F.col("p_partkey")


def _price():
    return F.format_number("p_retailprice", 2)


def _part(spark, sf_dir):
    condition = F.element_at(F.array(*map(F.lit, ("Brand New", "Used - Very Good", "Certified Refurbished", "For parts"))), (_k() % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").withColumns({"condition": condition, "seller": F.concat(F.lit("Seller "), "p_brand")})


def _listing_pages(spark, sf_dir):
    title, item = F.concat("p_name", F.lit(" "), "p_brand"), F.concat(F.lit("90000000"), _k().cast("string"))
    missing = F.when(_k() % 6 == 1, "").otherwise(_price())
    sold = F.when(_k() % 5 == 0, " Sold Mar 7, 2024 ").otherwise("")
    ebay = F.concat(
        F.lit('<html><h1 class="x-item-title__mainTitle big">\n  '), title, F.lit(' </h1><div class="x-price-primary">US $'), missing,
        F.lit('</div><span class="x-item-condition-text">'), "condition", F.lit('</span><i data-testid="ux-item-number">'), item,
        F.lit('</i><div class="x-sellercard-atf__info__about-seller"><a href="/s">'), "seller", F.lit("</a></div>"), sold, F.lit("</html>"),
    )
    amazon = F.concat(
        F.lit('<html><span id="productTitle">'), title, F.lit('</span><span class="a-price"><span class="a-offscreen">£'), missing,
        F.lit('</span></span><input type="hidden" name="ASIN" value="'), item, F.lit('"/><a id="bylineInfo">'), "seller", F.lit("</a><b>Add to Cart</b></html>"),
    )
    walmart = F.concat(
        F.lit('<html><meta name="product.itemId" content="'), item, F.lit('"><h1 class="prod-ProductTitle">'), title, F.lit('</h1><span itemprop="price">€'), missing,
        F.lit('</span><p data-testid="condition">'), "condition", F.lit("</p></html>"),
    )
    k = _k() % 4
    url = F.concat(F.when(k == 0, "https://www.ebay.com/itm/").when(k == 1, "https://amazon.co.uk/dp/").when(k == 2, "https://www.walmart.com/ip/").otherwise("https://other.example/"), item)
    return _part(spark, sf_dir).select("p_partkey", url.alias("url"), F.when(k == 0, ebay).when(k == 1, amazon).otherwise(walmart).alias("html"))


def parsed_listings(spark, sf_dir):
    out = market.parse_listings(_listing_pages(spark, sf_dir), "p_partkey")
    return out.withColumn("sold_on", F.col("sold_on").cast("string"))


def search_results(spark, sf_dir):
    """Results for each brand on pages of 500: cards for brands with an even number, older items for the rest. Places count
    on from page to page."""
    new = F.substring("p_brand", -1, 1).cast("int") % 2 == 0
    item = F.when(
        new,
        F.concat(
            F.lit('<li class="s-card s-card--x"><div class="s-card__title"><span>'), "p_name", F.lit('</span></div><span class="s-card__price">$'), F.when(_k() % 9 > 0, _price()).otherwise(""),
            F.lit('</span><em class="s-card__shipping">'), F.when(_k() % 2 == 0, "Free shipping").otherwise("+$4.50 delivery"), F.lit('</em><a href="https://x.example/itm/'), _k(), F.lit('?h=1">go</a></li>'),
        ),
    ).otherwise(
        F.concat(
            F.lit('<li class="s-item"><a class="s-item__link" href="https://x.example/itm/'), _k(), F.lit('">x</a><h3 class="s-item__title">'), F.when(_k() % 8 > 0, F.col("p_name")).otherwise("Shop on eBay"),
            F.lit('</h3><b class="s-item__price">$'), _price(), F.lit("</b><i>Sold  Jan 15, 2024</i></li>"),
        )
    )
    entries = F.array_sort(F.collect_list(F.struct(_k().alias("k"), item.alias("x"))))
    parts = running.totals(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_retailprice"), ["p_brand"], ["p_partkey"], no=F.lit(1))
    parts = dealt(parts.withColumn("page", F.floor(F.col("no") / PAGE).cast("int")), "p_brand", "page")
    pages = parts.groupBy("p_brand", "page").agg(entries.alias("e"))
    html = F.concat(F.lit('<ul class="srp-results">'), F.array_join(F.transform("e", lambda e: e["x"]), "\n"), F.lit("</ul>"))
    out = market.parse_search_results(pages.select("p_brand", "page", html.alias("html")), "p_brand", "page")
    return out.withColumns({"sold_on": F.col("sold_on").cast("string"), "place": F.col("page") * PAGE + F.col("place")}).drop("page")


def order_mails(spark, sf_dir):
    k = F.col("o_orderkey")
    sender = F.element_at(F.array(*map(F.lit, ("a@amazon.com", "b@ebay.co.uk", "Shop <c@WALMART.com>", "d@etsy.com", "e@other.org"))), (k % 5 + 1).cast("int"))
    number = F.when(k % 5 == 0, F.concat(F.lit("111-2222222-"), F.lpad((k % 10000000).cast("string"), 7, "0"))).otherwise(F.lpad(k.cast("string"), 12, "9"))
    total = F.format_number("o_totalprice", 2)
    body = F.concat(
        F.lit("Hello,\nOrder # "), number, F.lit("\nordered on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("\nShipping: $3.50\nOrder total: $"), total,
        F.when(k % 3 == 0, "\nTracking number: 1Z999AA10123456784").otherwise(""),
    )
    mails = table(spark, sf_dir, "orders").select("o_orderkey", sender.alias("sender"), body.alias("body"))
    out = market.parse_mails(mails, "o_orderkey")
    return out.withColumn("order_date", F.col("order_date").cast("string"))


def text_items(spark, sf_dir):
    """Items of a text for each brand: a title line, then price, date, condition and shipping in lines of their own."""
    lines = F.array(
        F.concat(F.lit("Listing of the product "), "p_name"),
        F.concat(F.lit("$"), F.when(_k() % 7 > 0, _price()).otherwise("0")),
        F.when(_k() % 2 == 0, "Sold Feb 3, 2024"),
        F.when(_k() % 3 == 0, "used, good").when(_k() % 3 == 1, "NEW in box"),
        F.when(_k() % 4 == 0, "+ $5.25 shipping"),
        F.lit("  "),
    )
    rows = table(spark, sf_dir, "part").select("p_brand", (_k() * 10).alias("_base"), F.posexplode(lines).alias("_i", "line")).filter("line IS NOT NULL")
    out = market.items_from_lines(rows.select("p_brand", (F.col("_base") + F.col("_i")).alias("line_no"), "line"), "p_brand")
    return out.select("p_brand", F.col("item").cast("long").alias("item"), "title", "amount", "condition", "shipping", F.col("sold_on").cast("string").alias("sold_on"))


def checked_listings(spark, sf_dir):
    """Listings against the JSON-LD of their pages, which has other prices and titles now and then."""
    json = F.to_json(
        F.struct(
            F.lit("Product").alias("@type"),
            F.when(_k() % 4 == 0, F.concat(F.lit("Not "), "p_brand")).otherwise(F.concat(F.upper("p_name"), F.lit("!"))).alias("name"),
            F.struct((F.col("p_retailprice") * F.when(_k() % 3 == 0, 1.2).otherwise(1.005)).alias("price")).alias("offers"),
            F.struct(F.concat(F.lit("seller  "), "p_brand").alias("name")).alias("seller"),
        )
    )
    rows = _part(spark, sf_dir).select("p_partkey", "p_name", "p_retailprice", "seller", json.alias("j"))
    rows = rows.withColumns(
        {
            "_t": F.get_json_object("j", "$.name"),
            "_p": F.get_json_object("j", "$.offers.price").cast("double"),
            "_s": F.get_json_object("j", "$.seller.name"),
        }
    )
    out = market.cross_check(rows, {"title": "p_name", "price": "p_retailprice", "seller": "seller"}, {"title": "_t", "price": "_p", "seller": "_s"})
    return rows.select("p_partkey", out["agreed"].alias("agreed"), out["conflicts"].alias("conflicts"), F.round(out["change"], 6).alias("change"))


def price_advice(spark, sf_dir):
    """Advice for each brand: used parts cost what new ones cost, divided by their size."""
    rows = _part(spark, sf_dir).withColumn("price", F.round(F.col("p_retailprice") / F.when(_k() % 4 == 1, F.col("p_size")).otherwise(1), 2))
    stats = pricing.statistics(rows, "price", "p_brand").select("p_brand", "p25", "p75", "median", "mean")
    kind = rows.groupBy("p_brand").agg(F.avg(F.when(_k() % 4 == 0, F.col("price"))).alias("new"), F.avg(F.when(_k() % 4 == 1, F.col("price"))).alias("used"))
    low = rows.join(stats.select("p_brand", F.col("mean").alias("_m")), "p_brand").groupBy("p_brand").agg(F.count_if(F.col("price") < F.col("_m") * 0.85).alias("deals"))
    both = stats.join(kind, "p_brand").join(low, "p_brand")
    change = F.round(F.col("p75") % 20 - 10, 6)
    way = F.when(change > 5, "up").when(change < -5, "down").otherwise("stable")
    args = [F.col(c) for c in ("p25", "p75", "median", "mean", "new", "used", "deals")]
    return both.select("p_brand", F.array_join(market.advice(*args, way, change), "\n").alias("advice"))


def listing_fields(spark, sf_dir):
    """Shipping, condition (by words and by number) and sold date, as listings spell them."""
    ship = F.when(_k() % 3 == 0, "FREE delivery").when(_k() % 3 == 1, F.concat(F.lit("+$"), _price(), F.lit(" shipping"))).otherwise("ask seller")
    code = F.element_at(F.array(*map(F.lit, ("1000", "1500", "2000", "3000", "4000", "7000"))), (_k() % 6 + 1).cast("int"))
    named = F
    for i, name in market.CONDITION_IDS.items():
        named = named.when(code == i, name)
    day = F.concat(F.lit("Sold "), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")), "MMM d, yyyy"), F.lit(" to you"))
    return _part(spark, sf_dir).select(
        "p_partkey", listings.shipping(ship).alias("shipping"), listings.condition(F.col("condition")).alias("condition"),
        named.otherwise("unknown").alias("condition_by_id"), market.sold_date(F.when(_k() % 2 == 0, day)).cast("string").alias("sold_on"),
    )


QUERIES = {
    f.__name__: f
    for f in (parsed_listings, search_results, order_mails, text_items, checked_listings, price_advice, listing_fields)
}

_COND = "['new', 'used_very_good', 'refurbished', 'unknown'][p_partkey % 4 + 1]"
_AMOUNT = "CASE WHEN p_partkey % 6 <> 1 THEN round(p_retailprice, 2) END"
_CHECK = """x AS (SELECT p_partkey, p_partkey % 4 = 0 AS other_title, abs(p_retailprice - p_retailprice * CASE WHEN p_partkey % 3 = 0 THEN 1.2::DOUBLE ELSE 1.005::DOUBLE END) > greatest(p_retailprice * 0.01, 0.01) AS other_price FROM part)"""
_MONEY = "printf('%.2f', {})"
ORACLE_SQL = {
    "parsed_listings": f"""WITH x AS (SELECT *, p_partkey % 4 AS k, {_AMOUNT} AS amount FROM part WHERE p_partkey % 4 <> 3)
SELECT p_partkey, ['ebay', 'amazon', 'walmart'][k + 1] AS marketplace, p_name || ' ' || p_brand AS title, amount, CASE WHEN amount IS NOT NULL THEN ['USD', 'GBP', 'EUR'][k + 1] END AS currency,
  CASE WHEN k = 1 THEN 'unknown' ELSE {_COND} END AS condition, '90000000' || p_partkey AS item_id, CASE WHEN k < 2 THEN 'Seller ' || p_brand END AS seller,
  CASE WHEN k = 0 AND p_partkey % 5 = 0 THEN '2024-03-07' END AS sold_on,
  round(CASE k WHEN 0 THEN 0.2 + CASE WHEN amount IS NULL THEN 0 ELSE 0.4 END + CASE WHEN p_partkey % 5 = 0 THEN 0.2 ELSE 0 END + 0.2
    WHEN 1 THEN 0.75 + CASE WHEN amount IS NULL THEN 0 ELSE 0.25 END ELSE 0.5 + CASE WHEN amount IS NULL THEN 0 ELSE 0.35 END END::DOUBLE, 6) AS confidence FROM x""",
    "search_results": """WITH x AS (SELECT *, right(p_brand, 1)::INTEGER % 2 = 0 AS card, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS place FROM part)
SELECT p_brand, place, p_name AS title, round(p_retailprice, 2) AS amount, 'USD' AS currency, CASE WHEN NOT card THEN '2024-01-15' END AS sold_on,
  CASE WHEN card THEN CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE 4.5 END END::DOUBLE AS shipping, 'https://x.example/itm/' || p_partkey || CASE WHEN card THEN '?h=1' ELSE '' END AS url,
  p_partkey::VARCHAR AS item_id, 1.0::DOUBLE AS confidence FROM x WHERE CASE WHEN card THEN p_partkey % 9 > 0 ELSE p_partkey % 8 > 0 END""",
    "order_mails": """SELECT o_orderkey, ['amazon', 'ebay', 'walmart', 'etsy'][o_orderkey % 5 + 1] AS marketplace,
  CASE WHEN o_orderkey % 5 = 0 THEN '111-2222222-' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') ELSE lpad(o_orderkey::VARCHAR, 12, '9') END AS order_id,
  o_orderdate::DATE::VARCHAR AS order_date, round(o_totalprice, 2) AS total, 3.5::DOUBLE AS shipping,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 3 THEN '1Z999AA10123456784' END AS tracking, 0.85::DOUBLE AS confidence FROM orders WHERE o_orderkey % 5 <> 4""",
    "text_items": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS item FROM part)
SELECT p_brand, item, 'Listing of the product ' || p_name AS title, CASE WHEN p_partkey % 7 > 0 THEN round(p_retailprice, 2) ELSE 5.25 END::DOUBLE AS amount, CASE p_partkey % 3 WHEN 0 THEN 'used' WHEN 1 THEN 'new' ELSE 'unknown' END AS condition,
  CASE WHEN p_partkey % 4 = 0 THEN 5.25::DOUBLE END AS shipping, CASE WHEN p_partkey % 2 = 0 THEN '2024-02-03' END AS sold_on FROM x
WHERE p_partkey % 7 > 0 OR p_partkey % 4 = 0""",
    "checked_listings": f"""WITH {_CHECK}
SELECT p_partkey, concat_ws(',', CASE WHEN NOT other_title THEN 'title' END, CASE WHEN NOT other_price THEN 'price' END, 'seller') AS agreed,
  concat_ws(',', CASE WHEN other_title THEN 'title' END, CASE WHEN other_price THEN 'price' END) AS conflicts,
  round(least((3 - other_title::INTEGER - other_price::INTEGER) * 0.05 - (other_title::INTEGER + other_price::INTEGER) * 0.03, 0.15)::DOUBLE, 6) AS change FROM x""",
    "price_advice": f"""WITH x AS (SELECT *, round(p_retailprice / CASE WHEN p_partkey % 4 = 1 THEN p_size ELSE 1 END, 2) AS price FROM part),
s AS (SELECT p_brand, quantile_disc(price, 0.25) AS p25, quantile_disc(price, 0.75) AS p75, median(price) AS median, avg(price) AS mean,
  avg(price) FILTER (p_partkey % 4 = 0) AS new, avg(price) FILTER (p_partkey % 4 = 1) AS used FROM x GROUP BY 1),
d AS (SELECT p_brand, count(*) FILTER (price < mean * 0.85) AS deals FROM x JOIN s USING (p_brand) GROUP BY 1),
c AS (SELECT *, round(p75 % 20 - 10, 6) AS change FROM s JOIN d USING (p_brand))
SELECT p_brand, concat_ws(chr(10), 'Typical price range: $' || {_MONEY.format("p25")} || ' - $' || {_MONEY.format("p75")},
  CASE WHEN abs(median - mean) > mean * 0.1 THEN 'Price distribution is skewed. Focus on median ($' || {_MONEY.format("median")} || ') rather than average.' END,
  CASE WHEN new IS NOT NULL AND used IS NOT NULL THEN 'Buying used saves ~' || printf('%.0f', (new - used) / new * 100) || '% (avg $' || {_MONEY.format("used")} || ' vs $' || {_MONEY.format("new")} || ' new)' END,
  CASE WHEN deals > 0 THEN 'Found ' || deals || ' deals below market average!' END,
  CASE WHEN change > 5 THEN 'Prices trending UP (+' || printf('%.1f', change) || '%). Consider buying soon.' WHEN change < -5 THEN 'Prices trending DOWN (' || printf('%.1f', change) || '%). May be worth waiting.' END) AS advice FROM c""",
    "listing_fields": f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN round(p_retailprice, 2) END AS shipping, {_COND} AS condition,
  ['new', 'new', 'refurbished', 'used_good', 'used_very_good', 'unknown'][p_partkey % 6 + 1] AS condition_by_id,
  CASE WHEN p_partkey % 2 = 0 THEN (DATE '2024-01-01' + p_size::INTEGER)::VARCHAR END AS sold_on FROM part""",
}
