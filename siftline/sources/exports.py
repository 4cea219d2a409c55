"""Order and listing exports (CSV), order e-mails, URL lists, sitemaps and robots files as DataFrames."""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Headers that exports use for each field, in order of preference.
ORDER_FIELDS = {
    "order_id": ["Order ID", "Order Number", "order-id"],
    "ordered_on": ["Order Date", "Sale Date", "Purchase Date"],
    "title": ["Item Name", "Item Title", "Title"],
    "item_id": ["ASIN", "Item Number"],
    "price": ["Item Price", "Sale Price", "Price"],
    "quantity": ["Quantity"],
    "seller": ["Seller", "Buyer Username"],
    "condition": ["Condition"],
}
LISTING_FIELDS = {
    "item_id": ["Item Number", "Item ID"],
    "title": ["Title", "Item Title"],
    "price": ["Current Price", "Start Price", "Sold For", "Buy It Now Price"],
    "quantity": ["Available Quantity", "Quantity", "Quantity Sold"],
    "listed_on": ["Start Date"],
    "ended_on": ["End Date"],
    "condition": ["Condition"],
    "category": ["Category", "Store Category"],
    "image": ["Picture URL"],
    "url": ["View Item URL"],
}
LISTING_MARKS = ("Start Price", "Current Price", "Format")
ORDER_MARKS = ("Sales Record Number", "Order Number", "Order ID")
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "d-MMM-yy", "d-MMM-yyyy")


def export_kind(columns: list[str]) -> str:
    """orders, listings or unknown, by the headers there are."""
    if any(c in columns for c in ORDER_MARKS):
        return "orders"
    return "listings" if any(c in columns for c in LISTING_MARKS) else "unknown"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any export: a header, quoted fields, rows of odd length kept; values trimmed, all strings."""
    options = {"header": True, "mode": "PERMISSIVE", "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    return spark.read.options(**options).csv(path)


def first_of(df: DataFrame, names: list[str]) -> Column:
    """The first filled column of these; null where none exists."""
    there = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(None).cast("string"))


def date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def amount(text: Column) -> Column:
    digits = F.replace(F.regexp_extract(text, r"([\d,]+\.?\d*)", 1), F.lit(","), F.lit(""))
    return digits.try_cast("double")


def currency(text: Column) -> Column:
    return F.when(text.contains("£"), "GBP").when(text.contains("€"), "EUR").when(text.isNotNull(), "USD")


def orders(raw: DataFrame) -> DataFrame:
    """One row for each line of an order export, whatever its headers; `errors` names what can't be read."""
    f = {name: first_of(raw, names) for name, names in ORDER_FIELDS.items()}
    rows = raw.select(
        f["order_id"].alias("order_id"), date(f["ordered_on"]).alias("ordered_on"), f["title"].alias("title"), f["item_id"].alias("item_id"),
        amount(f["price"]).alias("price"), currency(f["price"]).alias("currency"),
        F.coalesce(f["quantity"].try_cast("int"), F.lit(1)).alias("quantity"), f["seller"].alias("seller"), f["condition"].alias("condition"),
    )
    errors = F.array_compact(F.array(*[F.when(F.col(c).isNull(), f"missing {c}") for c in ("order_id", "title", "price")]))
    return rows.withColumn("errors", errors)


def listed(raw: DataFrame) -> DataFrame:
    """One row for each line of a listing export; a listing without an address gets that of its number."""
    f = {name: first_of(raw, names) for name, names in LISTING_FIELDS.items()}
    rows = raw.select(
        f["item_id"].alias("item_id"), f["title"].alias("title"), amount(f["price"]).alias("price"), currency(f["price"]).alias("currency"),
        F.coalesce(f["quantity"].try_cast("int"), F.lit(1)).alias("quantity"), date(f["listed_on"]).alias("listed_on"), date(f["ended_on"]).alias("ended_on"),
        f["condition"].alias("condition"), f["category"].alias("category"), f["image"].alias("image"),
        F.coalesce(f["url"], F.concat(F.lit("https://www.ebay.com/itm/"), f["item_id"])).alias("url"),
    )
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.col(c).isNull(), f"missing {c}") for c in ("item_id", "title", "price")])))


def read_export(raw: DataFrame) -> tuple[str, DataFrame]:
    """(kind, rows) of an export by its headers; an unknown one is read as orders, as most columns are theirs."""
    kind = export_kind(raw.columns)
    return kind, listed(raw) if kind == "listings" else orders(raw)


def write_emails(messages: DataFrame, path: str) -> None:
    """Each row of `messages`, a raw message, as a file of its own in a new folder.

    A file costs far more than its bytes, so rows should be dealt over all cores; tasks move their own files into place.
    Local files are written without checksum files, which would be four files' work and a `chmod` process for each.
    """
    plain = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": True}
    messages.write.options(**plain, **{"mapreduce.fileoutputcommitter.algorithm.version": 2}, maxRecordsPerFile=1).text(path)


def emails(spark: SparkSession, path: str) -> DataFrame:
    """(path, sender, recipient, subject, sent, body) of raw messages, one file each. Headers end at the first blank line."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("m"))
    rows = rows.withColumn("head", F.split("m", "\n\n", 2)[0])

    def header(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("head", rf"(?mi)^{name}:\s*(.+?)$", 1)), F.lit(""))

    body = F.regexp_extract("m", r"(?s)^.*?\n\n(.*)$", 1)
    return rows.select("path", header("From").alias("sender"), header("To").alias("recipient"), header("Subject").alias("subject"), header("Date").alias("sent"), body.alias("body"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and lines that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> '' AND NOT url LIKE '#%'")


def sitemap_urls(rows: DataFrame, xml: str) -> DataFrame:
    """The pages of <url><loc> entries."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<url>\s*<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return rows.select(F.explode(found).alias("url"))


def sitemap(files: DataFrame, at: str, xml: str, start: str) -> DataFrame:
    """(url): pages of the files whose address ends in `start`, and of the maps those name if they are an index (one
    level, as an index doesn't name others)."""
    named = F.regexp_extract_all(xml, F.lit(r"(?is)<sitemap>\s*<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    first = files.filter(F.col(at).endswith(start))
    listed = first.select(F.explode(named).alias("_at")).distinct()
    further = files.join(listed, F.col(at) == F.col("_at"), "left_semi")
    return sitemap_urls(first, xml).union(sitemap_urls(further, xml))


def crawl_delays(rows: DataFrame, origin: str, text: str, agent: str) -> DataFrame:
    """(origin, delay): seconds between requests that a robots file asks of an agent, or else of all; null if none."""
    lines = rows.select(origin, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "_l"))
    key, value = F.lower(F.trim(F.split_part("_l", F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace("_l", "^[^:]*:|#.*$", ""))
    lines = lines.withColumns({"_k": key, "_v": value})
    by = W.partitionBy(origin).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("_a", F.last(F.when(F.col("_k") == "user-agent", F.lower("_v")), ignorenulls=True).over(by))
    delay = F.when(F.col("_k") == "crawl-delay", F.col("_v").try_cast("double"))
    mine, every = (F.max(F.when(F.col("_a") == a, delay)) for a in (agent.lower(), "*"))
    return lines.groupBy(origin).agg(F.coalesce(mine, every).alias("delay"))


def merge_fetches(new: DataFrame, cached: DataFrame) -> DataFrame:
    """`new` (url, status, body, ...) with the bodies of `cached` (url, body) where a page hasn't changed (304), and
    `from_cache`. `cached` has a URL once."""
    held = cached.select(F.col("url").alias("_url"), F.col("body").alias("_body"))
    rows = new.join(held, F.col("url") == F.col("_url"), "left")
    same = (F.col("status") == 304) & F.col("_url").isNotNull()
    body = F.when(same, F.col("_body")).otherwise(F.col("body"))
    return rows.withColumns({"body": body, "from_cache": same}).drop("_url", "_body")


def robots_rules(rows: DataFrame, origin: str, text: str) -> DataFrame:
    """(origin, agent, line_no, allow, prefix): the rules of each user agent, comments dropped."""
    lines = rows.select(origin, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "_l"))
    lines = lines.withColumn("_l", F.trim(F.regexp_replace("_l", "#.*$", "")))
    key, value = F.lower(F.trim(F.split_part("_l", F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace("_l", "^[^:]*:", ""))
    lines = lines.withColumns({"_k": key, "_v": value})
    by = W.partitionBy(origin).orderBy("line_no")
    agent = F.last(F.when(F.col("_k") == "user-agent", F.lower("_v")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    rules = lines.withColumn("agent", agent).filter(F.col("_k").isin("allow", "disallow") & (F.col("_v") != ""))
    return rules.select(origin, "agent", "line_no", (F.col("_k") == "allow").alias("allow"), F.col("_v").alias("prefix"))


def allowed(urls: DataFrame, rules: DataFrame, agent: str, origin: str = "origin", path: str = "path") -> DataFrame:
    """Add `allowed`: the longest matching prefix decides, allow wins ties, and what no rule matches is allowed.

    An agent without rules of its own follows those of *.
    """
    mine = rules.filter(F.col("agent").isin(agent.lower(), "*"))
    own = W.partitionBy(origin)
    mine = mine.withColumn("_own", F.max((F.col("agent") == agent.lower()).cast("int")).over(own))
    mine = mine.filter((F.col("agent") == agent.lower()) | (F.col("_own") == 0)).groupBy(F.col(origin).alias("_o"))
    mine = mine.agg(F.collect_set(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("_rules"))
    both = urls.join(mine, F.col(origin) == F.col("_o"), "left")
    hit = F.filter("_rules", lambda r: F.startswith(F.col(path), r["prefix"]))
    best = F.array_max(hit)
    return both.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_o", "_rules")
