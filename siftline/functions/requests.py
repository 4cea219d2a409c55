"""What a request is checked and keyed by: addresses, schemes, cache keys, templates, search URLs, kinds of content."""

from pyspark.sql import Column, functions as F

_OCTETS = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"
V4 = rf"^{_OCTETS}$"

# Kinds of content by what a text holds, in order; marketplaces by name, in order.
MARKETPLACES = ("ebay", "amazon", "walmart", "etsy")


def is_v6(x: Column) -> Column:
    """Eight groups of hex digits, or fewer around one `::`; the last two may be written as an IPv4 address."""
    y = F.regexp_replace(F.lower(x), rf"(?<=:){_OCTETS}$", "0:0")
    groups = F.split(y, ":")
    filled = F.size(F.filter(groups, lambda g: g != ""))
    short = y.contains("::")
    form = y.rlike("^[0-9a-f:]+$") & ~y.rlike("[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$")
    return form & F.when(short, filled <= 7).otherwise((filled == 8) & (F.size(groups) == 8))


def private_ip(ip: Column) -> Column:
    """Whether an address is of a private, loopback, link-local or unspecified range; what is no address counts as such.

    IPv4 addresses written as IPv6 (::ffff:a.b.c.d) are judged as IPv4.
    """
    x = F.lower(ip)
    mapped = F.substring(x, 8, 64)
    v4 = F.when(x.startswith("::ffff:") & mapped.rlike(V4), mapped).when(x.rlike(V4), x)
    parts = F.split(v4, r"\.")
    a, b = F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")
    inside = a.isin(0, 127, 10) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168) | (a == 169) & (b == 254)
    own6 = (x == "::1") | x.rlike("^(fc|fd|fe80|fe9|fea|feb)")
    return F.coalesce(F.when(v4.isNotNull(), inside).when(is_v6(x), own6), F.lit(True))


def blocked(url: Column, blocked_hosts: list[str], allowed_hosts: list[str]) -> Column:
    """Why a request to a URL isn't let through: null if it is, `resolve` if only its name's addresses can tell.

    Addresses that a name resolves to are judged by `private_ip` once the caller has them.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    return (
        F.when((scheme == "") | (scheme.isin("http", "https") & (host == "")), "invalid")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host.isin(*blocked_hosts), "host")
        .when(host.isin(*allowed_hosts), F.lit(None).cast("string"))
        .when(host == "localhost", "localhost")
        .when(bare.rlike(V4) | is_v6(bare), F.when(private_ip(bare), "private"))
        .when(host.startswith("["), "invalid")
        .otherwise("resolve")
    )


def cache_key(query: Column, params: Column, prefix: str = "query:") -> Column:
    """Equal for queries that differ in case or outer spaces, and for maps of parameters in any order."""
    entries = F.array_sort(F.map_entries(params))
    pairs = F.transform(entries, lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(e["key"]) + 2), F.lit(":"), F.lit('"'), e["value"], F.lit('"')))
    text = F.when(params.isNull(), "").otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lower(F.trim(query)), text), 256), 1, 16))


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    """`{{name}}` becomes the value of that name; names without a value become nothing."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.regexp_replace(out, r"\{\{\w+\}\}", "")


def content_kind(text: Column) -> Column:
    """html, email, pdf_text, ocr_text or unknown."""
    return (
        F.when(text.contains("<html") | text.contains("<!DOCTYPE"), "html")
        .when(text.contains("From:") & text.contains("Subject:") & text.contains("order"), "email")
        .when(text.contains("%PDF") | text.contains("Invoice") | text.contains("Receipt"), "pdf_text")
        .when(text.rlike(r"\s{3,}") | text.rlike("[A-Z]{10,}"), "ocr_text")
        .otherwise("unknown")
    )


def marketplace(text: Column, source: Column) -> Column:
    both = F.lower(F.concat(F.coalesce(text, F.lit("")), F.coalesce(source, F.lit(""))))
    out = F
    for name in MARKETPLACES:
        out = out.when(both.contains(name), name)
    return out.otherwise(F.lit(None).cast("string"))


def search_url(base: str, query: Column, **options: tuple[str, Column]) -> Column:
    """`base?q=...`: the query percent-encoded with + for spaces, then each option (name, value) that isn't null."""
    pairs = [F.concat(F.lit("_nkw="), F.url_encode(query))]
    pairs += [F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value.cast("string"))) for name, value in options.values()]
    return F.concat(F.lit(f"{base}?"), F.array_join(F.array_compact(F.array(*pairs)), "&"))


def search_terms(url: Column) -> dict[str, Column]:
    """What a search URL asks for: the query, whether for sold items, price bounds, page."""

    def value(name: str) -> Column:
        return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))

    return {
        "query": F.url_decode(value("_nkw")),
        "sold": (value("LH_Sold") == "1") | (value("LH_Complete") == "1"),
        "min_price": value("_udlo").try_cast("double"),
        "max_price": value("_udhi").try_cast("double"),
        "page": F.coalesce(value("_pgn").try_cast("int"), F.lit(1)),
    }
