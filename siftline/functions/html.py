"""Regular-expression views of HTML, for what needs no parser."""

from pyspark.sql import Column, functions as F

# Patterns that mark a page as a bot challenge or a log-in wall, in order; the first match counts.
CHALLENGES = [
    ("captcha", "captcha"),
    ("verify you are human", "human_verification"),
    ("are you a robot", "robot_check"),
    ("access denied", "access_denied"),
    ("perimeterx", "perimeterx"),
    ("please enable javascript", "javascript_required"),
    ("unusual traffic", "unusual_traffic"),
    ("challenge-form", "cloudflare_challenge"),
    ("checking your browser", "cloudflare_check"),
    ("security check", "security_check"),
    ("automated requests", "automated_detection"),
]
WALLS = [
    (r"sign\s*in\s+to\s+(view|read|access|continue)", "sign_in_required"),
    (r"log\s*in\s+to\s+(view|read|access|continue)", "login_required"),
    (r"sign\s*up\s+to\s+(view|read|access|continue|unlock)", "signup_required"),
    (r"subscribe\s+to\s+(read|view|access|unlock|continue)", "paywall"),
    ("authwall", "linkedin_authwall"),
    (r"join\s+linkedin", "linkedin_join"),
    (r"sign\s+in.*linkedin", "linkedin_signin"),
]
SCAN_LIMIT = 4096


def first_reason(body: Column, patterns: list[tuple[str, str]]) -> Column:
    head = F.substring(body, 1, SCAN_LIMIT)
    out = F
    for pattern, reason in patterns:
        out = out.when(head.rlike(f"(?i){pattern}"), F.lit(reason))
    return out.otherwise(F.lit(None).cast("string"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Plain text: scripts, styles and tags go, six entities are read, white space collapses."""
    text = F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", "")
    text = F.regexp_replace(text, r"(?i)<style[\s\S]*?</style>", "")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


def canonical_html(html: Column) -> Column:
    """Comments go, scripts and styles and runs of white space become a space, none is left around tags."""
    text = F.regexp_replace(html, r"<!--[\s\S]*?-->", "")
    text = F.regexp_replace(text, r"(?i)<script\b[\s\S]*?</script>", " ")
    text = F.regexp_replace(text, r"(?i)<style\b[\s\S]*?</style>", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r"\s*<", "<")
    return F.trim(F.regexp_replace(text, r">\s*", ">"))


def title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)", 1))


def heading(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?i)<h1[^>]*>([^<]*)", 1))


def blocks(html: Column, tags: str) -> Column:
    """Text that follows each opening tag of the named ones, up to the next tag."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{tags})(?:\s[^>]*)?>([^<]*)"), F.lit(1))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")
