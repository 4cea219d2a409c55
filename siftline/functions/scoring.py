"""Scores of extraction candidates, as Column expressions that Catalyst keeps in one codegen span."""

from pyspark.sql import Column, functions as F

# Score bands, weights and priors.
ENSEMBLE_WEIGHTS = {"length": 0.20, "structure": 0.30, "metadata": 0.20, "density": 0.15, "extractor": 0.15}
BAYES_WEIGHTS = {"extraction": 0.30, "quality": 0.25, "metadata": 0.15, "credibility": 0.10, "consensus": 0.20}
PRIOR = 0.5


def bands(x: Column, *steps: tuple[Column, float], otherwise: float) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in steps:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def length_score(content: Column) -> Column:
    n = F.length(content)
    return bands(n, (n < 100, 0.1), (n < 300, 0.5), (n <= 3000, 1.0), (n <= 5000, 0.9), (n <= 10000, 0.7), otherwise=0.5)


def structure_score(paragraphs: Column) -> Column:
    """Two or more scores 0.8 wherever three to twenty don't score 1, so many paragraphs score 0.8 as well."""
    p = paragraphs
    return bands(p, (p == 0, 0.1), (p.between(3, 20), 1.0), (p >= 2, 0.8), (p >= 1, 0.5), otherwise=0.3)


def filled(x: Column) -> Column:
    return F.coalesce(F.length(x) > 0, F.lit(False))


def metadata_score(title: Column, author: Column, published: Column) -> Column:
    has_title = F.coalesce(F.length(title) > 5, F.lit(False))
    parts = [(has_title, 0.4), (filled(author), 0.3), (filled(published), 0.3)]
    return F.least(sum((F.when(c, v).otherwise(0.0) for c, v in parts), F.lit(0.0)), F.lit(1.0))


def density_score(content: Column) -> Column:
    """Characters for each word; white space alone counts as too sparse, no text as none."""
    n = F.length(content)
    words = F.size(F.filter(F.split(content, r"\s+"), lambda w: F.length(w) > 0))
    r = n / F.when(words > 0, words)
    return (
        F.when(n == 0, 0.0)
        .when(words == 0, 0.4)
        .when(r.between(5, 8), 1.0)
        .when((r >= 4) & (r < 5), 0.9)
        .when((r > 8) & (r <= 10), 0.9)
        .when((r >= 3) & (r < 4), 0.7)
        .when((r > 10) & (r <= 15), 0.6)
        .otherwise(0.4)
    )


def ensemble_score(length: Column, structure: Column, metadata: Column, density: Column, extractor: Column) -> Column:
    w = ENSEMBLE_WEIGHTS
    return (
        length * w["length"]
        + structure * w["structure"]
        + metadata * w["metadata"]
        + density * w["density"]
        + extractor * w["extractor"]
    )


def content_quality(content: Column, paragraphs: Column) -> Column:
    n, p = F.length(content), paragraphs
    size = bands(n, (n < 100, 0.1), (n < 300, 0.3), (n <= 3000, 0.5), (n <= 5000, 0.4), otherwise=0.2)
    shape = bands(p, (p.between(3, 20), 0.5), (p >= 2, 0.3), (p >= 1, 0.2), otherwise=0.1)
    return F.least(size + shape, F.lit(1.0))


def metadata_quality(title: Column, author: Column, published: Column, excerpt: Column) -> Column:
    has_title = F.coalesce((F.length(title) > 5) & (title != "Unknown"), F.lit(False))
    has_excerpt = F.coalesce(F.length(excerpt) > 20, F.lit(False))
    parts = [(has_title, 0.4), (filled(author), 0.25), (filled(published), 0.25), (has_excerpt, 0.1)]
    return F.least(sum((F.when(c, v).otherwise(0.0) for c, v in parts), F.lit(0.0)), F.lit(1.0))


def source_credibility(url: Column) -> Column:
    # Host tiers.
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))

    def holds(*names: str) -> Column:
        return F.greatest(*[host.contains(n) for n in names], F.lit(False))

    return (
        F.when(holds("nytimes.com", "bbc.com", "reuters.com", "apnews.com"), 0.9)
        .when(host.endswith(".edu") | host.endswith(".gov"), 0.85)
        .when(holds("techcrunch.com", "arstechnica.com", "theverge.com"), 0.8)
        .when(holds("medium.com", "substack.com"), 0.6)
        .otherwise(PRIOR)
    )


def log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))
    return F.ln(q / (1 - q))


def bayes_combine(**parts: Column) -> Column:
    total = sum((log_odds(parts[k]) * w for k, w in BAYES_WEIGHTS.items()), F.lit(0.0))
    return F.exp(total) / (1 + F.exp(total))


def stream_confidence(length: Column, byline: Column, nodes: Column, fallback: Column) -> Column:
    score = (
        F.when(fallback, 0.45).otherwise(0.62)
        + F.when(length > 1200, 0.1).when(length < 400, -0.08).otherwise(0.0)
        + F.when(filled(byline), 0.05).otherwise(0.0)
        + F.when(nodes > 5, 0.05).otherwise(0.0)
    )
    return F.least(F.greatest(score, F.lit(0.2)), F.lit(0.95))


def node_confidence(overall: Column, length: Column, heading: Column) -> Column:
    change = F.when(heading, 0.02).when(length > 200, 0.04).when(length < 40, -0.08).otherwise(0.0)
    return F.least(F.greatest(overall + change, F.lit(0.1)), F.lit(0.98))


def three_digits(x: Column) -> Column:
    """A score of 0 to 1 with three decimals, halves rounded up."""
    k = F.floor(x * 1000 + 0.5).cast("long")
    return F.concat(F.floor(k / 1000).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))
