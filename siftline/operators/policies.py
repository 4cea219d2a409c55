"""Policies: which parts of a page go and which stay, what its fields must be, and settings by host.

A policy is a dict: name, domain, keep and drop (lists of {"selector": ...} or {"regex": ...}), fields. Selectors are
those of `functions.selectors`; a drop rule with a regex takes the texts between tags that it matches.
"""

import json
from hashlib import sha256

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions import selectors
from siftline.operators.structured import policy as select_policy


def errors(policy: dict) -> list[str]:
    """What is wrong with a policy: no name, or a rule with neither selector nor regex."""
    found = [] if policy.get("name") else ["no name"]
    rules = [*policy.get("keep", []), *policy.get("drop", []), *policy.get("transform", [])]
    return found + [f"rule {k} has neither selector nor regex" for k, r in enumerate(rules) if not (r.get("selector") or r.get("regex"))]


def fingerprint(policies: list[dict]) -> str:
    """Eight hex digits that change with any policy."""
    return sha256("|".join(json.dumps(p, separators=(",", ":")) for p in policies).encode()).hexdigest()[:8]


def _element(selector: str) -> str:
    tag = selector.split(".")[0].split("[")[0].split("#")[0]
    if not tag:
        raise ValueError(f"a policy's selector needs a tag: {selector!r}")
    return rf"(?i){selectors.pattern(selector)}[\s\S]*?</{tag}>"


def _text(regex: str) -> str:
    return rf">[^<]*(?:{regex})[^<]*(?=<)"


def _applied(html: Column, policy: dict) -> tuple[Column, Column]:
    """(page, rules matched) after one policy: drops in order, texts, then what is kept, if anything is."""
    matched = F.lit(0)
    for rule in policy.get("drop", []):
        if "selector" in rule:
            matched = matched + F.regexp_count(html, F.lit(_element(rule["selector"])))
            html = F.regexp_replace(html, _element(rule["selector"]), "")
    for rule in policy.get("drop", []):
        if "regex" in rule:
            matched = matched + F.regexp_count(html, F.lit(_text(rule["regex"])))
            html = F.regexp_replace(html, _text(rule["regex"]), ">")
    kept = [F.regexp_extract_all(html, F.lit(_element(r["selector"])), F.lit(0)) for r in policy.get("keep", []) if "selector" in r]
    if kept:
        every = F.concat(*kept)
        matched = matched + F.size(every)
        html = F.when(F.size(every) > 0, F.concat(F.lit("<body>"), F.array_join(every, ""), F.lit("</body>"))).otherwise(html)
    return html, matched


def apply(pages: DataFrame, policies: list[dict], *keep: str) -> DataFrame:
    """(keep..., policy, html, rules_matched): each page after the first policy its host is for, else the last one.

    Rules run one after another on the whole page; each policy's branch is evaluated for its own pages only.
    """
    named = [(p["name"], p["domain"]) for p in policies[:-1]]
    rows = pages.withColumn("policy", select_policy(F.col("url"), named, policies[-1]["name"]))
    page = matched = F
    for p in policies:
        html, n = _applied(F.col("html"), p)
        mine = F.col("policy") == p["name"]
        page, matched = page.when(mine, html), matched.when(mine, n)
    return rows.select(*keep, "policy", page.alias("html"), matched.alias("rules_matched"))


def merged(defaults: dict, own: dict) -> dict:
    """Settings with those of `own` over them, maps level by level."""
    out = dict(defaults)
    for k, v in own.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def setting(host: Column, by_host: dict[str, dict], name: str, default) -> Column:
    """A setting of the host itself, else of the first pattern with * that it matches, else the default."""
    exact = [(h, s) for h, s in by_host.items() if "*" not in h]
    globs = [(h, s) for h, s in by_host.items() if "*" in h]
    out = F
    for h, s in exact + globs:
        hit = host.rlike("^" + h.replace(".", r"\.").replace("*", ".*") + "$") if "*" in h else host == h
        out = out.when(hit, F.lit(s.get(name, default)))
    return out.otherwise(F.lit(default))


# Many patterns, as a table. Each alternative of a pattern is known by whole labels that a host must begin or end with, so
# hosts meet patterns by equal keys: the branches of a prefix tree over labels, read from either end.


def _keyed(patterns: DataFrame) -> DataFrame:
    """(name, place, regex, key) of each alternative: `^www.` for hosts that begin with that label, `.news$` for those that
    end so, and `` for alternatives without a whole label at an end, which all hosts have to be tried on."""
    pattern = F.lower("pattern")
    regex = F.concat(F.lit("^"), F.replace(F.replace(pattern, F.lit("."), F.lit(r"\.")), F.lit("*"), F.lit(".*")), F.lit("$"))
    rows = patterns.select("name", "place", regex.alias("regex"), F.posexplode(F.split(pattern, r"\|")).alias("at", "part"), F.size(F.split(pattern, r"\|")).alias("n"))
    # Of `a|b` only the start of a and the end of b are anchored; a label at the cut of an open end may go on.
    head = F.when(F.col("at") == 0, F.regexp_extract(F.split_part("part", F.lit("*"), F.lit(1)), r"^(.*)\.", 1)).otherwise("")
    tail = F.when(F.col("at") == F.col("n") - 1, F.regexp_extract(F.split_part("part", F.lit("*"), F.lit(-1)), r"^[^.]*\.(.*)$", 1)).otherwise("")
    longer = F.length(head) >= F.length(tail)
    key = F.when((head == "") & (tail == ""), "").when(longer, F.concat(F.lit("^"), head, F.lit("."))).otherwise(F.concat(F.lit("."), tail, F.lit("$")))
    return rows.select("name", "place", "regex", key.alias("key")).distinct()


def match(rows: DataFrame, url: str, patterns: DataFrame, default: str) -> DataFrame:
    """`rows` with `policy`: the name of the first pattern by `place` that a URL's host matches, or `default`.

    patterns (name, place, pattern), any number of them; a pattern means what it does for `structured.policy`. Each host
    is matched once: its keys, two for each of its labels, are joined with those of the patterns, and only patterns that
    share one are tried. Of equal places the smaller name counts. URLs without a host match as an empty one does.
    """
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    hosts = rows.select(host.alias("_host")).distinct()
    labels = F.split("_host", r"\.")
    n = F.size(labels)
    heads = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("^"), F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit(".")))
    tails = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("."), F.array_join(F.slice(labels, -k, k), "."), F.lit("$")))
    asked = hosts.select("_host", F.explode(F.concat(heads, tails, F.array(F.lit("")))).alias("key"))
    tried = asked.join(_keyed(patterns), "key").filter(F.rlike(F.col("_host"), F.col("regex")))
    first = tried.groupBy("_host").agg(F.min(F.struct("place", "name")).alias("_first"))
    named = rows.withColumn("_host", host).join(first, "_host", "left")
    return named.withColumn("policy", F.coalesce("_first.name", F.lit(default))).drop("_host", "_first")
