"""Simple selectors by regular expressions: `.class`, `#id`, `tag`, `[name="value"]` and `tag[name="value"]`, and two of
them with a space between, the second one inside the first. What an element holds is read up to its next tag."""

import re

from pyspark.sql import Column, functions as F

_PART = re.compile(r"""^(?P<tag>[a-z][a-z0-9]*)?(?:\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)="(?P<value>[^"]*)"\])?$""")


def pattern(selector: str) -> str:
    """The opening tag of an element that a selector without spaces names."""
    m = _PART.match(selector)
    if not m or not selector:
        raise ValueError(f"selector {selector!r} is not supported")
    tag = m["tag"] or r"[a-z][a-z0-9]*"
    if m["cls"]:
        need = rf"""\sclass\s*=\s*["'](?:[^"']*\s)?{re.escape(m["cls"])}(?:\s[^"']*)?["']"""
    elif m["id"]:
        need = rf"""\sid\s*=\s*["']{re.escape(m["id"])}["']"""
    elif m["name"]:
        need = rf"""\s{re.escape(m["name"])}\s*=\s*["']{re.escape(m["value"])}["']"""
    else:
        need = r"(?=[\s>/])"
    return rf"<{tag}(?:{need}[^>]*|\s[^>]*?{need}[^>]*)>" if m["cls"] or m["id"] or m["name"] else rf"<{tag}{need}[^>]*>"


def _chain(selector: str) -> str:
    return r"[\s\S]*?".join(pattern(p) for p in selector.split())


def text_of(html: Column, selector: str) -> Column:
    """Text of the first such element, white space collapsed; null where there is none or it is empty."""
    text = F.regexp_extract(html, rf"(?i){_chain(selector)}([^<]*)", 1)
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def attribute_of(html: Column, selector: str, name: str) -> Column:
    tag = F.regexp_extract(html, rf"(?i)({_chain(selector)})", 1)
    value = F.regexp_extract(tag, rf"""(?i)[\s\S]*\s{name}\s*=\s*["']([^"']*)["']""", 1)
    return F.nullif(F.trim(value), F.lit(""))


def first_of(html: Column, cascade: list[str]) -> Column:
    """The first selector that finds something; `selector@name` asks for an attribute."""
    found = [attribute_of(html, *s.rsplit("@", 1)) if "@" in s else text_of(html, s) for s in cascade]
    return F.coalesce(*found)


def elements(html: Column, selector: str, tag: str) -> Column:
    """The innermost elements of that tag which a selector without spaces names, markup and all, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)({pattern(selector)}[\s\S]*?</{tag}>)"), F.lit(1))


def without(html: Column, selector: str) -> Column:
    """The page without the innermost such elements; as many passes as there are levels would take nested ones."""
    tag = _PART.match(selector)["tag"]
    close = f"</{tag}>" if tag else r"</\1>"
    opening = pattern(selector)
    if not tag:
        opening = opening.replace("<[a-z][a-z0-9]*", "<([a-z][a-z0-9]*)", 1)
    return F.regexp_replace(html, rf"(?i){opening}[\s\S]*?{close}", "")
