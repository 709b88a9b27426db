"""Crawl priority and retry rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.expr import any_of, col

# What a URL that contains one of these is worth, first match counts.
CONTENT_SCORES = [
    (1.0, ["/home", "/index", "/main", "/"]),
    (0.9, ["/product", "/item", "/game", "/article", "/news"]),
    (0.8, ["/category", "/section", "/page"]),
    (0.6, ["/search", "/filter", "/sort"]),
    (0.3, ["/api", "/ajax", "/json"]),
    (0.2, [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg"]),
    (0.1, [".css", ".js", ".pdf", ".doc", ".zip"]),
]
CONTENT_DEFAULT = 0.7

# Score up to and including a depth, and beyond.
DEPTH_SCORES = [(0, 1.0), (1, 0.9), (2, 0.8), (3, 0.7), (5, 0.6)]
DEPTH_BEYOND = 0.5

# Score up to and including a number of inlinks, and beyond.
INLINK_SCORES = [(0, 0.5), (5, 0.6), (20, 0.8), (100, 0.9)]
INLINK_BEYOND = 1.0

# Client statuses that may pass by themselves, with the reason to report.
RETRYABLE_CLIENT = {
    408: "Request timeout (server slow)",
    423: "Resource temporarily locked",
    429: "Rate limited",
    420: "Rate limited (Twitter)",
    451: "Unavailable for legal reasons (geo-blocking?)",
}


def _steps(value: Column, steps: list[tuple[int, float]], beyond: float) -> Column:
    out = F.lit(beyond)
    for limit, score in reversed(steps):
        out = F.when(value <= limit, F.lit(score)).otherwise(out)
    return out


def depth_score(depth: Column | str) -> Column:
    return _steps(col(depth), DEPTH_SCORES, DEPTH_BEYOND)


def sitemap_score(priority: Column | str) -> Column:
    """The sitemap priority kept between 0.1 and 1; 0.5 without one."""
    bounded = F.greatest(F.lit(0.1), F.least(F.lit(1.0), col(priority)))
    return F.when(col(priority).isNull(), F.lit(0.5)).otherwise(bounded)


def inlinks_score(inlinks: Column | str) -> Column:
    return _steps(col(inlinks), INLINK_SCORES, INLINK_BEYOND)


def content_type_score(url: Column | str, content_type: Column | None = None, strict: bool = True) -> Column:
    """What the URL says about its content. A bare `/` matches every absolute URL; with
    `strict=False` that pattern is skipped so that the others can tell URLs apart."""
    name = F.lower(col(url))
    out = F.lit(CONTENT_DEFAULT)
    for score, patterns in reversed(CONTENT_SCORES):
        told = [p for p in patterns if strict or p != "/"]
        out = F.when(any_of([name.contains(p) for p in told]), F.lit(score)).otherwise(out)
    if content_type is not None:
        out = F.when(F.lower(content_type).contains("html"), F.lit(1.0)).otherwise(out)
    return out


def priority_score(url: Column | str, depth: Column | str, sitemap_priority: Column | str,
                   inlinks: Column | str, content_type: Column | None = None, strict: bool = True) -> Column:
    """0.3 depth + 0.3 sitemap + 0.2 inlinks + 0.2 content type."""
    return (depth_score(depth) * F.lit(0.3) + sitemap_score(sitemap_priority) * F.lit(0.3)
            + inlinks_score(inlinks) * F.lit(0.2) + content_type_score(url, content_type, strict) * F.lit(0.2))


def retryable(status: Column | str) -> Column:
    """No answer, server errors and a few client errors are worth another try."""
    status = col(status)
    return (status == 0) | status.between(500, 599) | status.isin(list(RETRYABLE_CLIENT))


def failure_reason(status: Column | str) -> Column:
    status = col(status)
    out = F.when(status == 0, "Connection/timeout error")
    for code, reason in RETRYABLE_CLIENT.items():
        out = out.when(status == code, reason)
    text = status.cast("string")
    return out.when(status.between(500, 599), F.concat(F.lit("Server error "), text)).otherwise(
        F.concat(F.lit("HTTP "), text))
