"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First path segments that never name an article, and media suffixes.
RESERVED_PREFIXES = "category|tag|author|page|wp-"
MEDIA = "jpg|jpeg|png|gif|webp|svg|pdf|mp4|mp3|zip"


def canonical(url: Column) -> Column:
    """Without its fragment, with one trailing slash."""
    return F.concat(F.rtrim(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("/")), F.lit("/"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), "^/+|/+$", "")


def is_article(url: Column, own_host: Column | str, reserved: list[str] = ()) -> Column:
    """Whether a URL of ``own_host`` has one path segment that is neither reserved nor a file."""
    own = F.lit(own_host) if isinstance(own_host, str) else own_host
    p = path(url)
    fine = (host(url) == own) & (p != "") & ~p.contains("/") & ~p.rlike(f"^({RESERVED_PREFIXES})") & ~F.lower(p).rlike(rf"\.({MEDIA})$")
    return fine & ~p.isin(list(reserved)) if reserved else fine


def listing(base: str, page: Column) -> Column:
    """Address of a listing page: the first is the base itself."""
    return F.when(page == 1, F.lit(base)).otherwise(F.concat(F.lit(f"{base}?page="), page.cast("string")))
