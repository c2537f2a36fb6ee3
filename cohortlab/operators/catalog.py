"""Cache names of remote files, where a URL leads, and what a cache already holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(df: DataFrame, url: str = "url", etag: str = "etag", name: str = "cache_key") -> DataFrame:
    """SHA-256 of the URL, with that of the etag appended when there is one."""
    key = F.sha2(F.col(url), 256)
    known = F.col(etag).isNotNull() & (F.col(etag) != "")
    return df.withColumn(name, F.when(known, F.concat(key, F.lit("."), F.sha2(F.col(etag), 256))).otherwise(key))


def file_extension(path: Column, dot: bool = True, lower: bool = True) -> Column:
    """Last extension of a path; leading dots of the name do not count."""
    found = F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]*)$", 1)
    found = found if dot else F.regexp_replace(found, r"^\.", "")
    return F.lower(found) if lower else found


def route_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, route (fetch, local or error), bucket, object_key and extension."""
    c = F.col(url)
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    route = F.when(scheme.isin("http", "https", "s3"), "fetch").when(scheme == "", "local").otherwise("error")
    path = F.regexp_extract(c, r"^[^:/?#]+://[^/?#]+/?([^?#]*)", 1)
    host = F.regexp_extract(c, r"^[^:/?#]+://([^/?#]+)", 1)
    s3 = scheme == "s3"
    return df.withColumns({
        "scheme": scheme,
        "route": F.when(s3 & ((host == "") | (path == "")), "error").otherwise(route),
        "bucket": F.when(s3 & (host != ""), host),
        "object_key": F.when(s3 & (path != ""), path),
        "extension": file_extension(F.when(scheme == "", c).otherwise(path)),
    })


def resolve_cache(df: DataFrame, catalog: DataFrame, url: str = "url", etag: str = "etag") -> DataFrame:
    """Cached file of each URL: the exact name, else without an etag the last name for that URL.

    ``catalog`` has name, and url and etag from the sidecars. Sidecars are not
    entries. The join is on the part of the name before the dot.
    """
    keyed = cache_key(df, url, etag).withColumn("_stem", F.substring_index("cache_key", ".", 1))
    entries = catalog.where(~F.col("name").endswith(".json")).select(
        F.substring_index("name", ".", 1).alias("_stem"), F.col("name").alias("file"),
        F.col("url").alias("stored_url"), F.col("etag").alias("stored_etag"),
    )
    by_name = F.struct("file", "stored_url", "stored_etag")
    # the last entry per stem answers the lookups without an etag
    last = entries.where(F.col("file").contains(".")).groupBy("_stem").agg(F.max_by(by_name, "file").alias("_last"))
    exact = entries.select(F.col("file").alias("cache_key"), by_name.alias("_exact"))
    unknown = F.col(etag).isNull() | (F.col(etag) == "")
    joined = keyed.join(exact, "cache_key", "left").join(last, "_stem", "left")
    hit = F.coalesce(F.col("_exact"), F.when(unknown, F.col("_last")))
    return joined.withColumn("_hit", hit).select(
        *df.columns, "cache_key", F.col("_hit.file").alias("file"), F.col("_hit.stored_url").alias("stored_url"),
        F.col("_hit.stored_etag").alias("stored_etag"),
    )
