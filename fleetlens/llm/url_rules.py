"""URL rules as a sort-merge range join over reversed-host keys.

The canonical key of a host is its labels reversed, each closed by a dot:
``www.example.com`` is ``com.example.www.``.  A rule fits a host and all its subdomains, so
its host is the interval of keys that start with its key, and such intervals are nested or
apart.  Urls are sorted by key and dealt to ranges; every rule goes to the ranges its
interval touches, and one sweep over a range keeps the stack of active rules.  On the stack
the url's path decides: the longest rule whose path the url's path starts with wins.

The ranges come from a sample of the keys, which decides how even the load is and nothing
else.  The sort key holds the row's number, so one host, or one repeated row, with a third of
all rows is cut into several ranges.

Defined results: a null url, or one without ``://``, has an empty host and path, and no rule
fits it; rules without a host are ignored; rules of equal length are decided by host length, then by text; equal
rules with different verdicts block; without a fitting rule the verdict is ``default``;
repeated rows are judged row by row; an empty rule table leaves every url to the default.
Ids of any type, null and very large ones, come back as they are (they travel as text).
Labels are compared as they stand after lower-casing A-Z; a port belongs to the last label.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, by_hash

#: Sampled keys per range.
SAMPLE_PER_RANGE = 100


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    # regexp_extract matches [^...] across line breaks, so both are exact complements.
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws(".", labels), F.lit(".")))


def _bounds(keys: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Cut points from a sample of about ``SAMPLE_PER_RANGE`` keys a range."""
    total = keys.count()
    share = min(1.0, ranges * SAMPLE_PER_RANGE / max(total, 1))
    # A hash chooses, not a random number: a second run cuts at the same places.
    chosen = keys.where(by_hash(share, "key", "row_key"))
    points = sorted((row.key, row.row_key) for row in chosen.collect())
    step = len(points) / ranges
    return [points[int(step * k)] for k in range(1, ranges) if points]


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", default: str = "allow", ranges: int | None = None
) -> DataFrame:
    """``id, host, path, rule, verdict`` of each row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``).
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col("url"))
    kind = pages.schema[id_column].dataType
    # pandas has no null among whole numbers and would round large ones, so ids travel as text.
    urls = pages.select(F.col(id_column).cast("string").alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), F.lit(" "), "path"))
    urls = urls.withColumn("row_key", F.xxhash64(F.monotonically_increasing_id()))
    cuts = _bounds(urls.select("key", "row_key"), ranges)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(part=[bisect_right(cuts, pair) for pair in zip(frame["key"], frame["row_key"])])

    def touch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A rule once for each range from the first that may hold its keys to the last."""
        for frame in frames:
            low = [bisect_left(cuts, (key, -(2**63))) for key in frame["key"]]
            high = [bisect_right(cuts, key, key=lambda cut, n=len(key): cut[0][:n]) for key in frame["key"]]
            frame = frame.assign(part=[list(range(a, b + 1)) for a, b in zip(low, high)])
            yield frame.explode("part").astype({"part": "int64"})

    schema = "part int, kind int, key string, row_key long, id string, host string, path string, verdict string"
    empty = F.lit(None)
    sweep = urls.select("key", "row_key", "id", "host", "path").mapInPandas(
        place, "key string, row_key long, id string, host string, path string, part int"
    )
    sweep = sweep.select("part", F.lit(1).alias("kind"), "key", "row_key", "id", "host", "path", empty.cast("string").alias("verdict"))
    own = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    own = own.where(F.col("host") != "").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict")
    own = own.mapInPandas(touch, "key string, host string, path string, verdict string, part int")
    own = own.select(
        "part", F.lit(0).alias("kind"), "key", F.lit(-(2**63)).alias("row_key"), empty.cast("string").alias("id"), "host", "path", "verdict"
    )
    both = sweep.unionByName(own).repartition(ranges, "part").sortWithinPartitions("part", "key", "kind", "row_key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Per active host: its key, its rules by path, and the lengths of those paths.
        stack: list[tuple[str, dict[str, tuple], set[int]]] = []
        part = None
        for frame in frames:
            out = []
            columns = [frame[c].tolist() for c in ("part", "kind", "key", "id", "host", "path", "verdict")]
            for at, kind, key, page, host, path, verdict in zip(*columns):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, set()))
                    stack[-1][1][path] = (len(host) + len(path), len(host), host + path, verdict)
                    stack[-1][2].add(len(path))
                    continue
                fitting = [held[path[:n]] for _, held, lengths in stack for n in lengths if path[:n] in held]
                best = max(fitting, default=(0, 0, None, default))
                out.append((page, host, path, best[2], best[3]))
            yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"])

    judged = both.mapInPandas(run, "id string, host string, path string, rule string, verdict string")
    return judged.select(F.col("id").cast(kind).alias(id_column), "host", "path", "rule", "verdict")
