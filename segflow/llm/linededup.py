"""Line dedup by distinct-site spread.  DataFrame functions only.

A line (trimmed of white space) that occurs on many sites is boilerplate.  Per line hash a HyperLogLog sketch of its sites
is built in each task and the sketches are merged by aggregation: only sketches move.  Lines whose estimate lies clearly above
the threshold go, those clearly below stay, and only lines near it get an exact distinct count.  Lines shorter than `least`
characters are never removed.

Nulls: a null source is one site of its own; a null text has no lines and stays null; blank lines stay.  Repeated rows don't
raise a line's spread (sites count once), and each gets its result.  A text of any length is split whole.  Empty tables give empty results.  Extra columns
pass through, whatever their names; n_lines and n_removed are replaced if docs has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, fresh, row_hash, whole_row


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE_CHARS)))


def counts(line: Column, least: int) -> Column:
    return F.length(F.btrim(line, F.lit(SPACE_CHARS))) >= least


def lines(docs: DataFrame, text: str, site: str, least: int) -> DataFrame:
    """(line, site) of every line that counts, once per document."""
    split = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: counts(x, least))
    return docs.select(F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("null")).alias("site"), F.explode(F.array_distinct(F.transform(split, line_key))).alias("line"))


def sketches(docs: DataFrame, text: str, site: str, least: int, lg_k: int) -> DataFrame:
    """(line, sites): the estimated number of sites of every line hash, from sketches that are merged."""
    return lines(docs, text, site, least).groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))


#: Lines (eight bytes each) that may go to every executor; more are joined by a shuffle.
FEW_LINES = 500_000


def few(found: DataFrame) -> bool:
    """Whether a written table of lines is small enough to broadcast."""
    return found.count() <= FEW_LINES


def widespread(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 8, least: int = 20, lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """(line, sites): hashes of lines on at least min_sites sites; sites is exact inside the band and estimated above it."""
    spread = cut(sketches(docs, text, site, least, lg_k).filter(F.col("sites") >= min_sites * (1 - band)))
    far = spread.filter(F.col("sites") > min_sites * (1 + band))
    near = spread.filter(F.col("sites") <= min_sites * (1 + band)).select("line")
    # pairs are made distinct in each task before they move, so a line that is everywhere sends few rows
    every = lines(docs, text, site, least)
    distinct = lambda rows: rows.groupBy("line", "site").agg(F.lit(1))
    pairs = distinct(every.join(F.broadcast(near), "line", "left_semi")) if few(near) else distinct(every).join(near, "line", "left_semi")
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return far.unionByName(exact)


def drop_widespread_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 8, least: int = 20, **options) -> DataFrame:
    """docs with text rid of widespread lines, and n_lines and n_removed.  A document whose lines all stay is unchanged."""
    gone = cut(widespread(docs, text, site, min_sites, least, **options).select("line"))
    # rows are known by hashes of all their columns: equal texts of different documents don't meet in one task, equal rows share their answer
    of, row, key, check, held = (fresh(docs, x) for x in ("of", "row", "key", "check", "held"))
    whole = docs.select(F.col(text).alias(of), whole_row(docs).alias(row))
    keyed = whole.select(row_hash(docs, row).alias(key), row_hash(docs, row, F.hash).alias(check), of, row)
    each = keyed.select(key, check, F.explode(F.array_distinct(F.transform(F.filter(F.split(of, "\n"), lambda x: counts(x, least)), line_key))).alias("line"))
    found = each.join(F.broadcast(gone) if few(gone) else gone, "line").groupBy(key, check).agg(F.collect_set("line").alias(held))
    joined = keyed.join(found, [key, check], "left")
    split = F.split(F.col(of), "\n")
    stay = F.when(F.col(held).isNull(), split).otherwise(F.filter(split, lambda x: ~(F.array_contains(held, line_key(x)) & counts(x, least))))
    n = F.when(F.col(of).isNull(), 0).otherwise(F.size(split)).cast("long")
    cut_text = F.when(F.col(of).isNotNull(), F.array_join(stay, "\n"))
    removed = F.when(F.col(of).isNull(), 0).otherwise(F.size(split) - F.size(stay)).cast("long")
    kept = [cut_text.alias(c) if c == text else F.col(row).getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*kept, n.alias("n_lines"), removed.alias("n_removed"))
