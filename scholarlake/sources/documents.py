"""Scans and sinks of raw documents: (document_id, timestamp, data), data a JSON string with its payload under ``data``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

METRICS = ["hindex", "hindex5y", "citedby", "citedby5y", "i10index", "i10index5y"]
LAST_CHAR = "\uf8ff"
BIG = 1 << 62


def _payload(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("d", F.from_json("data", schema)["data"])


def integer(value: Column, strict: bool = True) -> Column:
    return value.cast("bigint") if strict else value.try_cast("bigint")


def author_documents(raw: DataFrame) -> DataFrame:
    """What profiles and listings are made of, for storing: ``profile``, ``listing`` and the timestamp, from one reading of the documents."""
    parsed = lambda schema: F.from_json("data", schema)["data"]
    return raw.select(parsed(schemas.AUTHOR).alias("profile"), parsed(schemas.AUTHOR_PUBLICATIONS).alias("listing"), "timestamp")


def decode_authors(raw: DataFrame, strict: bool = True) -> DataFrame:
    return profiles_of(_payload(raw, schemas.AUTHOR), strict)


def profiles_of(docs: DataFrame, strict: bool = True) -> DataFrame:
    """Profiles of parsed documents ``d``."""
    rows = docs.filter(F.col("d.scholar_id").isNotNull())
    texts = [F.col(f"d.{c}").alias(c) for c in ("scholar_id", "name", "affiliation", "email_domain")]
    return rows.select(*texts, *[integer(F.col(f"d.{c}"), strict).alias(c) for c in METRICS], "timestamp")


def decode_publications(raw: DataFrame, strict: bool = True) -> DataFrame:
    d = _payload(raw, schemas.PUBLICATION)
    return d.select(
        F.get(F.split("d.author_pub_id", ":"), F.lit(0)).alias("scholar_id"), F.col("d.author_pub_id").alias("author_pub_id"),
        integer(F.col("d.bib.pub_year"), strict).alias("pub_year"), F.col("d.bib.title").alias("title"), F.col("d.bib.author").alias("author"),
        F.col("d.bib.citation").alias("citation"), integer(F.col("d.num_citations"), strict).alias("num_citations"),
        F.col("d.cites_per_year").alias("cites_per_year"), F.col("d.url_related_articles").alias("url_related_articles"), "timestamp",
    )


def author_publications(raw_authors: DataFrame) -> DataFrame:
    """One row per listed publication; duplicates in a list stay duplicates."""
    return listings_of(_payload(raw_authors, schemas.AUTHOR_PUBLICATIONS))


def listings_of(docs: DataFrame) -> DataFrame:
    """Listed publications of parsed documents ``d``."""
    # a plain explode would parse each document twice, to filter by the list first; rows without id go below
    rows = docs.select("d.scholar_id", F.explode_outer("d.publications").alias("p"))
    rows = rows.select("scholar_id", F.col("p.author_pub_id").alias("author_pub_id"), F.col("p.bib.pub_year").cast("bigint").alias("pub_year"))
    return rows.filter("scholar_id is not null and author_pub_id is not null and pub_year is not null")


def coauthor_network(raw_authors: DataFrame) -> DataFrame:
    rows = _payload(raw_authors, schemas.AUTHOR_COAUTHORS).select("d.*").withColumn("c", F.explode("coauthors"))
    primary = [F.col(c).alias(f"primary_{c}") for c in ("scholar_id", "name", "affiliation", "email_domain")]
    return rows.select(*primary, *[F.col(f"c.{c}").alias(f"coauthor_{c}") for c in ("scholar_id", "name", "affiliation")])


def citations_by_year(pubs: DataFrame) -> DataFrame:
    """The per-year map as rows; keys that are no years and nested values are skipped."""
    cites = F.from_json("cites_per_year", "map<string,string>")
    rows = pubs.filter(F.col("pub_year").isNotNull()).select("*", F.explode(cites).alias("key", "value"))
    year = F.col("key").try_cast("bigint")
    plain = F.when(~F.col("value").rlike(r"^\s*[{\[]"), F.col("value")).cast("bigint")
    return rows.filter(year.isNotNull()).select(
        "scholar_id", "author_pub_id", "pub_year", F.col("num_citations").alias("total_citations"),
        year.alias("citation_year"), (year - F.col("pub_year")).alias("age"), plain.alias("yearly_citations"),
    )


def prefix_scan(df: DataFrame, field: str, prefix: str) -> DataFrame:
    """A range predicate, so that Parquet statistics prune it."""
    return df.filter((F.col(field) >= prefix) & (F.col(field) <= prefix + LAST_CHAR))


def lookup(df: DataFrame, ids: list[str] | DataFrame, key: str = "document_id") -> DataFrame:
    """Rows by id: a pushed-down list for a few, a semi join for a table of ids."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


def latest_snapshot(changes: DataFrame, key: str = "document_id", *order: str, deleted: str | None = None) -> DataFrame:
    """The version with the largest order columns per key; a partial aggregate, no sort. A key whose latest version has ``deleted`` true is absent."""
    latest = F.max_by(F.struct(*changes.columns), F.struct(*(order or ("timestamp",))))
    rows = changes.groupBy(key).agg(latest.alias("_v")).select("_v.*")
    return rows if deleted is None else rows.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def tombstones(keys: DataFrame, timestamp: Column) -> DataFrame:
    """Rows of a change log that delete ``keys`` (document_id) at a time."""
    return keys.select("document_id", timestamp.alias("timestamp"), F.lit(None).cast("string").alias("data"), F.lit(True).alias("deleted"))


def upsert_documents(current: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """Whole documents replaced by id; blank ids are rejected, older versions lose. With a ``deleted`` column on both sides tombstones are rows like others, for ``latest_snapshot`` to drop."""
    valid = updates.filter(F.length(F.trim("document_id")) > 0)
    if now is not None:
        valid = valid.withColumn("timestamp", now)
    both = current.withColumn("_new", F.lit(0)).unionByName(valid.withColumn("_new", F.lit(1)))
    return latest_snapshot(both, "document_id", "timestamp", "_new", "data").drop("_new")


def slim_author(raw_authors: DataFrame) -> DataFrame:
    """Per publication only id, citations (default 0), filled = false and year; without id it goes."""
    pubs = F.filter(F.coalesce("d.publications", F.array()), lambda p: F.coalesce(p["author_pub_id"], F.lit("")) != "")
    slim = F.transform(pubs, lambda p: F.struct(
        p["author_pub_id"].alias("author_pub_id"), F.coalesce(p["num_citations"].cast("bigint"), F.lit(0).cast("bigint")).alias("num_citations"),
        F.lit(False).alias("filled"), F.struct(p["bib"]["pub_year"].alias("pub_year")).alias("bib"),
    ))
    return _payload(raw_authors, schemas.AUTHOR_PUBLICATIONS).select("document_id", F.col("d.scholar_id").alias("scholar_id"), slim.alias("publications"))


def protected(value: Column, kind: T.DataType) -> Column:
    """``value`` with every integer in it as JSON text, those beyond 2^62 quoted; structs, arrays and maps are gone through."""
    if isinstance(kind, T.LongType):
        text = value.cast("string")
        return F.when((value > BIG) | (value < -BIG), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[protected(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: protected(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: protected(x, kind.valueType))
    return value


def protect_big_integers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns with integers as JSON text at every depth, those beyond 2^62 quoted."""
    return df.withColumns({c: protected(F.col(c), df.schema[c].dataType) for c in columns})
