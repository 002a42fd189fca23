"""Discovery of documents in feeds, indexes and archives whose payload Spark has already read."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import clean_fragment


def _items(payload: Column, tag: str) -> Column:
    return F.regexp_extract_all(payload, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)


def _part(item: Column, tag: str) -> Column:
    return clean_fragment(F.regexp_extract(item, rf"(?is)<{tag}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1))


def rss(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """(url, published) of the items of RSS feeds; RFC 2822 dates."""
    rows = feeds.select(F.explode(_items(F.col(payload), "item")).alias("i"))
    date = F.regexp_extract(_part(F.col("i"), "pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return rows.select(_part(F.col("i"), "link").alias("url"), F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss")).alias("published"))


def sitemap(maps: DataFrame, payload: str = "payload") -> DataFrame:
    rows = maps.select(F.explode(_items(F.col(payload), "url")).alias("i"))
    return rows.select(_part(F.col("i"), "loc").alias("url"), F.try_to_timestamp(F.nullif(_part(F.col("i"), "lastmod"), F.lit(""))).alias("modified"))


def atom(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    rows = feeds.select(F.explode(_items(F.col(payload), "entry")).alias("i"))
    return rows.select(_part(F.col("i"), "id").alias("url"), _part(F.col("i"), "title").alias("title"), F.try_to_timestamp(F.nullif(_part(F.col("i"), "published"), F.lit(""))).alias("published"))


def filings(submissions: DataFrame, payload: str = "payload") -> DataFrame:
    """(cik, accession, form, filed) from columnar JSON of a company's submissions."""
    schema = "cik string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>>>"
    rows = submissions.select(F.from_json(payload, schema).alias("j"))
    r = F.col("j.filings.recent")
    zipped = F.arrays_zip(r["accessionNumber"].alias("a"), r["form"].alias("f"), r["filingDate"].alias("d"))
    return rows.select(F.lpad("j.cik", 10, "0").alias("cik"), F.explode(zipped).alias("x")).select("cik", F.col("x.a").alias("accession"), F.col("x.f").alias("form"), F.try_to_timestamp("x.d").cast("date").alias("filed"))


def delimited_index(indexes: DataFrame, field: int, base: str = "", sep: str = "|", skip: tuple[str, ...] = ("#",), payload: str = "payload") -> DataFrame:
    """(url,) of the given field of each line that no skipped prefix begins."""
    rows = indexes.select(F.explode(F.split(payload, r"\r?\n")).alias("line")).where(F.trim("line") != "")
    for p in skip:
        rows = rows.where(~F.col("line").startswith(p))
    value = F.trim(F.get(F.split("line", f"\\Q{sep}\\E"), F.lit(field)))
    return rows.select(value.alias("v")).where("v is not null and v != ''").select(F.when(F.col("v").startswith("http"), F.col("v")).otherwise(F.concat(F.lit(base), F.col("v"))).alias("url"))


def archive_entries(spark: SparkSession, path: str, most_entries: int = 100_000, most_bytes: int = 1 << 30, most_ratio: float = 200.0) -> DataFrame:
    """(archive, entry, content) of the files in zip and tar archives; an archive beyond a limit raises."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                total = 0
                if zipfile.is_zipfile(io.BytesIO(data)):
                    z = zipfile.ZipFile(io.BytesIO(data))
                    members = [(i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir()]
                else:
                    t = tarfile.open(fileobj=io.BytesIO(data))
                    members = [(m.name, m.size, lambda m=m: t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
                if len(members) > most_entries:
                    raise ValueError(f"{name}: more than {most_entries} entries")
                for entry, size, get in members:
                    total += size
                    if total > most_bytes or total > most_ratio * max(1, len(data)):
                        raise ValueError(f"{name}: its content is too large")
                    rows.append((name, entry, get()))
            yield pd.DataFrame(rows, columns=["archive", "entry", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, entry string, content binary")


def unseen(found: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    return found.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def batches(total: int, page: int) -> list[tuple[int, int]]:
    """(start, size) of the pages of a listing."""
    return [(s, min(page, total - s)) for s in range(0, total, page)]


def months_back(spark: SparkSession, last: str, months: int) -> DataFrame:
    """(first_day, last_day) of a number of months, newest first."""
    day = F.add_months(F.trunc(F.lit(last).cast("date"), "month"), -F.col("id").cast("int"))
    return spark.range(months).select(day.alias("first_day"), F.last_day(day).alias("last_day"))


def retry_delay(attempt: int, retry_after: float | None = None, base: float = 30.0, most: float = 300.0) -> float:
    return float(retry_after) if retry_after is not None else min(most, base * 2**attempt)
