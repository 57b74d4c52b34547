"""Writers: names of artifacts, exports and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text


def artifact_name(url: Column) -> Column:
    """A file name of an address: 120 characters at most, else 100 and a digest's beginning."""
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "/+$", ""), "^https?://", ""), r"[^\p{L}\p{N}_-]+", "_")
    return F.when(F.length(slug) <= 120, slug).otherwise(F.concat(F.substring(slug, 1, 100), F.lit("_"), F.substring(F.sha1(url), 1, 12)))


def artifacts(pages: DataFrame, path: str) -> None:
    """Raw pages and what was extracted, by name: (url, html, extracted JSON) to two tables."""
    named = pages.withColumn("name", artifact_name(F.col("url")))
    named.select("name", "url", "html").write.mode("append").parquet(f"{path}/raw_pages")
    named.select("name", "url", "extracted").write.mode("append").parquet(f"{path}/extracted_documents")


def report(cases: DataFrame, path: str, measures: list[str]) -> None:
    """cases as JSON lines, and a summary with the number of cases and the mean of each measure."""
    cases.write.json(f"{path}/cases")
    cases.agg(F.count("*").alias("cases"), *(F.avg(m).alias(m) for m in measures)).coalesce(1).write.json(f"{path}/summary")


def freeze(spark: SparkSession, report_path: str, path: str) -> None:
    """A report's summary as the baseline, (metric, value)."""
    summary = spark.read.json(f"{report_path}/summary")
    summary.unpivot([], [c for c in summary.columns if c != "cases"], "metric", "value").coalesce(1).write.mode("overwrite").json(path)


def lexical_index(index: DataFrame, path: str) -> dict[str, int]:
    """The lexical index (code, chunk_text, ...) as JSON lines, and how many codes, rows and rows with a title it has."""
    index.write.mode("overwrite").json(path)
    title = text.row_title(F.col("chunk_text"))
    return index.agg(F.countDistinct("code").alias("codes"), F.countDistinct("chunk_id").alias("rows"), F.countDistinct(F.when(title != "", F.col("chunk_id"))).alias("titled")).first().asDict()


def index_or_extracts(spark: SparkSession, bundled: str | None, extracts: str | None, schema: str) -> DataFrame:
    """The bundled index where it is there, else what was extracted, else nothing."""
    for path in (bundled, extracts):
        if path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
                return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)


def catalog(listing: DataFrame, path: str, key: str, order: str, fields: list[str]) -> None:
    """A catalog as JSON, a line a key with its rows nested in order, and their number."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *fields)))
    nested = listing.groupBy(key).agg(items.alias("items")).withColumn("count", F.size("items"))
    nested.select(key, "count", F.transform("items", lambda x: x.dropFields("_o")).alias("items")).write.mode("overwrite").json(path)


def table_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report of at most `most` rows in markdown; a last line says if there are more."""
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    got = df.limit(most + 1).collect()
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in got[:most]]
    return "\n".join(lines + ["", f"Only the first {most} rows are shown."] * (len(got) > most))


def usage(events: DataFrame, path: str) -> None:
    """Usage events appended by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
