"""Submissions: typed JSON readers, validation, replay of saved ones, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texlith.functions import constants as C
from texlith.functions.text import normalize

SUBMISSION = "id string, stance string, headline string, body string"
SAVED = SUBMISSION + ", score double, admitted boolean, submitted_at string"


class DataError(RuntimeError):
    """A file that can't be read as what it should hold; the message names it."""


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(v): the file's JSON document by a schema. A file that is missing, broken, or of another shape at its top raises."""
    try:
        whole = spark.read.text(path, wholetext=True)
        found = whole.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v"), F.substring(F.trim("value"), 1, 1).alias("top")).collect()
    except Exception as e:
        raise DataError(f"{path} is unreadable: {str(e).splitlines()[0][:200]}") from None
    top = "[" if schema.startswith("array") else "{"
    if len(found) != 1 or found[0]["v"] is None or found[0]["top"] != top:
        raise DataError(f"{path} must hold a JSON {'list' if top == '[' else 'object'}")
    return spark.createDataFrame([(found[0]["v"],)], f"v {schema}")


_ROW = "struct<id:string,stance:string,headline:string,body:string>"


def _valid(rows: DataFrame, path: str) -> DataFrame:
    """rows normalised; the first that is no valid submission raises."""
    checked = validated(rows)
    bad = checked.where("error is not null").select("id", "error").first()
    if bad is not None:
        raise DataError(f"{path} item {bad['id']}: {bad['error']}")
    return checked.drop("error")


def read_article(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text): one row; a field that is missing, or a text that is blank or too long, raises."""
    rows = _parsed(spark, path, "struct<id:string,title:string,text:string>").select("v.*")
    r = rows.select("*", article_error(F.col("title"), F.col("text")).alias("error")).first()
    missing = [k for k in ("id", "title", "text") if r[k] is None]
    if missing or r["error"]:
        raise DataError(f"{path}: {'missing ' + ', '.join(missing) if missing else r['error']}")
    return rows


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return _valid(_parsed(spark, path, f"array<{_ROW}>").select(F.inline("v")), path)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """A list of strings as rows (anchor); none, or a blank one, raises."""
    rows = _parsed(spark, path, "array<string>").select(F.explode("v").alias("anchor"))
    if rows.isEmpty() or not rows.where("anchor is null or trim(anchor) = ''").isEmpty():
        raise DataError(f"{path} must hold strings that aren't blank")
    return rows


def read_negatives(spark: SparkSession, path: str) -> DataFrame:
    rows = _parsed(spark, path, "struct<items:array<struct<id:string,topic:string,headline:string,body:string,stance:string>>>")
    if rows.first()["v"]["items"] is None:
        raise DataError(f"{path} must have a list of items")
    return _valid(rows.select(F.inline("v.items")), path)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Rows (group, id, ...) of a map of lists; groups that begin with _ are notes."""
    groups = _parsed(spark, path, "map<string,string>").select(F.explode(F.map_filter("v", lambda k, x: ~k.startswith("_"))).alias("group", "items"))
    lists = groups.select("group", F.from_json("items", f"array<{_ROW}>").alias("items"))
    odd = lists.where("items is null").first()
    if odd is not None:
        raise DataError(f"{path} group {odd['group']} must be a list")
    rows = lists.select("group", F.inline("items"))
    for r in groups.select("group").collect():
        _valid(rows.where(F.col("group") == r["group"]).drop("group"), f"{path}[{r['group']}]")
    return rows


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Rows (stance, id, expect, label, headline, body): two of each stance, with a label and a known expectation."""
    groups = _parsed(spark, path, "map<string,string>").select(F.explode(F.map_filter("v", lambda k, x: ~k.startswith("_"))).alias("stance", "items"))
    lists = groups.select("stance", F.from_json("items", "array<struct<id:string,expect:string,label:string,headline:string,body:string>>").alias("items"))
    held = {r["stance"]: r["items"] for r in lists.collect()}
    if sorted(held) != sorted(C.STANCES) or any(not x or len(x) != 2 for x in held.values()):
        raise DataError(f"{path} must have two examples of each of {', '.join(C.STANCES)}")
    rows = lists.select("stance", F.inline("items"))
    if not rows.where(~F.coalesce(F.col("expect").isin("novel", "common", "off_topic"), F.lit(False)) | (F.coalesce("label", F.lit("")) == "")).isEmpty():
        raise DataError(f"{path}: an example needs a label and a known expectation")
    _valid(rows.select("id", "stance", "headline", "body"), path)
    return rows


def error(headline: Column, body: Column, stance: Column, id_: Column | None = None) -> Column:
    """What is wrong with a submission after normalising, or null."""
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in (("headline", headline), ("body", body), ("stance", stance))]))
    out = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(headline == "", "headline is required")
        .when(F.length(headline) > C.MAX_HEADLINE, f"headline is longer than {C.MAX_HEADLINE}")
        .when(~F.length(body).between(C.MIN_BODY, C.MAX_BODY), f"body needs {C.MIN_BODY} to {C.MAX_BODY} characters")
        .when(~stance.isin(*C.STANCES), "unknown stance")
    )
    return out if id_ is None else out.when(F.trim(id_) == "", "id is blank")


def validated(rows: DataFrame) -> DataFrame:
    """rows normalised, with `error`; an id that stands twice is an error in all its rows."""
    clean = rows.withColumn("headline", F.regexp_replace(normalize(F.col("headline")), r"\s+", " ")).withColumn("body", normalize(F.col("body")))
    n = F.count("*").over(Window.partitionBy("id"))
    wrong = error(F.col("headline"), F.col("body"), F.col("stance"), F.col("id"))
    return clean.withColumn("error", F.coalesce(wrong, F.when(F.col("id").isNotNull() & (n > 1), "id is not unique")))


def replayable(log: DataFrame, reserved: DataFrame) -> DataFrame:
    """Saved rows to add again: admitted, valid, with an id that is neither reserved(id) nor the article's; of equal ids the first by `pos`."""
    good = log.where(F.col("admitted") & F.col("id").isNotNull() & (F.col("id") != "article") & error(F.col("headline"), F.col("body"), F.col("stance"), F.col("id")).isNull())
    first = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return good.join(reserved.select("id"), "id", "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")


def article_error(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "text is blank").when(F.size(F.split(F.trim(text), r"\s+")) > C.MAX_ARTICLE_WORDS, f"text is longer than {C.MAX_ARTICLE_WORDS} words")


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to the log; Spark's commit makes them appear together."""
    rows.withColumn("submitted_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).write.mode("append").parquet(path)
