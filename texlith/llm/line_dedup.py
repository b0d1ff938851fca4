"""Line dedup by content-defined chunks, with DataFrame functions only.

A text's lines are hashed. A boundary stands before a line if the rolling hash of the two lines before it is 0 modulo
`divisor`, so that it depends on content alone and a passage gets the same inner boundaries wherever it stands; a line
of more than `long_words` words is a chunk of its own. Chunks that stand more than once in the corpus, and have more
than one line or are such a line, stay where they come first (by doc_id, then place) and go elsewhere, after their
bytes have been compared with the first one's.

Chunks alone miss short passages, whose ends are in chunks with foreign lines. `runs` finds these by pairs of adjacent
lines; the corpus pipeline removes them too, the query op5 follows its SQL, which knows chunks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texlith.llm._common import cleaned, written

DIVISOR = 3
LONG_WORDS = 50
MIN_WORDS = 8
_WORD = r"[^\x20\x09-\x0D]+"


def _apart(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row: a generator keeps later lambdas from repeating them."""
    made = df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_made"))
    return made.select(*[c for c in df.columns if c not in columns], *[F.col(f"_made.{k}").alias(k) for k in columns])


def _words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))


def chunked(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """docs(text, ...) with `chunks`: arrays of struct(n_lines, chunk, first line); null for a null text."""

    def line(x: Column) -> Column:
        long_ = F.when(F.length(x) > 2 * long_words, _words(x) > long_words).otherwise(F.lit(False))
        return F.struct(F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long").alias("h"), long_.alias("long"))

    df = _apart(docs, _lines=F.split("text", "\n", -1))
    df = _apart(df, _info=F.transform("_lines", line))

    def begins(i: Column) -> Column:
        at = lambda k: F.get("_info", i - k)
        rolled = (at(1)["h"] * 31 + F.coalesce(at(2)["h"], F.lit(0))) % divisor == 0
        return (i == 0) | at(0)["long"] | at(1)["long"] | rolled

    df = _apart(df, _cuts=F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), begins))

    def chunk(start: Column, k: Column) -> Column:
        n = F.coalesce(F.get("_cuts", k + 1), F.size("_lines")) - start
        return F.struct(n.alias("n_lines"), F.array_join(F.slice("_lines", start + 1, n), "\n").alias("chunk"), start.alias("first"))

    return _apart(df, chunks=F.when(F.col("text").isNotNull(), F.transform("_cuts", chunk))).drop("_lines", "_info", "_cuts")


def _who() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("who")


def _repeated(each: DataFrame, text: str, often: DataFrame) -> DataFrame:
    """key, place and `text` of the rows of each(h, key, place, text) whose bytes are those of their first one, without it."""
    is_first = ((F.col("key") == F.col("first_key")) & (F.col("place") == F.col("first_place"))).alias("is_first")
    met = written(each.join(often.hint("merge"), "h").select("h", "key", "place", text, is_first))
    kept = met.where("is_first").select("h", F.col(text).alias("kept")).dropDuplicates(["h"])
    return met.where("not is_first").join(kept.hint("merge"), "h").where(F.col(text).cast("binary") == F.col("kept").cast("binary"))


def _often(each: DataFrame) -> DataFrame:
    """Hashes that stand more than once, with key and place of the first."""
    first = F.min(F.struct("who", "place")).alias("first")
    return written(each.groupBy("h").agg(F.count("*").alias("n"), first).where("n > 1").select("h", F.col("first.who.key").alias("first_key"), F.col("first.place").alias("first_place")))


def runs(keyed: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """key, runs of keyed(doc_id, key, text): arrays of struct(first, last), the lines of each repeated passage.

    A run is a longest row of lines of which each two adjacent ones stand together at an earlier place (by doc_id, then
    line), with more than `long_words` words in all. So a line never goes from the first place where it stands.
    """
    lines = _apart(keyed.where(F.col("text").isNotNull()).select("key", _who(), "text"), text=F.split("text", "\n", -1))
    n = F.size("text") - 1
    pairs = F.zip_with(F.slice("text", F.lit(1), n), F.slice("text", F.lit(2), n), lambda a, b: F.concat(a, F.lit("\n"), b))
    each = lines.where(n > 0).select("key", "who", F.posexplode(pairs).alias("place", "pair")).withColumn("h", F.xxhash64("pair"))
    again = _repeated(each, "pair", _often(each)).dropDuplicates(["key", "place"])
    words = lambda at: _words(F.substring_index("pair", "\n", at))
    again = again.select("key", "place", words(1).alias("words"), words(-1).alias("more"))
    again = again.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("key").orderBy("place")))
    each = again.groupBy("key", "run").agg(F.min("place").alias("first"), (F.max("place") + 1).alias("last"), (F.sum("words") + F.max_by("more", "place")).alias("words"))
    return written(each.where(F.col("words") > long_words).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs")))


@cleaned
def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, divisor: int = DIVISOR, long_words: int = LONG_WORDS, short: bool = False) -> DataFrame:
    """doc_id, text, n_lines, n_removed for each row of docs(doc_id, text, ...): lines before, lines removed.

    A null text stays null with 0 lines. Rows equal in doc_id and text share one fate. A text whose lines all went is
    ''. Chunks of fewer than `min_words` words are left alone. With `short` the lines of `runs` go too. Other columns aren't read. An empty table gives no rows.
    What repeats has no size bound, so that all joins are merge joins, at any size; AQE splits a hot chunk's rows.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    whole = chunked(keyed, divisor, long_words)
    each = whole.select("key", _who(), F.posexplode("chunks").alias("place", "c"))
    each = each.where((F.col("c.n_lines") > 1) | (F.length("c.chunk") > 2 * long_words))
    words = _words(F.col("c.chunk"))
    each = each.select("key", "who", "place", "c.chunk", F.xxhash64("c.chunk").alias("h")).where(F.when(F.expr("c.n_lines") > 1, words >= min_words).otherwise(words > long_words))
    gone = written(_repeated(each, "chunk", _often(each)).groupBy("key").agg(F.collect_set("place").alias("gone")))
    out = whole.join(gone.hint("merge"), "key", "left")
    out = _apart(out, gone=F.coalesce("gone", F.array().cast("array<int>")))
    if short:
        return _without_lines(out.join(runs(keyed, long_words).hint("merge"), "key", "left"))
    out = _apart(out, left=F.transform(_others(F.size("chunks"), F.col("gone")), lambda i: F.get("chunks", i)))
    lines = lambda column: F.coalesce(F.aggregate(column, F.lit(0), lambda n, c: n + c["n_lines"]), F.lit(0))
    text = F.array_join(F.transform("left", lambda c: c["chunk"]), "\n")
    return out.select("doc_id", text.alias("text"), lines("chunks").alias("n_lines"), (lines("chunks") - lines("left")).alias("n_removed"), "key")


def _others(n: Column, some: Column) -> Column:
    """The numbers below n that aren't in an array, in order, by one hash set a text; null if n is."""
    return F.when(n > 0, F.array_except(F.sequence(F.lit(0), n - 1), some))


def _without_lines(out: DataFrame) -> DataFrame:
    """dedup_lines' rows of out(key, doc_id, text, chunks, gone, runs): without lines of either kind."""
    in_chunks = F.transform("gone", lambda g: F.sequence(F.get("chunks", g)["first"], F.get("chunks", g)["first"] + F.get("chunks", g)["n_lines"] - 1))
    in_runs = F.coalesce(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])), F.array().cast("array<array<int>>"))
    out = _apart(out, lines=F.split("text", "\n", -1), dropped=F.flatten(F.concat(in_chunks, in_runs)))
    out = _apart(out, left=F.transform(_others(F.size("lines"), F.col("dropped")), lambda i: F.get("lines", i)))
    size = lambda column: F.coalesce(F.when(F.col(column).isNotNull(), F.size(column)), F.lit(0))
    return out.select("doc_id", F.array_join("left", "\n").alias("text"), size("lines").alias("n_lines"), (size("lines") - size("left")).alias("n_removed"), "key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with repeated chunks and short passages removed from text, all other columns as they are.

    A row whose text was emptied goes; null texts and those that were empty before stay. Rows equal in doc_id and text
    share one fate, so that none of them is the other's repeat; an empty table stays empty.
    """
    done = dedup_lines(docs, short=True).select(F.col("key").alias("_key"), F.col("text").alias("_new"), "n_removed").where("n_removed > 0").dropDuplicates(["_key"])
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))
    joined = keyed.join(done.hint("merge"), keyed["_row_key"] == done["_key"], "left")
    text = F.when(F.col("_key").isNotNull(), F.col("_new")).otherwise(F.col("text")).alias("text")
    left = joined.where(F.col("_key").isNull() | (F.col("_new") != ""))
    return left.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, i, x AS line, ('0x' || substr(md5(x), 1, 8))::BIGINT AS h, len(regexp_extract_all(x, '{_WORD}')) > {LONG_WORDS} AS big
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), b AS (
  SELECT *, CASE WHEN i = 0 OR big OR lag(big) OVER w OR (lag(h) OVER w * 31 + coalesce(lag(h, 2) OVER w, 0)) % {DIVISOR} = 0 THEN 1 ELSE 0 END AS cut
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), k AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM b
), c AS (
  SELECT doc_id, place, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY 1, 2
), e AS (
  SELECT *, len(regexp_extract_all(chunk, '{_WORD}')) AS words FROM c
), g AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone
  FROM e WHERE n > 1 AND words >= {MIN_WORDS} OR n = 1 AND words > {LONG_WORDS}
), o AS (
  SELECT e.doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY e.place) FILTER (WHERE NOT coalesce(gone, false)), '') AS text,
    sum(n)::INTEGER AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::INTEGER AS n_removed
  FROM e LEFT JOIN g USING (doc_id, place) GROUP BY 1
)
SELECT d.doc_id, o.text, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN o USING (doc_id)
"""
