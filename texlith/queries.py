"""The engine's operators over the test tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texlith.functions import constants as C
from texlith.functions import text as T
from texlith.functions.scalars import normal_cdf
from texlith.operators import calibration, copies, lexical, relevance, similarity
from texlith.plans import evaluation, scorer
from texlith.sources.submissions import error, replayable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_WORDS = "regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')"
_FOLDED = "regexp_extract_all(strip_accents(lower(text)), '[a-z]+(?:''[a-z]+)?')"
_STOP = _sql_list(C.STOPWORDS)
_CONTENT = f"list_filter({_FOLDED}, lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"
_STEM = "CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, -3) WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, -2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END"
_TOKENS = f"list_transform({_CONTENT}, lambda w: {_STEM})"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_KNN = f"""k AS (
  SELECT q.vec_id AS id, e.vec_id AS neighbour, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS sim
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id
), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS INTEGER) AS rank FROM k QUALIFY rank <= 5
), r AS (SELECT id, round(0.5 * (1 - max(sim)) + 0.5 * (1 - avg(sim)), 9) AS raw FROM t GROUP BY id)"""
_CDF = "(1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) / 2)"


# dense similarity and calibration


@query(f"WITH {_KNN} SELECT id, rank, neighbour, sim FROM t")
def knn_cosine_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.raw_novelty(knn_cosine_top5(spark, sf_dir)).withColumn("raw", F.round("raw", 9))


@query(f"WITH {_KNN} SELECT id, raw FROM r")
def whole_text_raw_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir)


@query(f"""WITH {_KNN}, m AS (SELECT median(raw) AS m FROM r), s AS (SELECT m, greatest(1.4826 * (SELECT median(abs(raw - m.m)) FROM r, m), 0.01) AS s FROM m),
z AS (SELECT id, raw, (raw - m) / s AS z, abs((raw - m) / s) / sqrt(2.0) AS x FROM r, s), u AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM z)
SELECT id, raw, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN {_CDF} ELSE 1 - {_CDF} END, 6) AS value FROM u""")
def whole_text_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    out = calibration.z_and_cdf(raw, "raw", calibration.robust_scale(raw, "raw"))
    return out.select("id", "raw", F.round("z", 6).alias("z"), F.round("value", 6).alias("value"))


@query("""WITH m AS (SELECT o_orderpriority AS priority, median(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT priority, m AS median, greatest(1.4826 * median(abs(o_totalprice - m)), 0.01) AS scale FROM orders JOIN m ON priority = o_orderpriority GROUP BY 1, 2""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return calibration.robust_scale(orders, "o_totalprice", ["priority"])


@query(f"""WITH z AS (SELECT c_custkey, c_acctbal / 5000.0 AS z, abs(c_acctbal / 5000.0) / sqrt(2.0) AS x FROM customer), u AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM z)
SELECT c_custkey, round(CASE WHEN z >= 0 THEN {_CDF} ELSE 1 - {_CDF} END, 9) AS cdf FROM u""")
def normal_cdf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(normal_cdf(F.col("c_acctbal") / 5000.0), 9).alias("cdf"))


# text operators


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, len({_WORDS})::INTEGER AS n_words, len(list_distinct({_WORDS}))::INTEGER AS n_distinct FROM documents")
def words_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.once(_docs(spark, sf_dir), w=T.words(F.col("text")))
    return w.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(f"SELECT doc_id, len({_TOKENS})::INTEGER AS n_tokens, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def tokens_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.once(_docs(spark, sf_dir), t=T.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN len({_WORDS}) > 0 THEN len(list_filter({_WORDS}, lambda w: list_contains({_STOP}, w))) / len({_WORDS}) ELSE 0.0 END AS stop_share FROM documents")
def stopword_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.stopword_share(F.col("text")).alias("stop_share"))


@query(f"SELECT doc_id, CASE WHEN len({_WORDS}) > 0 THEN len(list_distinct({_WORDS})) / len({_WORDS}) ELSE 0.0 END AS distinct_share FROM documents")
def distinct_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.distinct_share(F.col("text")).alias("distinct_share"))


_GENERIC_ALL = sorted((set(C.GENERIC) | {g[: len(g) - len(b)] + e if b else g + e for g in C.GENERIC for e, b in C.GENERIC_ENDINGS if g.endswith(b)}) - set(C.SPECIFIC) | set(C.GENERIC))
_SPECIFIC = f"list_distinct(list_transform(list_filter({_CONTENT}, lambda w: NOT list_contains({_sql_list(_GENERIC_ALL)}, w)), lambda w: {_STEM}))"


@query(f"SELECT doc_id, len({_SPECIFIC})::INTEGER AS n_specific FROM documents")
def specific_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(T.specific_words(F.col("text"))).alias("n_specific"))


@query(f"SELECT doc_id, power(least(1.0, len({_SPECIFIC}) / 4.0), 2) AS specificity FROM documents")
def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.pow(F.least(F.lit(1.0), F.size(T.specific_words(F.col("text"))) / 4.0), F.lit(2.0)).alias("specificity"))


_NORM = "trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"
_SHINGLES = "CASE WHEN length(s) <= 5 THEN [s] ELSE list_distinct(list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5))) END"


@query(f"SELECT doc_id, len({_SHINGLES})::INTEGER AS n_shingles FROM (SELECT doc_id, {_NORM} AS s FROM documents)")
def shingle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(T.shingles(F.col("text"))).alias("n_shingles"))


@query(r"SELECT doc_id, CASE WHEN length(l) > 0 THEN length(regexp_replace(l, '[A-Za-z]', '', 'g')) / length(l) ELSE 0.0 END AS foreign_share FROM (SELECT doc_id, regexp_replace(text, '\P{L}', '', 'g') AS l FROM documents)")
def foreign_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.foreign_share(F.col("text")).alias("foreign_share"))


_PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?;:]+\s*|,\s+(?:and\s+|but\s+)?|\s+(?:and|but)\s+'), lambda x: trim(x, E' \t\n\r\f\x0b')), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_PARTS})::INTEGER AS n_parts FROM documents")
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(T.clauses(F.col("text"), 0)).alias("n_parts"))


_MERGED = rf"""WITH p AS (SELECT doc_id, {_PARTS} AS ps FROM documents), q AS (SELECT doc_id, unnest(ps) AS x, unnest(range(len(ps))) AS i FROM p),
f AS (SELECT *, sum(CASE WHEN i = 0 OR len(regexp_split_to_array(x, '\s+')) >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM q),
c AS (SELECT doc_id, c, string_agg(x, ' ' ORDER BY i) AS text FROM f GROUP BY 1, 2),
w AS (SELECT doc_id, c, text, {_WORDS} AS ws FROM c), s AS (SELECT doc_id, c, text, len(ws) >= 3 AND (len(ws) < 6 OR
len(list_filter(ws, lambda w: list_contains({_STOP}, w))) / len(ws) >= 0.1 AND len(list_distinct(ws)) / len(ws) >= 0.5) AS good FROM w)"""


@query(_MERGED + " SELECT d.doc_id, count(c)::INTEGER AS n_clauses, md5(coalesce(string_agg(s.text, '|' ORDER BY c), '')) AS digest FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1")
def clause_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.once(_docs(spark, sf_dir), c=T.clauses(F.col("text")))
    return c.select("doc_id", F.size("c").alias("n_clauses"), F.md5(F.array_join("c", "|").cast("binary")).alias("digest"))


@query(_MERGED + " SELECT d.doc_id, count(c) FILTER (WHERE good)::INTEGER AS n_substantive FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1")
def substantive_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.once(_docs(spark, sf_dir), c=T.clauses(F.col("text")))
    return c.select("doc_id", F.size(F.filter("c", T.substantive)).alias("n_substantive"))


@query(_MERGED + f"""SELECT d.doc_id, coalesce(bool_or(good), false) AS has_clause, any_value(len({_WORDS.replace("text", "d.text")})) >= 12
AND any_value(len(list_distinct({_WORDS.replace("text", "d.text")})) / len({_WORDS.replace("text", "d.text")})) < 0.35 AS repetitive FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.once(_docs(spark, sf_dir), c=T.clauses(F.col("text")), w=T.words(F.col("text")))
    repetitive = (F.size("w") >= 12) & (F.size(F.array_distinct("w")) / F.size("w") < 0.35)
    return c.select("doc_id", F.exists("c", T.substantive).alias("has_clause"), repetitive.alias("repetitive"))


# lexical operators

_TERMS = f"t AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2)"
_BTERMS = f"b AS (SELECT id, term, count(*) AS tf FROM (SELECT item_id AS id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY 1, 2)"
_IDF = "n AS (SELECT count(*) AS n FROM benchmark), i AS (SELECT term, count(*) AS df, ln((any_value(n) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM b, n GROUP BY 1)"


def _vec(source: str, name: str) -> str:
    return f"{name}0 AS (SELECT s.id, s.term, i.df, (1 + ln(tf)) * coalesce(idf, ln(n + 1.0) + 1.0) AS w FROM {source} s CROSS JOIN n LEFT JOIN i USING (term)), {name} AS (SELECT id, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}0)"


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(terms, idf, n) of the reference texts."""
    items = table(spark, sf_dir, "benchmark")
    terms = lexical.term_counts(items, "item_id", "text")
    return terms, lexical.idf(terms, items), items.count()


@query(f"WITH {_TERMS} SELECT term, count(*) AS df FROM t GROUP BY 1")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(lexical.term_counts(_docs(spark, sf_dir), "doc_id", "text"))


@query(f"WITH {_BTERMS}, {_IDF} SELECT term, df, round(idf, 9) AS idf FROM i")
def idf_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir)[1].select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_BTERMS}, {_IDF}, {_vec('b', 'v')} SELECT id, term, round(w, 9) AS w FROM v WHERE df IS NOT NULL")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, idf, n = _corpus(spark, sf_dir)
    return lexical.tfidf(terms, idf, n).withColumn("w", F.round("w", 9))


_COSINES = f"""WITH {_TERMS}, {_BTERMS}, {_IDF}, {_vec('b', 'e')}, {_vec('t', 'q')},
c AS (SELECT q.id, e.id AS entry, round(sum(q.w * e.w), 8) AS sim FROM q JOIN e USING (term) WHERE q.df IS NOT NULL GROUP BY 1, 2)"""


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, idf, n = _corpus(spark, sf_dir)
    asked = lexical.tfidf(lexical.term_counts(_docs(spark, sf_dir), "doc_id", "text"), idf, n)
    return lexical.cosines(asked, lexical.tfidf(terms, idf, n)).withColumn("sim", F.round("sim", 8))


@query(_COSINES + " SELECT id, entry, sim, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, entry) AS INTEGER) AS rank FROM c QUALIFY rank <= 5")
def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(_cosines(spark, sf_dir), 5)


@query(f"SELECT doc_id, least(1.0, len({_TOKENS}) / 6.0) AS confidence FROM documents")
def lexical_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.least(F.lit(1.0), F.size(T.tokens(F.col("text"))) / 6.0).alias("confidence"))


# copies and categories

_SH = "SELECT {k} AS id, unnest(" + _SHINGLES + ") AS sh FROM (SELECT {k}, " + _NORM + " AS s FROM {t})"
_CONTAINED = f"""WITH d AS ({_SH.format(k='doc_id', t='documents')}), b AS ({_SH.format(k='item_id', t='benchmark')}), nd AS (SELECT id, count(*) AS n FROM d GROUP BY 1),
nb AS (SELECT id, count(*) AS n FROM b GROUP BY 1), p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS common FROM d JOIN b USING (sh) GROUP BY 1, 2),
c AS (SELECT doc_id, item_id, common, common / least(nd.n, nb.n) AS held FROM p JOIN nd ON nd.id = doc_id JOIN nb ON nb.id = item_id)"""


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.contained(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query(_CONTAINED + " SELECT doc_id, item_id, common, round(held, 9) AS held FROM c WHERE held >= 0.6")
def shingle_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contained(spark, sf_dir).select("doc_id", "item_id", "common", F.round("held", 9).alias("held"))


@query(_CONTAINED + """, h AS (SELECT * FROM c WHERE held >= 0.6), u AS (SELECT doc_id, count(DISTINCT sh) AS copied FROM h JOIN b ON b.id = item_id JOIN d ON d.id = doc_id AND d.sh = b.sh GROUP BY 1),
a AS (SELECT doc_id, arg_max(item_id, held * 1000000 - item_id / 1000000.0) AS of_item FROM h GROUP BY 1)
SELECT u.doc_id, of_item, round(copied / nd.n, 9) AS share, copied / nd.n >= 0.5 AS is_copy FROM u JOIN a USING (doc_id) JOIN nd ON nd.id = u.doc_id""".replace(", sh) AS", ", b.sh) AS").replace("DISTINCT sh", "DISTINCT b.sh"))
def near_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(_contained(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("""WITH c AS (SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) + count(*) AS t FROM c), p AS (SELECT category, (n + 1) / t AS p FROM c, t)
SELECT category, round(p, 9) AS p, round(1 - p / (SELECT max(p) FROM p), 9) AS rarity FROM p""")
def category_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    total = n.agg((F.sum("n") + F.count("*")).alias("t"))
    p = n.crossJoin(F.broadcast(total)).select("category", ((F.col("n") + 1) / F.col("t")).alias("p"))
    top = p.agg(F.max("p").alias("top"))
    return p.crossJoin(F.broadcast(top)).select("category", F.round("p", 9).alias("p"), F.round(1 - F.col("p") / F.col("top"), 9).alias("rarity"))


# relevance


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).alias("positive"), F.col("embedding").cast("array<double>").alias("v"))


_E = "e AS (SELECT vec_id AS id, label = 0 AS positive, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings)"


@query(f"WITH {_E} SELECT positive, pos, round(avg(x), 9) AS mean, count(*) AS n FROM e GROUP BY 1, 2")
def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.class_means(_labelled(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


@query(f"WITH {_E} SELECT a.positive, a.pos AS i, b.pos AS j, round(sum(a.x * b.x), 8) AS sxx FROM e a JOIN e b ON a.id = b.id AND a.pos <= b.pos GROUP BY 1, 2, 3")
def scatter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.scatter_stats(_labelled(spark, sf_dir)).withColumn("sxx", F.round("sxx", 8))


@query(f"""WITH {_E}, m AS (SELECT pos, avg(x) FILTER (WHERE positive) - avg(x) FILTER (WHERE NOT positive) AS w FROM e GROUP BY 1)
SELECT id, round(sum(x * w), 8) AS p FROM e JOIN m USING (pos) GROUP BY 1""")
def fisher_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With full shrinkage the direction is the difference of the means (times a constant, left out here)."""
    return _projected(spark, sf_dir).select("id", "p")


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _labelled(spark, sf_dir)
    means = relevance.class_means(v).groupBy("pos").agg((F.max(F.when(F.col("positive"), F.col("mean"))) - F.max(F.when(~F.col("positive"), F.col("mean")))).alias("w"))
    w = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]).alias("w"))
    p = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return v.crossJoin(F.broadcast(w)).select("id", "positive", F.round(p, 8).alias("p"))


@query(f"""WITH {_E}, m AS (SELECT pos, avg(x) FILTER (WHERE positive) - avg(x) FILTER (WHERE NOT positive) AS w FROM e GROUP BY 1),
s AS (SELECT id, any_value(positive) AS positive, round(sum(x * w), 8) AS p FROM e JOIN m USING (pos) GROUP BY 1),
g AS (SELECT c.p, abs((SELECT count(*) FROM s WHERE positive AND s.p < c.p) / (SELECT count(*) FROM s WHERE positive) - (SELECT count(*) FROM s WHERE NOT positive AND s.p >= c.p) / (SELECT count(*) FROM s WHERE NOT positive)) AS gap FROM (SELECT DISTINCT p FROM s) c)
SELECT p AS boundary FROM g ORDER BY round(gap, 12), p LIMIT 1""")
def equal_error_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.equal_error_boundary(_projected(spark, sf_dir))


@query()
def fisher_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned gate: projections on the shrunken direction, relative to the boundary's band."""
    v = _labelled(spark, sf_dir)
    p = relevance.projections(v, relevance.discriminant(v))
    at = calibration.equal_error_boundary(p).crossJoin(calibration.median(p.where("positive"), "p", name="mid"))
    both = p.crossJoin(F.broadcast(at)).withColumn("width", F.greatest(F.col("mid") - F.col("boundary"), F.lit(1e-6)))
    rel = F.least(F.greatest((F.col("p") - F.col("boundary") + 0.2 * F.col("width")) / (0.4 * F.col("width")), F.lit(0.0)), F.lit(1.0))
    return both.select("id", "positive", "p", rel.alias("relevance"), (rel * rel * (3 - 2 * rel)).alias("gate"))


_TOPIC = f"""WITH {_E}, t AS (SELECT pos, sum(x) AS t FROM e WHERE positive GROUP BY 1), g0 AS (SELECT pos, avg(x) AS g FROM e WHERE NOT positive GROUP BY 1), g AS (SELECT pos, g / (SELECT sqrt(sum(g * g)) FROM g0) AS g FROM g0),
s AS (SELECT id, sum(x * t) AS tv, sum(x * x) AS vv, sum(x * g) AS vg FROM e JOIN t USING (pos) JOIN g USING (pos) WHERE positive GROUP BY 1),
m AS (SELECT id, round((tv - vv) / sqrt(greatest((SELECT sum(t * t) FROM t) - 2 * tv + vv, 1e-24)) - vg, 8) AS margin FROM s)"""


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _labelled(spark, sf_dir)
    total = relevance.vector_sum(v.where("positive"))
    other = relevance.vector_sum(v.where("not positive"))
    norm = F.sqrt(F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x))
    generic = T.once(other, norm=norm).select(F.transform("total", lambda x: x / F.col("norm")).alias("g"))
    return relevance.loo_margins(v.where("positive"), total, generic).withColumn("margin", F.round("margin", 8))


@query(_TOPIC + " SELECT id, margin FROM m")
def topic_margin_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _margins(spark, sf_dir)


@query(_TOPIC + " SELECT median(margin) AS on_topic_margin, count(*) AS n FROM m")
def topic_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    margins = _margins(spark, sf_dir)
    return calibration.median(margins, "margin", name="on_topic_margin").crossJoin(margins.agg(F.count("*").alias("n")))


# evaluation

_JUDGED = "j AS (SELECT doc_id, quality, toxic, lang, CAST(length(text) AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("double").alias("s"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


@query(f"WITH {_JUDGED} SELECT quality AS label, count(*) AS n, avg(CASE WHEN s >= 1000 THEN 1.0 ELSE 0.0 END) AS rate FROM j GROUP BY 1")
def label_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.pass_rates(_judged(spark, sf_dir).withColumn("label", F.col("quality")), "label", F.col("s") >= 1000)


@query(f"WITH {_JUDGED} SELECT lang AS topic, count(*) AS n, avg(CASE WHEN s <= 2000 THEN 1.0 ELSE 0.0 END) AS rate FROM j WHERE toxic = 0 GROUP BY 1")
def topic_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.pass_rates(_judged(spark, sf_dir).where("toxic = 0").withColumn("topic", F.col("lang")), "topic", F.col("s") <= 2000)


@query(f"WITH {_JUDGED} SELECT toxic, count(*) AS n, avg(CASE WHEN s <= 5000 THEN 1.0 ELSE 0.0 END) AS rate FROM j GROUP BY 1")
def loose_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.pass_rates(_judged(spark, sf_dir), "toxic", F.col("s") <= 5000)


_AUC = f"WITH {_JUDGED} SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / count(*), 9) AS auc FROM j a JOIN j b ON a.quality = 1 AND b.quality = 0"


@query(_AUC)
def auc_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.auc(_judged(spark, sf_dir).select(F.col("s").alias("p"), (F.col("quality") == 1).alias("positive"))).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {_JUDGED} SELECT quality AS label, doc_id, s AS score, CAST(row_number() OVER (ORDER BY quality, s DESC, doc_id) AS INTEGER) AS rank FROM j WHERE s < 1000 QUALIFY rank <= 25")
def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst failures: by label, the highest scores first."""
    failed = _judged(spark, sf_dir).where("s < 1000").select(F.col("quality").alias("label"), F.col("doc_id").alias("id"), F.col("s").alias("score"))
    return evaluation.worst(failed, 25).withColumnRenamed("id", "doc_id")


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL INTERSECT SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 1)")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts two splits share; a held-out split must share none."""
    docs = _docs(spark, sf_dir)
    return evaluation.overlap(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text")


_TOK = r"list_transform(regexp_extract_all(text, '\p{L}[\p{L}\p{N}\p{M}_''/]*'), lambda w: lower(w))"


@query(rf"""WITH t AS (SELECT doc_id, {_TOK} AS ws, regexp_replace(text, '\P{{L}}', '', 'g') AS l FROM documents), f AS (SELECT *, len(list_filter(ws, lambda w: list_contains({_sql_list(C.FOREIGN_WORDS)}, strip_accents(w)))) AS foreign_words,
len(list_filter(ws, lambda w: list_contains({_STOP}, w))) AS stops FROM t)
SELECT doc_id, length(regexp_replace(l, '[A-Za-z]', '', 'g')) > 0.3 * length(l) AND length(l) > 0 OR foreign_words >= 2 AND foreign_words > stops AS looks_foreign FROM f""")
def language_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.looks_foreign(F.col("text")).alias("looks_foreign"))


@query("""WITH s AS (SELECT conv_id, turn, substr(text, 1, 130) AS headline, text AS body, CASE role WHEN 'user' THEN 'support' WHEN 'assistant' THEN 'oppose' ELSE role END AS stance FROM conversations)
SELECT conv_id, turn, CASE WHEN headline = '' THEN 'headline is required' WHEN length(headline) > 120 THEN 'headline is longer than 120' WHEN NOT (length(body) BETWEEN 20 AND 2000) THEN 'body needs 20 to 2000 characters'
WHEN stance NOT IN ('support', 'oppose', 'mixed', 'undecided') THEN 'unknown stance' END AS error FROM s""")
def submission_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with turns as submissions; null if nothing is."""
    stance = F.when(F.col("role") == "user", "support").when(F.col("role") == "assistant", "oppose").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("text", 1, 130).alias("headline"), F.col("text").alias("body"), stance.alias("stance"))
    return rows.select("conv_id", "turn", error(F.col("headline"), F.col("body"), F.col("stance")).alias("error"))


# the whole engine


def _state(spark: SparkSession, sf_dir: str) -> scorer.State:
    """A corpus from all reference texts by item_id: the first is the article; of each twelve after it six are its
    comments, one is an anchor and five are negatives. What is scored is the whole of `conversations`."""
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]
    dealt = [(i, t, (i - 1) % 12) for i, t in enumerate(items) if i]
    held = [scorer.Submission(f"c{i:02d}", t[:60], t, C.STANCES[i % 4]) for i, t, k in dealt if k < 6]
    return scorer.State((items[0][:60], items[0]), held, [t for _, t, k in dealt if k == 6] or items[:1], [(t[:60], t) for _, t, k in dealt if k > 6])


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stance = F.element_at(F.array(*map(F.lit, C.STANCES)), (F.pmod(F.xxhash64("conv_id"), F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.substring("text", 1, 60).alias("headline"), F.col("text").alias("body"), stance.alias("stance"))


@query()
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorer.score(_submissions(spark, sf_dir), _state(spark, sf_dir))


@query()
def admission_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_breakdown(spark, sf_dir).groupBy("admitted", "admission").agg(F.count("*").alias("n"))


@query()
def verdict_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_breakdown(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'view' AND value >= 10 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 0))
SELECT event_id, user_id FROM l WHERE k = 1""")
def replay_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted rows whose id isn't reserved, the first of each id: events stand for a log of submissions."""
    log = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("pos"), F.lit("A headline").alias("headline"), F.lit("A body that is long enough.").alias("body"), F.lit("mixed").alias("stance"),
        ((F.col("event_type") != "view") & (F.col("value") >= 10)).alias("admitted"),
    )
    reserved = table(spark, sf_dir, "customer").where("c_nationkey = 0").select(F.col("c_custkey").cast("string").alias("id"))
    return replayable(log, reserved).select("event_id", "user_id")


@query()
def submit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of conversations submitted in order of (conv, turn) to one of eight articles, each with the same first
    corpus; pos is a turn's place in its article."""
    from texlith.streaming.fold import submit_fold as fold

    state = _state(spark, sf_dir)
    rows = _submissions(spark, sf_dir).withColumn("conv", F.split("id", "-")[0].cast("long")).withColumn("turn", F.split("id", "-")[1].cast("long"))
    rows = rows.withColumn("article", F.concat(F.lit("a"), (F.col("conv") % 8).cast("string")))
    pos = F.row_number().over(Window.partitionBy("article").orderBy("conv", "turn")).cast("long").alias("pos")
    return fold(rows.select("article", pos, "id", "headline", "body", "stance"), {f"a{k}": state for k in range(8)})
