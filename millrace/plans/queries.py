"""The registered queries of the retrieval engine, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking as C
from ..operators import keyword as K
from ..operators import links as L
from ..operators import maintain as M
from ..operators import merge
from ..operators import ranking as R
from ..operators import substring as SUB
from ..sources import files as S
from ..streaming.watch import quiet_bursts
from ..sources.storage import exists, shared_folder
from . import index as I
from . import spaces
from . import search as SE
from .search import SearchOptions, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Hits per query, dimension of hashed vectors, and thresholds of similarity on these tables.
TOP, DIM, STRONG, FAIR = 10, 64, 0.75, 0.55
#: Media windows that a task makes and merges, about; more get more tasks.
WINDOWS = 1 << 18
#: Folders of the indexes that this process has built, by session and tables.
_built: dict[tuple[str, str], str] = {}


def query(sql: str | None = None):  # type: ignore[no-untyped-def]
    def keep(f):  # type: ignore[no-untyped-def]
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each document as one analyzed chunk."""
    return K.analyzed(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source"))


def index(spark: SparkSession, d: str) -> I.Index:
    """The index of the documents, each one chunk with a hashed vector. The first query that wants it builds it, below the shared
    folder; those after it in the session search what is there."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built or not exists(spark, _built[key]):
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        I.build(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source"), folder, DIM)
        _built[key] = folder
    return I.opened(spark, _built[key])


def path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


_TOK = r"list_filter(regexp_extract_all(lower({}), '[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{Nd}]+'), lambda x: (length(x) > 1 AND x NOT IN (STOP)) OR regexp_matches(x, '^[\p{Han}\p{Hiragana}\p{Katakana}]$'))".replace("STOP", ", ".join(f"'{w}'" for w in T.STOPWORDS))
_tok = lambda c: _TOK.replace("{}", c)
_BASE = f"""
toks AS (SELECT doc_id, lang, source, {_tok("coalesce(text, '')")} AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len(t)) AS average FROM toks WHERE len(t) > 0),
ask AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({_tok("text")}) AS term FROM benchmark)),
size AS (SELECT query_id, count(*) AS asked FROM ask GROUP BY query_id)"""
_KEYWORD = (
    _BASE
    + """,
kwall AS (
  SELECT query_id, p.doc_id AS chunk_id, count(*) AS met,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(k.t) / average))), 4) AS score
  FROM ask JOIN dfs USING (term) JOIN post p USING (term) JOIN toks k ON k.doc_id = p.doc_id, stats
  WHERE {where} GROUP BY ALL),
kw AS (SELECT query_id, chunk_id, score, 2 * met >= asked AS kw,
              row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
       FROM kwall JOIN size USING (query_id) QUALIFY rank <= {pool})"""
)
_kw = lambda pool, where="true": _KEYWORD.replace("{pool}", str(pool)).replace("{where}", where)


@query(f"WITH {_BASE} SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM post GROUP BY term")
def tokenize_df(spark, d):
    return K.postings(chunks(spark, d)).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


@query(f"WITH {_BASE} SELECT n, round(average, 6) AS average FROM stats")
def corpus_stats(spark, d):
    return K.corpus_stats(chunks(spark, d)).select("n", F.round("average", 6).alias("average"))


@query(f"WITH {_kw(TOP)} SELECT query_id, chunk_id, score, rank FROM kw")
def bm25_topk(spark, d):
    return K.keyword_hits(asked(spark, d), index(spark, d).postings, TOP).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


_WHERE = "k.lang = 'en' AND k.source || '/' || k.lang || '/' || k.doc_id || '.md' GLOB 'src[1-9]*/en/*.md'"


@query(f"WITH {_kw(TOP, _WHERE)} SELECT query_id, chunk_id, score, rank FROM kw")
def bm25_filtered_topk(spark, d):
    docs = table(spark, d, "documents")
    allowed = docs.where((F.col("lang") == "en") & path().rlike(T.search_glob("src[1-9]*/en/*.md"))).select(F.col("doc_id").alias("chunk_id"))
    return K.keyword_hits(asked(spark, d), index(spark, d).postings, TOP, allowed).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_kw(5 * TOP)} SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE kw) AS covered FROM kw GROUP BY query_id")
def keyword_coverage(spark, d):
    return K.keyword_hits(asked(spark, d), index(spark, d).postings, 5 * TOP).groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if("kw").alias("covered"))


def _vectors(spark, d, dim=None):
    e = table(spark, d, "embeddings")
    vector = F.col("embedding") if dim is None else V.fit(F.col("embedding"), dim)
    return e.select(F.col("vec_id").alias("row_id"), vector.alias("vector"), "label")


def _self_search(rows, k):
    """Every twentieth vector, which is the query set, against all."""
    return V.search(rows.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "vector"), rows, k)


def _vec_sql(vector="embedding::DOUBLE[]", where="true", k=TOP):
    return f"""v AS (SELECT vec_id, label, {vector} AS e FROM embeddings),
vec AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, r.label, round(list_cosine_similarity(q.e, r.e), 6) AS sim,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, r.e), 6) DESC, r.vec_id) AS rank
        FROM v q, v r WHERE q.vec_id % 20 = 0 AND {where} QUALIFY rank <= {k})"""


def _vec_out(hits):
    return hits.select("query_id", "row_id", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


_VEC_SELECT = "SELECT query_id, row_id, round(sim, 4) AS sim, rank FROM vec"
_FIT32 = "list_transform(embedding[1:32]::DOUBLE[], lambda x: (x / sqrt(list_sum(list_transform(embedding[1:32]::DOUBLE[], lambda y: y * y))))::FLOAT)::DOUBLE[]"


@query(f"WITH {_vec_sql()} {_VEC_SELECT}")
def vector_topk(spark, d):
    return _vec_out(_self_search(_vectors(spark, d), TOP))


@query(f"WITH {_vec_sql(where='r.label IN (1, 3, 5)')} {_VEC_SELECT}")
def vector_filtered_topk(spark, d):
    rows = _vectors(spark, d)
    return _vec_out(V.search(rows.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "vector"), rows.where(F.col("label").isin(1, 3, 5)), TOP))


@query(f"WITH {_vec_sql(_FIT32)} {_VEC_SELECT}")
def vector_fit_topk(spark, d):
    return _vec_out(_self_search(_vectors(spark, d, 32), TOP))


_HASHED = f"""
dvec AS (SELECT doc_id, b, count(*)::DOUBLE AS c FROM (SELECT doc_id, ('0x' || substring(md5(unnest(t)), 1, 8))::BIGINT % {DIM} AS b FROM toks) GROUP BY ALL),
dnorm AS (SELECT doc_id, sqrt(sum(c * c)) AS z FROM dvec GROUP BY doc_id),
qtok AS (SELECT item_id AS query_id, unnest({_tok("text")}) AS term FROM benchmark),
qvec AS (SELECT query_id, ('0x' || substring(md5(term), 1, 8))::BIGINT % {DIM} AS b, count(*)::DOUBLE AS c FROM qtok GROUP BY ALL),
qnorm AS (SELECT query_id, sqrt(sum(c * c)) AS z FROM qvec GROUP BY query_id),
cosine AS (
  SELECT q.query_id, n.doc_id AS chunk_id, round(coalesce(x.dot, 0) / (q.z * n.z), 6) AS sim
  FROM qnorm q CROSS JOIN dnorm n
  LEFT JOIN (SELECT query_id, doc_id, sum(q.c * d.c) AS dot FROM qvec q JOIN dvec d USING (b) GROUP BY ALL) x ON x.query_id = q.query_id AND x.doc_id = n.doc_id),
vl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM cosine QUALIFY rank <= {{pool}})"""


def _hybrid_sql(pool: int) -> str:
    return f"""{_kw(pool)}, {_HASHED.replace("{pool}", str(pool))},
fused AS (
  SELECT query_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + w.rank), 0), 8) AS score,
         coalesce(sim, 0) AS sim, coalesce(w.kw, false) AS kw
  FROM vl v FULL JOIN kw w USING (query_id, chunk_id)),
hyb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)"""


def _hybrid(spark, d, **options):
    """Hybrid search of all benchmark texts over all documents."""
    own = index(spark, d)
    return search(_questions(spark, d), own.chunks, SearchOptions(k=TOP, **options), postings=own.postings, blocks=own.blocks)


def _questions(spark, d):
    return SE.embedded(asked(spark, d), lambda text: V.embed_tokens(T.tokens(text), DIM), DIM)


@query(f"WITH {_hybrid_sql(5 * TOP)} SELECT query_id, chunk_id, round(score, 4) AS score, round(sim, 3) AS sim, kw, rank FROM hyb WHERE rank <= {TOP}")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d).select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.round("sim", 3).alias("sim"), "kw", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_hybrid_sql(5 * TOP)}
SELECT query_id, chunk_id, rank, d.source || '/' || d.lang || '/' || d.doc_id || '.md' AS path, p.doc_id AS pair_id,
       least(d.doc_id, coalesce(p.doc_id, d.doc_id)) AS pair_key
FROM hyb JOIN documents d ON d.doc_id = chunk_id
LEFT JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) > 1) p ON p.text = d.text AND p.doc_id <> d.doc_id
WHERE rank <= {TOP}"""
)
def hybrid_details(spark, d):
    docs = table(spark, d, "documents")
    twins = docs.groupBy(F.sha2("text", 256).alias("_h")).agg(F.min("doc_id").alias("pair_id"), F.count("*").alias("_n")).where("_n > 1")
    named = docs.select("doc_id", path().alias("path"), F.sha2("text", 256).alias("_h"))
    hits = _hybrid(spark, d).join(named, F.col("chunk_id") == F.col("doc_id"))
    met = hits.join(twins, (hits["_h"] == twins["_h"]) & (F.col("pair_id") != F.col("doc_id")), "left")
    return met.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "path", "pair_id", F.least("doc_id", F.coalesce("pair_id", "doc_id")).alias("pair_key"))


@query(
    f"""WITH {_hybrid_sql(20 * TOP)},
g AS (SELECT h.query_id, h.chunk_id, t.source, h.rank, count(*) OVER w AS chunks, max(h.sim) OVER w AS sim, bool_or(h.kw) OVER w AS kw,
             row_number() OVER (PARTITION BY h.query_id, t.source ORDER BY h.rank) AS i
      FROM hyb h JOIN toks t ON t.doc_id = h.chunk_id WINDOW w AS (PARTITION BY h.query_id, t.source)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM g WHERE i = 1)
SELECT query_id, chunk_id, source, rank, chunks, round(sim, 3) AS sim, kw FROM f WHERE place <= {TOP}"""
)
def group_by_doc(spark, d):
    return _hybrid(spark, d, group="source").select("query_id", "chunk_id", "source", F.col("rank").cast("long").alias("rank"), "chunks", F.round("sim", 3).alias("sim"), "kw")


def _confidence_sql(setting: str) -> str:
    floor = {"high": "3", "medium": "2", "auto": "CASE WHEN best >= 2 THEN 2 ELSE 0 END"}.get(setting, "0")
    near = f"AND NOT (best >= 2 AND top >= {STRONG} AND NOT kw AND round(top - sim, 6) > 0.1)" if setting == "auto" else ""
    return f"""WITH {_hybrid_sql(5 * TOP)},
rated AS (SELECT *, CASE WHEN sim = 0 AND NOT kw THEN 0 ELSE least(3, CASE WHEN sim >= {STRONG} THEN 3 WHEN sim >= {FAIR} THEN 2 ELSE 1 END + kw::INT) END AS level FROM hyb),
best AS (SELECT *, max(level) OVER (PARTITION BY query_id) AS best, max(sim) OVER (PARTITION BY query_id) AS top FROM rated),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM best WHERE best = 0 OR (level >= {floor} {near}))
SELECT query_id, chunk_id, rank, level::INT AS level FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS j FROM kept WHERE NOT (best = 1 AND {floor} <= 1) OR i <= 3) WHERE j <= {TOP}"""


def _confidence(setting):
    def run(spark, d):
        return _hybrid(spark, d, confidence=setting, strong=STRONG, fair=FAIR).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "level")

    run.__name__ = f"confidence_{setting}"
    return run


for _setting in ("auto", "all", "medium", "high"):
    query(_confidence_sql(_setting))(_confidence(_setting))


@query(
    f"""WITH {_kw(TOP)}, c AS (SELECT query_id, chunk_id, rank, d.text, substring(d.text, 1, 200) AS head FROM kw JOIN documents d ON d.doc_id = chunk_id),
b AS (SELECT *, regexp_extract(head, '(?s)^(.*)[ \\n]', 1) AS before FROM c)
SELECT query_id, chunk_id, rank, CASE WHEN length(text) <= 200 THEN text WHEN octet_length(encode(before)) > 100 THEN before || '…' ELSE head || '…' END AS snippet FROM b"""
)
def final_topk_trim(spark, d):
    hits = K.keyword_hits(asked(spark, d), index(spark, d).postings, TOP)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return hits.join(docs, "chunk_id").select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), T.trimmed(F.col("text"), 200).alias("snippet"))


def _relevant(spark, d):
    """Documents that hold a passage, in any case: postings of its rarest whole word narrow them down, then texts are searched.

    The first and last token may be parts of words in a document, so they don't narrow; passages without others go through a gram index.
    """
    return _holding(asked(spark, d), index(spark, d).postings, table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


def _holding(passages, postings, documents):
    """query_id, chunk_id of the documents (chunk_id, text) that hold a passage (query_id, text). While the rarest words have few postings these are known to
    every task, and neither the other postings nor the texts are dealt."""
    questions = passages.withColumn("q", F.lower("text"))
    inner = F.slice(T.tokens(F.col("text")), 2, F.greatest(F.size(T.tokens(F.col("text"))) - 2, F.lit(0)))
    words = questions.select("query_id", F.explode(F.array_distinct(inner)).alias("term"))
    own = postings.of(words.select("term").distinct())
    first = words.join(own.terms, "term").groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("_r"))
    many = first.agg(F.coalesce(F.sum("_r.df"), F.lit(0)), F.count("*")).first()
    told = F.broadcast if max(many) <= SE.TOLD_HITS else lambda rows: rows
    rarest = first.select("query_id", F.col("_r.term").alias("term"))
    held = replace(own, blocks=own.blocks.join(told(rarest.select("term").distinct()), "term", "left_semi")).post.select("term", "chunk_id")
    near = held.join(told(rarest), "term").select("query_id", "chunk_id")
    met = documents.join(told(near), "chunk_id").join(told(questions.select("query_id", "q")), "query_id")
    found = met.where("contains(lower(text), q)").select("query_id", "chunk_id")
    texts = documents.select("chunk_id", F.lower("text").alias("t"))
    bare = questions.join(words.select("query_id").distinct(), "query_id", "left_anti").select(F.col("query_id").alias("short_id"), F.col("q").alias("text"))
    return found.union(SUB.contained(bare, texts.select(F.col("chunk_id").alias("long_id"), F.col("t").alias("text"))))


@query("SELECT l.conv_id AS short_id, l.turn, d.conv_id AS long_id, d.turn AS long_turn FROM (SELECT conv_id, turn, substring(text, 3, 12) AS s FROM conversations WHERE turn = 0) l, conversations d WHERE l.s <> '' AND contains(d.text, l.s)")
def substring_join(spark, d):
    """Turns that hold the characters 3 to 14 of a conversation's first turn."""
    turns = table(spark, d, "conversations")
    own = F.struct("conv_id", "turn")
    short = turns.where("turn = 0").select(own.alias("short_id"), F.substring("text", 3, 12).alias("text"))
    found = SUB.contained(short, turns.select(own.alias("long_id"), "text"))
    return found.select(F.col("short_id.conv_id").alias("short_id"), F.col("short_id.turn").alias("turn"), F.col("long_id.conv_id").alias("long_id"), F.col("long_id.turn").alias("long_turn"))


@query(
    f"""WITH {_kw(TOP)}, rel AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b, documents d WHERE contains(lower(d.text), lower(b.text))),
f AS (SELECT r.query_id, min(k.rank) AS first FROM rel r LEFT JOIN kw k USING (query_id, chunk_id) GROUP BY r.query_id)
SELECT count(*) AS queries, round(avg(coalesce((first <= 1)::INT, 0)), 6) AS hit_at_1, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS hit_at_5,
       round(avg(coalesce((first <= 10)::INT, 0)), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f"""
)
def retrieval_metrics(spark, d):
    return R.retrieval_metrics(K.keyword_hits(asked(spark, d), index(spark, d).postings, TOP), _relevant(spark, d))


@query(
    f"""WITH {_kw(5 * TOP)}, rel AS (SELECT DISTINCT item_id AS query_id, source FROM benchmark b, documents d WHERE contains(lower(d.text), lower(b.text))),
p AS (SELECT query_id, source, min(rank) AS first FROM kw JOIN toks ON doc_id = chunk_id GROUP BY ALL),
k AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS rank FROM p),
f AS (SELECT r.query_id, min(k.rank) AS first FROM rel r LEFT JOIN k USING (query_id, source) GROUP BY r.query_id)
SELECT count(*) AS queries, round(avg(coalesce((first <= 1)::INT, 0)), 6) AS hit_at_1, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS hit_at_5,
       round(avg(coalesce((first <= 10)::INT, 0)), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM f"""
)
def page_metrics(spark, d):
    """Sources as pages: several hits of one source are one."""
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    hits = R.page_ranks(K.keyword_hits(asked(spark, d), index(spark, d).postings, 5 * TOP).join(sources, "chunk_id"), "source").withColumnRenamed("source", "chunk_id")
    relevant = _relevant(spark, d).join(sources, "chunk_id").select("query_id", F.col("source").alias("chunk_id")).distinct()
    return R.retrieval_metrics(hits, relevant)


# Two sets of vectors of each pair of neighbours: whole ones of one against those of the other cut to half their length.
@query(
    """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT round(list_cosine_similarity(x.e[1:32], y.e[33:64]), 6) AS sim FROM a x JOIN a y USING (vec_id)),
o AS (SELECT sim, row_number() OVER (ORDER BY sim) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT max(n) AS n, min(sim) AS least, max(sim) FILTER (WHERE i = n // 10) AS p10, max(sim) FILTER (WHERE i = n // 2) AS median, round(avg(sim), 6) AS mean FROM o"""
)
def vector_parity(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    half = lambda from_: e.select("id", F.slice("embedding", from_, 32).alias("vector"))
    return V.parity(half(1), half(33))


@query(f"WITH {_vec_sql(k=1)}, half AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e[1:32], r.e[1:32]), 6) DESC, r.vec_id) AS rank FROM v q, v r WHERE q.vec_id % 20 = 0 AND r.vec_id % 20 <> 0 QUALIFY rank = 1), "
       "whole AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, r.e), 6) DESC, r.vec_id) AS rank FROM v q, v r WHERE q.vec_id % 20 = 0 AND r.vec_id % 20 <> 0 QUALIFY rank = 1) "
       "SELECT count(*) AS n, count(*) FILTER (WHERE a.row_id = b.row_id) AS agree FROM whole a JOIN half b USING (query_id)")
def vector_agreement(spark, d):
    """Whether whole vectors and those cut to half their length have the same nearest one, the queries themselves aside."""
    found = []
    for rows in (_vectors(spark, d), _vectors(spark, d, 32)):
        found.append(V.search(rows.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "vector"), rows.where("row_id % 20 <> 0"), 1))
    return V.top_agreement(*found)


@query("SELECT vec_id, len(embedding) * 4 AS bytes, embedding[1]::DOUBLE AS first, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vector_codec(spark, d):
    """Vectors to bytes and back."""
    e = table(spark, d, "embeddings").select("vec_id", V.encoded(F.col("embedding")).alias("blob"))
    back = e.select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), V.decoded(F.col("blob")).alias("v"))
    return back.select("vec_id", "bytes", F.get("v", F.lit(0)).cast("double").alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("SELECT vec_id, len(embedding) AS dim, len(embedding) >= 32 AS fits FROM embeddings")
def vector_dims(spark, d):
    """Vectors of the stated length, and whether they can be cut to 32: one of another length would end the query."""
    e = table(spark, d, "embeddings").select("vec_id", V.of_length(F.col("embedding"), 64).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("dim"), V.fit(F.col("v"), 32).isNotNull().alias("fits"))


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{0B}\x{85}\p{Z}]+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, greatest((length(coalesce(text, '')) + 3) // 4, ({_WORDS} * 4 + 2) // 3)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def _atoms(column):
    return lambda spark, d: table(spark, d, "documents").select("doc_id", F.posexplode(column(F.col("text"))).alias("i", "part")).select("doc_id", F.col("i").cast("long").alias("i"), F.sha2("part", 256).alias("part"))


_ATOMS = "SELECT doc_id, (i - 1)::BIGINT AS i, sha256(parts[i]) AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split({}, chr(30)), lambda x: x <> '') AS parts FROM documents))"
QUERIES["paragraph_atoms"] = _atoms(T.paragraphs)
ORACLE["paragraph_atoms"] = _ATOMS.format("replace(text, chr(10) || chr(10), chr(10) || chr(10) || chr(30))")
QUERIES["sentence_atoms"] = _atoms(T.sentences)
ORACLE["sentence_atoms"] = _ATOMS.format(r"regexp_replace(text, '([.!?]\s|\n)', '\1' || chr(30), 'g')")


@query(
    f"""WITH {_BASE}, s AS (SELECT doc_id, t, unnest(range(0, greatest(1, ceil((len(t) - 64) / 48.0)::BIGINT + 1) * 48, 48)) AS start FROM toks WHERE len(t) > 0)
SELECT doc_id, start, len(t[start + 1 : start + 64]) AS n, md5(array_to_string(t[start + 1 : start + 64], ' ')) AS digest FROM s"""
)
def stride_chunks(spark, d):
    own = chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), "tokens", F.explode(C.stride_starts(F.size("tokens"), 64, 16)).alias("start"))
    part = F.slice("tokens", (F.col("start") + 1).cast("int"), F.lit(64))
    return own.select("doc_id", "start", F.size(part).cast("long").alias("n"), F.md5(F.array_join(part, " ")).alias("digest"))


_CLOCK = "CASE WHEN {0} // 3600000 > 0 THEN printf('%d:%02d:%02d', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000) ELSE printf('%d:%02d', {0} // 60000, {0} % 60000 // 1000) END"


@query(
    f"""WITH m AS (SELECT o_orderkey, round(o_totalprice)::BIGINT AS dur FROM orders),
w AS (SELECT o_orderkey, dur, unnest(range(0, greatest(0, ceil((dur - 30000) / 25000.0))::BIGINT + 1)) * 25000 AS start_ms FROM m WHERE dur > 0),
e AS (SELECT o_orderkey, start_ms, least(start_ms + 30000, dur) AS end_ms FROM w)
SELECT o_orderkey, start_ms, end_ms, {_CLOCK.format("start_ms")} || '-' || {_CLOCK.format("end_ms")} AS span FROM e"""
)
def media_windows(spark, d):
    dur = F.round("o_totalprice").cast("long")
    own = table(spark, d, "orders").select("o_orderkey", F.explode(C.media_windows(dur)).alias("w")).select("o_orderkey", "w.start_ms", "w.end_ms")
    return own.withColumn("span", F.concat(T.clock(F.col("start_ms")), F.lit("-"), T.clock(F.col("end_ms"))))


@query(
    """WITH p AS (SELECT conv_id, turn, text, conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS paired FROM conversations)
SELECT conv_id, turn + 1 AS page, 'text' AS modality FROM p WHERE NOT paired AND trim(text) <> '' UNION ALL SELECT conv_id, turn + 1, 'pdf_page' FROM p"""
)
def pdf_units(spark, d):
    pages = table(spark, d, "conversations")
    paired = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id")).distinct()
    texts = pages.where("trim(text) <> ''").join(paired, "conv_id", "left_anti")
    unit = lambda df, name: df.select("conv_id", (F.col("turn") + 1).alias("page"), F.lit(name).alias("modality"))
    return unit(texts, "text").unionByName(unit(pages, "pdf_page"))


_MARKDOWN = "'![a pic](x/' || n_chars || '.png \"t\")' || chr(10) || chr(10) || chr(10) || chr(10) || '<img class=x alt=\"tagged\" src=y>' || chr(10) || text || chr(10) || '[ref]: http://a/' || doc_id || chr(10) || 'see [1]: no' || chr(10)"


@query(rf"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKDOWN}, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<img [^>]*alt="([^"]*)"[^>]*>', '\1', 'g'), '(?m)^\[[^\]]+\]:[^\n]*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))) AS digest FROM documents""")
def text_cleanup(spark, d):
    docs = table(spark, d, "documents")
    id_, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    text = F.concat(F.lit("![a pic](x/"), n, F.lit('.png "t")\n\n\n\n<img class=x alt="tagged" src=y>\n'), "text", F.lit("\n[ref]: http://a/"), id_, F.lit("\nsee [1]: no\n"))
    return docs.select("doc_id", F.sha2(T.clean_markdown(text), 256).alias("digest"))


@query("SELECT doc_id, sha256(trim(regexp_replace(translate(chr(2) || text || chr(1) || chr(31) || ' ', chr(2), '-'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'))) AS digest FROM documents")
def page_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.clean_page(F.concat(F.lit("\x02"), "text", F.lit("\x01\x1f "))), 256).alias("digest"))


# Pages as code: cut to lines at some tags, every seventh is line breaks alone, every eleventh has a NUL.
_CODE = "(SELECT page_id, CASE WHEN page_id % 7 = 0 THEN chr(10) || ' ' || chr(10) WHEN page_id % 11 = 0 THEN html || chr(0) WHEN page_id % 2 = 0 THEN replace(html, '</p>', '</p>' || chr(10)) || chr(10) ELSE html END AS t FROM pages)"


def _code(spark, d):
    html = F.col("html")
    text = F.when(F.col("page_id") % 7 == 0, "\n \n").when(F.col("page_id") % 11 == 0, F.concat(html, F.lit("\x00"))).when(F.col("page_id") % 2 == 0, F.concat(F.replace(html, F.lit("</p>"), F.lit("</p>\n")), F.lit("\n"))).otherwise(html)
    return table(spark, d, "pages").select("page_id", "url", text.alias("text"))


@query(f"SELECT page_id, CASE WHEN contains(t, chr(0)) THEN 'binary' WHEN octet_length(encode(t)) // (len(string_split(t, chr(10))) - ends_with(t, chr(10))::INT) > 300 THEN 'minified' WHEN NOT regexp_matches(t, '\\S') THEN 'empty' END AS problem FROM {_CODE}")
def code_reject(spark, d):
    return _code(spark, d).select("page_id", S.code_problem(F.col("text").cast("binary")).alias("problem"))


@query("""SELECT doc_id, doc_id || '.md' || CASE WHEN lang = 'fr' THEN '' ELSE ' > ' || lang END AS title,
sha256(CASE WHEN source = 'src1' THEN (n_chars - 1)::VARCHAR ELSE CASE WHEN lang = 'fr' THEN '' WHEN source = 'src2' THEN lang || ': ' ELSE lang || chr(10) || chr(10) END || text END) AS input, translate(source || '-' || lang || '_x', '-_', '  ') AS name FROM documents""")
def embed_input(spark, d):
    modality = F.when(F.col("source") == "src1", "pdf_page").when(F.col("source") == "src2", "image").otherwise("text")
    units = table(spark, d, "documents").select("doc_id", path().alias("path"), modality.alias("modality"), F.when(F.col("lang") != "fr", F.col("lang")).alias("heading_path"), "text", F.col("n_chars").alias("page"), "source", "lang")
    name = S.file_words(F.concat(F.lit("a-b/"), "source", F.lit("-"), "lang", F.lit("_x.tar")))
    return SE.embedding_input(units).select("doc_id", "title", F.sha2("input", 256).alias("input"), name.alias("name"))


_PATH = "source || '/' || lang || '/' || doc_id || '.md'"


@query(f"SELECT doc_id FROM documents WHERE {_PATH} GLOB 'src[0-4]*/[!e]?/*7.md'")
def glob_filter(spark, d):
    return table(spark, d, "documents").where(path().rlike(T.search_glob("src[0-4]*/[^e]?/*7.md"))).select("doc_id")


@query(rf"SELECT doc_id FROM documents WHERE NOT regexp_matches({_PATH}, '^(?:.*/)?fr/.*$') AND NOT regexp_matches({_PATH}, '^src1[^/]*/de/[^/]*\.md$') AND NOT starts_with({_PATH}, 'src3/')")
def ignore_filter(spark, d):
    return table(spark, d, "documents").where(~S.ignored(path(), ["**/fr/**", "src1*/de/*.md", "src3"])).select("doc_id")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'markdown' WHEN 'de' THEN 'pdf' WHEN 'fr' THEN 'code' END AS kind FROM documents")
def kind_map(spark, d):
    ext = F.when(F.col("lang") == "en", ".MD").when(F.col("lang") == "de", ".pdf").when(F.col("lang") == "fr", ".Py").otherwise(".txt")
    return table(spark, d, "documents").select("doc_id", S.kind(F.concat("source", F.lit("/x"), ext)).alias("kind"))


@query("SELECT page_id FROM pages WHERE length(html) * 100 > 1048576 OR regexp_matches(url, '\\.(?:min\\.js|min\\.css|map)$') OR string_split(url, '/')[-1] IN ('yarn.lock', 'go.sum')")
def generated_filter(spark, d):
    return table(spark, d, "pages").where(S.generated(F.col("url"), F.char_length("html") * 100)).select("page_id")


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'pdf/' || doc_id || '.pdf' END AS source FROM documents")
def front_matter_source(spark, d):
    head = F.when(F.col("lang") == "en", F.concat(F.lit('---\ntitle: x\nsource: "pdf/'), F.col("doc_id").cast("string"), F.lit('.pdf"\n---\n'))).when(F.col("lang") == "de", F.concat(F.lit("---\nsource: pdf/"), F.col("doc_id").cast("string"), F.lit(".pdf\n...\n"))).otherwise("---\ntitle: y\n---\nsource: none\n")
    return table(spark, d, "documents").select("doc_id", S.front_matter_source(F.concat(head, "text")).alias("source"))


# Two snapshots of the corpus: the earlier one lacks the toxic documents, the later one those of low quality. In between,
# Spanish documents have moved, German ones were edited, French ones only touched.
_OLD = f"old AS (SELECT doc_id, {_PATH} AS path, 'markdown' AS kind, sha256(text) AS sha, octet_length(encode(text))::BIGINT AS size, doc_id * 1000 AS mtime, CASE WHEN source = 'src5' THEN 'stale' ELSE 'done' END AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"
_NEW = f"new AS (SELECT doc_id, CASE lang WHEN 'es' THEN 'moved/' ELSE '' END || {_PATH} AS path, 'markdown' AS kind, sha256(CASE lang WHEN 'de' THEN text || ' edited' ELSE text END) AS sha, octet_length(encode(CASE lang WHEN 'de' THEN text || ' edited' ELSE text END))::BIGINT AS size, doc_id * 1000 + CASE WHEN lang IN ('de', 'fr') THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"


def _snapshots(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    old = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    old = old.select("doc_id", path().alias("path"), F.lit("markdown").alias("kind"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 1000).alias("mtime"), F.when(F.col("source") == "src5", "stale").otherwise("done").alias("status"))
    body = F.when(F.col("lang") == "de", F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    new = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti")
    new = new.select("doc_id", F.concat(F.when(F.col("lang") == "es", "moved/").otherwise(""), path()).alias("path"), F.lit("markdown").alias("kind"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("size"), (F.col("doc_id") * 1000 + F.col("lang").isin("de", "fr").cast("int")).alias("mtime"))
    return old, new


@query(
    f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' WHEN o.status = 'stale' AND o.sha = n.sha THEN 'revived'
WHEN o.size = n.size AND o.mtime = n.mtime THEN 'unchanged' WHEN o.sha = n.sha THEN 'touched' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.path = n.path"""
)
def snapshot_diff(spark, d):
    return M.snapshot_diff(*_snapshots(spark, d))


@query(
    f"""WITH {_OLD}, {_NEW}, g AS (SELECT path, kind, sha, row_number() OVER (PARTITION BY sha, kind ORDER BY path) AS n FROM old WHERE path NOT IN (SELECT path FROM new)),
a AS (SELECT path, kind, sha, row_number() OVER (PARTITION BY sha, kind ORDER BY path) AS n FROM new WHERE path NOT IN (SELECT path FROM old))
SELECT g.path AS old_path, a.path AS new_path FROM g JOIN a USING (sha, kind, n)"""
)
def move_detect(spark, d):
    old, new = (x.select("path", "kind", "sha256") for x in _snapshots(spark, d))
    return M.moves(old.join(new, "path", "left_anti"), new.join(old, "path", "left_anti"))


# Transcriptions and PDFs: a text per document, a PDF per English or French one under another folder; some texts name one.
_MD = "md AS (SELECT 'md/' || source || '/' || doc_id || '.md' AS path, CASE WHEN lang = 'en' AND source = 'src1' THEN 'pdf/src1/' || doc_id || '.pdf' WHEN source = 'src2' THEN 'pdf/none.pdf' END AS source, CASE WHEN lang = 'en' THEN 'pdf/' || source || '/' || doc_id || '.pdf' END AS mirror, doc_id FROM documents)"
_PDF = "pdf AS (SELECT 'pdf/' || source || '/' || doc_id || '.pdf' AS path, doc_id FROM documents WHERE lang IN ('en', 'fr'))"
_PAIRS = f"""{_MD}, {_PDF},
p1 AS (SELECT path AS md_path, source AS pdf_path FROM md WHERE source IN (SELECT path FROM pdf) QUALIFY row_number() OVER (PARTITION BY source ORDER BY path) = 1),
p2 AS (SELECT path AS md_path, mirror AS pdf_path FROM md WHERE source IS NULL AND mirror IN (SELECT path FROM pdf) AND mirror NOT IN (SELECT pdf_path FROM p1)
       QUALIFY row_number() OVER (PARTITION BY mirror ORDER BY path) = 1),
u AS (SELECT doc_id, min(path) AS path FROM pdf GROUP BY doc_id HAVING count(*) = 1),
p3 AS (SELECT m.path AS md_path, u.path AS pdf_path FROM md m JOIN u USING (doc_id) WHERE m.source IS NULL AND m.path NOT IN (SELECT md_path FROM p2)
       AND u.path NOT IN (SELECT pdf_path FROM p1) AND u.path NOT IN (SELECT pdf_path FROM p2)),
paired AS (SELECT *, 'source' AS how FROM p1 UNION ALL SELECT *, 'mirror' FROM p2 UNION ALL SELECT *, 'name' FROM p3)"""


def _pairing(spark, d):
    docs = table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    file = lambda top, ext: F.concat(F.lit(top), "source", F.lit("/"), key, F.lit(ext))
    named = F.when((F.col("lang") == "en") & (F.col("source") == "src1"), file("pdf/", ".pdf")).when(F.col("source") == "src2", "pdf/none.pdf")
    texts = docs.select(file("md/", ".md").alias("path"), named.alias("source"), F.when(F.col("lang") == "en", file("pdf/", ".pdf")).alias("mirror"))
    return texts, docs.where(F.col("lang").isin("en", "fr")).select(file("pdf/", ".pdf").alias("path"))


@query(f"WITH {_PAIRS} SELECT md_path, pdf_path, how FROM paired")
def pairing(spark, d):
    return M.pairs(*_pairing(spark, d))


@query(f"WITH {_PAIRS} SELECT p.path, m.md_path, m.md_path IS NOT NULL AS requeue FROM pdf p LEFT JOIN paired m ON m.pdf_path = p.path")
def apply_pairs(spark, d):
    texts, pdfs = _pairing(spark, d)
    return pdfs.join(M.pairs(texts, pdfs), F.col("path") == F.col("pdf_path"), "left").select("path", "md_path", F.col("md_path").isNotNull().alias("requeue"))


# Links: a conversation is a parent, the length of a turn's text names the image it shows. Later, user turns show nothing.
@query(
    """WITH o AS (SELECT DISTINCT conv_id AS parent_id, 'img/' || (length(text) % 97) || '.png' AS child_path FROM conversations),
n AS (SELECT DISTINCT conv_id AS parent_id, 'img/' || (length(text) % 97) || '.png' AS child_path FROM conversations WHERE role = 'assistant')
SELECT DISTINCT child_path FROM o WHERE (parent_id, child_path) NOT IN (SELECT (parent_id, child_path) FROM n) AND child_path NOT IN (SELECT child_path FROM n)"""
)
def link_reassign(spark, d):
    turns = table(spark, d, "conversations")
    links = lambda t: t.select(F.col("conv_id").alias("parent_id"), F.concat(F.lit("img/"), (F.char_length("text") % 97).cast("string"), F.lit(".png")).alias("child_path")).distinct()
    return M.dropped_links(links(turns), links(turns.where("role = 'assistant'")))


@query(f"WITH {_BASE}, lost AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT term, count(*) AS df_before, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM lost)) AS df_after FROM post GROUP BY term")
def delete_cascade(spark, d):
    own = index(spark, d).postings
    return M.frequencies_after(own.terms, own.post, table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")))


@query(f"WITH {_BASE}, n AS (SELECT doc_id, {_tok('lang')} AS t FROM documents WHERE source = 'src1'), a AS (SELECT doc_id, t FROM toks WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, t FROM n), g AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM a) GROUP BY term) SELECT term, df, s.n, s.total FROM g, (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::BIGINT AS total FROM a) s")
def replace_postings(spark, d):
    """Stored postings after the chunks of one source were replaced, their frequencies and totals adjusted instead of counted anew."""
    docs = table(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("text"))
    after = index(spark, d).postings.replaced(docs, K.analyzed(docs))
    return after.terms.crossJoin(after.totals).select("term", "df", F.col("n").cast("long").alias("n"), F.col("total").cast("long").alias("total"))


@query(f"WITH {_BASE}, n AS (SELECT doc_id, {_tok('lang')} AS t FROM documents WHERE source = 'src1'), a AS (SELECT doc_id, t FROM toks WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, t FROM n) SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM a) GROUP BY term")
def replace_chunks(spark, d):
    own = chunks(spark, d).select(F.col("chunk_id").alias("document_id"), "tokens")
    new = table(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").alias("document_id"), T.tokens(F.col("lang")).alias("tokens"))
    return K.document_frequencies(K.postings(M.replace_chunks(own, new).withColumnRenamed("document_id", "chunk_id")))


_KIND = "CASE lang WHEN 'en' THEN 'markdown' WHEN 'de' THEN 'pdf' WHEN 'fr' THEN 'audio' ELSE 'image' END"


def _jobs(spark, d):
    kind = F.when(F.col("lang") == "en", "markdown").when(F.col("lang") == "de", "pdf").when(F.col("lang") == "fr", "audio").otherwise("image")
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), kind.alias("kind"), F.col("n_chars").alias("enqueued_at"), path().alias("path"), F.octet_length("text").cast("double").alias("bytes"), "source")


@query(f"SELECT doc_id AS document_id, row_number() OVER (ORDER BY CASE {_KIND} WHEN 'markdown' THEN 0 WHEN 'code' THEN 1 WHEN 'pdf' THEN 2 WHEN 'image' THEN 3 WHEN 'audio' THEN 4 ELSE 5 END, n_chars, {_PATH}) <= 100 AS first_hundred FROM documents")
def job_order(spark, d):
    jobs = _jobs(spark, d)
    first = M.job_order(jobs).select("document_id").limit(100)
    return jobs.join(first.withColumn("_f", F.lit(True)), "document_id", "left").select("document_id", F.coalesce("_f", F.lit(False)).alias("first_hundred"))


@query("SELECT d.doc_id AS document_id, (CASE WHEN source = 'src1' THEN 2 ELSE 0 END + CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::INT AS attempts, CASE WHEN source = 'src1' AND toxic = 1 THEN 'failed' ELSE 'queued' END AS state FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1")
def job_transitions(spark, d):
    jobs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("source") == "src1", 2).otherwise(0).alias("attempts"))
    outcomes = table(spark, d, "labels").groupBy(F.col("doc_id").alias("document_id")).agg(F.when(F.max("toxic") == 1, "failed").otherwise("done").alias("outcome"))
    return M.step_jobs(jobs, outcomes)


@query("SELECT user_id, event_id, value, hits FROM (SELECT user_id, event_id, value, count(*) OVER (PARTITION BY user_id) AS hits, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def cache_upsert(spark, d):
    return M.upsert_latest(table(spark, d, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "value", "hits")


@query("SELECT key, hits FROM (SELECT user_id AS key, count(*) AS hits, max(ts) AS last_used FROM events GROUP BY user_id) WHERE last_used >= TIMESTAMP '2024-01-15' ORDER BY hits DESC, last_used DESC, key DESC LIMIT 40")
def cache_evict(spark, d):
    cache = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("hits"), F.max("ts").alias("last_used"))
    return M.evict(cache, F.to_timestamp(F.lit("2024-01-15 00:00:00")), 40).select("key", "hits")


# A rebuild is cancelled: toxic documents changed meanwhile, and those without a token have no chunk.
@query(f"WITH {_BASE} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR len(t) = 0 THEN 'pending' ELSE 'done' END AS status FROM toks")
def cancel_shadow(spark, d):
    dirty = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"), F.lit(True).alias("_d")).distinct()
    return chunks(spark, d).join(dirty, "chunk_id", "left").select(F.col("chunk_id").alias("doc_id"), F.when(F.coalesce("_d", F.lit(False)) | (F.col("bm25_len") == 0), "pending").otherwise("done").alias("status"))


@query("SELECT source, count(*) AS all_docs, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS ready, coalesce(sum(CASE WHEN quality = 1 THEN n_chars END), 0)::BIGINT AS good_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def shadow_progress(spark, d):
    met = table(spark, d, "documents").join(table(spark, d, "labels").withColumnRenamed("doc_id", "_l"), F.col("doc_id") == F.col("_l"), "left")
    return met.groupBy("source").agg(F.count("*").alias("all_docs"), F.count("_l").alias("ready"), F.coalesce(F.sum(F.when(F.col("quality") == 1, F.col("n_chars"))), F.lit(0)).alias("good_chars"))


@query("SELECT lang AS kind, CASE WHEN source = 'src5' THEN 'stale' ELSE 'done' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def status_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("kind"), F.when(F.col("source") == "src5", "stale").otherwise("done").alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH f AS (SELECT unnest(['.', 'src1', 'src1/en', 'src']) AS folder) SELECT folder, count(doc_id) AS n FROM f LEFT JOIN documents ON folder = '.' OR {_PATH} = folder OR starts_with({_PATH}, folder || '/') GROUP BY folder")
def folder_counts(spark, d):
    folders = spark.createDataFrame([(".",), ("src1",), ("src1/en",), ("src",)], "folder string")  # the configured folders
    docs = table(spark, d, "documents").select("doc_id", path().alias("path"))
    return folders.join(docs, S.folder_covers(F.col("folder"), F.col("path")), "left").groupBy("folder").agg(F.count("doc_id").alias("n"))


@query(f"SELECT doc_id, CASE WHEN starts_with({_PATH}, 'src1/') OR starts_with({_PATH}, 'src2/en/') THEN 'stale' ELSE 'done' END AS status FROM documents")
def stale_mark(spark, d):
    docs = table(spark, d, "documents").select("doc_id", path().alias("path"), F.lit("done").alias("status"))
    return M.mark_stale(docs, ["src1", "src2/en"]).select("doc_id", "status")


@query(f"SELECT source, count(*) AS n, sum(CASE WHEN {_KIND} = 'image' THEN 1 ELSE 0 END)::BIGINT AS images, round(sum(CASE WHEN {_KIND} = 'pdf' THEN octet_length(encode(text)) ELSE 0 END)::DOUBLE, 3) AS pdf_bytes FROM documents GROUP BY source")
def consent_totals(spark, d):
    return M.consent_totals(_jobs(spark, d), "source")


@query(
    """WITH r AS (SELECT event_type, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY event_type)
SELECT event_type, len(v) AS samples, round(list_reduce(v, lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE), 6) AS rate FROM r"""
)
def ewma_rate(spark, d):
    rates = M.moving_rates(table(spark, d, "events"), "event_type", "ts", "event_id", "value")
    return rates.select("event_type", "samples", F.round("rate", 6).alias("rate"))


# A rate that was saved goes on, here that of every type but one.
@query(
    """WITH r AS (SELECT event_type, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY event_type)
SELECT event_type, len(v) AS samples, round(list_reduce(list_prepend(CASE WHEN event_type = 'click' THEN v[1] ELSE 100.0 END, v), lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE), 6) AS rate FROM r"""
)
def ewma_saved(spark, d):
    events = table(spark, d, "events")
    known = events.where("event_type <> 'click'").select("event_type", F.lit(100.0).alias("rate")).distinct()
    return M.moving_rates(events, "event_type", "ts", "event_id", "value", known).select("event_type", "samples", F.round("rate", 6).alias("rate"))


@query(f"WITH j AS (SELECT {_KIND} AS kind, octet_length(encode(text))::DOUBLE AS b FROM documents) SELECT kind, count(*) AS jobs, round(sum(CASE kind WHEN 'image' THEN 1.0::DOUBLE WHEN 'markdown' THEN greatest(1.0::DOUBLE, b / 4096) WHEN 'pdf' THEN greatest(1.0::DOUBLE, b / 81920) ELSE greatest(1.0::DOUBLE, b / 16384) END), 4) AS cost FROM j GROUP BY kind")
def progress_eta(spark, d):
    return _jobs(spark, d).groupBy("kind").agg(F.count("*").alias("jobs"), F.round(F.sum(M.work_cost(F.col("kind"), F.col("bytes"))), 4).alias("cost"))


_COST = "CASE kind WHEN 'image' THEN 1.0::DOUBLE WHEN 'markdown' THEN greatest(1.0::DOUBLE, b / 4096) WHEN 'pdf' THEN greatest(1.0::DOUBLE, b / 81920) ELSE greatest(1.0::DOUBLE, b / 16384) END"


@query(f"""WITH j AS (SELECT {_KIND} AS kind, octet_length(encode(text))::DOUBLE AS b, (doc_id % 5) / 4.0::DOUBLE AS done FROM documents), c AS (SELECT *, {_COST} AS cost FROM j)
SELECT round(100 * sum(cost * done) / sum(cost), 4) AS percent, round(sum(cost * (1 - done) * CASE kind WHEN 'markdown' THEN 2.5::DOUBLE WHEN 'pdf' THEN 1.0::DOUBLE WHEN 'audio' THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END), 4) AS eta FROM c""")
def work_progress(spark, d):
    """A rate was measured for texts alone; the rest of the kinds take the usual time."""
    jobs = _jobs(spark, d).select("kind", M.work_cost(F.col("kind"), F.col("bytes")).alias("cost"), ((F.col("document_id") % 5) / 4.0).alias("done"))
    rates = table(spark, d, "region").limit(1).select(F.lit("markdown").alias("kind"), F.lit(2.5).alias("rate"))
    return M.progress(jobs, rates).select(F.round("percent", 4).alias("percent"), F.round("eta", 4).alias("eta"))


@query(f"SELECT doc_id AS document_id, CASE WHEN {_KIND} = 'audio' THEN 'done' ELSE 'pending' END AS status, CASE WHEN {_KIND} = 'audio' THEN 'no vectors of audio' END AS note FROM documents")
def media_skip(spark, d):
    return M.skip_media(_jobs(spark, d), ["text", "image"]).select("document_id", "status", "note")


@query(f"WITH l AS (SELECT DISTINCT conv_id FROM conversations) SELECT doc_id AS document_id FROM documents WHERE {_KIND} = 'image' AND doc_id IN (SELECT conv_id FROM l)")
def linked_skip(spark, d):
    links = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("child_path"))
    return M.skip_linked(_jobs(spark, d).withColumn("path", F.col("document_id").cast("string")), links).select("document_id")


# Results of all shapes, from turns: pages, moments that may start at 0, linked images, pairs, groups and labels.
_ROWS = """(SELECT conv_id AS query_id, turn + 1 AS rank, length(text) / 8 AS score, CASE WHEN role = 'user' THEN 0 ELSE length(text) % 8 / 8 END AS sim, turn % 4 AS level, 'f' || conv_id AS path,
turn % 3 AS page, CASE WHEN turn % 2 = 0 THEN 0 ELSE turn * 25000 END AS start_, CASE WHEN role = 'user' THEN 0 ELSE turn * 25000 + 30000 END AS end_, CASE WHEN turn = 0 THEN '' ELSE role END AS heading, text,
CASE WHEN turn = 1 THEN 'md' ELSE '' END AS paired, CASE WHEN turn = 2 THEN 'up' END AS parent, turn % 2 AS chunks FROM conversations)"""


def _rows(spark, d):
    turns = table(spark, d, "conversations")
    user, n, turn = F.col("role") == "user", F.char_length("text"), F.col("turn").cast("int")
    start, end = F.when(turn % 2 == 0, 0).otherwise(turn * 25000), F.when(user, 0).otherwise(turn * 25000 + 30000)
    return turns.select(
        F.col("conv_id").alias("query_id"), (turn + 1).alias("rank"), (n / 8).alias("score"), F.when(user, 0.0).otherwise(n % 8 / 8).alias("sim"), (turn % 4).alias("level"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("path"),
        F.lit("pdf").alias("kind"), F.lit("text").alias("modality"), (turn % 3).alias("page"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.when(turn == 0, "").otherwise(F.col("role")).alias("heading"), "text",
        F.when(turn == 1, "md").otherwise("").alias("paired_path"), F.when(turn == 2, "up").alias("parent_path"), (turn % 2).cast("long").alias("chunks"),
    )


@query(f"""SELECT query_id, rank::INT AS rank, score, CASE WHEN sim > 0 THEN sim END AS similarity, CASE level WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END AS confidence, path, CASE WHEN page > 0 THEN page::INT END AS page,
CASE WHEN end_ > 0 THEN start_::BIGINT END AS start_ms, CASE WHEN end_ > 0 THEN end_::BIGINT END AS end_ms, nullif(heading, '') AS heading_path, sha256(text) AS text, nullif(paired, '') AS paired_path, parent AS parent_path, CASE WHEN chunks > 0 THEN chunks::BIGINT END AS chunks,
(5 + (sim > 0)::INT + (level > 0)::INT + (page > 0)::INT + 2 * (end_ > 0)::INT + (heading <> '')::INT + (paired <> '')::INT + (parent IS NOT NULL)::INT + (chunks > 0)::INT)::INT AS fields FROM {_ROWS}""")
def result_json(spark, d):
    schema = "score double, similarity double, confidence string, path string, page int, start_ms long, end_ms long, heading_path string, text string, paired_path string, parent_path string, chunks long"
    told = SE.result_json(_rows(spark, d)).select("query_id", "rank", F.from_json("json", schema).alias("j"), F.size(F.json_object_keys("json")).alias("fields"))
    return told.select("query_id", "rank", "j.*", "fields").withColumn("text", F.sha2("text", 256))


@query(f"""WITH t AS (SELECT *, trim(regexp_replace(text, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS plain, {_CLOCK.format("start_::BIGINT")} || '-' || {_CLOCK.format("end_::BIGINT")} AS span FROM {_ROWS})
SELECT query_id, rank::INT AS rank, concat_ws(chr(10), printf('%2d', rank::INT) || '. ' || path || CASE WHEN page > 0 THEN ', page ' || page ELSE '' END || CASE WHEN end_ > start_ THEN ', ' || span ELSE '' END || ' (' ||
CASE WHEN level > 0 THEN CASE level WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END || ', similarity ' || printf('%.2f', round(sim::DOUBLE, 2)) ELSE 'score ' || printf('%.3f', score::DOUBLE) END || ')',
'    shown in ' || parent, '    transcribed in ' || coalesce(nullif(paired, ''), CASE WHEN paired = '' THEN NULL END), CASE WHEN NOT end_ > start_ AND heading <> '' THEN '    ' || heading END,
'    ' || CASE WHEN length(plain) > 220 THEN substring(plain, 1, 220) || '…' ELSE nullif(plain, '') END) AS lines FROM t""")
def result_lines(spark, d):
    rows = _rows(spark, d).withColumns({"paired_path": F.nullif("paired_path", F.lit("")), "sim": F.round("sim", 2)})
    return SE.shown(rows)


@query()
def markdown_chunks(spark, d):
    return C.chunk_documents(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("# "), "source", F.lit("\n\n"), "text").alias("text")))


@query()
def code_chunks(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("document_id"), F.col("url").alias("path"), F.regexp_replace("html", "(</[a-z]+>)", "$1\n").alias("text"))
    return C.chunk_code(pages.where(S.code_problem(F.col("text")).isNull()))


# Titles with marks of all kinds; whether a small section joins the next, by whether both fit into a chunk.
@query(
    """WITH s AS (SELECT doc_id, lang || ' of ' || source || ' a*b link pic <x' AS title, n_chars % 7 AS n FROM documents), w AS (SELECT *, repeat('word ', 7 * n::INT + 2) AS body FROM s),
j AS (SELECT *, greatest((length(trim(body)) + 3) // 4, ((7 * n + 2) * 4 + 2) // 3) AS size FROM w)
SELECT doc_id AS document_id, 0 AS ord, title AS heading_path, CASE WHEN size < 16 THEN trim(body) || chr(10) || chr(10) || '## Next' || chr(10) || 'after' ELSE trim(body) END AS text, 0 AS page FROM j
UNION ALL SELECT doc_id, 1, title || ' > Next', 'after', 0 FROM j WHERE size >= 16"""
)
def heading_sections(spark, d):
    docs = table(spark, d, "documents")
    body = F.expr("repeat('word ', cast(7 * (n_chars % 7) + 2 as int))")
    text = F.concat(F.lit("# **"), "lang", F.lit("** _of_ `"), "source", F.lit("` a\\*b [link](u) ![pic](v) \\<x ##\n\n"), body, F.lit("\n\n## <b>Next</b>\nafter\n"))
    found = C.chunk_documents(docs.select(F.col("doc_id").alias("document_id"), text.alias("text")), 64, 8)
    return found.select("document_id", "ord", "heading_path", "text", "page")


def _media_hits(spark, d):
    """Ranked hits of media windows: per customer the windows of its orders, the dearest first, each in the order of time."""
    length = F.round("o_totalprice").cast("long")
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc"), "o_totalprice").withColumn("_size", C.window_count(length)).where("_size is not null")
    files = files.repartition((files.agg(F.sum("_size")).first()[0] or 0) // WINDOWS + 1, "query_id")
    # Of files alike, each window's copies stand together. A place is the windows of the files before, those before it in its own and in those alike, and its copy's number.
    alike, upto = Window.partitionBy("query_id", "o_totalprice", "doc"), Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "doc")
    placed = files.withColumns({"_n": F.count("*").over(alike), "_c": F.row_number().over(alike.orderBy("doc"))})
    placed = placed.withColumn("_before", F.sum("_size").over(upto.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size") * F.col("_n"))
    own = placed.select("*", F.posexplode(C.media_windows(length)).alias("i", "w"))
    rank = (F.col("_before") + F.col("i") * F.col("_n") + F.col("_c")).cast("int")
    kind = F.when((F.col("i") % 2 == 0) | (F.col("doc") % 3 == 0), "video").otherwise("audio")
    return own.select("query_id", rank.alias("rank"), "doc", (1.0 / (F.col("i") + 1)).alias("sim"), (F.col("i") % 4 == 1).alias("kw"), kind.alias("modality"), F.lit("").alias("heading"), F.col("w.start_ms").alias("start"), F.col("w.end_ms").alias("end"))


# Windows overlap their neighbours, and two fit the longest span: those of an even place take in the next one, and a short last one.
@query(
    f"""WITH m AS (SELECT o_custkey AS query_id, o_orderkey AS doc, o_totalprice, round(o_totalprice)::BIGINT AS dur FROM orders),
w AS (SELECT *, unnest(range(0, greatest(0, ceil((dur - 30000) / 25000.0))::BIGINT + 1)) AS i FROM m WHERE dur > 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o_totalprice DESC, doc, i) AS r, i * 25000 AS s, least(i * 25000 + 30000, dur) AS e, CASE WHEN i % 2 = 0 OR doc % 3 = 0 THEN 'video' ELSE 'audio' END AS modality FROM w),
g AS (SELECT query_id, doc, min(r) AS r, max(1.0::DOUBLE / (i + 1)) AS sim, bool_or(i % 4 = 1) AS kw, CASE WHEN count(DISTINCT modality) > 1 THEN 'audio+video' ELSE min(modality) END AS modality, min(s) AS start, max(e) AS end_ms, count(*) AS n FROM h GROUP BY query_id, doc, CASE WHEN i % 2 = 0 AND i >= 2 AND e - (i - 2) * 25000 <= 60000 THEN i // 2 - 1 ELSE i // 2 END)
SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, round(sim, 6) AS sim, kw, modality, start, end_ms, CASE WHEN n > 1 THEN {_CLOCK.format("start")} || '-' || {_CLOCK.format("end_ms")} ELSE '' END AS heading FROM g"""
)
def merge_moments(spark, d):
    out = merge.merge_moments(_media_hits(spark, d))
    return out.select("query_id", "doc", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"), "kw", "modality", "start", F.col("end").alias("end_ms"), "heading")


# Turns of a conversation as hits, the longest first: users' are pages of a PDF, assistants' those of its transcription, which in
# every third conversation has no pages. There the first hits of both sides are one result, the host being the better one; and the
# second hit of the other side than the host's, with the first one of the host's side after it.
@query(
    """WITH t AS (SELECT conv_id, turn, text, role = 'user' AS pdf, turn // 2 + 1 AS p FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id, turn // 2, role ORDER BY turn) = 1),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, pdf) AS r, CASE WHEN pdf OR conv_id % 3 <> 0 THEN p ELSE 0 END AS page FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pdf ORDER BY r) AS i, min(r) FILTER (WHERE NOT pdf) OVER c < min(r) FILTER (WHERE pdf) OVER c AS md_leads FROM h WINDOW c AS (PARTITION BY conv_id)),
x AS (SELECT *, max(CASE WHEN i = 2 AND pdf = md_leads THEN r END) OVER (PARTITION BY conv_id) AS x FROM n),
y AS (SELECT *, min(CASE WHEN pdf <> md_leads AND r > x THEN r END) OVER (PARTITION BY conv_id) AS y FROM x),
k AS (SELECT *, CASE WHEN conv_id % 3 <> 0 THEN 'p' || p WHEN i = 1 THEN 'first' WHEN y IS NOT NULL AND r IN (x, y) THEN 'second' ELSE 'r' || r END AS g FROM y),
m AS (SELECT conv_id, min(r) AS r, max(page) AS page, max(round(1.0::DOUBLE / r, 6)) AS sim, bool_or(pdf) AS kw, count(*) AS n, bool_or(pdf) AS has_pdf,
      max(CASE WHEN NOT pdf THEN text END) AS md, max(CASE WHEN pdf THEN text END) AS own FROM k GROUP BY conv_id, g)
SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS rank, page::INT AS page, sim, kw, CASE WHEN has_pdf THEN 'pdf' ELSE 'markdown' END AS kind, CASE WHEN has_pdf THEN 'x.pdf' ELSE 'x.md' END AS path,
CASE WHEN n > 1 THEN 'x.md' END AS paired_path, CASE WHEN md IS NOT NULL THEN 'text' ELSE 'pdf_page' END AS modality, sha256(coalesce(md, own)) AS text FROM m"""
)
def merge_pairs(spark, d):
    turns = table(spark, d, "conversations").where("role <> 'system'").withColumn("p", F.floor(F.col("turn") / 2) + 1)
    once = turns.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id", "p", "role").orderBy("turn"))).where("_n = 1")
    pdf = F.col("role") == "user"
    order = Window.partitionBy("query_id").orderBy(F.desc(F.char_length("text")), "turn", pdf)
    rank = F.row_number().over(order)
    hits = once.withColumn("query_id", F.col("conv_id")).select(
        "query_id", rank.alias("rank"), (F.col("conv_id") * 2 + pdf.cast("int") + 1).alias("doc"), (F.col("conv_id") * 2 + 2 - pdf.cast("int")).alias("pair"), F.lit(False).alias("linked"), F.round(1.0 / rank, 6).alias("sim"), pdf.alias("kw"),
        F.when(pdf, "pdf_page").otherwise("text").alias("modality"), F.when(pdf, "pdf").otherwise("markdown").alias("kind"), F.when(pdf | (F.col("conv_id") % 3 != 0), F.col("p")).otherwise(0).cast("int").alias("page"), F.when(pdf, "x.pdf").otherwise("x.md").alias("path"), F.lit("").alias("heading"), "text",
    )
    out = merge.merge_pairs(hits)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "page", "sim", "kw", "kind", "path", "paired_path", "modality", F.sha2("text", 256).alias("text"))


@query("SELECT event_type AS key, min(ts) AS from_ts, max(ts) + INTERVAL 20 SECOND AS to_ts, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT event_type, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 20 SECOND THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY event_type, burst")
def change_bursts(spark, d):
    return quiet_bursts(table(spark, d, "events").select(F.col("event_type").alias("key"), "ts"), "20 seconds")


# A Markdown text per document: an image beside it that some documents have a file for, one in a folder of assets, one outside,
# one elsewhere, one defined at the end, one by its tag, the first one again, and one in code.
_SHOWS = "m AS (SELECT doc_id, n_chars % 60 AS a, doc_id % 7 AS b, lang FROM documents)"
_IMAGES = f"""{_SHOWS}, f AS (SELECT DISTINCT 'img/' || a || ' x.png' AS path FROM m WHERE lang = 'en' UNION ALL SELECT DISTINCT 'md/assets/' || b || '.jpg' FROM m UNION ALL SELECT 'md/notes.txt'),
l AS (SELECT doc_id AS document_id, unnest([{{'ord': 0, 'p': 'img/' || a || ' x.png', 'alt': 'one', 'h': lang, 'e': 'missing'}}, {{'ord': 1, 'p': 'md/assets/' || b || '.jpg', 'alt': 'two', 'h': lang, 'e': ''}},
{{'ord': 2, 'p': NULL, 'alt': 'out', 'h': lang, 'e': 'outside'}}, {{'ord': 4, 'p': 'img/' || b || ' x.png', 'alt': 'tag', 'h': lang || ' > Part', 'e': 'missing'}},
{{'ord': 5, 'p': NULL, 'alt': 'text', 'h': lang || ' > Part', 'e': 'kind'}}, {{'ord': 6, 'p': 'img/' || a || ' x.png', 'alt': 'again', 'h': lang || ' > Part', 'e': 'missing'}}], recursive := true) FROM m),
r AS (SELECT document_id, ord, path AS child_path, alt, h AS heading_path, CASE WHEN path IS NULL THEN e END AS warning FROM l LEFT JOIN f ON f.path = l.p)"""


def _shown(spark, d):
    docs = table(spark, d, "documents").withColumns({"a": F.col("n_chars") % 60, "b": F.col("doc_id") % 7})
    text = F.concat(
        F.lit("# "), "lang", F.lit("\n\n![one](../img/"), F.col("a").cast("string"), F.lit("%20x.png?raw=1 \"t\")\n\n![two][ref]\n![out](../../up.png) ![web](https://example.com/a.png)\n\n## Part\n\n<img alt='tag' src='/img/"),
        F.col("b").cast("string"), F.lit("%20x.png'>\n\n![text](notes.txt)\n\n![again](<./../img/"), F.col("a").cast("string"), F.lit(" x.png>)\n```\n![code](c.png)\n```\n\n[ref]: pics/"), F.col("b").cast("string"), F.lit(".jpg\n"),
    )
    files = docs.where("lang = 'en'").select(F.concat(F.lit("img/"), F.col("a").cast("string"), F.lit(" x.png")).alias("path"))
    files = files.union(docs.select(F.concat(F.lit("md/assets/"), F.col("b").cast("string"), F.lit(".jpg")))).union(docs.select(F.lit("md/notes.txt")))
    links = L.image_links(docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("md/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text")))
    return L.resolve_links(links, files.distinct())


@query(f"WITH {_IMAGES} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY document_id, coalesce(child_path, ord::VARCHAR) ORDER BY ord) = 1")
def image_links(spark, d):
    return _shown(spark, d).select("document_id", "ord", "child_path", "alt", "heading_path", "warning")


# Turns as links again; documents are images named by their id's rest by 97, read again are the conversations of even ids.
_LINKS = """o AS (SELECT DISTINCT conv_id AS parent_id, 'img/' || (length(text) % 97) || '.png' AS child_path FROM conversations WHERE role = 'user'),
n AS (SELECT DISTINCT conv_id AS parent_id, 'img/' || (length(text) % 97) || '.png' AS child_path FROM conversations WHERE role = 'assistant' AND conv_id % 2 = 0 AND length(text) % 3 = 0),
nl AS (SELECT * FROM o WHERE parent_id % 2 = 1 UNION ALL SELECT * FROM n)"""


def _old_new_links(spark, d):
    turns = table(spark, d, "conversations")
    links = lambda t: t.select(F.col("conv_id").alias("parent_id"), F.concat(F.lit("img/"), (F.char_length("text") % 97).cast("string"), F.lit(".png")).alias("child_path")).distinct()
    again = turns.where("conv_id % 2 = 0").select(F.col("conv_id").alias("document_id"))
    return links(turns.where("role = 'user'")), links(turns.where("role = 'assistant' AND conv_id % 2 = 0 AND char_length(text) % 3 = 0")), again


@query(f"""WITH {_LINKS} SELECT doc_id AS document_id, CASE WHEN p IN (SELECT child_path FROM n) THEN 'done' WHEN p IN (SELECT child_path FROM o) AND p NOT IN (SELECT child_path FROM nl) THEN 'pending' ELSE 'done' END AS status,
CASE WHEN p IN (SELECT child_path FROM n) THEN 0 ELSE 1 END AS chunk_count, p IN (SELECT child_path FROM n) AS noted FROM (SELECT doc_id, 'img/' || (doc_id % 97) || '.png' AS p FROM documents)""")
def link_ownership(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("img/"), (F.col("doc_id") % 97).cast("string"), F.lit(".png")).alias("path"), F.lit("done").alias("status"), F.lit(1).alias("chunk_count"), F.lit(None).cast("string").alias("note"))
    return M.replace_links(docs, *_old_new_links(spark, d))[1].select("document_id", "status", "chunk_count", F.col("note").isNotNull().alias("noted"))


def _paired_docs(spark, d):
    """Documents in pairs of an even id, a text, and the odd id after it, a PDF; images are of German."""
    kind = F.when(F.col("lang") == "de", "image").when(F.col("doc_id") % 2 == 1, "pdf").otherwise("markdown")
    other = F.when(F.col("lang") != "de", F.col("doc_id") + 1 - 2 * (F.col("doc_id") % 2))
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("img/"), (F.col("doc_id") % 97).cast("string"), F.lit(".png")).alias("path"), kind.alias("kind"), F.lit("done").alias("status"), other.alias("pair_id"))


@query(f"""WITH {_LINKS}, lost AS (SELECT doc_id FROM labels WHERE toxic = 1), d AS (SELECT doc_id, 'img/' || (doc_id % 97) || '.png' AS p, CASE WHEN lang = 'de' THEN 'image' WHEN doc_id % 2 = 1 THEN 'pdf' ELSE 'markdown' END AS kind, CASE WHEN lang <> 'de' THEN doc_id + 1 - 2 * (doc_id % 2) END AS pair FROM documents)
SELECT doc_id AS document_id, CASE WHEN p IN (SELECT child_path FROM o WHERE parent_id IN (SELECT doc_id FROM lost)) OR (kind = 'pdf' AND coalesce(pair IN (SELECT doc_id FROM lost), false)) THEN 'pending' ELSE 'done' END AS status,
CASE WHEN pair NOT IN (SELECT doc_id FROM lost) THEN pair END AS pair_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM lost)""")
def delete_documents(spark, d):
    lost = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    docs, _ = M.delete_documents(_paired_docs(spark, d), _old_new_links(spark, d)[0], lost)
    return docs.select("document_id", "status", "pair_id")


@query(f"""WITH {_OLD}, {_NEW} SELECT path FROM old WHERE path NOT IN (SELECT path FROM new) AND NOT ((starts_with(path, 'src1/') OR starts_with(path, 'src2/en/') OR starts_with(path, 'src5/')) AND status <> 'stale' AND path IN (SELECT {_PATH} FROM documents WHERE n_chars % 2 = 0))""")
def keep_folders(spark, d):
    old, new = _snapshots(spark, d)
    there = table(spark, d, "documents").where("n_chars % 2 = 0").select(path().alias("path"))
    return M.really_gone(old.join(new.select("path"), "path", "left_anti").select("path", "status"), ["src1", "src2/en", "src5"], there).select("path")


@query(f"""WITH {_PAIRS}, d AS (SELECT path, doc_id AS id, 'markdown' AS kind, NULL AS pair FROM md UNION ALL SELECT path, -doc_id, 'pdf', CASE WHEN doc_id % 3 = 0 THEN 0 END FROM pdf),
w AS (SELECT a.id AS a, b.id AS b FROM paired JOIN d a ON a.path = md_path JOIN d b ON b.path = pdf_path), both_ AS (SELECT a AS id, b AS pair FROM w UNION ALL SELECT b, a FROM w)
SELECT d.id AS document_id, b.pair AS pair_id, CASE WHEN kind = 'pdf' AND (d.pair IS NULL) <> (b.pair IS NULL) THEN 'pending' ELSE 'done' END AS status FROM d LEFT JOIN both_ b ON b.id = d.id""")
def pair_requeue(spark, d):
    texts, pdfs = _pairing(spark, d)
    number = F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long")
    row = lambda df, key, kind, pair: df.select(key.alias("document_id"), "path", F.lit(kind).alias("kind"), F.lit("done").alias("status"), pair.alias("pair_id"))
    docs = row(texts, number, "markdown", F.lit(None).cast("long")).union(row(pdfs, -number, "pdf", F.when(number % 3 == 0, F.lit(0).cast("long"))))
    return M.apply_pairs(docs, M.pairs(texts, pdfs)).select("document_id", "pair_id", "status")


@query("SELECT d.doc_id AS document_id, CASE WHEN toxic = 1 THEN 'queued' WHEN lang = 'en' THEN 'queued' ELSE 'failed' END AS state, CASE WHEN toxic = 1 THEN 0 ELSE 2 END AS attempts FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def job_recovery(spark, d):
    jobs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("lang") == "en", "running").otherwise("failed").alias("state"), F.lit(2).alias("attempts"), F.lit(1).alias("enqueued_at"))
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return M.enqueue(M.recovered(jobs), toxic, F.lit(2)).select("document_id", "state", "attempts")


@query("SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN item_id::DOUBLE END AS first FROM benchmark")
def cache_lookup(spark, d):
    """Of the benchmark's queries the cache holds every third; those of odd ids with vectors of another length."""
    items = table(spark, d, "benchmark")
    vector = F.when(F.col("item_id") % 2 == 0, F.array(F.col("item_id").cast("double"), F.lit(1.0))).otherwise(F.array(F.lit(1.0)))
    cache = items.where("item_id % 3 = 0").select(F.lit("s").alias("space"), T.normal_query(F.concat(F.lit("  "), F.col("text"))).alias("query"), vector.alias("vector"), F.lit(1).alias("hits"), F.lit(0).alias("last_used")).dropDuplicates(["query"])
    return M.cached(items.select(F.col("item_id").alias("query_id"), "text"), cache, "s", 2, F.lit(1))[0].select("query_id", F.get("vector", F.lit(0)).alias("first"))


@query(f"WITH {_BASE}, dirty AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT doc_id AS document_id, len(t) > 0 AND doc_id NOT IN (SELECT doc_id FROM dirty) AS live, CASE WHEN len(t) > 0 THEN 1 ELSE 0 END AS chunk_count FROM toks")
def give_up_switch(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("processing").alias("status"), F.lit("next").alias("embed_id"))
    held = chunks(spark, d).where("bm25_len > 0").select(F.col("chunk_id").alias("document_id"))
    dirty = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    out = spaces.cancelled(docs, held, dirty, F.lit("live"))
    return out.select("document_id", ((F.col("status") == "done") & (F.col("embed_id") == "live")).alias("live"), F.col("chunk_count").cast("int").alias("chunk_count"))


# Chunks in full: French ones are shown as images of another path, Spanish ones are pages.
_PLACE = f"CASE lang WHEN 'fr' THEN 'img/' || doc_id || '.png' ELSE {_PATH} END"


def _full_chunks(spark, d):
    own = index(spark, d).chunks
    rows = own.select("*", F.col("chunk_id").alias("document_id"), F.when(F.col("lang") == "fr", "image").otherwise("text").alias("modality"), F.lit("").alias("heading_path"), F.when(F.col("lang") == "es", 3).otherwise(0).alias("page"), F.when(F.col("lang") == "fr", F.concat(F.lit("img/"), F.col("chunk_id").cast("string"), F.lit(".png"))).alias("source_path"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), path().alias("path"), F.lit("markdown").alias("kind"), F.lit(None).cast("long").alias("pair_id"))
    return rows, docs


_SHOWN = f"""SELECT query_id, place AS rank, score, 0.0::DOUBLE AS sim, {_PLACE} AS path, CASE lang WHEN 'fr' THEN 'image' ELSE 'markdown' END AS kind, CASE lang WHEN 'fr' THEN 'image' ELSE 'text' END AS modality, CASE lang WHEN 'es' THEN 3 ELSE 0 END AS page,
CASE lang WHEN 'fr' THEN {_PATH} END AS parent_path, CASE WHEN length(text) <= 200 THEN text WHEN octet_length(encode(before)) > 100 THEN before || '…' ELSE head || '…' END AS text"""


@query(
    f"""WITH {_kw(5 * TOP, f"{_PLACE.replace('doc_id', 'k.doc_id').replace('lang', 'k.lang').replace('source', 'k.source')} GLOB 'img/*[02468].png'")},
c AS (SELECT query_id, rank AS place, score, d.*, substring(text, 1, 200) AS head FROM kw JOIN documents d ON doc_id = chunk_id WHERE rank <= {TOP}), b AS (SELECT *, regexp_extract(head, '(?s)^(.*)[ \n]', 1) AS before FROM c)
{_SHOWN} FROM b"""
)
def search_results(spark, d):
    """Whole results of keyword search, filtered by modality and path."""
    options = SearchOptions(k=0, mode="keyword", modalities=("image",), path_glob="img/*[02468].png", max_chars=200)
    rows, _ = SE.search_documents(asked(spark, d), *_full_chunks(spark, d), options, index(spark, d).postings)
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "score", "sim", "path", "kind", "modality", "page", "parent_path", "text")


@query(f"""WITH f AS (SELECT DISTINCT item_id AS query_id, item_id % 5 = 0 AS blank FROM benchmark)
SELECT query_id, CASE WHEN blank THEN 'empty query' ELSE 'keywords only: the index holds vectors of a, not of b' END AS notice FROM f""")
def search_notices(spark, d):
    """Every fifth query is blank, and the queries' vectors are of another space."""
    queries = asked(spark, d).withColumn("text", F.when(F.col("query_id") % 5 == 0, "  ").otherwise(F.col("text")))
    return SE.search_documents(queries, *_full_chunks(spark, d), SearchOptions(k=1), index(spark, d).postings, ("a", "b"))[1]


@query(
    f"""WITH m AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS audio, (o_custkey % 3 <> 0) AS sound, (o_custkey % 5 <> 0) AS sight, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE round(o_totalprice)::BIGINT END AS dur FROM orders),
e AS (SELECT *, CASE WHEN dur <= 0 THEN 'no length' WHEN audio AND NOT sound THEN 'no audio track' WHEN NOT audio AND NOT sight THEN 'no video track' END AS error FROM m),
u AS (SELECT *, unnest(CASE WHEN error IS NOT NULL THEN [NULL] WHEN audio THEN ['audio'] WHEN sound THEN ['video', 'audio'] ELSE ['video'] END) AS modality FROM e),
w AS (SELECT *, unnest(CASE WHEN error IS NOT NULL THEN [NULL] ELSE range(0, greatest(0, ceil((dur - 30000) / 25000.0))::BIGINT + 1) END) * 25000 AS start_ms FROM u),
s AS (SELECT *, least(start_ms + 30000, dur) AS end_ms FROM w)
SELECT id AS document_id, modality, CASE WHEN error IS NULL THEN 'clip no ' || id END AS text, {_CLOCK.format("start_ms")} || '-' || {_CLOCK.format("end_ms")} AS heading_path, start_ms, CASE WHEN error IS NULL THEN end_ms END AS end_ms, error FROM s"""
)
def media_units(spark, d):
    o = table(spark, d, "orders")
    audio = F.col("o_orderkey") % 2 == 0
    name = F.concat(F.lit("m/clip-no_"), F.col("o_orderkey").cast("string"), F.when(audio, ".mp3").otherwise(".mp4"))
    length = F.when(F.col("o_custkey") % 7 == 0, 0).otherwise(F.round("o_totalprice")).cast("long")
    files = o.select(F.col("o_orderkey").alias("document_id"), name.alias("path"), F.when(audio, "audio").otherwise("video").alias("kind"), length.alias("duration_ms"), (F.col("o_custkey") % 3 != 0).alias("has_audio"), (F.col("o_custkey") % 5 != 0).alias("has_video"))
    return C.media_units(files).drop("path")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'pdf_page' WHEN turn % 3 = 0 THEN 'image' ELSE 'text' END AS modality, role <> 'user' AND turn % 3 <> 0 AS embedded FROM conversations WHERE role <> 'user'")
def capability_filter(spark, d):
    kind = F.when(F.col("role") == "user", "pdf_page").when(F.col("turn") % 3 == 0, "image").otherwise("text")
    return C.embeddable(table(spark, d, "conversations").select("conv_id", "turn", kind.alias("modality")), ["text", "audio"])


@query("SELECT doc_id || '/a-' || lang || '_b.c.png' AS path, 'image' AS modality, 'a ' || lang || ' b.c' AS text FROM documents WHERE lang IN ('de', 'fr')")
def image_units(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.lit("/a-"), "lang", F.lit("_b.c"), F.when(F.col("lang").isin("de", "fr"), ".png").otherwise(".md"))
    return S.image_units(table(spark, d, "documents").select(name.alias("path"), S.kind(name).alias("kind")))


def _listed(spark, d):
    docs = _paired_docs(spark, d)
    return docs.withColumn("status", F.when(F.col("document_id") % 4 == 0, "stale").otherwise("done"))


_LISTED = "(SELECT doc_id AS document_id, 'img/' || (doc_id % 97) || '.png' AS path, CASE WHEN lang = 'de' THEN 'image' WHEN doc_id % 2 = 1 THEN 'pdf' ELSE 'markdown' END AS kind, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'done' END AS status, CASE WHEN lang <> 'de' THEN doc_id + 1 - 2 * (doc_id % 2) END AS pair_id FROM documents)"


@query(f"SELECT document_id, path, kind, status FROM {_LISTED} WHERE status = 'done' AND kind = 'pdf'")
def document_list(spark, d):
    return M.list_documents(_listed(spark, d), "done", "pdf").select("document_id", "path", "kind", "status")


@query(f"SELECT count(*) AS n FROM {_LISTED} WHERE kind = 'markdown' AND pair_id IS NOT NULL")
def pair_count(spark, d):
    return M.pair_count(_listed(spark, d))


@query(f"SELECT l.document_id, l.path, l.kind, p.path AS pair_path FROM {_LISTED} l LEFT JOIN {_LISTED} p ON p.document_id = l.pair_id WHERE l.document_id % 3 = 0")
def job_queue(spark, d):
    docs = _listed(spark, d)
    jobs = docs.select("document_id", F.when(F.col("document_id") % 3 == 0, "queued").otherwise("failed").alias("state"), F.lit(1).alias("enqueued_at"))
    return M.job_queue(jobs, docs).select("document_id", "path", "kind", "pair_path")


@query("SELECT doc_id AS document_id FROM documents WHERE source = 'src1' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def dirty_while_switching(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source")
    jobs = docs.select("document_id", F.lit("failed").alias("state"), F.lit(1).alias("attempts"), F.lit(1).alias("enqueued_at"))
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return M.enqueue_while(jobs, docs.where("source = 'src1'").select("document_id"), toxic, table(spark, d, "region"), F.lit(2))[1]


@query("SELECT doc_id AS document_id, CASE WHEN toxic = 1 AND lang = 'en' THEN 'running' WHEN lang = 'fr' THEN 'queued' WHEN lang = 'de' THEN 'failed' ELSE 'queued' END AS state FROM (SELECT d.doc_id, lang, max(toxic) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id, lang)")
def job_claims(spark, d):
    """Waiting jobs of toxic documents are claimed; French ones failed twice and wait again, German ones failed for good."""
    kind = F.when(F.col("lang").isin("fr", "de"), "failed").otherwise("queued")
    jobs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang", kind.alias("state"), F.when(F.col("lang") == "fr", 2).otherwise(3).alias("attempts"))
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    out = M.requeued(M.claim(jobs.where("lang <> 'es'"), toxic)).unionByName(jobs.where("lang = 'es'"))
    return out.select("document_id", "state")


@query("SELECT doc_id AS document_id, CASE WHEN n_chars % 3 > 0 AND lang IN ('en', 'de') THEN 'done' ELSE 'pending' END AS status FROM documents")
def revive(spark, d):
    embed = F.when(F.col("lang") == "en", "a").when(F.col("lang") == "de", "b").when(F.col("lang") == "fr", "")
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), M.revived_status(F.col("n_chars") % 3, embed).alias("status"))


@query(
    f"""WITH {_PAIRS}, n AS (SELECT doc_id, count(*) AS n FROM pdf GROUP BY doc_id)
SELECT m.path AS path, CASE WHEN m.source IS NOT NULL AND p.path IS NULL THEN 'missing' WHEN m.source IS NOT NULL THEN 'taken' WHEN n.n > 1 THEN 'several' ELSE 'taken' END AS warning
FROM md m LEFT JOIN pdf p ON p.path = m.source LEFT JOIN n ON n.doc_id = m.doc_id WHERE m.path NOT IN (SELECT md_path FROM paired) AND (m.source IS NOT NULL OR n.n >= 1)"""
)
def pair_warnings(spark, d):
    texts, pdfs = _pairing(spark, d)
    return M.pair_warnings(texts, pdfs, M.pairs(texts, pdfs))


@query("SELECT item_id AS query_id, substring(text, 1, 24) AS text FROM benchmark")
def clipped_input(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.clip(F.col("text"), 8).alias("text"))


@query("SELECT DISTINCT source || '/' || lang AS path, 0 AS size FROM documents UNION ALL SELECT DISTINCT source || '/x', 1 FROM documents")
def insert_or_ignore(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select(F.concat_ws("/", "source", "lang").alias("path"), F.lit(0).alias("size")).dropDuplicates(["path"])
    new = docs.select(F.explode(F.array(F.concat_ws("/", "source", "lang"), F.concat("source", F.lit("/x")))).alias("path"), F.lit(1).alias("size"))
    return M.insert_missing(old, new, ["path"])


@query("SELECT text AS query, CASE WHEN n % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS first, (n % 3)::INT AS hits, CASE WHEN n % 2 = 0 THEN 9 ELSE 0 END AS last_used FROM (SELECT text, min(item_id) AS n FROM benchmark GROUP BY text) WHERE n % 2 = 0 OR n % 3 > 0")
def cache_put(spark, d):
    items = table(spark, d, "benchmark").groupBy("text").agg(F.min("item_id").alias("n"))
    row = lambda vector, hits, at: [F.lit("s").alias("space"), F.col("text").alias("query"), F.array(F.lit(vector)).alias("vector"), hits.cast("int").alias("hits"), F.lit(at).alias("last_used")]
    cache, fresh = items.where("n % 3 > 0").select(*row(1.0, F.col("n") % 3, 0)), items.where("n % 2 = 0").select(*row(2.0, F.lit(0), 9))
    return M.put_cached(cache, fresh, F.lit(9)).select("query", F.get("vector", F.lit(0)).alias("first"), "hits", "last_used")


@query(f"WITH h AS (SELECT doc_id, {_tok("source || ' ' || coalesce(text, '')")} AS t FROM documents) SELECT count(*) FILTER (WHERE len(t) > 0) AS n, round(avg(len(t)) FILTER (WHERE len(t) > 0), 6) AS average FROM h")
def headed_stats(spark, d):
    """Lengths of chunks whose headings count."""
    own = K.analyzed(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("heading_path"), "text"))
    return K.corpus_stats(own).select("n", F.round("average", 6).alias("average"))


@query("SELECT DISTINCT path, 'src' || n AS folder FROM (SELECT source || '/' || lang || '/a.md' AS path, unnest(range(0, 12)) AS n FROM documents) WHERE starts_with(path, 'src' || n || '/')")
def folder_overlap(spark, d):
    """Files of overlapping folders, each once."""
    files = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.lit("a.md")).alias("path"))
    once = files.dropDuplicates(["path"])
    folders = spark.range(12).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("folder"))  # the configured folders
    return once.join(folders, S.folder_covers(F.col("folder"), F.col("path"))).select("path", "folder")
