"""Views of the test tables that the queries run on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import table

#: Documents in one Markdown file of a source: the files stay small however many documents there are.
FILE = 1000

SQL = {
    "md": f"""md AS (
  SELECT source || '/' || (doc_id // {FILE}) AS doc,
         string_agg('# doc ' || doc_id || ' ' || lang || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY doc_id) AS md
  FROM documents GROUP BY 1)""",
    "lines": """lines AS (
  SELECT doc, unnest(string_split(md, chr(10))) AS line, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS n FROM md)""",
    "sections": r"""heads AS (
  SELECT doc, n AS start_line, regexp_extract(line, '^(#{1,6})\s+(.+)$', 1) AS mark,
         left(regexp_replace(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2), '^\s+|\s+$', '', 'g'), 200) AS title
  FROM lines WHERE regexp_matches(line, '^(#{1,6})\s+(.+)$')),
sections AS (
  SELECT h.doc, row_number() OVER w AS section_no, title, length(mark) AS level, start_line,
         coalesce(lead(start_line) OVER w - 1, t.n) AS end_line
  FROM heads h JOIN (SELECT doc, max(n) AS n FROM lines GROUP BY doc) t ON h.doc = t.doc
  WINDOW w AS (PARTITION BY h.doc ORDER BY start_line))""",
    "chunks": r"""counted AS MATERIALIZED (
  SELECT doc, n, line, len(regexp_extract_all(line, '\S+')) AS words, left(line, 1) = '#' AS head,
         trim(line) = '' AS blank, n = max(n) OVER (PARTITION BY doc) AS final FROM lines),
folded AS (
  SELECT doc, n, 1 AS first, words, (words >= 512 AND (head OR blank)) OR (head AND words > 50) AS cut, final FROM counted WHERE n = 1
  UNION ALL
  SELECT c.doc, c.n, CASE WHEN f.cut THEN c.n ELSE f.first END, CASE WHEN f.cut THEN 0 ELSE f.words END + c.words,
         (CASE WHEN f.cut THEN 0 ELSE f.words END + c.words >= 512 AND (c.head OR c.blank))
           OR (c.head AND CASE WHEN f.cut THEN 0 ELSE f.words END + c.words > 50), c.final
  FROM folded f JOIN counted c ON c.doc = f.doc AND c.n = f.n + 1),
spans AS (SELECT doc, first, n AS last, words FROM folded WHERE (cut OR final) AND words > 10),
chunks AS (
  SELECT s.doc, s.first AS start_line, s.last AS end_line, s.words AS word_count,
         regexp_replace(string_agg(c.line, chr(10) ORDER BY c.n), '^\s+|\s+$', '', 'g') AS text
  FROM spans s JOIN counted c ON c.doc = s.doc AND c.n BETWEEN s.first AND s.last GROUP BY ALL)""",
    "lex": r"""lex AS (
  SELECT doc_id AS chunk_id, source AS doc, text,
         contains(lower(left(text, 600)), 'table of contents') OR CASE WHEN length(text) = 0 THEN 0.0
           ELSE length(regexp_replace(left(text, 1000), '[^\p{L}\p{Nl}\p{No}]', '', 'g')) / length(left(text, 1000)) END < 0.55 AS is_index
  FROM documents)""",
    "vectors": "vectors AS (SELECT vec_id AS chunk_id, CAST(label AS VARCHAR) AS doc, embedding::DOUBLE[] AS embedding FROM embeddings)",
    "queries": r"""queries AS (
  SELECT item_id AS qid, array_to_string(list_filter(regexp_extract_all(b.text, '[a-zA-Z0-9_-]+'), lambda x: length(x) >= 2)[1:2], ' ') AS query,
         e.embedding::DOUBLE[] AS q_emb,
         CASE WHEN item_id % 10 = 0 THEN 'negative' WHEN item_id % 3 = 0 THEN 'exact' ELSE 'natural' END AS category
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)""",
    "near": """near AS (
  SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id DESC) AS rank FROM (
    SELECT q.qid, v.chunk_id, list_cosine_similarity(q.q_emb, v.embedding) AS score FROM queries q, vectors v)),
total AS (SELECT count(*) AS n FROM lex),
wanted AS (SELECT least(greatest(50, least(n, greatest(150, floor(n * 0.05), 50))), 1500) AS n FROM total),
candidates AS (SELECT * FROM near WHERE rank <= (SELECT n FROM wanted))""",
    "index": r"""tokens AS MATERIALIZED (
  SELECT chunk_id, unnest(t) AS term, unnest(range(len(t))) AS at FROM (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM lex)),
sizes AS (SELECT l.chunk_id, len(regexp_extract_all(lower(l.text), '[\p{L}\p{N}]+')) AS dl FROM lex l),
corpus AS (SELECT count(*) AS total, avg(dl) AS mean FROM sizes)""",
    "found": r"""parts AS (
  SELECT qid, unnest(t) AS word, unnest(range(len(t))) AS phrase_no FROM (
    SELECT qid, list_filter(regexp_extract_all(query, '[a-zA-Z0-9_-]+'), lambda x: length(x) >= 2) AS t FROM queries)),
phrased AS (
  SELECT *, count(*) OVER (PARTITION BY qid) AS phrases FROM (
    SELECT qid, phrase_no, regexp_extract_all(lower(word), '[\p{L}\p{N}]+') AS toks FROM parts) WHERE len(toks) > 0),
pieces AS (SELECT qid, phrase_no, phrases, len(toks) AS size, unnest(toks) AS term, unnest(range(len(toks))) AS k FROM phrased),
starts AS (
  SELECT p.qid, p.phrase_no, p.phrases, t.chunk_id, t.at - p.k AS start FROM pieces p JOIN tokens t ON t.term = p.term
  GROUP BY ALL HAVING count(DISTINCT p.k) = any_value(p.size)),
hits AS (SELECT qid, phrase_no, phrases, chunk_id, count(*) AS tf FROM starts GROUP BY ALL),
dfs AS (SELECT qid, phrase_no, count(*) AS df FROM hits GROUP BY ALL),
scored AS (
  SELECT h.qid, h.chunk_id, h.phrases,
         CASE WHEN ln((total - df + 0.5) / (df + 0.5)) > 0 THEN ln((total - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
           * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS part
  FROM hits h JOIN dfs USING (qid, phrase_no) JOIN sizes USING (chunk_id), corpus),
found AS (
  SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT qid, chunk_id, sum(part) AS score FROM scored GROUP BY qid, chunk_id, phrases HAVING count(*) = phrases))""",
    "fused": """side AS (
  SELECT f.* FROM found f WHERE f.rank <= (SELECT count(*) FROM candidates c WHERE c.qid = f.qid)),
both_sides AS (
  SELECT coalesce(c.qid, s.qid) AS qid, coalesce(c.chunk_id, s.chunk_id) AS chunk_id, c.score AS embed, c.rank AS v_rank, s.rank AS f_rank
  FROM candidates c FULL JOIN side s ON c.qid = s.qid AND c.chunk_id = s.chunk_id),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf_score, 12) DESC, v_rank NULLS LAST, f_rank NULLS LAST) AS rank FROM (
    SELECT *, CASE WHEN count(f_rank) OVER (PARTITION BY qid) > 0
      THEN coalesce(1.0::DOUBLE / (20 + v_rank), 0) + coalesce(1.0::DOUBLE / (20 + f_rank), 0) ELSE embed END AS rrf_score FROM both_sides))""",
    "ranked": """terms AS (SELECT qid, list_filter(regexp_extract_all(query, '[a-zA-Z0-9_-]+'), lambda x: length(x) >= 2) AS t, query FROM queries),
folded_text AS (SELECT chunk_id, doc, is_index, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM lex),
bonused AS (
  SELECT f.*, l.doc, l.is_index, CASE WHEN len(t) > 0 THEN CASE WHEN contains(low, lower(trim(query))) THEN 0.3::DOUBLE ELSE 0 END
           + 0.15::DOUBLE * (len(list_filter(t, lambda x: contains(low, lower(x)))) / len(t)) ELSE 0 END AS bonus
  FROM fused f JOIN folded_text l USING (chunk_id) JOIN terms USING (qid) WHERE f.rank <= 20),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(final_score, 12) DESC, fused_rank) AS final_rank FROM (
    SELECT qid, chunk_id, doc, is_index, rrf_score, coalesce(embed, 0) AS embed_score, f_rank IS NOT NULL AS fts_hit, bonus, rank AS fused_rank,
           rrf_score * 30 + CASE WHEN is_index THEN -0.5::DOUBLE ELSE 0 END + bonus AS final_score FROM bonused))""",
    "spread": """decayed AS (
  SELECT *, final_score * pow(0.95::DOUBLE, row_number() OVER (PARTITION BY qid, doc ORDER BY final_rank) - 1) AS diversity_score FROM ranked),
spread AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(diversity_score, 12) DESC, final_rank) AS rank FROM decayed) WHERE rank <= 10)""",
    "results": """vres AS (SELECT n.qid, n.chunk_id, v.doc, n.score AS sim, n.rank FROM near n JOIN vectors v USING (chunk_id) WHERE n.rank <= 10)""",
    "qrels": """labelled AS (SELECT q.qid, q.category, e.label AS own FROM queries q JOIN embeddings e ON e.vec_id = q.qid),
qrels AS (
  SELECT l.qid, e.vec_id AS chunk_id, CASE WHEN e.label = l.own THEN 3 WHEN abs(e.label - l.own) = 1 THEN 1 ELSE 0 END AS score,
         CASE WHEN e.vec_id % 5 = 0 THEN [] ELSE ['l' || e.label, 'm' || (e.vec_id % 4)] END AS subtopics
  FROM labelled l, embeddings e WHERE (e.vec_id + l.qid) % 3 <> 0)""",
    "old": r"""oldchunks AS (
  SELECT row_number() OVER (ORDER BY doc, start_line) AS chunk_id, doc, start_line, end_line, word_count, text, is_index, section_no FROM (
    SELECT c.doc, c.start_line, c.end_line, c.word_count, CASE WHEN c.start_line % 7 = 0 THEN text || ' x' ELSE text END AS text, false AS is_index,
           CASE WHEN c.start_line % 5 = 0 THEN NULL ELSE s.section_no END AS section_no
    FROM chunks c LEFT JOIN sections s ON s.doc = c.doc AND c.start_line BETWEEN s.start_line AND s.end_line WHERE c.start_line % 11 <> 0)
  UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY doc), doc, 999999, 999999, 0, 'gone', false, NULL FROM (SELECT DISTINCT doc FROM chunks))""",
}


def with_(*names: str) -> str:
    """The WITH clause of the named views."""
    return "WITH RECURSIVE " + ",\n".join(SQL[x] for x in names) + "\n"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, md): the documents of a source, in files of FILE ids, each document under a heading."""
    docs = table(spark, sf_dir, "documents")
    part = F.concat(F.lit("# doc "), F.col("doc_id"), F.lit(" "), F.col("lang"), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    name = F.concat_ws("/", "source", F.floor(F.col("doc_id") / FILE).cast("string"))
    rows = docs.select(name.alias("doc"), F.struct("doc_id", part.alias("part")).alias("row"))
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["part"]), "\n").alias("md"))


def lex_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, doc, text, is_index): documents as chunks."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), "text", T.index_like(F.col("text")).alias("is_index"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("doc"), "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query, q_emb, category): the first two terms of benchmark items, with vectors by id."""
    items, vecs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    category = F.when(F.col("item_id") % 10 == 0, "negative").when(F.col("item_id") % 3 == 0, "exact").otherwise("natural")
    return items.join(vecs, items["item_id"] == vecs["vec_id"]).select(F.col("item_id").alias("qid"), F.array_join(F.slice(T.terms(F.col("text")), 1, 2), " ").alias("query"), F.col("embedding").alias("q_emb"), category.alias("category"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, category, chunk_id, score, subtopics): vectors of the query's label are relevant, of the next labels a little.
    The queries are a stated set, each against all vectors."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    own = queries(spark, sf_dir).select("qid", "category").join(vecs.select(F.col("chunk_id").alias("qid"), F.col("label").alias("own")), "qid")
    score = F.when(F.col("label") == F.col("own"), 3).when(F.abs(F.col("label") - F.col("own")) == 1, 1).otherwise(0)
    topics = F.when(F.col("chunk_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("l"), "label"), F.concat(F.lit("m"), F.col("chunk_id") % 4)))
    return own.join(vecs, (F.col("chunk_id") + F.col("qid")) % 3 != 0).select("qid", "category", "chunk_id", score.alias("score"), topics.alias("subtopics"))
