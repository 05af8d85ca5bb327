"""Registered queries of the engine and their SQL, over adapters of the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from engram.config import DEFAULT, LONGMEMEVAL
from engram.functions import prompts as P
from engram.functions import text as T
from engram.operators import dialogue as D
from engram.operators import graph as G
from engram.operators import knowledge as K
from engram.operators import metrics as M
from engram.operators import retrieve as R
from engram.operators import select as S
from engram.plans import answer as A
from engram.plans import encode as E
from engram.plans.rounds import sequential
from engram.plans.state import folder
from engram.sources.segments import Segments
from engram.sources.store import dialog_text, dialogs

QUERIES, ORACLES = {}, {}
#: The cutoff of 0.5 finds no pair in the given vectors.
LINKED = replace(DEFAULT, min_similarity=0.3)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- adapters -----------------------------------------------------------------


def vec_nodes(spark, sf):
    seq = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("graph_id"), F.col("vec_id").alias("node_id"), seq.cast("long").alias("node_seq"), "embedding")


def vec_queries(nodes):
    return nodes.where("node_seq = 1").select(F.col("graph_id").alias("query_id"), "graph_id", F.col("embedding").alias("q_embedding"))


def turns(spark, sf):
    return D.pair_adjacent(read(spark, sf, "conversations"), ["conv_id"], "turn")


def text_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf, "conversations").where("role <> 'system'")
    return c.select("conv_id", "turn", F.col("text").alias("reference"), F.lead("text").over(w).alias("prediction")).where("prediction IS NOT NULL")


def scored(spark, sf):
    return M.token_scores(text_pairs(spark, sf))


def event_nodes(spark, sf):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf, "events").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("node_id"), seq.cast("long").alias("node_seq"), "ts", F.lit(0).alias("access_count"), "event_type", F.col("value"))


def event_edges(nodes):
    """Chain edges whose weight is small for small values, so that some nodes are forgotten."""
    prev = F.lag("node_id").over(Window.partitionBy("graph_id").orderBy("node_seq"))
    e = nodes.select("graph_id", prev.alias("src"), F.col("node_id").alias("dst"), F.least(F.lit(1.0), F.abs("value") / 1000).alias("weight"))
    return G.both_ways(e.where("src IS NOT NULL"))


VEC = """n AS (SELECT CAST(label AS BIGINT) AS graph_id, vec_id AS node_id, embedding,
       row_number() OVER (PARTITION BY label ORDER BY vec_id) AS node_seq FROM embeddings),
q AS (SELECT graph_id AS query_id, graph_id, embedding AS qe FROM n WHERE node_seq = 1),
c AS (SELECT graph_id, lag(node_id) OVER (PARTITION BY graph_id ORDER BY node_seq) AS src, node_id AS dst, 0.5::DOUBLE AS weight FROM n),
e AS (SELECT * FROM c WHERE src IS NOT NULL UNION ALL SELECT graph_id, dst, src, weight FROM c WHERE src IS NOT NULL)"""
SCORES = VEC + """,
s AS (SELECT query_id, graph_id, node_id, node_seq, (list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]) + 1) / 2 AS enh FROM n JOIN q USING (graph_id)),
b AS (SELECT s.query_id, e.dst AS node_id, sum(s.enh * e.weight * 0.1::DOUBLE) AS boost FROM s JOIN e ON s.graph_id = e.graph_id AND s.node_id = e.src WHERE s.enh > 0.4::DOUBLE GROUP BY ALL),
f AS (SELECT s.*, enh + coalesce(boost, 0) AS fin FROM s LEFT JOIN b USING (query_id, node_id))"""
RANKED = SCORES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(enh, 12) DESC, node_seq DESC) AS br,
       row_number() OVER (PARTITION BY query_id ORDER BY round(fin, 12) DESC, node_seq DESC) AS sr, count(*) OVER (PARTITION BY query_id) AS nn FROM f),
x AS (SELECT *, br > 10 AS flipped, sum(CASE WHEN br > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY sr ROWS UNBOUNDED PRECEDING) AS fr FROM r WHERE br <= 10 OR sr <= 10),
res AS (SELECT query_id, graph_id, node_id, CAST(CASE WHEN flipped THEN least(10, nn) + fr ELSE br END AS BIGINT) AS out_rank, round(fin, 9) AS score, round(enh, 9) AS base_score, flipped,
       CASE WHEN flipped THEN 'spreading' ELSE 'base' END AS source FROM x WHERE NOT flipped OR fr <= 5)"""
PAIRS = """t AS (SELECT conv_id, turn, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prediction FROM conversations WHERE role <> 'system'),
k AS (SELECT conv_id, turn, {p} AS p, {r} AS r FROM t WHERE prediction IS NOT NULL),
o AS (SELECT *, len(p) AS np, len(r) AS nr, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))), 0) AS o FROM k),
m AS (SELECT conv_id, turn, CASE WHEN np = 0 AND nr = 0 THEN 1.0::DOUBLE WHEN o = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * o / (np + nr) END AS f1,
      CASE WHEN np = 0 OR nr = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN np < nr THEN exp(1 - nr::DOUBLE / np) ELSE 1.0::DOUBLE END) * o / np END AS bleu1 FROM o)"""


def _norm_sql(c):
    s = f"trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    s = f"regexp_replace({s}, '(^|\\s)(a|an|the)(\\s|$)', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def _tokens_sql(c):
    return f"list_filter(string_split({_norm_sql(c)}, ' '), lambda x: x <> '')"


SCORED = PAIRS.format(p=_tokens_sql("prediction"), r=_tokens_sql("reference"))
STATS = ", ".join(f"round(coalesce(avg({m}), 0), 9) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 9) AS {m}_std" for m in ("f1", "bleu1"))
TURNS = """l AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS ai FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
tu AS (SELECT conv_id, turn, text AS user_text, ai AS ai_text FROM l WHERE role = 'user' AND nr = 'assistant')"""
EVENTS = """n AS (SELECT user_id AS graph_id, event_id AS node_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS node_seq, ts, value, event_type FROM events),
c AS (SELECT graph_id, lag(node_id) OVER (PARTITION BY graph_id ORDER BY node_seq) AS src, node_id AS dst, least(1.0::DOUBLE, abs(value) / 1000) AS weight FROM n),
e AS (SELECT * FROM c WHERE src IS NOT NULL UNION ALL SELECT graph_id, dst, src, weight FROM c WHERE src IS NOT NULL),
w AS (SELECT n.*, coalesce(sum(e.weight), 0) AS tw FROM n LEFT JOIN e ON n.graph_id = e.graph_id AND n.node_id = e.src GROUP BY ALL),
g AS (SELECT graph_id, node_id, CAST(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) AS BIGINT) AS age_days FROM w WHERE round(tw, 9) < 0.1 AND floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) > 15)"""


# --- dialogue -----------------------------------------------------------------


@query(f"WITH {TURNS} SELECT conv_id, turn, user_text, ai_text FROM tu")
def pair_adjacent(spark, sf):
    return turns(spark, sf)


@query("""WITH r AS (SELECT *, event_type IN ('signup', 'view', 'click') AS u FROM events),
a AS (SELECT *, sum(CASE WHEN u THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM r),
b AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m FROM a),
c AS (SELECT *, sum(CASE WHEN u THEN 1 ELSE 0 END) OVER w AS un, sum(CASE WHEN NOT u AND s >= m THEN 1 ELSE 0 END) OVER w AS rn FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT x.user_id, CAST(x.un AS BIGINT) AS turn_seq, x.event_id AS user_row, y.event_id AS reply_row FROM c x JOIN c y ON x.user_id = y.user_id AND x.un = y.rn WHERE x.u AND NOT y.u AND y.s >= y.m""")
def pair_fifo(spark, sf):
    e = read(spark, sf, "events")
    return D.pair_fifo(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type").isin("signup", "view", "click"), "event_id")


@query(f"WITH {TURNS} SELECT conv_id AS graph_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS node_seq, 'User: ' || user_text || chr(10) || 'AI: ' || ai_text AS content, 'interaction' AS role FROM tu")
def memory_nodes(spark, sf):
    return D.memory_nodes(turns(spark, sf), "conv_id", "turn")


@query(f"WITH {TURNS}, s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM tu) SELECT conv_id, (k - 1) // 10 AS batch, count(*) AS n_turns FROM s GROUP BY ALL")
def buffer_batches(spark, sf):
    return D.buffers(turns(spark, sf), "conv_id", "turn")


def _stripped_sql(c):
    return f"regexp_replace({c}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"


@query(f"""WITH x AS (SELECT conv_id, role, CASE WHEN turn >= 12 THEN 1000000000 ELSE turn // 4 + 1 END AS s, row_number() OVER (PARTITION BY conv_id, least(turn // 4, 3) ORDER BY turn) - 1 AS pos,
  {_stripped_sql("CASE WHEN turn % 5 = 0 THEN ' ' ELSE text END")} AS t, CASE WHEN turn % 2 = 0 THEN 'photo ' || turn END AS cap FROM conversations)
SELECT * FROM (SELECT CAST(conv_id AS VARCHAR) AS sample_id, CAST(s AS INTEGER) AS session_seq, CAST(pos AS INTEGER) AS pos, CASE WHEN s IN (1, 3) THEN 'day ' || s END AS ts, role = 'user' AS is_user,
  CASE WHEN cap IS NULL THEN t WHEN t = '' THEN '[image: ' || cap || ']' ELSE t || ' [image: ' || cap || ']' END AS text FROM x) WHERE text <> ''""")
def session_rows(spark, sf):
    """Samples whose sessions are keys of a document: in numeric order, the one without a number last, some without a date; empty dialogs go."""
    part = F.least(F.floor(F.col("turn") / 4), F.lit(3))
    name = F.when(part == 3, "session_last").otherwise(F.concat(F.lit("session_"), part + 1))
    line = F.struct("turn", F.when(F.col("role") == "user", "A").otherwise("B").alias("speaker"), F.when(F.col("turn") % 5 == 0, " ").otherwise(F.col("text")).alias("text"),
                    F.when(F.col("turn") % 2 == 0, F.concat(F.lit("photo "), "turn")).alias("blip_caption"))
    bodies = read(spark, sf, "conversations").groupBy("conv_id", name.alias("key")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.dropFields("turn"))).alias("body"))
    dates = F.array(*[F.struct(F.lit(f"session_{i}_date_time").alias("key"), F.lit(f"day {i}").alias("body")) for i in (1, 3)], F.struct(F.lit("speaker_a").alias("key"), F.lit("A").alias("body")))
    talk = F.map_from_entries(F.concat(dates, F.collect_list(F.struct("key", "body")))).alias("conversation")
    return dialogs(bodies.groupBy(F.col("conv_id").cast("string").alias("sample_id")).agg(talk))


@query(f"""WITH x AS (SELECT *, turn // 6 AS s, max(turn // 6) OVER (PARTITION BY conv_id) AS last, row_number() OVER w - 1 AS pos, lead(role) OVER w AS nr, lead(text) OVER w AS ai
  FROM conversations WINDOW w AS (PARTITION BY conv_id, turn // 6 ORDER BY turn))
SELECT conv_id AS graph_id, CAST(s AS INTEGER) AS session_seq, CAST(pos AS INTEGER) AS turn_seq, CASE WHEN s < last THEN 'day ' || s ELSE 'today' END AS ts, text AS user_text, ai AS ai_text
FROM x WHERE role = 'user' AND nr = 'assistant'""")
def session_list_turns(spark, sf):
    """Items of session lists, whose last session has no date and gets the present one."""
    rows = read(spark, sf, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 6).alias("s")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("r"))
    rows = rows.select("conv_id", "s", F.transform("r", lambda x: x.dropFields("turn")).alias("r"))
    lists = rows.groupBy(F.col("conv_id").alias("question_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "r"))), lambda x: x["r"]).alias("haystack_sessions"))
    days = F.transform(F.filter(F.sequence(F.lit(-1), F.size("haystack_sessions") - 2), lambda i: i >= 0), lambda i: F.concat(F.lit("day "), i))
    return E.item_turns(lists.withColumn("haystack_dates", days), F.lit("today"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN '[image: ' || url || ']' ELSE url || ' [image: ' || url || ']' END AS text FROM pages")
def dialog_text_rows(spark, sf):
    p, k = read(spark, sf, "pages"), F.col("page_id") % 3
    return p.select("page_id", dialog_text(F.when(k != 1, F.col("url")), F.when(k != 0, F.col("url"))).alias("text"))


QUERIES["dialog_text"], ORACLES["dialog_text"] = QUERIES.pop("dialog_text_rows"), ORACLES.pop("dialog_text_rows")


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), source) AS answer FROM documents")
def answer_fallback(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", T.reference_answer(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("answer"))


LINES = f"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), s AS (SELECT doc_id, regexp_replace(raw, '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS raw FROM l)"


@query(f"WITH {LINES}, c AS (SELECT doc_id, regexp_replace(ltrim(raw, '- '), '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS line FROM s) SELECT doc_id, line FROM c WHERE line <> '' AND lower(line) <> 'none' AND NOT starts_with(line, '【')")
def clean_lines(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    return rows.select("doc_id", T.clean_line(F.col("raw")).alias("line")).where("line IS NOT NULL")


@query(f"""WITH x AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN ' None ' WHEN 1 THEN '- NONE' WHEN 2 THEN '- None.' || chr(10) || text ELSE text END AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM x WHERE lower({_stripped_sql("text")}) NOT IN ('', 'none', '- none')),
c AS (SELECT doc_id, line_no, {_stripped_sql("ltrim(" + _stripped_sql("raw") + ", '- ')")} AS content FROM l)
SELECT doc_id AS graph_id, 0 AS batch, CAST(line_no AS INTEGER) AS line_no, content FROM c WHERE content <> '' AND lower(content) <> 'none' AND NOT starts_with(content, '【') AND content NOT IN ('- None', '- None.')""")
def clean_blocks(spark, sf):
    """The session-list style: a text that is none as a whole goes first, and only line feeds end a line."""
    k, text = F.col("doc_id") % 9, F.col("text")
    text = F.when(k == 0, " None ").when(k == 1, "- NONE").when(k == 2, F.concat(F.lit("- None.\n"), text)).otherwise(text)
    return E.facts(read(spark, sf, "documents").select(F.col("doc_id").alias("graph_id"), F.lit(0).alias("batch"), text.alias("private")), "private", whole=True)


@query(f"WITH {LINES}, c AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '^- ', ''), '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS line FROM s) SELECT doc_id, line FROM c WHERE length(line) > 10 AND lower(line) <> 'none'")
def fact_lines(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    return rows.select("doc_id", T.fact_line(F.col("raw")).alias("line")).where("line IS NOT NULL")


@query("""WITH m AS (SELECT conv_id, turn, string_split(text, 'the ') AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN len(p) <= 2 THEN p[1] END AS profile, CASE WHEN len(p) = 1 THEN 'None' WHEN len(p) = 2 THEN p[2] END AS private, len(p) > 2 AS failed FROM m""")
def marker_split(spark, sf):
    parts = E.split_reply(F.col("text"), "the ")
    return read(spark, sf, "conversations").select("conv_id", "turn", parts["profile"].alias("profile"), parts["private"].alias("private"), parts["failed"].alias("failed"))


# --- retrieval ----------------------------------------------------------------


@query(f"WITH {VEC} SELECT graph_id, src, dst, weight FROM e")
def temporal_edges(spark, sf):
    return G.temporal_edges(vec_nodes(spark, sf))


@query(f"WITH {SCORES} SELECT query_id, node_id, round(enh, 9) AS base_score FROM s")
def base_similarity(spark, sf):
    n = vec_nodes(spark, sf)
    return R.base_scores(n, vec_queries(n)).select("query_id", "node_id", F.round("base", 9).alias("base_score"))


KW = "list_distinct(list_filter(list_transform(string_split({}, ','), lambda x: regexp_replace(x, '^SPACE+|SPACE+$', '', 'g')), lambda x: x <> ''))".replace("SPACE", T.SPACE.replace("{", "{{").replace("}", "}}"))


@query(f"SELECT doc_id, len({KW.format('text')}) AS n_keywords, list_aggregate(list_sort({KW.format('text')}), 'string_agg', '|') AS keywords FROM documents")
def keyword_parse(spark, sf):
    k = T.keywords(F.col("text"))
    joined = F.when(F.size(k) > 0, F.array_join(F.array_sort(k), "|"))
    return read(spark, sf, "documents").select("doc_id", F.size(k).cast("long").alias("n_keywords"), joined.alias("keywords"))


@query(f"""WITH k AS (SELECT conv_id, turn, string_split(text, ' ') AS a, lead(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(a)), 9) AS score FROM k WHERE b IS NOT NULL""")
def keyword_score(spark, sf):
    w = F.array_distinct(F.split("text", " "))
    c = read(spark, sf, "conversations").select("conv_id", "turn", w.alias("a"), F.lead(w).over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b IS NOT NULL")
    return c.select("conv_id", "turn", F.round(T.keyword_score(F.col("a"), F.col("b")), 9).alias("score"))


@query(f"WITH {SCORES} SELECT query_id, node_id, round(fin, 9) AS score FROM f")
def spread_scores(spark, sf):
    n = vec_nodes(spark, sf)
    return R.spread(R.base_scores(n, vec_queries(n)), G.temporal_edges(n)).select("query_id", "node_id", F.round("fin", 9).alias("score"))


def results(spark, sf):
    n = vec_nodes(spark, sf)
    return R.retrieve(n, G.temporal_edges(n), vec_queries(n), k=10)


@query(f"WITH {RANKED} SELECT * FROM res")
def retrieve_topk(spark, sf):
    return results(spark, sf)


@query(f"WITH {RANKED} SELECT query_id, string_agg(CASE WHEN base_score > 0.6 THEN '[direct] ' ELSE '[associative] ' END || 'node ' || node_id, chr(10) || chr(10) ORDER BY out_rank) AS context FROM res GROUP BY 1")
def context_blocks(spark, sf):
    contents = vec_nodes(spark, sf).select("graph_id", "node_id", F.concat(F.lit("node "), "node_id").alias("content"))
    return R.context(results(spark, sf), contents)


@query(f"""WITH {VEC}, s AS (SELECT query_id, node_id, node_seq, list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]) AS sim FROM n JOIN q USING (graph_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, node_seq) AS rank FROM s)
SELECT query_id, node_id, rank, round(sim, 9) AS score FROM r WHERE rank <= 10""")
def fallback_kb(spark, sf):
    n = vec_nodes(spark, sf)
    return K.nearest(n, vec_queries(n), 10).select("query_id", "node_id", F.col("out_rank").alias("rank"), "score")


@query(f"WITH {VEC} SELECT graph_id, node_id, 'fact ' || node_id AS knowledge FROM n")
def kb_scan(spark, sf):
    return K.contents(vec_nodes(spark, sf).withColumn("content", F.concat(F.lit("fact "), "node_id")))


# --- graph state --------------------------------------------------------------

REINFORCED = RANKED + ", d AS (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, count(*) * 0.01::DOUBLE AS weight FROM res a JOIN res b ON a.query_id = b.query_id AND a.out_rank < b.out_rank GROUP BY ALL)"


@query(f"WITH {REINFORCED} SELECT graph_id, src, dst, round(weight, 9) AS weight FROM d")
def reinforce_pairs(spark, sf):
    return G.reinforce_pairs(results(spark, sf)).withColumn("weight", F.round("weight", 9))


UPSERT = REINFORCED + ", v AS (SELECT graph_id, src, dst, least(1.0::DOUBLE, sum(weight)) AS weight FROM (SELECT * FROM e UNION ALL SELECT * FROM d UNION ALL SELECT graph_id, dst, src, weight FROM d) GROUP BY ALL)"


@query(f"WITH {UPSERT} SELECT graph_id, src, dst, round(weight, 9) AS weight FROM v")
def edge_upsert(spark, sf):
    return _upserted(spark, sf).withColumn("weight", F.round("weight", 9))


def _upserted(spark, sf):
    n = vec_nodes(spark, sf)
    e = G.temporal_edges(n)
    return G.upsert(e, G.reinforce_pairs(R.retrieve(n, e, vec_queries(n), k=10)))


@query(f"WITH {UPSERT} SELECT graph_id, src, dst, round(weight * 0.995::DOUBLE, 9) AS weight FROM v WHERE weight * 0.995::DOUBLE >= 0.01::DOUBLE")
def edge_decay(spark, sf):
    return G.decay(_upserted(spark, sf)).withColumn("weight", F.round("weight", 9))


SIMILAR = VEC + """,
z AS (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, b.node_seq AS dseq, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
  (greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 1e-10) * greatest(sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-10)) AS sim
  FROM n a JOIN n b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id),
y AS (SELECT *, row_number() OVER (PARTITION BY graph_id, src ORDER BY round(sim, 12) DESC, dseq DESC) AS r FROM z),
u AS (SELECT graph_id, least(src, dst) AS src, greatest(src, dst) AS dst, max(sim) * 0.3::DOUBLE AS weight FROM y WHERE r <= 5 AND sim > 0.3::DOUBLE GROUP BY ALL),
t AS (SELECT u.* FROM u ANTI JOIN e USING (graph_id, src, dst)),
se AS (SELECT * FROM t UNION ALL SELECT graph_id, dst, src, weight FROM t)"""


@query(f"WITH {SIMILAR} SELECT graph_id, src, dst, round(weight, 9) AS weight FROM se")
def similarity_edges(spark, sf):
    n = vec_nodes(spark, sf)
    return G.similarity_edges(n, G.temporal_edges(n), LINKED).withColumn("weight", F.round("weight", 9))


ALL_EDGES = SIMILAR + ", ae AS (SELECT * FROM e UNION ALL SELECT * FROM se), dg AS (SELECT n.graph_id, n.node_id, n.node_seq, count(ae.src) AS degree, coalesce(sum(ae.weight), 0) AS total_weight FROM n LEFT JOIN ae ON n.graph_id = ae.graph_id AND n.node_id = ae.src GROUP BY ALL)"


def _linked(spark, sf):
    n = vec_nodes(spark, sf)
    e = G.temporal_edges(n)
    return n, e.unionByName(G.similarity_edges(n, e, LINKED))


@query(f"WITH {ALL_EDGES} SELECT graph_id, node_id, degree, round(total_weight, 9) AS total_weight FROM dg")
def node_degree(spark, sf):
    d = G.degrees(*_linked(spark, sf))
    return d.select("graph_id", "node_id", "degree", F.round("total_weight", 9).alias("total_weight"))


@query(f"""WITH {ALL_EDGES}, h AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY round(degree * total_weight, 9) DESC, node_seq) AS hub_rank FROM dg WHERE degree >= 3)
SELECT graph_id, node_id, hub_rank, round(degree * total_weight, 9) AS hub_score FROM h WHERE hub_rank <= 20""")
def hub_nodes(spark, sf):
    h = G.hubs(G.degrees(*_linked(spark, sf)))
    return h.select("graph_id", "node_id", F.col("hub_rank").cast("long").alias("hub_rank"), F.round("hub_score", 9).alias("hub_score"))


CLUSTERS = ALL_EDGES.replace("n AS (", "RECURSIVE n AS (", 1) + """,
h AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY round(degree * total_weight, 9) DESC, node_seq) AS k FROM dg WHERE degree >= 3),
l AS (SELECT graph_id, src, list(dst ORDER BY r) AS near FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, src ORDER BY round(weight, 12) DESC, dst) AS r FROM ae) WHERE r < 8 GROUP BY ALL),
hh AS (SELECT h.graph_id, h.k, h.node_id AS hub, l.near FROM h JOIN l ON h.graph_id = l.graph_id AND h.node_id = l.src WHERE h.k <= 20),
fold AS (SELECT DISTINCT graph_id, 0::BIGINT AS k, []::BIGINT[] AS done, NULL::BIGINT AS hub, []::BIGINT[] AS members FROM hh
  UNION ALL SELECT graph_id, k, CASE WHEN taken THEN done ELSE list_concat(done, new) END, hub, CASE WHEN taken THEN [] ELSE new END
  FROM (SELECT f.graph_id, hh.k, f.done, hh.hub, list_contains(f.done, hh.hub) AS taken, list_filter(list_concat([hh.hub], hh.near), lambda x: NOT list_contains(f.done, x)) AS new FROM fold f JOIN hh ON f.graph_id = hh.graph_id AND hh.k = f.k + 1)),
cl AS (SELECT graph_id, hub, members FROM fold WHERE len(members) >= 2)"""


@query(f"WITH {CLUSTERS} SELECT graph_id, hub, array_to_string(members, ',') AS members FROM cl")
def greedy_clusters(spark, sf):
    n, e = _linked(spark, sf)
    c = G.greedy_clusters(G.hubs(G.degrees(n, e)), e.withColumn("edge_seq", F.col("dst")))
    return c.select("graph_id", "hub", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"WITH {CLUSTERS} SELECT graph_id, hub, array_to_string(list_transform(members, lambda x: 'node ' || x), chr(10)) AS texts FROM cl")
def consolidation_plan(spark, sf):
    """Texts of each cluster as they would go to the text model, cut at 1500 characters."""
    contents = vec_nodes(spark, sf).select("graph_id", F.col("node_id").cast("string").alias("m"), F.substring(F.concat(F.lit("node "), "node_id"), 1, 1500).alias("c"))
    rows = greedy_clusters(spark, sf).select("graph_id", "hub", F.posexplode(F.split("members", ",")).alias("pos", "m"))
    out = rows.join(contents, ["graph_id", "m"]).groupBy("graph_id", "hub").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("l"))
    return out.select("graph_id", "hub", F.array_join(F.transform("l", lambda x: x["c"]), "\n").alias("texts"))


@query(f"WITH {UPSERT} SELECT graph_id, src, dst, round(weight, 9) AS weight FROM v")
def stored_edges(spark, sf):
    """A graph that is stored, reinforced by increments in a commit of its own, compacted and read again."""
    n = vec_nodes(spark, sf)
    e = G.temporal_edges(n)
    store = Segments(spark, folder(spark, "edges"), key="bigint")
    store.commit({"edges": e})
    store.commit(add={"edges": G.both_ways(G.reinforce_pairs(R.retrieve(n, e, vec_queries(n), k=10)))})
    store.compact()
    return store.read("edges").select("graph_id", "src", "dst", F.round("weight", 9).alias("weight"))


@query("""SELECT user_id AS graph_id, event_type || ' ' || event_id AS data, CAST(date_trunc('second', ts) AS VARCHAR) AS last_updated
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'signup' ORDER BY ts DESC, event_id DESC) AS r, max(event_type = 'signup') OVER (PARTITION BY user_id) AS signed FROM events)
WHERE r = 1 AND (event_type = 'signup') = signed""")
def stored_profiles(spark, sf):
    """Profiles of all users are stored; a second commit replaces those of users who signed up."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("graph_id"), F.struct("ts", "event_id").alias("at"), F.concat("event_type", F.lit(" "), "event_id").alias("data"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), "event_type")
    newest = lambda df: df.groupBy("graph_id").agg(F.max_by(F.struct("data", "last_updated"), "at").alias("p")).select("graph_id", "p.*")
    store = Segments(spark, folder(spark, "profiles"), key="bigint")
    store.commit({"profiles": newest(e.where("event_type <> 'signup'"))})
    store.commit({"profiles": newest(e.where("event_type = 'signup'"))})
    return store.read("profiles")


def as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _forgotten(n, e):
    return G.forget_candidates(n, e, as_of(), min_age=15)


@query(f"WITH {EVENTS} SELECT graph_id, node_id, age_days FROM g")
def forget_candidates(spark, sf):
    n = event_nodes(spark, sf)
    return _forgotten(n, event_edges(n)).select("graph_id", "node_id", F.col("age_days").cast("long").alias("age_days"))


@query(f"WITH {EVENTS} SELECT graph_id, src, dst, round(weight, 9) AS weight FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.graph_id = e.graph_id AND g.node_id IN (e.src, e.dst))")
def forget_apply(spark, sf):
    n = event_nodes(spark, sf)
    e = event_edges(n)
    return G.forget(n, e, _forgotten(n, e))[1].select("graph_id", "src", "dst", F.round("weight", 9).alias("weight"))


@query(f"""WITH {EVENTS}, ends AS (SELECT graph_id, src AS node_id FROM e UNION ALL SELECT graph_id, dst FROM e), counted AS (SELECT graph_id, node_id, count(*) AS n FROM ends GROUP BY ALL)
SELECT g.graph_id, g.node_id, round(w.tw, 9) AS total_weight, g.age_days, coalesce(counted.n, 0) AS n_edges, left(w.event_type || ' of user ' || g.graph_id, 50) AS preview
FROM g JOIN w USING (graph_id, node_id) LEFT JOIN counted USING (graph_id, node_id)""")
def forget_preview(spark, sf):
    n = event_nodes(spark, sf).withColumn("content", F.concat("event_type", F.lit(" of user "), "graph_id"))
    e = event_edges(n)
    return G.forgetting_preview(n, e, _forgotten(n, e))


@query("SELECT event_id, round(exp(-(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 1e7), 9) AS decay FROM events")
def time_decay(spark, sf):
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf, "events").select("event_id", F.round(T.time_decay(ts, as_of(), 1e7), 9).alias("decay"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 1 THEN CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) WHEN 2 THEN CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) END AS seconds FROM events")
def ts_parse(spark, sf):
    k = F.col("event_id") % 4
    forms = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "h:mm a 'on' d MMMM, yyyy")).when(k == 2, F.date_format("ts", "d MMMM yyyy")).otherwise("no date")
    return read(spark, sf, "events").select("event_id", F.unix_timestamp(T.parsed_time(forms)).alias("seconds"))


@query("SELECT user_id, event_id, event_type AS knowledge FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100")
def ak_retention(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("knowledge"))
    return K.retain(rows, "user_id", [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""WITH k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type IN ('signup', 'view') AS old FROM events),
o AS (SELECT *, max(CASE WHEN old THEN k END) OVER (PARTITION BY user_id) AS last FROM k),
n AS (SELECT *, CASE WHEN old THEN k ELSE coalesce(last, -1) + row_number() OVER (PARTITION BY user_id, old ORDER BY k) END AS seq FROM o WHERE old OR event_type <> 'error')
SELECT user_id AS graph_id, seq::BIGINT AS ak_seq, event_type || ' ' || event_id AS knowledge FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM n) WHERE r <= 5""")
def ak_append(spark, sf):
    """Signups and views are stored, other events are added behind them; errors state nothing."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    text = F.when(F.col("event_type") == "error", "- None").otherwise(F.concat("event_type", F.lit(" "), "event_id"))
    e = read(spark, sf, "events").select(F.col("user_id").alias("graph_id"), k.alias("ak_seq"), text.alias("knowledge"), F.col("event_type").isin("signup", "view").alias("old"))
    return K.add_assistant_knowledge(e.where("old").drop("old"), e.where("NOT old").drop("old"), 5)


def _profiles(spark, sf):
    return K.latest(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").withColumnRenamed("event_type", "data")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS data FROM events GROUP BY 1")
def profile_upsert(spark, sf):
    return _profiles(spark, sf)


@query("SELECT c_custkey AS user_id, coalesce(data, '') AS data FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS data FROM events GROUP BY 1) ON user_id = c_custkey")
def profile_lookup(spark, sf):
    return K.profile_of(read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), _profiles(spark, sf), "user_id")


@query("SELECT page_id, split_part(regexp_extract(url, '[^/]*$'), '_', 1) AS name FROM pages")
def profile_key(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.name_key(F.col("url")).alias("name"))


@query("SELECT event_id, key AS dst, CAST(props ->> ('$.' || key) AS DOUBLE) AS weight FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def edge_explode(spark, sf):
    return read(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "MAP<STRING, DOUBLE>")).alias("dst", "weight"))


# --- scoring ------------------------------------------------------------------


@query(f"WITH {SCORED} SELECT conv_id, turn, round(f1, 9) AS f1 FROM m")
def token_f1(spark, sf):
    return scored(spark, sf).select("conv_id", "turn", F.round("f1", 9).alias("f1"))


@query(f"WITH {SCORED} SELECT conv_id, turn, round(bleu1, 9) AS bleu1 FROM m")
def bleu1(spark, sf):
    return scored(spark, sf).select("conv_id", "turn", F.round("bleu1", 9).alias("bleu1"))


@query(f"WITH {SCORED} SELECT count(*) AS n, {STATS} FROM m")
def metrics_overall(spark, sf):
    return M.summary(scored(spark, sf))


NAMES = "CASE turn % 6 + 1 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in T.CATEGORIES.items()) + " ELSE 'Unknown' END"


@query(f"WITH {SCORED} SELECT {NAMES} AS category, count(*) AS n, {STATS} FROM m GROUP BY 1")
def metrics_by_category(spark, sf):
    return M.by_category(scored(spark, sf).withColumn("category", (F.col("turn") % 6 + 1).cast("string")))


@query(f"WITH {SCORED} SELECT conv_id, count(*) AS n, {STATS} FROM m GROUP BY 1")
def metrics_by_sample(spark, sf):
    return M.summary(scored(spark, sf), "conv_id")


@query(f"WITH {SCORED} SELECT conv_id, turn, round(avg(f1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 9) AS running_f1 FROM m")
def running_metrics(spark, sf):
    return M.running(scored(spark, sf), "conv_id", "turn", "f1", "running_f1").select("conv_id", "turn", "running_f1")


FORMS = ["Yes.", "y", "Yes, it is", "No, yes", "no yes", "", "correct", "No"]
REPLY = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FORMS)) + " END"
JUDGED = f"j AS (SELECT doc_id, quality, {REPLY} AS reply FROM labels), h AS (SELECT *, regexp_replace(lower(reply), '[.!:;]', '', 'g') AS l FROM j), w AS (SELECT *, string_split(l, ' ')[1] AS hd FROM h), v AS (SELECT doc_id, quality, hd IN ('yes', 'y') OR (hd <> '' AND hd NOT IN ('no', 'n') AND contains(l, 'yes')) AS correct FROM w)"


def _judged(spark, sf):
    reply = F.get(F.array(*map(F.lit, FORMS)), (F.col("doc_id") % 8).cast("int"))
    return read(spark, sf, "labels").select("doc_id", "quality", T.judged(reply).alias("correct"))


@query(f"WITH {JUDGED} SELECT doc_id, correct FROM v")
def judge_parse(spark, sf):
    return _judged(spark, sf).select("doc_id", "correct")


@query(f"WITH {JUDGED} SELECT CASE quality WHEN 1 THEN 'high' ELSE 'low' END AS question_type, count(*) AS n, sum(correct::INT)::BIGINT AS n_correct, round(sum(correct::INT) * 100.0::DOUBLE / count(*), 6) AS accuracy FROM v GROUP BY ROLLUP (CASE quality WHEN 1 THEN 'high' ELSE 'low' END)")
def judge_accuracy(spark, sf):
    j = _judged(spark, sf).select(F.when(F.col("quality") == 1, "high").otherwise("low").alias("question_type"), F.col("correct").cast("int").alias("correct"))
    return M.accuracy(j)


@query("SELECT doc_id, contains(source || '_' || lang || CASE WHEN doc_id % 7 = 0 THEN '_abs' ELSE '' END, 'abs') AS abstains FROM documents")
def abstention(spark, sf):
    name = F.concat("source", F.lit("_"), "lang", F.when(F.col("doc_id") % 7 == 0, "_abs").otherwise(""))
    return read(spark, sf, "documents").select("doc_id", T.abstains(name).alias("abstains"))


@query("SELECT page_id, 'sample_' || left(sha256(url || chr(31) || html), 12) AS sample_id FROM pages")
def sample_identifiers(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.sample_key(F.col("url"), F.col("html")).alias("sample_id"))


@query("""SELECT user_id, string_agg('- ' || event_type || ' ' || event_id, chr(10) ORDER BY ts, event_id) AS traits
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100 GROUP BY 1""")
def bullet_lists(spark, sf):
    """What is retained of each user, as the list that a prompt shows."""
    rows = K.retain(read(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")])
    rows = rows.select("user_id", F.struct("ts", "event_id").alias("at"), F.concat("event_type", F.lit(" "), "event_id").alias("content"))
    return A.listed(rows, "user_id", "at", "content", "traits")


@query("SELECT event_id, printf('%.2f', value) AS shown FROM events")
def shown_scores(spark, sf):
    return read(spark, sf, "events").select("event_id", T.two_decimals(F.col("value")).alias("shown"))


@query("""WITH u AS (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, unnest(range(len(embedding))) AS place, round(unnest(list_transform(embedding, lambda x: CAST(x / n AS FLOAT)))::DOUBLE, 6) AS value FROM u""")
def unit_vectors(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", F.posexplode(T.unit(F.col("embedding"))).alias("place", "value"))
    return v.select("vec_id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'corrupted' WHEN quality IS NULL THEN 'missing' WHEN toxic = 1 THEN 'empty' ELSE 'evaluated' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def item_status(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", S.status(F.col("doc_id") % 97 == 0, F.col("quality").isNull(), F.col("toxic") == 1).alias("status"))


# --- selection and summaries --------------------------------------------------


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k BETWEEN 3 AND 5")
def sample_slice(spark, sf):
    return S.positions(read(spark, sf, "conversations"), "conv_id", "turn", 2, 3).select("conv_id", "turn")


@query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def sample_ids_semi(spark, sf):
    return S.chosen(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_ids(spark, sf):
    return S.unknown(read(spark, sf, "labels"), read(spark, sf, "documents"), "doc_id")


SUMMARY = f"WITH {TURNS} SELECT count(DISTINCT conv_id) AS n_graphs, count(*) AS n_nodes, sum(length(user_text) + length(ai_text))::BIGINT AS n_chars FROM tu"


@query(SUMMARY)
def encode_summary(spark, sf):
    return M.encode_totals(turns(spark, sf), "conv_id")


@query(f"WITH s AS ({SUMMARY}) SELECT '{{\"n_graphs\":' || n_graphs || ',\"n_nodes\":' || n_nodes || ',\"n_chars\":' || n_chars || '}}' AS summary FROM s")
def summary_json(spark, sf):
    return encode_summary(spark, sf).select(F.to_json(F.struct("n_graphs", "n_nodes", "n_chars")).alias("summary"))


# --- knowledge, prompts and model-backed plans --------------------------------

ENDED = "(SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM events)"


@query(f"""WITH u AS (SELECT *, max(era) OVER (PARTITION BY user_id) AS last FROM {ENDED})
SELECT user_id, string_agg(event_type || ' ' || event_id, chr(10) || chr(10) || '--- Updated ---' || chr(10) ORDER BY ts, event_id) AS data FROM u WHERE era = last GROUP BY 1""")
def profile_merge(spark, sf):
    """A signup replaces the profile, every other event is appended to it."""
    e = read(spark, sf, "events").withColumn("d", F.concat("event_type", F.lit(" "), "event_id"))
    return K.fold_profiles(e, "user_id", [F.col("ts"), F.col("event_id")], "d", F.col("event_type") != "signup")


@query(f"""WITH k AS (SELECT conv_id, turn, {_tokens_sql("text")} AS t FROM conversations),
c AS (SELECT conv_id, turn, list_sort(list_transform(list_distinct(t), lambda w: {{'n': -len(list_filter(t, lambda x: x = w)), 'w': w}}))[1:3] AS l FROM k)
SELECT conv_id, turn, coalesce(array_to_string(list_transform(l, lambda s: s.w), ','), '') AS keywords FROM c""")
def keyword_extract(spark, sf):
    return K.with_keywords(read(spark, sf, "conversations"), "text").select("conv_id", "turn", F.array_join("keywords", ",").alias("keywords"))


TASKS = [*P.JUDGE, "other"]


def _quoted(s):
    return "'" + s.replace("'", "''") + "'"


RULES = f"CASE WHEN doc_id % 11 = 0 THEN {_quoted(P.ABSTAIN)} " + " ".join(f"WHEN doc_id % {len(TASKS)} = {i} THEN {_quoted(P.JUDGE.get(t, P.ANY))}" for i, t in enumerate(TASKS)) + " END"


@query(f"SELECT doc_id, concat_ws(chr(10) || chr(10), {RULES}, 'Question: ' || lang, 'Reference: ' || source, 'Reply: ' || n_chars, 'Answer yes or no.') AS prompt FROM documents")
def judge_prompt(spark, sf):
    task = F.get(F.array(*map(F.lit, TASKS)), (F.col("doc_id") % len(TASKS)).cast("int"))
    ask = P.judge(task, F.col("lang"), F.col("source"), F.col("n_chars").cast("string"), F.col("doc_id") % 11 == 0)
    return read(spark, sf, "documents").select("doc_id", ask.alias("prompt"))


@query(f"""WITH {RANKED},
fs AS (SELECT query_id, graph_id, node_id, node_seq, list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]) /
  (greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-10) * greatest(sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[])), 1e-10)) AS sim FROM n JOIN q USING (graph_id) WHERE graph_id % 2 = 1),
fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, node_seq) AS out_rank FROM fs)
SELECT query_id, graph_id, node_id, out_rank, score, 'graph' AS origin FROM res WHERE graph_id % 2 = 0
UNION ALL SELECT query_id, graph_id, node_id, out_rank, round(sim, 9), 'fallback' FROM fk WHERE out_rank <= 10""")
def search_knowledge(spark, sf):
    """Graphs with an even identifier have knowledge nodes, the others fallback rows only."""
    n = vec_nodes(spark, sf)
    own = n.where("graph_id % 2 = 0")
    return K.search_knowledge(own, G.temporal_edges(own), n, vec_queries(n), k=10)


@query(f"""WITH {TURNS}, s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM tu)
SELECT conv_id AS graph_id, k // 10 AS batch, string_agg('User: ' || user_text || chr(10) || 'AI: ' || ai_text, chr(10) ORDER BY k) AS text FROM s GROUP BY 1, 2""")
def batch_texts(spark, sf):
    return E.batch_texts(turns(spark, sf), "conv_id", "turn")


def conv_turns(spark, sf):
    return turns(spark, sf).select(F.col("conv_id").alias("graph_id"), F.lit(1).alias("session_seq"), F.col("turn").alias("turn_seq"), F.lit(None).cast("string").alias("ts"), "user_text", "ai_text")


@query()
def memory_graph(spark, sf):
    """Nodes of conversations with the vectors and keywords of the default hooks."""
    return E.memory_graph(conv_turns(spark, sf))[0]


@query(f"""WITH {TURNS}, n AS (SELECT conv_id AS graph_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS node_seq, 'User: ' || user_text || chr(10) || 'AI: ' || ai_text AS content FROM tu),
k AS (SELECT *, {_tokens_sql("content")} AS t FROM n),
c AS (SELECT *, list_sort(list_transform(list_distinct(t), lambda w: {{'n': -len(list_filter(t, lambda x: x = w)), 'w': w}}))[1:3] AS l FROM k)
SELECT graph_id, node_seq, node_seq AS node_id, content, 'interaction' AS role, coalesce(array_to_string(list_transform(l, lambda s: s.w), ','), '') AS keywords FROM c""")
def memory_keywords(spark, sf):
    """The nodes of conversations with their keywords."""
    n = E.memory_graph(conv_turns(spark, sf))[0]
    return n.select("graph_id", "node_seq", "node_id", "content", "role", F.array_join("keywords", ",").alias("keywords"))


@query(f"""WITH {TURNS}, s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM tu),
b AS (SELECT conv_id, k // 10 AS batch, string_agg('User: ' || user_text || chr(10) || 'AI: ' || ai_text, chr(10) ORDER BY k) AS text FROM s GROUP BY 1, 2),
r AS (SELECT conv_id, batch, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM b),
x AS (SELECT *, regexp_replace(raw, '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS line FROM r),
f AS (SELECT conv_id, batch, row_number() OVER (PARTITION BY conv_id, batch ORDER BY i) - 1 AS line_no, regexp_replace(ltrim(line, '- '), '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS content FROM x WHERE line <> '')
SELECT conv_id AS graph_id, batch, CAST(line_no AS INTEGER) AS line_no, content, 'assistant' AS kind FROM f
WHERE line_no < 3 AND content <> '' AND lower(content) <> 'none' AND NOT starts_with(content, '【')""")
def extracted_facts(spark, sf):
    found = E.extract(batch_texts(spark, sf))
    return E.facts(found, "private").withColumn("kind", F.lit("user")).unionByName(E.facts(found, "assistant").withColumn("kind", F.lit("assistant")))


@query()
def profile_fold(spark, sf):
    return E.fold_extracted(E.extract(batch_texts(spark, sf)))


@query(f"""WITH {CLUSTERS} SELECT graph_id, hub, 0 AS line_no, 'passage of node ' || members[1] AS content FROM cl
UNION ALL SELECT graph_id, hub, 2, 'passage of node ' || members[2] FROM cl""")
def consolidate(spark, sf):
    """The default model repeats the first three lines of a cluster's texts; the line between two texts is no fact."""
    n = vec_nodes(spark, sf).withColumn("content", F.concat(F.lit("passage of node "), "node_id"))
    return E.consolidate(n, G.temporal_edges(n), c=LINKED)


def conv_questions(spark, sf):
    """Each conversation is asked its own last user text."""
    q = turns(spark, sf).groupBy("conv_id").agg(F.max_by("user_text", "turn").alias("question"))
    return q.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("graph_id"), F.lit(0).alias("qa_index"), "question", F.lit("2024-02-01").alias("asked_on"))


def _answered(spark, sf):
    t = conv_turns(spark, sf)
    found = E.extract(batch_texts(spark, sf))
    told = E.facts(found, "assistant").select("graph_id", (F.col("batch") * 1000 + F.col("line_no")).alias("ak_seq"), F.col("content").alias("knowledge"))
    nodes, edges = E.knowledge_graph(E.facts(found, "private"), ["batch", "line_no"])
    none = spark.createDataFrame([], "graph_id long, node_seq long, node_id long, content string, embedding array<float>")
    knowledge = {"profiles": E.fold_extracted(found), "assistant": told, "nodes": nodes, "edges": edges, "fallback": none}
    return A.answer_questions(E.memory_graph(t), knowledge, conv_questions(spark, sf), LONGMEMEVAL.top_k, c=LONGMEMEVAL)


@query()
def answer_question(spark, sf):
    """Prompt and answer of one question per conversation over its memories, knowledge, profile and traits."""
    return _answered(spark, sf)[0]


@query()
def scored_answers(spark, sf):
    """From logs to scores: each conversation's question, answered from its memories and scored against the reply that followed it."""
    reply = turns(spark, sf).groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("ai_text", "turn").alias("reference"))
    rows = _answered(spark, sf)[0].select("query_id", F.col("answer").alias("prediction")).join(reply, "query_id")
    return M.token_scores(rows).select("query_id", F.round("f1", 9).alias("f1"), F.round("bleu1", 9).alias("bleu1"))


@query()
def retrieve_sequential(spark, sf):
    """The first three and every hundredth node of each graph are its queries, in order; each reinforces what the next one reads.

    So what is reinforced grows with the longest graph. A query has the identifier of its node.
    """
    n = vec_nodes(spark, sf)
    q = n.where("node_seq <= 3 OR node_seq % 100 = 0").select(F.col("node_id").alias("query_id"), "graph_id", F.col("node_seq").alias("qa_index"), F.col("embedding").alias("q_embedding"))
    return sequential(n, G.temporal_edges(n), q.select("query_id", "graph_id", "qa_index", "q_embedding"), k=10)[0]
