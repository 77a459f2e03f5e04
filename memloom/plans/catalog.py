"""Queries of the engine by name, and the DuckDB SQL that each is checked against.

Every float is rounded, every array shown as text, and every tie broken by id, so that two engines can agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import evals, graph, journal, lifecycle, mutations, retrieval, scan, temporal, trees
from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- the tables, as SQL

NOTES = """notes AS (SELECT doc_id AS id, text AS content, source AS user_id, lang AS agent_id, doc_id*86400.0 AS created_at, doc_id%7 AS access_count, doc_id%5 AS trust,
 CASE WHEN doc_id%10=9 THEN [doc_id-1, doc_id-2] ELSE [] END AS parents FROM documents)"""
MEM = f"""{NOTES}, memories AS (SELECT n.*, CAST(e.embedding AS DOUBLE[]) AS embedding FROM notes n JOIN embeddings e ON n.id=e.vec_id)"""
QRY = "queries AS (SELECT item_id AS query_id, text, CAST(embedding AS DOUBLE[]) AS embedding FROM benchmark JOIN embeddings ON item_id=vec_id)"
COS = "round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6) + 0.0"
SCORED = f"scored AS (SELECT q.query_id, m.id, {COS.format(a='m.embedding', b='q.embedding')} AS score FROM {{rows}} m, queries q)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"
FACTS = """facts AS (SELECT event_id AS id, user_id AS entity_id, event_type AS fact_type, printf('%.2f', value) AS value, epoch(ts) AS valid_from,
 CASE WHEN event_id%3<>0 THEN CAST(event_id%3 AS VARCHAR) END AS believed_by, event_id%1000 AS source_memory_id, event_id*7919%1000003 AS seq FROM events)"""
HELD = f"""{FACTS}, b AS (SELECT *, max(valid_from) OVER (PARTITION BY entity_id, fact_type, believed_by ORDER BY seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM facts),
h AS (SELECT *, lead(valid_from) OVER (PARTITION BY entity_id, fact_type, believed_by ORDER BY seq, id) AS following FROM b WHERE high IS NULL OR valid_from>=high),
held AS (SELECT id, entity_id, fact_type, value, valid_from, believed_by, source_memory_id, seq, following AS valid_until FROM h
 UNION ALL SELECT id, entity_id, fact_type, value, valid_from, believed_by, source_memory_id, seq, high FROM b WHERE valid_from<high)"""
MID = "(SELECT (min(valid_from)+max(valid_from))/2 FROM facts)"
EDGES = """edges AS (SELECT doc_id AS id, doc_id AS from_id, doc_id+1 AS to_id, ['next','supports','contradicts','refines','related'][CAST(doc_id%5+1 AS INT)] AS relation, (doc_id%10)/10.0 AS weight FROM documents)"""
MENTIONS = r"""spans AS (SELECT doc_id AS memory_id, source AS user_id, unnest(x) AS entity, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, source, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\P{L}]', '0', 'g'), '\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b') AS x FROM documents)),
mentions AS (SELECT memory_id, user_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY memory_id, lower(entity) ORDER BY pos) AS n FROM spans WHERE lower(entity) NOT IN ('i','the','a','an','he','she','they','we')) WHERE n=1)"""
JUDGED = "judged AS (SELECT l.doc_id AS question_id, lang AS category, CAST(quality=1 AS INT) AS a_correct, CAST(toxic=0 AS INT) AS b_correct FROM labels l JOIN documents d ON l.doc_id=d.doc_id)"
TOKENS = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> '')"
JOURNAL = """journal AS (
 SELECT 'add' AS op, doc_id AS id, text AS content, source AS user_id, NULL::BIGINT AS from_id, NULL::BIGINT AS to_id, NULL AS relation, doc_id*10+1 AS seq FROM documents
 UNION ALL SELECT 'update', doc_id, NULL, lang, NULL, NULL, NULL, doc_id*10+23 FROM documents WHERE doc_id%4=1
 UNION ALL SELECT 'update', doc_id, lower(text), NULL, NULL, NULL, NULL, doc_id*10+45 FROM documents WHERE doc_id%6=1
 UNION ALL SELECT 'delete', doc_id, NULL, NULL, NULL, NULL, NULL, doc_id*10+67 FROM documents WHERE doc_id%9=0
 UNION ALL SELECT 'add_edge', doc_id+1000000000, NULL, NULL, doc_id, doc_id+1, 'next', doc_id*10+34 FROM documents
 UNION ALL SELECT 'delete_edge', doc_id+1000000000, NULL, NULL, NULL, NULL, NULL, doc_id*10+56 FROM documents WHERE doc_id%7=0)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["fact_intervals"](spark, sf_dir)


def _held(spark: SparkSession, d: str) -> DataFrame:
    return temporal.intervals(views.facts(spark, d))


def _mid(facts: DataFrame) -> float:
    low, high = facts.agg(F.min("valid_from"), F.max("valid_from")).first()
    return ((low or 0.0) + (high or 0.0)) / 2


# ---------------------------------------------------------------- scans and filters


@query(f"WITH {NOTES} SELECT user_id, agent_id, count(*) AS n FROM notes GROUP BY ALL")
def scope_count(s, d):
    return views.notes(s, d).groupBy("user_id", "agent_id").agg(F.count("*").alias("n"))


@query(f"WITH {NOTES} SELECT id, content FROM notes WHERE user_id='src3' AND agent_id='en'")
def scope_scan(s, d):
    return scan.scope(views.notes(s, d), "src3", "en").select("id", "content")


@query(f"WITH {NOTES} SELECT n.id, n.user_id FROM notes n JOIN (SELECT item_id AS id, CASE WHEN item_id%2=0 THEN 'src1' END AS asker FROM benchmark) a ON n.id=a.id WHERE asker IS NULL OR user_id=asker")
def owned_lookup(s, d):
    asked = views.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "src1").alias("user_id"))
    return scan.owned(views.notes(s, d), asked).select("id", "user_id")


@query(f"WITH {NOTES} SELECT id FROM notes WHERE id NOT IN (SELECT unnest(parents) FROM notes)")
def parent_filter(s, d):
    return scan.without_parents(views.notes(s, d).withColumn("user_id", F.lit("all"))).select("id")


@query(f"WITH {NOTES} SELECT user_id, count(*) FILTER (trust < 2) AS held, count(*) FILTER (trust >= 2) AS shown, min(trust) AS least FROM notes GROUP BY user_id")
def quarantine_split(s, d):
    return views.notes(s, d).groupBy("user_id").agg(F.count_if(scan.quarantined()).alias("held"), F.count_if(~scan.quarantined()).alias("shown"), F.min("trust").alias("least"))


@query("SELECT source_name, CASE source_name WHEN 'system' THEN 4 WHEN 'user' THEN 3 WHEN 'agent' THEN 2 WHEN 'tool' THEN 1 ELSE 0 END AS tier, count(*) AS n FROM (SELECT ['system','user','agent','tool','web'][CAST(event_id%5+1 AS INT)] AS source_name FROM events) GROUP BY ALL")
def trust_tiers(s, d):
    rows = views.table(s, d, "events").select(F.element_at(F.array(*[F.lit(x) for x in scan.TIERS]), (F.col("event_id") % 5 + 1).cast("int")).alias("source_name"))
    return rows.withColumn("tier", scan.tier_of(F.col("source_name"))).groupBy("source_name", "tier").agg(F.count("*").alias("n"))


@query(f"""WITH {MEM}, r AS (SELECT id, content, embedding, CASE WHEN id%11=0 THEN '' ELSE CAST(id AS VARCHAR) END AS sid, CASE WHEN id%13=0 THEN '  ' ELSE content END AS c, CASE WHEN id%17=0 THEN embedding[1:63] ELSE embedding END AS e, access_count-(CASE WHEN id%19=0 THEN 9 ELSE 0 END) AS a, len(parents)=0 AS p FROM memories)
SELECT id, concat_ws(',', CASE WHEN sid='' THEN 'id' END, CASE WHEN trim(c)='' THEN 'content_present' END, CASE WHEN len(e)<>64 THEN 'vector_size' END, CASE WHEN a<0 THEN 'access_count' END, CASE WHEN NOT p THEN 'parents_kind' END) AS broken
FROM r WHERE sid='' OR trim(c)='' OR len(e)<>64 OR a<0 OR NOT p""")
def record_validation(s, d):
    i = F.col("key")
    rows = views.memories(s, d).withColumn("key", F.col("id")).withColumns({
        "id": F.when(i % 11 == 0, "").otherwise(i.cast("string")), "content": F.when(i % 13 == 0, "  ").otherwise(F.col("content")), "embedding": F.when(i % 17 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")),
        "access_count": F.col("access_count") - F.when(i % 19 == 0, 9).otherwise(0), "operator": F.lit(None).cast("string"), "metadata": F.lit('{"a": 1}'),
    })
    return scan.split_valid(rows, scan.record_rules(64))[1].select(i.alias("id"), F.array_join("broken", ",").alias("broken"))


@query(f"WITH {EDGES} SELECT id, from_id, to_id, weight FROM edges WHERE from_id=from_id AND to_id IS NOT NULL AND weight BETWEEN 0 AND 1")
def edge_validation(s, d):
    return scan.split_valid(views.edges(s, d), scan.edge_rules())[0].select("id", "from_id", "to_id", "weight")


@query(f"WITH {EDGES} SELECT id, from_id, to_id, 'out' AS side FROM edges WHERE from_id=5 UNION ALL SELECT id, from_id, to_id, 'in' FROM edges WHERE to_id=5")
def edges_of_anchor(s, d):
    e = views.edges(s, d)
    return scan.edges_of(e, 5).select("id", "from_id", "to_id", F.when(F.col("from_id") == 5, "out").otherwise("in").alias("side"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def metadata_projection(s, d):
    return views.table(s, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# ---------------------------------------------------------------- retrieval


@query(f"WITH {MEM}, {QRY}, {SCORED.format(rows='memories')} SELECT * FROM (SELECT *, {RANK} FROM scored) WHERE rank<=10")
def dense_topk(s, d):
    return retrieval.dense_topk(views.memories(s, d), views.queries(s, d), 10)


@query(f"WITH {MEM}, {QRY}, {SCORED.format(rows='memories')} SELECT * FROM (SELECT *, {RANK} FROM scored) WHERE rank<=3")
def dense_topk_native(s, d):
    return retrieval.ranked(retrieval.dense_scores(views.memories(s, d), views.queries(s, d)), 3)


@query(f"""WITH {MEM}, {QRY}, sc AS (SELECT q.query_id, m.id, {COS.format(a='m.embedding', b='q.embedding')} AS score FROM memories m, queries q
 WHERE m.user_id='src' || CAST(q.query_id%20 AS VARCHAR) AND m.id NOT IN (q.query_id, q.query_id+1)) SELECT * FROM (SELECT *, {RANK} FROM sc) WHERE rank<=5""")
def scoped_topk(s, d):
    q = F.col("query_id")
    asked = views.queries(s, d).withColumn("user_id", F.concat(F.lit("src"), (q % 20).cast("string"))).withColumn("exclude", F.array(q, q + 1))
    return retrieval.dense_topk(views.memories(s, d), asked, 5)


@query(f"""WITH {MEM}, {QRY}, seen AS (SELECT * FROM memories m WHERE trust>=2 AND NOT EXISTS (SELECT 1 FROM (SELECT user_id, unnest(parents) AS p FROM memories) x WHERE x.p=m.id)),
{SCORED.format(rows='seen')} SELECT * FROM (SELECT *, {RANK} FROM scored) WHERE rank<=10""")
def recall_topk(s, d):
    return retrieval.search(views.memories(s, d), views.queries(s, d), 10)


@query(f"WITH {MEM}, {QRY}, held AS (SELECT * FROM memories WHERE trust<2), {SCORED.format(rows='held')} SELECT * FROM (SELECT *, {RANK} FROM scored) WHERE rank<=10")
def quarantined_search(s, d):
    return retrieval.search_quarantined(views.memories(s, d), views.queries(s, d), 10)


BM25 = f"""tok AS (SELECT id, unnest({TOKENS.format('content')}) AS term FROM {{rows}}), size AS (SELECT id, count(*) AS size FROM tok GROUP BY id), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(size) AS mean_size FROM size), df AS (SELECT term, count(*) AS df, ln((any_value(n)-count(*)+0.5)/(count(*)+0.5)) AS idf FROM tf, st GROUP BY term),
w AS (SELECT term, CASE WHEN idf<0 THEN 0.25*(SELECT avg(idf) FROM df) ELSE idf END AS idf FROM df),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, tf.id, round(sum(times*idf*tf*2.5/(tf+1.5*(0.25+0.75*size/mean_size))), 6) AS score FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN size ON size.id=tf.id, st GROUP BY query_id, tf.id)"""


def _items(s, d):
    return views.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {NOTES}, {BM25.format(rows='notes')} SELECT * FROM (SELECT *, {RANK} FROM bm) WHERE rank<=10")
def bm25_topk(s, d):
    return retrieval.bm25_topk(views.notes(s, d), _items(s, d), 10)


@query(f"WITH {NOTES}, tok AS (SELECT id, unnest({TOKENS.format('content')}) AS term FROM notes), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL) SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term")
def corpus_statistics(s, d):
    return retrieval.term_counts(retrieval.words_of(views.notes(s, d)))


FUSED = f"""dn AS (SELECT * FROM (SELECT *, {RANK} FROM scored) WHERE rank<=50),
fill AS (SELECT q.query_id, m.id, 0.0 AS score FROM queries q, (SELECT id FROM memories ORDER BY id LIMIT 100) m WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.query_id=q.query_id AND bm.id=m.id)),
sp AS (SELECT * FROM (SELECT *, {RANK} FROM (SELECT query_id, id, score FROM bm UNION ALL SELECT * FROM fill)) WHERE rank<=50)"""


@query(f"WITH {MEM}, {QRY}, {SCORED.format(rows='memories')}, {BM25.format(rows='memories')}, {FUSED}, f AS (SELECT query_id, id, round(sum(1.0/(60+rank)), 9) AS score FROM (SELECT query_id, id, rank FROM dn UNION ALL SELECT query_id, id, rank FROM sp) GROUP BY ALL) SELECT * FROM (SELECT *, {RANK} FROM f) WHERE rank<=10")
def hybrid_topk(s, d):
    return retrieval.hybrid_topk(views.memories(s, d), views.queries(s, d), 10)


@query(f"WITH {MEM}, {QRY}, {SCORED.format(rows='memories')}, {BM25.format(rows='memories')}, {FUSED}, f AS (SELECT query_id, id, round(sum(w/(60+rank)), 9) AS score FROM (SELECT query_id, id, rank, 2.0 AS w FROM dn UNION ALL SELECT query_id, id, rank, 1.0 FROM sp) GROUP BY ALL) SELECT * FROM (SELECT *, {RANK} FROM f) WHERE rank<=10")
def weighted_fusion(s, d):
    m, q = views.memories(s, d), views.queries(s, d)
    return retrieval.fuse([(retrieval.dense_topk(m, q, 50), 2.0), (retrieval.bm25_topk(m, q, 50, fill=True), 1.0)], 10)


@query(f"""WITH {MEM}, {QRY}, {SCORED.format(rows='memories')}, p AS (SELECT DISTINCT unnest(parents) AS id FROM memories), x AS (SELECT s.*, s.id=s.query_id AS ex, s.id IN (SELECT id FROM p) AS pa, m.trust<2 AS he FROM scored s JOIN memories m USING (id)),
y AS (SELECT *, NOT ex AND NOT pa AND NOT he AS open, row_number() OVER (PARTITION BY query_id, NOT ex AND NOT pa AND NOT he ORDER BY score DESC, id) AS place FROM x)
SELECT query_id, id, score, CASE WHEN open AND place<=10 THEN place END AS final_rank, CASE WHEN open AND place<=10 THEN 'included' WHEN ex THEN 'excluded by caller' WHEN pa THEN 'parent' WHEN he THEN 'quarantined' ELSE 'beyond limit' END AS reason FROM y""")
def explain_search(s, d):
    q = views.queries(s, d)
    return retrieval.explain(views.memories(s, d), q, 10, q.select("query_id", F.col("query_id").alias("id")))


@query(f"""WITH {MEM}, {QRY}, {SCORED.format(rows='memories')}, t AS (SELECT * FROM (SELECT *, {RANK} FROM scored) WHERE rank<=20), n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM t),
r AS (SELECT query_id, id, round(0.7*(1-(rank-1)/n)+0.3*id/(SELECT max(id) FROM memories), 6) AS score FROM n) SELECT * FROM (SELECT *, {RANK} FROM r) WHERE rank<=5""")
def recency_rerank(s, d):
    m = views.memories(s, d)
    order = m.select("id", "ord").crossJoin(F.broadcast(m.agg(F.max("ord").alias("last"))))  # one row
    return retrieval.recency_rerank(retrieval.dense_topk(m, views.queries(s, d), 20), order, 5)


@query(f"WITH {NOTES} SELECT id, round(1.0+0.15*least(len(list_distinct(regexp_extract_all(regexp_replace(content, '[^\\x00-\\x7F\\P{{L}}]', '0', 'g'), '\\b[A-Z][a-z]{{2,}}\\b'))),4)+0.1*least(len(regexp_extract_all(regexp_replace(content, '[^\\x00-\\x7F\\P{{L}}]', 'a', 'g'), '\\b[0-9]{{2,}}\\b')),3)+0.2*least(length(content)/200.0,1.0), 6) AS importance FROM notes")
def importance(s, d):
    return views.notes(s, d).select("id", F.round(T.importance(F.col("content")), 6).alias("importance"))


@query(f"""WITH {MEM}, {QRY}, {SCORED.format(rows='memories')}, {BM25.format(rows='memories')}, a AS (SELECT query_id, 0 AS pool, id, rank FROM (SELECT *, {RANK} FROM scored) WHERE rank<=10 UNION ALL SELECT query_id, 1, id, rank FROM (SELECT *, {RANK} FROM bm) WHERE rank<=10),
f AS (SELECT query_id, id, min((pool, rank)) AS place FROM a GROUP BY ALL) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM f""")
def pooled_candidates(s, d):
    m, q = views.memories(s, d), views.queries(s, d)
    pools = retrieval.dense_topk(m, q, 10).select("query_id", F.lit(0).alias("pool"), "id", "rank").unionByName(retrieval.bm25_topk(m, q, 10).select("query_id", F.lit(1).alias("pool"), "id", "rank"))
    return retrieval.pooled(pools)


@query()
def mmr_choice(s, d):
    m = views.memories(s, d)
    pool = retrieval.dense_topk(m, views.queries(s, d), 30).join(m.select("id", "embedding"), "id")
    return retrieval.mmr(pool.select("query_id", "id", "rank", "embedding"), 10)


@query(f"""WITH {MEM}, {QRY}, {SCORED.format(rows='memories')}, {MENTIONS}, base AS (SELECT * FROM (SELECT *, {RANK} FROM scored) WHERE rank<=12),
names AS (SELECT DISTINCT lower(entity) AS name FROM mentions WHERE length(entity)>=3), named AS (SELECT query_id, name FROM queries JOIN names ON contains(lower(text), name)),
sharing AS (SELECT DISTINCT lower(entity) AS name, memory_id AS id FROM mentions),
cand AS (SELECT query_id, id, count(*) AS n FROM named JOIN sharing USING (name) WHERE query_id IN (SELECT query_id FROM named GROUP BY query_id HAVING count(*)>=2) GROUP BY ALL),
sc AS (SELECT c.query_id, c.id, c.n, s.score AS cos FROM cand c JOIN scored s ON s.query_id=c.query_id AND s.id=c.id JOIN (SELECT query_id, min(score) AS low FROM base GROUP BY query_id) l ON l.query_id=c.query_id
 WHERE s.score>=low-0.05 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.query_id=c.query_id AND b.id=c.id)),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, cos DESC, id) AS place FROM sc) WHERE place<=2),
al AS (SELECT query_id, id, score, 'base' AS origin FROM base b WHERE rank<=12-(SELECT count(*) FROM tk WHERE tk.query_id=b.query_id) UNION ALL SELECT query_id, id, round(cos+0.02*n, 6), 'graph' FROM tk)
SELECT *, {RANK} FROM al""")
def graph_search(s, d):
    names = views.mentions(s, d)
    return retrieval.graph_search(views.memories(s, d), views.queries(s, d), names.select("entity", "memory_id"), 12)


@query(f"""WITH {MEM}, {QRY}, {SCORED.format(rows='memories')}, t AS (SELECT query_id, id, score FROM (SELECT *, {RANK} FROM scored) WHERE rank<=30), l AS (SELECT t.* FROM t WHERE id%4=2) SELECT * FROM (SELECT *, {RANK} FROM l) WHERE rank<=10""")
def level_search(s, d):
    return retrieval.levels(views.memories(s, d).withColumn("level", (F.col("id") % 4).cast("int")), views.queries(s, d), 10, 2)


TURNS = f"turns AS (SELECT conv_id AS scope, turn AS ord, role AS speaker, text, len({TOKENS.format('text')}) AS tokens FROM conversations)"


@query(f"WITH {TURNS}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY scope ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY scope ORDER BY ord) AS n FROM turns) SELECT scope, ord, tokens, used FROM u WHERE used<=120 OR n=1")
def budget_take(s, d):
    return retrieval.budget_take(views.turns(s, d).withColumn("tokens", T.n_tokens(F.col("text"))), 120, order="ord").select("scope", "ord", "tokens", "used")


@query(f"WITH {TURNS}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY scope ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS used FROM turns) SELECT scope, ord, used FROM u WHERE used<=120")
def last_take(s, d):
    return retrieval.last_take(views.turns(s, d).withColumn("tokens", T.n_tokens(F.col("text"))), 120, order="ord").select("scope", "ord", "used")


@query("SELECT conv_id AS scope, string_agg('- ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def turn_context(s, d):
    return retrieval.context(views.turns(s, d), order="ord")


@query("SELECT conv_id AS scope, turn AS ord, CASE WHEN turn%3=0 THEN role || ': ' || text ELSE '[day ' || CAST(turn AS VARCHAR) || '] ' || role || ': ' || text END AS line FROM conversations")
def conversation_history(s, d):
    day = F.when(F.col("ord") % 3 != 0, F.concat(F.lit("day "), F.col("ord").cast("string")))
    return views.turns(s, d).select("scope", "ord", T.turn_text(day, F.col("speaker"), F.col("text")).alias("line"))


# ---------------------------------------------------------------- retrieval metrics

HITS = f"{SCORED.format(rows='(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)')}, hits AS (SELECT r.query_id, rank, CAST(a.label=b.label AS INT) AS hit FROM (SELECT *, {RANK} FROM scored) r JOIN embeddings a ON a.vec_id=r.id JOIN embeddings b ON b.vec_id=r.query_id WHERE rank<=10)"


def _hits(s, d):
    e = views.table(s, d, "embeddings")
    found = retrieval.dense_topk(e.select(F.col("vec_id").alias("id"), "embedding"), views.queries(s, d), 10)
    a, b = e.select(F.col("vec_id").alias("id"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("lb"))
    return found.join(a, "id").join(b, "query_id").withColumn("hit", (F.col("la") == F.col("lb")).cast("int"))


@query(f"""WITH {QRY}, {HITS} SELECT query_id, {', '.join(f"round(coalesce(sum(hit) FILTER (rank<={k})/nullif(count(*) FILTER (rank<={k}),0),0),6) AS precision_{k}, coalesce(max(hit) FILTER (rank<={k}),0) AS hit_{k}" for k in (1, 3, 5, 10))}, round(coalesce(1.0/min(rank) FILTER (hit=1),0),6) AS mrr FROM hits GROUP BY query_id""")
def retrieval_metrics(s, d):
    return evals.retrieval_metrics(_hits(s, d))


@query(f"WITH {QRY}, {SCORED.format(rows='(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)')}, r AS (SELECT *, {RANK} FROM scored), n AS (SELECT query_id, id FROM r WHERE rank<=5), w AS (SELECT query_id, embedding FROM queries), m AS (SELECT n.query_id, max({COS.format(a='CAST(e.embedding AS DOUBLE[])', b='w.embedding')}) AS best FROM n JOIN embeddings e ON e.vec_id=n.id JOIN w ON w.query_id=n.query_id GROUP BY n.query_id) SELECT query_id, best, CAST(best>=0.7 AS INT) AS hit FROM m")
def semantic_hits(s, d):
    e, q = views.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), views.queries(s, d)
    return evals.semantic_hit(retrieval.dense_topk(e, q, 5).join(e, "id"), q, 5)


@query("""WITH r AS (SELECT doc_id AS question_id, [doc_id%5, (doc_id+1)%5] AS ev, [doc_id%3, doc_id%4, doc_id%7] AS got FROM documents), e AS (SELECT question_id, CASE WHEN question_id%6=0 THEN [] ELSE ev END AS ev, got FROM r)
SELECT question_id, CASE WHEN len(ev)=0 THEN 1.0 ELSE round(len(list_distinct(list_filter(ev, lambda x: list_contains(got, x))))/len(list_distinct(ev)),6) END AS hit_rate, CAST(len(list_filter(ev, lambda x: NOT list_contains(got, x)))=0 AS INT) AS "full" FROM e""")
def evidence_recall(s, d):
    i = F.col("doc_id")
    rows = views.table(s, d, "documents").select(i.alias("question_id"), F.when(i % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i % 5, (i + 1) % 5)).alias("evidence"), F.array(i % 3, i % 4, i % 7).alias("retrieved"))
    return evals.evidence_recall(rows)


@query("""WITH s AS (SELECT doc_id//4 AS pair_id, doc_id AS seed, [doc_id%7, doc_id%5+2, doc_id%3+4] AS ids FROM documents), j AS (SELECT a.pair_id, avg(len(list_distinct(list_filter(a.ids, lambda x: list_contains(b.ids, x))))/len(list_distinct(list_concat(a.ids, b.ids)))) AS m FROM s a JOIN s b ON a.pair_id=b.pair_id AND a.seed<b.seed GROUP BY a.pair_id)
SELECT p.pair_id, round(coalesce(m, 1.0), 6) AS jaccard FROM (SELECT DISTINCT pair_id FROM s) p LEFT JOIN j ON p.pair_id=j.pair_id""")
def jaccard_diversity(s, d):
    i = F.col("doc_id")
    return evals.diversity(views.table(s, d, "documents").select(F.floor(i / 4).alias("pair_id"), i.alias("seed"), F.array(i % 7, i % 5 + 2, i % 3 + 4).alias("ids")))


@query(f"WITH {JUDGED} SELECT count(*) AS n, count(*) FILTER (a_correct=1 AND b_correct=0) AS b, count(*) FILTER (a_correct=0 AND b_correct=1) AS c, round(pow(abs(b-c)-1,2)/(b+c),6) AS chi2 FROM judged")
def mcnemar(s, d):
    return evals.mcnemar(views.judged(s, d))


LONG = f"{JUDGED}, results AS (SELECT 'a' AS config, question_id, category, a_correct AS score FROM judged UNION ALL SELECT 'b', question_id, category, b_correct FROM judged)"


def _results(s, d):
    j = views.judged(s, d)
    return j.select(F.lit("a").alias("config"), "question_id", "category", F.col("a_correct").alias("score")).unionByName(j.select(F.lit("b").alias("config"), "question_id", "category", F.col("b_correct").alias("score")))


@query(f"WITH {LONG} SELECT config, category, round(avg(score),6) AS mean_score, count(*) AS n FROM results GROUP BY GROUPING SETS ((config), (config, category))")
def eval_rollup(s, d):
    return evals.rollup(_results(s, d))


@query(f"WITH {LONG}, m AS (SELECT config, category, avg(score) AS m FROM results GROUP BY ALL) SELECT config, round(avg(m),6) AS macro FROM m GROUP BY config")
def eval_macro(s, d):
    return evals.macro(_results(s, d))


@query(f"WITH {LONG} SELECT config, round(avg(score) FILTER (category='en' OR category='fr'),6) AS headline, round(avg(score) FILTER (category='de'),6) AS adversarial, count(*) AS n FROM results GROUP BY config")
def eval_headline(s, d):
    renamed = F.when(F.col("category") == "en", "multi-hop").when(F.col("category") == "fr", "temporal").when(F.col("category") == "de", "adversarial").otherwise("other")
    return evals.headline(_results(s, d).withColumn("category", renamed))


@query(f"WITH {LONG} SELECT a.config AS system_a, b.config AS system_b, count(*) AS n, sum(a.score) AS a_correct, sum(b.score) AS b_correct FROM results a JOIN results b ON a.question_id=b.question_id AND a.config<b.config GROUP BY ALL")
def paired_systems(s, d):
    rows = _results(s, d).select(F.col("config").alias("system"), "question_id", F.col("score").alias("correct"))
    return evals.paired(rows).groupBy("system_a", "system_b").agg(F.count("*").alias("n"), F.sum("a_correct").alias("a_correct"), F.sum("b_correct").alias("b_correct"))


def bootstrap_sql(tables: str, rows: str, by: str, resamples: int, seed: int = 42) -> str:
    """rows: g (the group), key, value. Every row's draws of every resample, from its key's hash."""
    part = lambda k: f"('0x' || substr(sha256('{seed}:' || key), {1 + 7 * k}, 7))::BIGINT"
    times = "+".join(f"(u>={c})::BIGINT" for c in evals.DRAW_CUTS)
    return f"""WITH {tables}, bv AS ({rows}), bh AS (SELECT g, CAST(round(value*1000000.0) AS BIGINT) AS v, {part(0)} AS a, {part(1)} AS b, {part(2)} AS c FROM bv),
bu AS (SELECT g, r, v, (a+b*r+c*r*r)%{evals.DRAW_PRIME} AS u FROM bh, (SELECT unnest(range({resamples})) AS r)), bw AS (SELECT g, r, v, {times} AS w FROM bu),
bs AS (SELECT g, r, CAST(sum(v*w) AS DOUBLE)/nullif(CAST(sum(w) AS DOUBLE), 0) AS m, sum(v) AS plain, count(*) AS n FROM bw GROUP BY g, r)
SELECT g AS {by}, round(CAST(any_value(plain) AS DOUBLE)/any_value(n)/1000000.0, 6) AS mean, round(quantile_cont(m, 0.025)/1000000.0, 6) AS low, round(quantile_cont(m, 0.975)/1000000.0, 6) AS high, any_value(n) AS n FROM bs GROUP BY g"""


def bounds(ci, by):
    return ci.select(by, *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "n")


@query(bootstrap_sql(LONG, "SELECT config AS g, CAST(question_id AS VARCHAR) AS key, score AS value FROM results", "config", 1000))
def bootstrap_interval(s, d):
    return bounds(evals.poisson_bootstrap(_results(s, d).select("config", "question_id", F.col("score").alias("value"))), "config")


@query(f"WITH {JUDGED} SELECT question_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY question_id) AS n FROM judged) WHERE n<=10")
def stratified_head(s, d):
    return evals.stratified_head(views.judged(s, d), 40, 4).select("question_id", "category")


@query("""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), k AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g')), '\\s+'), lambda x: x NOT IN ('','a','an','the')) AS p, list_filter(string_split_regex(lower(regexp_replace(nxt, '[!-/:-@\\[-`{-~]', '', 'g')), '\\s+'), lambda x: x NOT IN ('','a','an','the')) AS g FROM t WHERE nxt IS NOT NULL),
pc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS w FROM k) GROUP BY ALL), gc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(g) AS w FROM k) GROUP BY ALL), o AS (SELECT conv_id, turn, sum(least(pc.c, gc.c)) AS o FROM pc JOIN gc USING (conv_id, turn, w) GROUP BY ALL)
SELECT k.conv_id, k.turn, round(CASE WHEN len(p)+len(g)=0 THEN 1.0 WHEN len(p)=0 OR len(g)=0 THEN 0.0 ELSE 2.0*coalesce(o,0)/(len(p)+len(g)) END, 6) AS f1 FROM k LEFT JOIN o USING (conv_id, turn)""")
def token_f1(s, d):
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = views.table(s, d, "conversations").withColumn("nxt", nxt).where("nxt is not null")
    return rows.select("conv_id", "turn", F.round(T.token_f1(F.col("text"), F.col("nxt")), 6).alias("f1"))


@query("SELECT event_type AS name, count(*) AS count, round(sum(value),4) AS sum, round(avg(value),6) AS mean, round(avg(value) FILTER (n<=1024),6) AS recent_mean, round(max(value) FILTER (n<=1024),6) AS recent_max FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) GROUP BY event_type")
def histogram(s, d):
    return evals.histogram(views.table(s, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "value"))


@query("SELECT event_type AS fingerprint, count(*) AS n, max_by(CAST(event_id AS VARCHAR), event_id) AS last_message FROM events GROUP BY event_type")
def error_groups(s, d):
    e = F.col("event_id")
    return evals.error_groups(views.table(s, d, "events").select(F.col("event_type").alias("fingerprint"), e.alias("ts"), e.cast("string").alias("message")))


@query(f"SELECT conv_id AS scope, round((sum(length(text))*0.25 + count(*)*12.5)/1e6, 9) AS cost, round(count(*)*12*0.00001, 2) AS yearly FROM conversations GROUP BY conv_id")
def cost_projection(s, d):
    rows = views.turns(s, d).groupBy("scope").agg(F.sum(F.length("text")).alias("tokens_in"), F.count("*").alias("tokens_out"))
    return rows.select("scope", evals.cost(rows, 0.25, 12.5).alias("cost"), evals.yearly_cost(F.col("tokens_out"), 0.00001).alias("yearly"))


# ---------------------------------------------------------------- facts in time


@query(f"WITH {HELD} SELECT id, entity_id, fact_type, believed_by, round(valid_from,3) AS valid_from, round(valid_until,3) AS valid_until FROM held")
def fact_intervals(s, d):
    return _held(s, d).select("id", "entity_id", "fact_type", "believed_by", F.round("valid_from", 3).alias("valid_from"), F.round("valid_until", 3).alias("valid_until"))


@query(f"WITH {FACTS} SELECT id, round(lead(valid_from) OVER (PARTITION BY entity_id, fact_type, believed_by ORDER BY valid_from, seq, id),3) AS valid_until FROM facts")
def normalized_intervals(s, d):
    return temporal.normalized_intervals(views.facts(s, d)).select("id", F.round("valid_until", 3).alias("valid_until"))


def _guarded_sql(closes: str) -> str:
    """Facts that were open at once, told by pairs: one caps a later arrival unless an arrival of higher trust closed it in between."""
    same = "{0}.entity_id={1}.entity_id AND {0}.fact_type={1}.fact_type AND coalesce({0}.believed_by,'')=coalesce({1}.believed_by,'')"
    return f"""WITH {FACTS}, f AS (SELECT *, id%4 AS trust, {closes} AS closes, row_number() OVER (PARTITION BY entity_id, fact_type, believed_by ORDER BY seq, id) AS pos FROM facts),
pairs AS (SELECT n.id AS nid, p.id AS pid, p.pos AS pp, n.pos AS np, p.valid_from AS ps, n.trust AS nt, n.entity_id, n.fact_type, n.believed_by FROM f n JOIN f p ON {same.format('n', 'p')} AND p.pos<n.pos AND p.trust<=n.trust AND p.valid_from>n.valid_from WHERE n.closes),
gone AS (SELECT DISTINCT nid, pid FROM pairs x JOIN f q ON {same.format('x', 'q')} AND q.pos>pp AND q.pos<np AND q.closes AND q.trust>nt AND q.valid_from>=ps),
born AS (SELECT *, id NOT IN (SELECT nid FROM pairs ANTI JOIN gone USING (nid, pid)) AS opens FROM f),
ends AS (SELECT p.id, min_by(q.valid_from, q.pos) AS until, min(q.pos) AS upos FROM born p JOIN f q ON {same.format('p', 'q')} AND q.pos>p.pos AND q.closes AND q.trust>=p.trust AND q.valid_from>=p.valid_from WHERE p.opens GROUP BY p.id),
caps AS (SELECT n.id, min(p.valid_from) AS until FROM born n JOIN born p ON {same.format('n', 'p')} AND p.opens AND p.pos<n.pos AND p.trust<=n.trust AND p.valid_from>n.valid_from LEFT JOIN ends e ON e.id=p.id WHERE NOT n.opens AND (e.upos IS NULL OR e.upos>=n.pos) GROUP BY n.id)
SELECT f.id, entity_id, round(coalesce(ends.until, caps.until), 3) AS valid_until FROM f LEFT JOIN ends USING (id) LEFT JOIN caps USING (id)"""


def _guarded(s, d, **own):
    rows = views.facts(s, d).withColumn("trust", (F.col("id") % 4).cast("int")).withColumns(own)
    return temporal.guarded_intervals(rows).select("id", "entity_id", F.round("valid_until", 3).alias("valid_until"))


@query(_guarded_sql("true"))
def guarded_intervals(s, d):
    return _guarded(s, d)


@query(_guarded_sql("id%5<>0"))
def coexisting_facts(s, d):
    """Each fifth fact is recorded beside what is open: it closes nothing, and is born open."""
    return _guarded(s, d, invalidate_previous=F.col("id") % 5 != 0)


@query(_guarded_sql("id%5<>0"))
def coexisting_facts_by_parts(s, d):
    """The same with every slot of over twenty arrivals cut into parts."""
    rows = views.facts(s, d).withColumn("trust", (F.col("id") % 4).cast("int")).withColumn("invalidate_previous", F.col("id") % 5 != 0)
    return temporal.guarded_intervals(rows, 20, 8).select("id", "entity_id", F.round("valid_until", 3).alias("valid_until"))


@query(f"""WITH {FACTS}, {NOTES}, f AS (SELECT *, id%23 AS owner, CASE WHEN id%11=0 THEN 'nan'::DOUBLE ELSE 1.0 END AS confidence, CASE WHEN id%7=0 THEN 'en' END AS caller FROM facts)
SELECT f.id, CASE WHEN isnan(f.confidence) THEN 'not finite' WHEN e.id IS NULL THEN 'no such entity' WHEN e.id%9=4 THEN 'not an entity' WHEN f.caller IS NOT NULL AND f.caller<>e.agent_id THEN 'not the caller''s'
 WHEN s.id IS NOT NULL AND (s.user_id<>e.user_id OR s.agent_id<>e.agent_id) THEN 'source of another scope' END AS refused
FROM f LEFT JOIN (SELECT * FROM notes WHERE id%13<>5) e ON e.id=f.owner LEFT JOIN notes s ON s.id=f.source_memory_id""")
def refused_facts(s, d):
    """Which facts may not be recorded, and why: unknown or other records as entities, other scopes, numbers that aren't finite."""
    notes = views.notes(s, d)
    entities = notes.where("id % 13 <> 5").withColumn("operator", F.when(F.col("id") % 9 == 4, "note").otherwise("entity"))
    f = views.facts(s, d).withColumn("entity_id", F.col("id") % 23).withColumn("confidence", F.when(F.col("id") % 11 == 0, float("nan")).otherwise(1.0)).withColumn("caller_agent", F.when(F.col("id") % 7 == 0, "en"))
    return temporal.recorded(f, entities, notes).select("id", "refused")


@query(f"WITH {HELD}, q AS (SELECT DISTINCT entity_id AS question_id, entity_id, {MID} + entity_id*3600.0 AS asked FROM facts) SELECT question_id, id, fact_type, value FROM q JOIN held USING (entity_id) WHERE valid_from<=asked AND (valid_until IS NULL OR valid_until>asked)")
def facts_as_of(s, d):
    f = views.facts(s, d)
    mid = _mid(f)
    asked = f.select("entity_id").distinct().select(F.col("entity_id").alias("question_id"), "entity_id", (F.lit(mid) + F.col("entity_id") * 3600.0).alias("at"))
    return temporal.as_of(temporal.intervals(f), asked).select("question_id", "id", "fact_type", "value")


@query(f"WITH {HELD}, q AS (SELECT event_id AS question_id, user_id AS entity_id, epoch(ts)+1800.0 AS asked FROM events) SELECT question_id, count(*) AS n, sum(id) AS ids FROM q JOIN held USING (entity_id) WHERE valid_from<=asked AND (valid_until IS NULL OR valid_until>asked) GROUP BY question_id")
def facts_as_of_by_bins(s, d):
    """A question for each event, half an hour after it; every entity's facts and questions meet by the nodes of time bins."""
    f = views.facts(s, d)
    asked = f.select(F.col("id").alias("question_id"), "entity_id", (F.col("valid_from") + 1800.0).alias("at"))
    return temporal.as_of(temporal.intervals(f), asked, pairs=0).groupBy("question_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"WITH {HELD} SELECT id, entity_id, value FROM held WHERE valid_from<={MID} AND (valid_until IS NULL OR valid_until>{MID})")
def current_facts(s, d):
    f = views.facts(s, d)
    return temporal.current(temporal.intervals(f), _mid(f)).select("id", "entity_id", "value")


@query(f"WITH {HELD} SELECT id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, seq, id) AS place FROM held")
def entity_timeline(s, d):
    return temporal.timeline(_held(s, d)).select("id", "entity_id", "place")


@query(f"WITH {HELD} SELECT id, 'one' AS who FROM held WHERE believed_by='1' UNION ALL SELECT id, 'nobody' FROM held WHERE believed_by IS NULL")
def believer_view(s, d):
    h = _held(s, d)
    return temporal.believed_by(h, "1").select("id", F.lit("one").alias("who")).unionByName(temporal.believed_by(h, None).select("id", F.lit("nobody").alias("who")))


@query(f"WITH {HELD} SELECT entity_id, fact_type, count(DISTINCT value) AS n_values, string_agg(coalesce(believed_by,'') || '/' || CAST(id AS VARCHAR) || '/' || value, ',' ORDER BY coalesce(believed_by,''), id) AS positions FROM held WHERE valid_from<={MID} AND (valid_until IS NULL OR valid_until>{MID}) GROUP BY ALL HAVING count(DISTINCT value)>1")
def belief_conflicts(s, d):
    f = views.facts(s, d)
    shown = F.array_join(F.transform("positions", lambda p: F.concat_ws("/", p["believer"], p["id"].cast("string"), p["value"])), ",")
    return temporal.conflicts(temporal.intervals(f), _mid(f)).select("entity_id", "fact_type", "n_values", shown.alias("positions"))


@query(f"WITH {HELD}, m AS (SELECT *, CASE WHEN entity_id%5=0 THEN entity_id END AS merged_from, CASE WHEN entity_id%5=0 THEN entity_id+1 ELSE entity_id END AS e2 FROM held) SELECT e2 AS entity_id, count(*) AS n, count(merged_from) AS moved, count(*) FILTER (valid_until IS NULL) AS n_open FROM m GROUP BY e2")
def merge_entities(s, d):
    h = _held(s, d)
    merges = h.select(F.col("entity_id").alias("from_id")).distinct().where("from_id % 5 = 0").withColumn("to_id", F.col("from_id") + 1)
    return temporal.merge_entities(h, merges).groupBy("entity_id").agg(F.count("*").alias("n"), F.count("merged_from").alias("moved"), F.count_if(F.col("valid_until").isNull()).alias("n_open"))


@query(f"WITH {HELD} SELECT id, round(CASE WHEN id%7=0 THEN valid_from+200.0 ELSE valid_until END,3) AS valid_until FROM held")
def invalidate_facts(s, d):
    h = _held(s, d)
    c = h.where("id % 7 = 0").select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), (F.col("valid_from") + 100.0).alias("at")), F.struct(F.lit(2).alias("seq"), (F.col("valid_from") + 200.0).alias("at")))).alias("x")).select("id", "x.*")
    return temporal.invalidate(h, c).select("id", F.round("valid_until", 3).alias("valid_until"))


@query(f"WITH {HELD}, {NOTES} SELECT h.id, h.entity_id, n.content AS source_text, coalesce(n.trust,3) AS source_trust FROM held h LEFT JOIN notes n ON n.id=h.source_memory_id")
def explain_belief(s, d):
    return temporal.audit(_held(s, d), views.notes(s, d)).select("id", "entity_id", "source_text", "source_trust")


@query(f"""WITH {HELD}, q AS (SELECT DISTINCT entity_id AS question_id, entity_id, ['click','view','purchase','none'][CAST(entity_id%4+1 AS INT)] AS attribute, ['current','as_of','history'][CAST(entity_id%3+1 AS INT)] AS mode, {MID} AS asked FROM facts), m AS (SELECT {MID}+864000.0 AS now),
j AS (SELECT q.question_id, q.mode, q.asked, q.attribute, held.* FROM q JOIN held USING (entity_id), m WHERE mode='history' OR (valid_from<=(CASE WHEN mode='as_of' THEN asked ELSE now END) AND (valid_until IS NULL OR valid_until>(CASE WHEN mode='as_of' THEN asked ELSE now END)))),
t AS (SELECT *, count(*) FILTER (fact_type=attribute) OVER (PARTITION BY question_id) AS ty FROM j)
SELECT question_id, any_value(CASE mode WHEN 'as_of' THEN 'valid as of ' || strftime(make_timestamp(CAST(asked*1000000 AS BIGINT)), '%b %Y') WHEN 'history' THEN 'full history' ELSE 'current' END) || ':' || chr(10) ||
 string_agg('- ' || fact_type || ': ' || value || ' [' || strftime(make_timestamp(CAST(valid_from*1000000 AS BIGINT)), '%b %Y') || ' - ' || coalesce(strftime(make_timestamp(CAST(valid_until*1000000 AS BIGINT)), '%b %Y'), 'present') || ']', chr(10) ORDER BY valid_from DESC, seq, id) AS context
FROM t WHERE ty=0 OR fact_type=attribute GROUP BY question_id""")
def belief_context(s, d):
    f = views.facts(s, d)
    mid, e = _mid(f), F.col("entity_id")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (e % n + 1).cast("int"))
    asked = f.select("entity_id").distinct().select(e.alias("question_id"), e.alias("subject"), pick(("click", "view", "purchase", "none"), 4).alias("attribute"), pick(("current", "as_of", "history"), 3).alias("mode"), F.lit(mid).alias("at"))
    return temporal.answer_context(temporal.intervals(f), asked, mid + 864000.0)


# ---------------------------------------------------------------- graph


@query(f"WITH {MENTIONS} SELECT entity, count(DISTINCT memory_id) AS n FROM mentions GROUP BY entity")
def regex_entities(s, d):
    return views.mentions(s, d).groupBy("entity").agg(F.count_distinct("memory_id").alias("n"))


@query(f"WITH {MENTIONS} SELECT memory_id, count(DISTINCT entity) AS n_shared FROM mentions WHERE entity IN (SELECT entity FROM mentions GROUP BY entity HAVING count(DISTINCT memory_id)>1) GROUP BY memory_id")
def co_mentions(s, d):
    return graph.co_mentions(views.mentions(s, d))


@query(f"WITH {EDGES}, p AS (SELECT from_id AS anchor, to_id AS neighbour FROM edges UNION SELECT to_id, from_id FROM edges) SELECT * FROM p WHERE anchor IN (SELECT doc_id FROM documents) AND neighbour IN (SELECT doc_id FROM documents)")
def related_both(s, d):
    return graph.related(views.edges(s, d), views.notes(s, d)).select("anchor", "neighbour")


@query(f"WITH {EDGES}, {NOTES} SELECT e.id, CASE WHEN b.id IS NULL THEN 'missing to' WHEN a.user_id<>b.user_id OR a.agent_id<>b.agent_id THEN 'two scopes' END AS refused FROM edges e LEFT JOIN notes a ON a.id=e.from_id LEFT JOIN notes b ON b.id=e.to_id")
def check_links(s, d):
    return graph.check_links(views.edges(s, d), views.notes(s, d)).select("id", "refused")


@query("WITH RECURSIVE p AS (SELECT doc_id AS id, unnest([doc_id-1, doc_id-2]) AS a FROM documents WHERE doc_id%10=9), r AS (SELECT id, a, 1 AS depth FROM p UNION ALL SELECT r.id, p.a, r.depth+1 FROM r JOIN p ON p.id=r.a WHERE r.depth<3) SELECT id, a AS ancestor, min(depth) AS depth FROM r GROUP BY id, a")
def provenance(s, d):
    return graph.ancestors(views.notes(s, d), 3)


@query(f"WITH {MENTIONS} SELECT user_id AS scope, count(DISTINCT (memory_id, lower(entity))) AS edges, count(DISTINCT lower(entity)) AS entities FROM mentions GROUP BY user_id")
def persist_entities(s, d):
    m = views.mentions(s, d).select("memory_id", F.col("user_id").alias("scope"), F.lit("OTHER").alias("type"), F.col("entity").alias("name"))
    known = m.limit(0).select("scope", "type", "name", F.lit("x").alias("entity_id"))
    nodes, edges = graph.persist_entities(m, known)
    return edges.join(nodes.select(F.col("entity_id").alias("to_id"), "scope"), "to_id").groupBy("scope").agg(F.count("*").alias("edges"), F.count_distinct("to_id").alias("entities"))


# ---------------------------------------------------------------- vectors and lifecycle

PAIRS_SQL = "v AS (SELECT a.vec_id AS id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1)"
SHOW = "array_to_string(list_transform(list_zip({z}), lambda z: printf('%.6f', round({e},6)+0.0)), ',')"


def _pairs(s, d):
    e = views.table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b")), "id")


def _vector_query(name: str, column, sql: str | None) -> None:
    def f(s, d):
        return _pairs(s, d).select("id", V.rounded(column(F.col("a"), F.col("b"))).alias("v"))

    f.__name__ = name
    query(f"WITH {PAIRS_SQL} SELECT id, {sql} AS v FROM v" if sql else None)(f)


_vector_query("vec_average", V.average, SHOW.format(z="a, b", e="(z[1]+z[2])/2"))
_vector_query("vec_weighted", lambda a, b: V.weighted(a, b, 0.3), SHOW.format(z="a, b", e="0.3*z[1]+0.7*z[2]"))
_vector_query("vec_frequency", V.frequency, SHOW.format(z="a, b", e="CASE WHEN abs(z[1])>=abs(z[2]) THEN z[1] ELSE z[2] END"))
_vector_query("vec_attention", V.attention, SHOW.format(z="a, b", e="(exp(abs(z[1])-greatest(abs(z[1]),abs(z[2])))*z[1]+exp(abs(z[2])-greatest(abs(z[1]),abs(z[2])))*z[2])/(exp(abs(z[1])-greatest(abs(z[1]),abs(z[2])))+exp(abs(z[2])-greatest(abs(z[1]),abs(z[2]))))"))
_vector_query("vec_single_point", lambda a, b: V.single_point(a, b, 20), "array_to_string(list_transform(list_concat(a[1:20], b[21:64]), lambda z: printf('%.6f', round(z,6)+0.0)), ',')")
_vector_query("vec_multi_point", lambda a, b: V.multi_point(a, b, [10, 40]), "array_to_string(list_transform(list_concat(a[1:10], b[11:40], a[41:64]), lambda z: printf('%.6f', round(z,6)+0.0)), ',')")
MASK = "[" + ", ".join(str(m).lower() for m in V.uniform_mask(64)) + "]"
_vector_query("vec_uniform", lambda a, b: V.uniform(a, b, V.uniform_mask(64)), SHOW.format(z=f"a, b, {MASK}", e="CASE WHEN z[3] THEN z[1] ELSE z[2] END"))


@query("SELECT label, array_to_string(list_transform(list(m ORDER BY pos), lambda z: printf('%.6f', round(z,6)+0.0)), ',') AS centroid FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding,1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label")
def centroid(s, d):
    return lifecycle.centroid(views.table(s, d, "embeddings"), "label").select("label", V.rounded(F.col("centroid")).alias("centroid"))


CENTROIDS = "cen AS (SELECT user_id, list(m ORDER BY pos) AS c FROM (SELECT user_id, pos, avg(x) AS m FROM (SELECT user_id, unnest(embedding) AS x, generate_subscripts(embedding,1) AS pos FROM memories) GROUP BY user_id, pos) GROUP BY user_id)"
FIT = f"{MEM}, {CENTROIDS}, fit AS (SELECT m.*, round(ln(access_count+1.0)*exp(-greatest(0,(86400.0*600-created_at)/86400.0)/30.0) + 0.1*greatest(0, list_dot_product(embedding, c)/(sqrt(list_dot_product(embedding, embedding))*sqrt(list_dot_product(c, c)))), 6) AS fitness FROM memories m JOIN cen USING (user_id))"


def _fit(s, d):
    return lifecycle.fitness(views.memories(s, d), 86400.0 * 600)


@query(f"WITH {FIT} SELECT id, fitness FROM fit")
def fitness(s, d):
    return _fit(s, d).select("id", "fitness")


CONS = f"""{FIT}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fitness DESC, id)<=10 AS keep FROM fit), w AS (SELECT *, row_number() OVER (PARTITION BY user_id, keep ORDER BY fitness, id) AS worst, count(*) OVER (PARTITION BY user_id, keep) AS n FROM k),
cons AS (SELECT *, CASE WHEN NOT keep AND worst<=(n//2)*2 THEN (worst-1)//2 END AS pair FROM w)"""


@query(f"WITH {CONS} SELECT id, keep, pair FROM cons")
def consolidate(s, d):
    return lifecycle.consolidate(_fit(s, d), 10).select("id", "keep", "pair")


@query(f"WITH {CONS} SELECT user_id, pair, string_agg(CAST(id AS VARCHAR), ',' ORDER BY fitness, id) AS parents, min(trust) AS trust FROM cons WHERE pair IS NOT NULL GROUP BY ALL")
def consolidation_hybrids(s, d):
    return lifecycle.hybrids(lifecycle.consolidate(_fit(s, d), 10)).select("user_id", "pair", F.array_join(F.transform("parents", lambda x: x.cast("string")), ",").alias("parents"), "trust")


@query(f"WITH {CONS} SELECT user_id, count(*) AS before, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS pruned, count(DISTINCT pair) AS pairs FROM cons GROUP BY user_id")
def consolidation_summary(s, d):
    return lifecycle.consolidation_summary(lifecycle.consolidate(_fit(s, d), 10))


@query(f"WITH {NOTES}, a AS (SELECT id//3 AS hybrid_id, id AS parent_id FROM notes) SELECT hybrid_id, count(*) AS n_parents, count(DISTINCT user_id) AS n_owners, min(trust) AS trust, min_by(parent_id, (trust, parent_id)) AS least_trusted FROM a JOIN notes n ON n.id=a.parent_id GROUP BY hybrid_id")
def synthesize_trust(s, d):
    n = views.notes(s, d)
    return lifecycle.synthesis_inputs(n, n.select(F.floor(F.col("id") / 3).alias("hybrid_id"), F.col("id").alias("parent_id")))


@query(f"WITH {NOTES} SELECT user_id, count(*) AS \"count\" FROM notes GROUP BY user_id HAVING count(*)>48")
def consolidation_due(s, d):
    return lifecycle.due(views.notes(s, d), 48)


@query()
def summary_tree(s, d):
    nodes, edges = trees.summary_tree(views.memories(s, d), 20)
    return nodes.join(edges.groupBy("node_id").agg(F.count("*").alias("members"), F.round(F.sum("weight"), 6).alias("weight")), "node_id").select("node_id", "level", "size", "members", "weight")


# ---------------------------------------------------------------- reports and event time


@query("WITH d AS (SELECT n_chars AS size, doc_id%7 AS delta FROM documents), p AS (SELECT *, percent_rank() OVER (ORDER BY size, delta) AS h FROM d) SELECT round(corr(size, delta),6) AS pearson, round(avg(delta) FILTER (h<0.5),6) AS small_half, round(avg(delta) FILTER (h>=0.5),6) AS large_half FROM p")
def scaling(s, d):
    return evals.scaling(views.table(s, d, "documents").select(F.col("n_chars").alias("size"), (F.col("doc_id") % 7).alias("delta")))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL")
def event_windows(s, d):
    from ..streaming.facts import windowed_counts

    return windowed_counts(views.table(s, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(s, d):
    from ..streaming.facts import sessions

    return sessions(views.table(s, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT doc_id, CASE WHEN n='CORRECT' THEN 1.0 WHEN n='PARTIAL' THEN 0.5 ELSE 0.0 END AS score FROM (SELECT doc_id, ['CORRECT','PARTIAL','INCORRECT'][CAST(doc_id%3+1 AS INT)] AS n FROM documents)")
def judge_scores(s, d):
    said = F.element_at(F.array(F.lit("CORRECT\nsure"), F.lit("so: partial"), F.lit("no idea")), (F.col("doc_id") % 3 + 1).cast("int"))
    return views.table(s, d, "documents").select("doc_id", T.judge_score(T.judge_label_lines(said)).alias("score"))


@query("SELECT doc_id, 'UPDATE' AS kind, 'mem_' || CAST(doc_id AS VARCHAR) AS target_id FROM documents WHERE doc_id%3=0 UNION ALL SELECT doc_id, 'ADD', NULL FROM documents WHERE doc_id%3<>0")
def parse_decisions(s, d):
    i = F.col("doc_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("Thinking.\nDECISION: UPDATE id=mem_"), i.cast("string"))).when(i % 3 == 1, "DECISION: maybe").otherwise("DECISION: ADD")
    return views.table(s, d, "documents").select("doc_id", T.parse_decision(said).alias("p")).select("doc_id", "p.kind", "p.target_id")


@query("SELECT doc_id, 'likes ' || source AS fact, n FROM (SELECT doc_id, source, unnest([0, 1]) AS n FROM documents) WHERE n=0 UNION ALL SELECT doc_id, 'speaks ' || lang, 1 FROM documents")
def parse_fact_lists(s, d):
    said = F.concat(F.lit("- likes "), "source", F.lit("\n* LIKES "), F.upper("source"), F.lit("\nnoise\n2. speaks "), "lang")
    return views.table(s, d, "documents").select("doc_id", F.posexplode(T.parse_facts(said)).alias("n", "fact"))


@query("SELECT doc_id, 'user' AS subject, 'home_town' AS attribute, source AS value, 'FIRM' AS certainty FROM documents")
def parse_statements(s, d):
    said = F.concat(F.lit("FACT | user | Home Town | "), "source", F.lit(" | 2024 | firm\nFACT | too | short"))
    return views.table(s, d, "documents").select("doc_id", F.explode(T.parse_statements(said)).alias("x")).select("doc_id", "x.subject", "x.attribute", "x.value", "x.certainty")


# ---------------------------------------------------------------- op log and changes

REPLAY = """x AS (SELECT *, max(seq) FILTER (op='add') OVER (PARTITION BY id) AS added, max(seq) FILTER (op='delete') OVER (PARTITION BY id) AS gone FROM journal WHERE op IN ('add','update','delete') {cut})
SELECT id, max_by(content, seq) FILTER (content IS NOT NULL) AS content, max_by(user_id, seq) FILTER (user_id IS NOT NULL) AS user_id, max(seq) AS last_seq FROM x WHERE seq>=added AND (gone IS NULL OR gone<added) GROUP BY id"""


@query(f"WITH {JOURNAL}, {REPLAY.format(cut='')}")
def journal_replay(s, d):
    return journal.replay(views.journal(s, d))


@query(f"WITH {JOURNAL}, {REPLAY.format(cut='AND seq<=3000')}")
def journal_replay_prefix(s, d):
    return journal.replay(views.journal(s, d), 3000)


@query(f"""WITH {JOURNAL} SELECT e.id, e.from_id, e.to_id, e.relation FROM journal e WHERE op='add_edge' AND NOT EXISTS (SELECT 1 FROM journal x WHERE x.op='delete_edge' AND x.id=e.id AND x.seq>=e.seq)
 AND NOT EXISTS (SELECT 1 FROM journal x WHERE x.op='delete' AND x.id=e.from_id AND x.seq>=e.seq) AND NOT EXISTS (SELECT 1 FROM journal x WHERE x.op='delete' AND x.id=e.to_id AND x.seq>=e.seq)""")
def journal_edges(s, d):
    return journal.replay_edges(views.journal(s, d))


@query("SELECT doc_id AS seq, 'chain' AS fault FROM documents WHERE doc_id>=1 AND doc_id%50=0 AND doc_id-1 IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'gap' FROM documents WHERE doc_id>1 AND doc_id-1 NOT IN (SELECT doc_id FROM documents)")
def chain_gaps(s, d):
    i = F.col("doc_id")
    lines = views.table(s, d, "documents").where("doc_id >= 1").select(i.alias("seq"), F.sha2(i.cast("string"), 256).alias("line_hash"), F.when(i % 50 == 0, "forged").when(i == 1, journal.FIRST).otherwise(F.sha2((i - 1).cast("string"), 256)).alias("before_hash"))
    return journal.chain_breaks(lines)


@query(f"WITH {NOTES} SELECT id, CASE WHEN id%6=0 THEN 'moved' ELSE user_id END AS user_id, access_count FROM notes")
def update_records(s, d):
    n = views.notes(s, d)
    patch = n.where("id % 6 = 0").select("id", F.lit("moved").alias("user_id"), F.lit(None).cast("int").alias("access_count"))
    return mutations.update(n, patch, ("user_id", "access_count")).select("id", "user_id", "access_count")


@query(f"WITH {NOTES}, {EDGES} SELECT 'memories' AS what, count(*) AS n FROM notes WHERE id%8<>0 UNION ALL SELECT 'edges', count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.id%8=0 AND n.id IN (e.from_id, e.to_id))")
def delete_cascade(s, d):
    n = views.notes(s, d)
    rows, edges = mutations.delete(n, views.edges(s, d), n.where("id % 8 = 0"))
    return rows.agg(F.lit("memories").alias("what"), F.count("*").alias("n")).unionByName(edges.agg(F.lit("edges").alias("what"), F.count("*").alias("n")))


@query(f"WITH {NOTES} SELECT count(*) AS n FROM notes WHERE user_id='src1'")
def reset_scope(s, d):
    return mutations.reset(views.notes(s, d), "src1")[1]


@query(f"WITH {NOTES}, l AS (SELECT event_id%200 AS id, count(*) AS n, max(epoch(ts)) AS latest FROM events GROUP BY 1) SELECT notes.id, access_count+coalesce(n,0) AS access_count, round(latest,3) AS accessed_at FROM notes LEFT JOIN l ON l.id=notes.id")
def touch(s, d):
    log = views.table(s, d, "events").select((F.col("event_id") % 200).alias("id"), views.epoch(F.col("ts")).alias("at"))
    return mutations.touch(views.notes(s, d), log).select("id", "access_count", F.round("accessed_at", 3).alias("accessed_at"))


@query(f"""WITH {NOTES}, n AS (SELECT id AS new_id, trust, ['ADD','UPDATE','DELETE','NONE'][CAST(id%4+1 AS INT)] AS kind, id+1+(id%3) AS target, [id+1, id+2] AS offered FROM notes)
SELECT new_id, CASE WHEN kind='NONE' THEN 'NONE' WHEN kind IN ('UPDATE','DELETE') AND list_contains(offered, target) AND n.trust>=coalesce(t.trust,3) THEN kind ELSE 'ADD' END AS action, CASE WHEN kind IN ('UPDATE','DELETE') AND list_contains(offered, target) AND n.trust>=coalesce(t.trust,3) THEN target END AS target_id FROM n LEFT JOIN notes t ON t.id=n.target""")
def conflict_routing(s, d):
    n, i = views.notes(s, d), F.col("id")
    new = n.select(i.alias("new_id"), "trust")
    decisions = n.select(i.alias("new_id"), F.element_at(F.array(*[F.lit(x) for x in ("ADD", "UPDATE", "DELETE", "NONE")]), (i % 4 + 1).cast("int")).alias("kind"), (i + 1 + i % 3).alias("target_id"))
    offered = n.select(i.alias("new_id"), F.explode(F.array(i + 1, i + 2)).alias("id"))
    return mutations.route(new, decisions, offered, n)


# ---------------------------------------------------------------- text


@query("SELECT doc_id, CASE doc_id%8 WHEN 0 THEN 1.0 WHEN 1 THEN epoch(make_date(2021, CAST(doc_id%12+1 AS INT), CAST(doc_id%28+1 AS INT))::TIMESTAMP) WHEN 2 THEN epoch(make_date(2020, CAST(doc_id%12+1 AS INT), 1)::TIMESTAMP) WHEN 3 THEN epoch(make_date(CAST(1990+doc_id%30 AS INT),3,1)::TIMESTAMP) WHEN 4 THEN epoch(make_date(CAST(1990+doc_id%30 AS INT),1,1)::TIMESTAMP) WHEN 5 THEN epoch((make_date(2023,2,1) + 29)::TIMESTAMP) WHEN 6 THEN 1.0 ELSE 1.0 END AS at FROM documents")
def parse_when(s, d):
    i = F.col("doc_id")
    n = lambda k, plus=0: (i % k + plus).cast("string")
    phrase = (
        F.when(i % 8 == 0, "today").when(i % 8 == 1, F.concat(F.lit("2021-"), n(12, 1), F.lit("-"), n(28, 1))).when(i % 8 == 2, F.concat(F.lit("since 2020-"), F.lpad(n(12, 1), 2, "0")))
        .when(i % 8 == 3, F.concat(F.lit("in Marchtime "), n(30, 1990))).when(i % 8 == 4, F.concat(F.lit("around "), n(30, 1990))).when(i % 8 == 5, "Feb. 30th, 2023").when(i % 8 == 6, "soon")
    )
    return views.table(s, d, "documents").select("doc_id", T.parse_when(phrase, F.lit(1.0)).alias("at"))


@query("SELECT conv_id, turn, regexp_matches(text || CASE WHEN turn%3=0 THEN ' I don''t know' WHEN turn%3=1 THEN ' cannot be answered' ELSE '' END, '(?i)i don''?t know|i do not know|no answer|not mentioned|no information|cannot be (?:determined|answered)|can''?t be (?:determined|answered)|not specified|does not (?:say|mention|contain)|no relevant memor') AS abstains FROM conversations")
def abstention(s, d):
    more = F.when(F.col("turn") % 3 == 0, " I don't know").when(F.col("turn") % 3 == 1, " cannot be answered").otherwise("")
    return views.table(s, d, "conversations").select("conv_id", "turn", T.abstains(F.concat("text", more)).alias("abstains"))


STOP = ", ".join(f"'{w}'" for w in T.CONTENT_STOP)
WORDS_SQL = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda x: length(x)>=3 AND x NOT IN ({STOP}))"


@query(f"WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT conv_id, turn, CASE WHEN nxt IS NULL THEN false WHEN len({WORDS_SQL.format('text')})=0 THEN true ELSE list_has_any({WORDS_SQL.format('text')}, {WORDS_SQL.format('nxt')}) END AS overlap FROM t")
def overlap_skip(s, d):
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    others = F.when(F.col("nxt").isNull(), F.array().cast("array<string>")).otherwise(F.array("nxt"))
    return views.table(s, d, "conversations").withColumn("nxt", nxt).select("conv_id", "turn", T.any_overlap(F.col("text"), others).alias("overlap"))


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n, array_to_string({TOKENS.format('text')}[1:5], ' ') AS first FROM documents")
def tokenize(s, d):
    return views.table(s, d, "documents").select("doc_id", T.n_tokens(F.col("text")).alias("n"), F.array_join(F.slice(T.tokenize(F.col("text")), 1, 5), " ").alias("first"))


@query("SELECT doc_id, regexp_replace(text || ' </ User_Input > x' || text, '(?i)</?\\s*user_input\\s*>', '[redacted-tag]', 'g') AS clean FROM documents")
def sanitize(s, d):
    return views.table(s, d, "documents").select("doc_id", T.sanitized(F.concat("text", F.lit(" </ User_Input > x"), "text"), "user_input").alias("clean"))


from . import more  # noqa: E402, F401  (its queries register themselves here)
