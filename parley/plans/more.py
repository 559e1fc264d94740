"""Further queries over the driver's tables, and the same in DuckDB's SQL: operators whose cases the tables lack are fed made-up columns.

Made-up columns follow from ids, so both sides can say them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.config import COMPETITORS, POLITICAL_TERMS, WARRANTY_TERMS, Pool
from parley.functions import guards, text
from parley.operators import agents, clean, context, evaluation, graph, routing, splits, telemetry, volume
from parley.plans.queries import _TURNS, SQL, conversation_threads, messages, query, table
from parley.sources import tables


def one_of(values: list[str | None], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (at % len(values) + 1).cast("int"))


def sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


# Reply graphs with declared children, orphans, branches and cycles


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: each answers the one of a quarter of its id; some declare children, missing ones, or their own parent."""
    i, m = F.col("event_id"), lambda c: F.concat(F.lit("m"), c.cast("string"))
    up = F.floor(i / 4)
    return table(spark, sf_dir, "events").select(
        m(i).alias("tweet_id"), F.when(i < 4, None).when(i % 13 == 5, F.concat(F.lit("x"), i.cast("string"))).otherwise(m(up)).alias("in_response_to_tweet_id"),
        F.when(i % 5 == 0, F.concat(m(4 * i), F.lit(", "), m(4 * i + 1), F.lit(","), m(4 * i), F.lit(" ,nan,zz"), i.cast("string"))).when((i % 7 == 3) & (i >= 4), m(up)).alias("response_tweet_id"),
    )


_REPLIES = """m AS (SELECT 'm' || event_id AS id, CASE WHEN event_id < 4 THEN NULL WHEN event_id % 13 = 5 THEN 'x' || event_id ELSE 'm' || (event_id // 4) END AS parent,
  CASE WHEN event_id % 5 = 0 THEN 'm' || (4 * event_id) || ', m' || (4 * event_id + 1) || ',m' || (4 * event_id) || ' ,nan,zz' || event_id WHEN event_id % 7 = 3 AND event_id >= 4 THEN 'm' || (event_id // 4) END AS resp FROM events),
dc AS (SELECT DISTINCT id AS src, trim(u) AS dst FROM (SELECT id, unnest(string_split(resp, ',')) AS u FROM m WHERE resp IS NOT NULL) WHERE trim(u) <> '' AND lower(trim(u)) <> 'nan'),
e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM dc UNION ALL SELECT parent, id FROM m WHERE parent IS NOT NULL) WHERE src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m))"""


@query(f"WITH {_REPLIES} SELECT src, dst FROM e")
def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(replies(spark, sf_dir)).select("src", "dst")


@query(f"WITH {_REPLIES} SELECT dc.src, dc.dst, CASE WHEN m.id IS NULL THEN 'missing' ELSE 'disagrees' END AS issue FROM dc LEFT JOIN m ON m.id = dc.dst WHERE m.id IS NULL OR m.parent IS DISTINCT FROM dc.src")
def reply_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_audit(replies(spark, sf_dir))


@query(f"WITH {_REPLIES} SELECT id AS tweet_id, 'orphan' AS kind FROM m WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM m) UNION ALL SELECT id, 'root' FROM m WHERE parent IS NULL")
def roots_and_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = replies(spark, sf_dir)
    return graph.orphans(m).withColumn("kind", F.lit("orphan")).unionByName(graph.roots(m).withColumn("kind", F.lit("root")))


@query(f"""WITH RECURSIVE {_REPLIES}, p AS (SELECT [id] AS path, id AS last FROM m WHERE parent IS NULL UNION ALL SELECT list_append(p.path, e.dst), e.dst FROM p JOIN e ON e.src = p.last WHERE NOT list_contains(p.path, e.dst))
SELECT array_to_string(path, '>') AS path FROM p LEFT JOIN e ON e.src = p.last WHERE e.dst IS NULL OR list_contains(p.path, e.dst)""")
def reply_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches, and cycles that end a path."""
    return graph.paths(replies(spark, sf_dir)).select(F.array_join("path", ">").alias("path"))


@query(f"WITH {_TURNS} SELECT thread_id, max(n)::INT AS turns FROM turns GROUP BY thread_id HAVING max(n) > 4")
def long_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.long_threads(conversation_threads(spark, sf_dir), 4).select("thread_id", graph.turn_count(F.col("tweets")).alias("turns"))


@query(f"""WITH {_TURNS}, own AS (SELECT conv_id FROM turns WHERE conv_id % 3 = 0 GROUP BY conv_id), h AS (SELECT 'assistant-' || min(conv_id) AS handle FROM own)
SELECT tweet_id FROM turns, h WHERE (NOT inbound AND 'assistant-' || conv_id = handle) OR (inbound AND conv_id % 3 = 0)""")
def brand_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first such conversation's assistant is the brand; threads of every third conversation expand it."""
    m, third = messages(spark, sf_dir), F.substring_index("thread_id", ":", 1).cast("long") % 3 == 0
    t = conversation_threads(spark, sf_dir).where(third)
    least = t.agg(F.min(F.substring_index("thread_id", ":", 1).cast("long"))).first()[0]
    return clean.filter_brand(m, f"assistant-{least}", t).select("tweet_id")


# Cleaning

_INBOUND = ["true", "FALSE", "1", "yes", " T ", "no", None]


@query(f"""WITH raw AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN ' nan ' ELSE source END AS author_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE ' ' || (doc_id - doc_id % 7 % 2) || ' ' END AS tweet_id,
    CASE WHEN doc_id % 11 = 0 THEN 'soon' WHEN doc_id % 4 = 1 THEN 'Tue Oct 31 22:10:47 +0000 2017' ELSE '2024-01-02T03:04:05Z' END AS created_at, {sql_list(_INBOUND)}[doc_id % 7 + 1] AS inbound,
    CASE WHEN doc_id % 6 = 0 THEN NULL ELSE source END AS text, CASE WHEN doc_id % 3 = 0 THEN ' NaN ' WHEN doc_id % 3 = 1 THEN ' 5 , 6' END AS response FROM documents),
  d AS (SELECT *, row_number() OVER (PARTITION BY trim(tweet_id) ORDER BY doc_id) AS nth FROM raw WHERE lower(trim(author_id)) NOT IN ('', 'nan', 'none') AND trim(tweet_id) <> '')
SELECT trim(tweet_id) AS tweet_id, author_id, COALESCE(lower(trim(inbound)) IN ('true', '1', 't', 'yes'), false) AS inbound, CASE WHEN created_at LIKE 'Tue%' THEN 1509487847 ELSE 1704164645 END::BIGINT AS sent, COALESCE(text, '') AS text,
  CASE WHEN lower(trim(response)) <> 'nan' THEN response END AS response_tweet_id FROM d WHERE nth = 1 AND created_at <> 'soon'""")
def cleaned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    raw = d.select(
        i.alias("ordinal"), F.when(i % 17 == 0, " nan ").otherwise(F.col("source")).alias("author_id"), F.when(i % 13 == 0, "").otherwise(F.concat(F.lit(" "), (i - i % 7 % 2).cast("string"), F.lit(" "))).alias("tweet_id"),
        F.when(i % 11 == 0, "soon").when(i % 4 == 1, "Tue Oct 31 22:10:47 +0000 2017").otherwise("2024-01-02T03:04:05Z").alias("created_at"), one_of(_INBOUND, i).alias("inbound"),
        F.when(i % 6 != 0, F.concat("source", F.lit("\x00"))).alias("text"), F.when(i % 3 == 0, " NaN ").when(i % 3 == 1, " 5 , 6").alias("response_tweet_id"), F.lit(None).cast("string").alias("in_response_to_tweet_id"),
    )
    return clean.clean(raw).select("tweet_id", "author_id", "inbound", F.unix_timestamp("created_at").alias("sent"), "text", "response_tweet_id")


@query("SELECT doc_id::VARCHAR AS tweet_id, source || chr(10) || 'said \"so\", twice' AS text, lang AS author_id FROM documents")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV with quotes and line breaks, read as messages of text columns."""
    path = f"{graph.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit('\nsaid "so", twice')).alias("text"), F.col("lang").alias("author_id"))
    d.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_messages(spark, path, {"tweet_id": "id"}).select("tweet_id", "text", "author_id")


@query(f"WITH {_TURNS} SELECT thread_id, count(*)::INT AS n, NOT max_by(inbound, i) AS terminal, max(text) AS last_text FROM turns GROUP BY thread_id")
def thread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads as JSON lines and back."""
    path = f"{graph.shared_folder(spark)}/threads-{uuid.uuid4().hex}"
    tables.write_threads(conversation_threads(spark, sf_dir).withColumn("tweets", F.transform("tweets", lambda t: t.withField("response_tweet_id", F.lit(None).cast("string")).withField("in_response_to_tweet_id", F.lit(None).cast("string")))), path)
    return tables.read_threads(spark, path).select("thread_id", F.size("tweets").alias("n"), "terminal", F.array_max("tweets.text").alias("last_text"))


_FIRST = ["", None, "  ", "a"]


@query(f"SELECT doc_id, COALESCE(nullif(trim({sql_list(_FIRST)}[doc_id % 4 + 1]), ''), lang) AS text FROM documents")
def first_filled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", one_of(_FIRST, F.col("doc_id")).alias("body"), "lang")
    return tables.first_text(d, ["body", "absent", "lang"]).select("doc_id", "text")


@query("SELECT doc_id::VARCHAR AS item_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS query, lang AS response, len([source, lang])::INT AS n_contexts FROM documents")
def evaluation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("query"), F.col("lang").alias("text"), F.col("lang").alias("answer"), F.array("source", "lang").alias("contexts"))
    return agents.normalise_items(d).select("item_id", "query", "response", F.size("contexts").alias("n_contexts"))


# Splits and samples


@query("""WITH n AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || doc_id::VARCHAR), doc_id) AS i FROM documents),
v AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 ELSE greatest(1, round_even(n * 0.15::DOUBLE, 0)) END AS nv FROM n), t AS (SELECT *, least(CASE WHEN n < 3 THEN 0 ELSE greatest(1, round_even(n * 0.15::DOUBLE, 0)) END, greatest(n - 1 - nv, 0)) AS nt FROM v)
SELECT doc_id, lang, CASE WHEN i <= nv THEN 'val' WHEN i <= nv + nt THEN 'test' ELSE 'train' END AS split FROM t""")
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split3(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("""WITH s AS (SELECT COALESCE(lang, 'unknown') AS s, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT *, greatest(1, least(n, round_even(n / (SELECT sum(n) FROM s)::DOUBLE * 150, 0)))::BIGINT AS seats, row_number() OVER (ORDER BY n DESC, encode(s)) AS nth FROM s),
f AS (SELECT s, CASE WHEN (SELECT sum(n) FROM s) <= 150 THEN n ELSE seats + CASE WHEN nth <= abs(150 - (SELECT sum(seats) FROM a)) THEN sign(150 - (SELECT sum(seats) FROM a)) ELSE 0 END END AS seats FROM a),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY COALESCE(lang, 'unknown') ORDER BY md5('42' || doc_id::VARCHAR), doc_id) AS i FROM documents)
SELECT doc_id, lang FROM r JOIN f ON COALESCE(lang, 'unknown') = s WHERE i <= seats""")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 150)


@query("WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1) SELECT label, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.class_weights(table(spark, sf_dir, "labels").select(F.col("quality").alias("label")), "label")


@query("WITH l AS (SELECT doc_id, 'c' || (doc_id % 97 % (doc_id % 11 + 1)) AS label FROM documents), n AS (SELECT label, count(*) AS n FROM l GROUP BY 1) SELECT doc_id, CASE WHEN n < 40 THEN 'Other' ELSE label END AS label FROM l JOIN n USING (label)")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return splits.merge_sparse(table(spark, sf_dir, "documents").select(i, F.concat(F.lit("c"), (i % 97 % (i % 11 + 1)).cast("string")).alias("label")), "label", 40)


_PURITY = ["Unclassified", "-1", "a", "b"]


@query(f"SELECT doc_id, {sql_list(_PURITY)}[doc_id % 4 + 1] AS label, doc_id % 10 / 10::DOUBLE AS p FROM documents WHERE doc_id % 4 > 1 AND doc_id % 10 / 10::DOUBLE >= 0.7")
def pure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = splits.pure(table(spark, sf_dir, "documents").select(i, one_of(_PURITY, i).alias("label"), (i % 10 / 10).alias("p")), "label", "p")
    splits.require_classes(rows, "label", 2)
    return rows


# Evaluation

_PREDICTED = "r AS (SELECT quality + 2 * toxic AS y, CASE WHEN doc_id % 6 = 0 THEN doc_id % 4 ELSE quality + 2 * toxic END AS p FROM labels)"
_REPORT = f"""{_PREDICTED}, v AS (SELECT y AS l FROM r UNION SELECT p FROM r), c AS (SELECT l, count(*) FILTER (y = l AND p = l) AS hit, count(*) FILTER (y = l) AS sup, count(*) FILTER (p = l) AS said FROM r, v GROUP BY l),
rep AS (SELECT l AS label, CASE WHEN said = 0 THEN 0 ELSE hit::DOUBLE / said END AS "precision", CASE WHEN sup = 0 THEN 0 ELSE hit::DOUBLE / sup END AS recall, CASE WHEN said + sup = 0 THEN 0 ELSE 2.0::DOUBLE * hit / (said + sup) END AS f1, sup AS support FROM c)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, i = F.col("quality") + 2 * F.col("toxic"), F.col("doc_id")
    return evaluation.class_report(table(spark, sf_dir, "labels").select(y.cast("long").alias("y"), F.when(i % 6 == 0, i % 4).otherwise(y.cast("long")).alias("p")), "y", "p")


@query(f"WITH {_REPORT} SELECT * FROM rep")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query("SELECT item_id, avg((quality = 1 AND doc_id % 7 <> 0)::INT::DOUBLE) AS context_recall FROM (SELECT *, doc_id % 50 AS item_id FROM labels) GROUP BY item_id")
def context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return evaluation.context_recall(table(spark, sf_dir, "labels").select((i % 50).alias("item_id"), F.when(i % 7 != 0, F.col("quality") == 1).alias("supported")))


@query("""WITH c AS (SELECT doc_id % 40 AS item_id, CASE WHEN doc_id % 23 <> 0 AND doc_id % 40 <> 3 THEN doc_id % 160 END AS claim, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 11 / 10::DOUBLE END AS score FROM documents),
e AS (SELECT item_id, claim, max(COALESCE(score, 0)) AS s FROM c WHERE claim IS NOT NULL GROUP BY ALL), f AS (SELECT item_id, avg((s >= 0.5)::INT::DOUBLE) AS faithfulness FROM e GROUP BY 1) SELECT item_id, faithfulness FROM (SELECT DISTINCT item_id FROM c) LEFT JOIN f USING (item_id)""")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select((i % 40).alias("item_id"), F.when((i % 23 != 0) & (i % 40 != 3), (i % 160).cast("string")).alias("claim"), F.lit("k").alias("context"), F.when(i % 9 != 0, i % 11 / 10).alias("score"))
    return evaluation.faithfulness(c)


_TOKENS = [" 1", "2", "3 ", "4", "5", "x", "7", "five"]


@query(f"""WITH l AS (SELECT event_id % 300 AS item_id, try_cast(trim({sql_list(_TOKENS)}[event_id % 8 + 1]) AS INT) AS d, exp(-(event_id % 5 + 3.5::DOUBLE)) AS p FROM events), q AS (SELECT item_id, d, CASE WHEN d BETWEEN 1 AND 5 THEN p END AS p FROM l)
SELECT item_id, round(sum(d * p) / nullif(sum(p), 0), 8) AS weighted_score, round(COALESCE(sum(p), 0), 8) AS mass, COALESCE(sum(p), 0) < 0.5 AS low_confidence FROM q GROUP BY item_id""")
def expected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select((i % 300).alias("item_id"), one_of(_TOKENS, i).alias("token"), (-(i % 5 + 3.5)).cast("double").alias("logprob"))
    return evaluation.weighted_score(e).select("item_id", F.round("weighted_score", 8).alias("weighted_score"), F.round("mass", 8).alias("mass"), "low_confidence")


_OWN, _JUDGES = ["A", "b ", "", None, "z"], ["a", " B", "c"]


@query(f"""WITH j AS (SELECT event_id % 400 AS item_id, nullif(lower(trim({sql_list(_OWN)}[event_id % 400 % 5 + 1])), '') AS own, lower(trim({sql_list(_JUDGES)}[event_id % 3 + 1])) AS p, event_id AS pos, (event_id % 7 % 5 + 1)::DOUBLE AS score FROM events),
b AS (SELECT item_id, p, list_reduce(list(score ORDER BY pos), lambda a, x: (a + x) / 2) AS s FROM j WHERE own IS NULL OR p <> own GROUP BY ALL), f AS (SELECT item_id, median(s) AS final_score, max(s) - min(s) > 2 AS high_disagreement FROM b GROUP BY 1)
SELECT item_id, max(CASE WHEN p = own THEN own END) AS recused_provider, bool_or(own IS NULL) AS recusal_unverified, max(round(final_score, 9)) AS final_score, bool_or(high_disagreement) AS high_disagreement FROM j LEFT JOIN f USING (item_id) GROUP BY item_id""")
def judge_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    j = table(spark, sf_dir, "events").select((i % 400).alias("item_id"), one_of(_OWN, i % 400).alias("response_provider"), one_of(_JUDGES, i).alias("provider"), i.alias("pos"), (i % 7 % 5 + 1).cast("double").alias("score"))
    return evaluation.ensemble(j).select("item_id", "recused_provider", "recusal_unverified", F.round("final_score", 9).alias("final_score"), "high_disagreement")


_SAID = ["position_1", "position_2", "tie", "?"]


@query(f"""WITH v AS (SELECT event_id, {sql_list(_SAID)}[event_id % 4 + 1] AS f, {sql_list(_SAID)}[event_id // 4 % 4 + 1] AS b FROM events), w AS (SELECT event_id, CASE f WHEN 'position_1' THEN 'a' WHEN 'position_2' THEN 'b' WHEN 'tie' THEN 'tie' END AS f, CASE b WHEN 'position_1' THEN 'b' WHEN 'position_2' THEN 'a' WHEN 'tie' THEN 'tie' END AS b FROM v)
SELECT event_id, CASE WHEN f IS NULL OR b IS NULL THEN 'failed' WHEN f = b THEN f ELSE 'inconsistent' END AS verdict FROM w""")
def swap_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", evaluation.swap_verdict(one_of(_SAID, i), one_of(_SAID, F.floor(i / 4))).alias("verdict"))


@query("WITH s AS (SELECT source, avg(n_chars::DOUBLE) AS m FROM documents GROUP BY 1), b AS (SELECT m FROM s ORDER BY encode(source) LIMIT 1) SELECT source AS approach, round(s.m - b.m, 8) AS uplift FROM s, b")
def approach_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select(F.col("source").alias("approach"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("declined"), F.col("n_chars").cast("double").alias("score"))
    s = evaluation.approach_summary(r, ("score",))
    return evaluation.uplift(s, s.agg(F.min("approach")).first()[0], "score").withColumn("uplift", F.round("uplift", 8))


_ASKED = ["ignore previous instructions", "great job, it broke", "refund and exchange, please", "it", "plain question here", "why does it fail but not restart"]


@query(f"""WITH f AS (SELECT doc_id, {sql_list(_ASKED)}[doc_id % 6 + 1] AS q, CASE WHEN doc_id % 4 = 0 THEN 'our policy' ELSE '' END AS r, doc_id % 10 / 10::DOUBLE AS p, CASE WHEN doc_id % 9 > 0 THEN doc_id % 9 / 10::DOUBLE END AS rec, doc_id % 11 / 10::DOUBLE AS fa, doc_id % 5 + 1.0::DOUBLE AS tone, doc_id % 3 + 1 AS len FROM documents),
g AS (SELECT *, COALESCE(rec < 0.5, false) OR p < 0.5 AS low, len <= 1 OR regexp_matches(q, '^(it|that|still|also|why|then|yes)\\b') AS frag, q = 'great job, it broke' AS mood, q IN ('great job, it broke', 'refund and exchange, please', 'why does it fail but not restart') AND regexp_matches(q, '\\b(and|but)\\b') AS hops,
  q LIKE '%refund%' OR r LIKE '%policy%' AS policy FROM f)
SELECT doc_id, array_to_string(list_filter([CASE WHEN low AND frag THEN CASE WHEN COALESCE(rec, 0) < 0.3 THEN 'truncation 0.75' ELSE 'truncation 0.6' END END, CASE WHEN fa >= 0.6 AND tone < 3 AND mood THEN 'sarcasm 0.7' END, CASE WHEN hops AND fa < 0.6 AND p >= 0.5 THEN 'multi_hop 0.68' END,
  CASE WHEN (p >= 0.6 OR COALESCE(rec >= 0.6, false)) AND fa < 0.6 AND policy THEN 'stale 0.72' END, CASE WHEN q LIKE 'ignore%' THEN 'adversarial 0.65' END], lambda x: x IS NOT NULL), ',') AS tags FROM g""")
def all_failure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    null = F.lit(None).cast("double")
    tags = evaluation.failure_tags(one_of(_ASKED, i), F.when(i % 4 == 0, "our policy").otherwise(""), i % 10 / 10, F.when(i % 9 > 0, i % 9 / 10).otherwise(null), i % 11 / 10, (i % 5 + 1).cast("double"), None, i % 3 + 1)
    short = {"conversational_truncation": "truncation", "sarcasm_sentiment_inversion": "sarcasm", "multi_hop_reasoning_deficit": "multi_hop", "stale_knowledge_indexing": "stale", "adversarial_extraction": "adversarial"}
    names = F.create_map(*(F.lit(x) for kv in short.items() for x in kv))
    return table(spark, sf_dir, "documents").select("doc_id", tags.alias("t")).select("doc_id", F.array_join(F.transform("t", lambda x: F.concat(names[x["mode"]], F.lit(" "), x["confidence"].cast("string"))), ",").alias("tags"))


# Texts and guards


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(trim(COALESCE(text, '')), '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS c FROM documents),
t AS (SELECT doc_id, regexp_replace(regexp_replace(c, '^\s+|\s+$', '', 'g'), '^[-*123456789.) ]+|[-*123456789.) ]+$', '', 'g') AS c FROM s)
SELECT doc_id, count(*) AS n_claims, sum(length(c))::BIGINT AS chars FROM t WHERE length(c) >= 8 AND NOT regexp_matches(c, '(?i)^(hello|hi|hey|greetings|thank you|thanks|sure|okay|here is|here are)\b|^(hope this helps|let me know|regards|best)\b') GROUP BY doc_id""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.extract_claims(F.col("text"), like_sql=True)).alias("c"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_claims"), F.sum(F.length("c")).alias("chars"))


_RIVALS = ["We recommend Samsung.", "It works with Samsung phones.", "Zendesk is here. Buy now.", "Huawei is here.", "Nothing else."]


@query(f"SELECT doc_id, {sql_list(['Samsung', None, 'Zendesk', None, None])}[doc_id % 5 + 1] AS mention, {sql_list(['Samsung', 'Samsung', 'Zendesk', 'Huawei', None])}[doc_id % 5 + 1] AS input_blocked FROM documents")
def competitor_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", one_of(_RIVALS, F.col("doc_id")).alias("t"))
    return d.select("doc_id", guards.competitor_udf(F.col("t")).alias("mention"), F.regexp_extract(guards.input_rail(F.col("t"))["reason"], "competitor comparison: (.+)", 1).alias("input_blocked"))


_RAILS = ["the election is near", "I have a Samsung", "a lifetime warranty", "all is well", None]


@query(f"""SELECT doc_id, doc_id % 5 NOT IN (0, 1) AS input_ok, {sql_list(['political discourse', 'competitor comparison: Samsung', None, None, None])}[doc_id % 5 + 1] AS input_reason, doc_id % 5 NOT IN (1, 2) AS output_ok,
{sql_list([None, 'competitor mention: Samsung', 'warranty commitment: lifetime warranty', None, None])}[doc_id % 5 + 1] AS output_reason FROM documents""")
def rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", one_of(_RAILS, F.col("doc_id")).alias("t"))
    a, b = guards.input_rail(F.col("t")), guards.output_rail(F.col("t"))
    return d.select("doc_id", a["passed"].alias("input_ok"), a["reason"].alias("input_reason"), b["passed"].alias("output_ok"), b["reason"].alias("output_reason"))


_TALK = ["my battery drains", "where can I buy one", "the screen broke", "hello"]


@query(f"""WITH RECURSIVE {_TURNS}, x AS (SELECT conv_id, i, {sql_list(_TALK)}[(conv_id + turn) % 4 + 1] AS t FROM turns), st AS (SELECT conv_id, 0::BIGINT AS i, NULL::VARCHAR AS topic, 0 AS n, 0 AS rejected FROM x WHERE i = 1
UNION ALL SELECT st.conv_id, x.i, CASE WHEN COALESCE(topic LIKE '%battery%', false) AND t LIKE '%buy%' THEN topic WHEN t LIKE '%battery%' THEN 'battery troubleshooting' WHEN t LIKE '%screen%' THEN 'screen repair' ELSE topic END,
  n + CASE WHEN COALESCE(topic LIKE '%battery%', false) AND t LIKE '%buy%' THEN 0 ELSE 1 END, rejected + CASE WHEN COALESCE(topic LIKE '%battery%', false) AND t LIKE '%buy%' THEN 1 ELSE 0 END FROM st JOIN x ON x.conv_id = st.conv_id AND x.i = st.i + 1)
SELECT conv_id, max_by(topic, i) AS topic, max_by(n, i)::INT AS turns, max_by(rejected, i)::INT AS rejected FROM st GROUP BY conv_id""")
def dialog_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select(F.substring_index("tweet_id", ":", 1).cast("long").alias("conv_id"), F.substring_index("tweet_id", ":", -1).cast("long").alias("turn"))
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one_of(_TALK, F.col("conv_id") + F.col("turn")).alias("t")))).alias("s"))
    m = m.select("conv_id", guards.dialog_rail(F.col("s.t")).alias("st"))
    last = F.element_at("st", -1)
    return m.select("conv_id", last["topic"].alias("topic"), last["turns"].alias("turns"), F.size(F.filter("st", lambda s: ~s["passed"])).alias("rejected"))


def _terms(words: list[str], tail: str = "") -> str:
    return "(?i)\\b(?:" + "|".join(w.replace("'", "''") for w in words) + ")" + tail + "\\b"


_PLURAL = "(?:''s|s)?"
_OFF = "COALESCE(topic LIKE '%battery%', false) AND regexp_matches(t, '(?i)\\b(buy|purchase|pricing|store hours|weather|refund)\\b')"
SQL["guarded_dialog"] = f"""WITH RECURSIVE {_TURNS}, x AS (SELECT conv_id, thread_id, i, trim(text) AS t FROM turns), st AS (SELECT conv_id, 0::BIGINT AS i, NULL::VARCHAR AS topic, 0 AS rejected FROM x WHERE i = 1
UNION ALL SELECT st.conv_id, x.i, CASE WHEN {_OFF} THEN topic WHEN regexp_matches(t, '(?i)\\bbattery\\b') THEN 'battery troubleshooting' WHEN regexp_matches(t, '(?i)\\bscreen|display\\b') THEN 'screen repair' ELSE topic END,
  rejected + CASE WHEN {_OFF} THEN 1 ELSE 0 END FROM st JOIN x ON x.conv_id = st.conv_id AND x.i = st.i + 1),
r AS (SELECT conv_id, max_by(rejected, i)::INT AS rejected FROM st GROUP BY 1), ends AS (SELECT conv_id, any_value(thread_id) AS thread_id, min_by(text, i) AS a, max_by(text, i) AS z FROM turns GROUP BY 1)
SELECT thread_id, rejected, NOT regexp_matches(a, '{_terms(POLITICAL_TERMS, _PLURAL)}') AND NOT regexp_matches(a, '{_terms(COMPETITORS, _PLURAL)}') AS input_ok, NOT regexp_matches(z, '{_terms(COMPETITORS, _PLURAL)}') AND NOT regexp_matches(z, '{_terms(WARRANTY_TERMS)}') AS output_ok FROM ends JOIN r USING (conv_id)"""
# The driver's texts hold no device, link or contraction, so their tokens are the plain ones; device_tokens has those.
SQL["entity_tokens"] = "SELECT doc_id, len(COALESCE(regexp_extract_all(lower(text), '[a-z0-9]+'), []))::INT AS n_tokens FROM documents"

_PERSONAL = [" SSN: 123-45-6789.", " 123 45 6789 here", " card 4111 1111 1111 1111", " card 4111 1111 1111 1112", " tax id is 123456789", ""]
_MASKED = [" SSN: [REDACTED_SSN].", " [REDACTED_SSN] here", " card [REDACTED_CREDIT_CARD]", " card 4111 1111 1111 1112", " tax id is [REDACTED_SSN]", ""]


@query(f"SELECT doc_id, lang || {sql_list(_MASKED)}[doc_id % 6 + 1] AS masked, {sql_list(['ssn', 'ssn', 'credit_card', '', 'ssn', ''])}[doc_id % 6 + 1] AS types FROM documents WHERE lang IS NOT NULL")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", guards.mask_pii(F.concat("lang", one_of(_PERSONAL, F.col("doc_id")))).alias("m"))
    return d.select("doc_id", "m.text", F.array_join("m.types", ",").alias("types")).withColumnRenamed("text", "masked")


_TICKETS = ["TCKT-123456", " TCKT-000001 ", "TCKT-12345", "tckt-123456", None]


@query("SELECT doc_id, doc_id % 5 IN (0, 1) AS valid, doc_id % 5 IN (0, 1, 4) AS tags_valid FROM documents")
def ticket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    t = one_of(_TICKETS, i)
    return table(spark, sf_dir, "documents").select("doc_id", guards.valid_id(t).alias("valid"), guards.valid_ticket_tags(F.array(F.lit("Billing"), F.concat(F.lit("id:"), F.coalesce(t, F.lit("TCKT-999999"))))).alias("tags_valid"))


_SPOKEN = ["It's late, I CAN'T wait", "gonna see https://x.co/it's now", "Y'all don't mind", "plain words", None]
_WRITTEN = ["It is late, I CANNOT wait", "going to see https://x.co/it's now", "You all do not mind", "plain words", None]
_LINKS = ["It is late, I CANNOT wait", "going to see <url> now", "You all do not mind", "plain words", None]


@query(f"SELECT doc_id, {sql_list(_WRITTEN)}[doc_id % 5 + 1] AS expanded, {sql_list(_LINKS)}[doc_id % 5 + 1] AS masked FROM documents")
def expanded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.expand_udf(one_of(_SPOKEN, F.col("doc_id"))).alias("expanded"))
    return d.select("doc_id", "expanded", text.mask_urls_col(F.col("expanded")).alias("masked"))


_DEVICE = " It's on my iPhone 7 Plus, see https://x.co/a b."


@query(r"""SELECT doc_id, (len(regexp_extract_all(lower(text), '[a-z0-9]+')) + 9)::INT AS n_tokens FROM documents WHERE text IS NOT NULL""")
def device_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device is one token: it, is, on, my, iphone 7 plus, see, url and b, with the link masked; the preserved text keeps the device."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.preserve_udf(text.expand_udf(F.concat("text", F.lit(_DEVICE)))).alias("t"))
    kept = F.col("t").endswith(" It is on my iPhone 7 Plus, see <url> b.").cast("int")
    return d.select("doc_id", (F.size(text.tokens_udf(F.col("t"))) + kept).alias("n_tokens"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'I am an automated assistant. Please visit our support center at https://support.example.com for assistance with your device.' END AS reply FROM documents")
def trivial_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.trivial_reply(one_of(["It is FROZEN!", "please help", "helpful", "unbroken"], F.col("doc_id"))).alias("reply"))


# Routing

_SEVERE_TEXT = ["I call my Lawyer and sue", "it caught fire", "a pursuer", "all is well"]


@query("""WITH s AS (SELECT doc_id, doc_id % 4 < 2 AS flag, ['lawyer,sue', 'caught fire', '', ''][doc_id % 4 + 1] AS words, CASE WHEN doc_id % 3 = 0 THEN 'Safety/Legal' WHEN doc_id % 3 = 1 THEN 'Other' END AS label FROM documents)
SELECT doc_id, words, flag AND COALESCE(label = 'Safety/Legal', false) AS is_severe, flag AND NOT COALESCE(label = 'Safety/Legal', false) AS is_disagreement FROM s""")
def severity_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    t, label = one_of(_SEVERE_TEXT, i), F.when(i % 3 == 0, "Safety/Legal").when(i % 3 == 1, "Other")
    c = routing.consensus(routing.severe(t), label, "Safety/Legal")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(routing.severe_words(t), ",").alias("words"), c["is_severe"].alias("is_severe"), c["is_disagreement"].alias("is_disagreement"))


_SKILLED = {"escalation_critical": Pool("escalation_critical", "critical", ("e0", "e1", "e2"), {"e2": ("legal_liaison",)}), "technical_specialist": Pool("technical_specialist", "urgent", ("t0", "t1")), "standard_support": Pool("standard_support", "standard", ("s0",))}


@query("""WITH t AS (SELECT doc_id, ['critical', 'urgent', 'standard', 'none'][doc_id % 4 + 1] AS tier, ['Legal_Threat', 'General_Inquiry', 'Hardware_Failure'][doc_id % 3 + 1] AS intent FROM documents),
p AS (SELECT *, CASE WHEN tier = 'critical' THEN 'escalation_critical' WHEN tier = 'urgent' OR (tier = 'standard' AND intent = 'Hardware_Failure') THEN 'technical_specialist' ELSE 'standard_support' END AS pool, tier = 'critical' AND intent = 'Legal_Threat' AS skilled FROM t),
n AS (SELECT *, COALESCE(sum((NOT skilled)::INT) OVER (PARTITION BY pool ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, pool, CASE WHEN skilled THEN 'skill_based' ELSE 'round_robin' END AS strategy, CASE WHEN skilled THEN 'e2' WHEN pool = 'escalation_critical' THEN 'e' || ((before + 2) % 3)::INT WHEN pool = 'technical_specialist' THEN 't' || ((before + 1) % 2)::INT ELSE 's0' END AS agent FROM n""")
def skilled_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal threats go to the liaison; the critical pool's cursor begins after its first agent."""
    i = F.col("doc_id")
    t = table(spark, sf_dir, "documents").select("doc_id", one_of(["critical", "urgent", "standard", "none"], i).alias("escalation_tier"), one_of(["Legal_Threat", "General_Inquiry", "Hardware_Failure"], i).alias("predicted_intent"))
    return routing.assign(t, _SKILLED, last={"escalation_critical": 1}, skills={"Legal_Threat": "legal_liaison"}, order="doc_id").select("doc_id", "pool", "strategy", "agent")


@query("""WITH h AS (SELECT doc_id AS thread, 1 AS rank, 'd' || (doc_id % 50) AS id FROM documents UNION ALL SELECT doc_id, 2, 'gone' FROM documents WHERE doc_id % 2 = 0), k AS (SELECT 'd' || n AS id, CASE WHEN n % 2 = 0 THEN repeat('long text ', 30) ELSE 'short' END AS r FROM range(50) x(n)),
l AS (SELECT thread, string_agg('- ' || h.id || ': ' || CASE WHEN r IS NULL THEN '[document not found]' WHEN length(r) > 200 THEN substr(r, 1, 200) || '...' ELSE r END, chr(10) ORDER BY rank) AS lines FROM h LEFT JOIN k USING (id) WHERE thread % 3 <> 0 GROUP BY 1)
SELECT doc_id::VARCHAR AS thread_id, 'Intent: ' || CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'Billing_Issue' END || chr(10) || 'Tier: urgent' || chr(10) || 'Related resolutions:' || chr(10) || COALESCE(lines, '- none') AS note FROM documents LEFT JOIN l ON thread = doc_id""")
def handoff_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("doc_id"), table(spark, sf_dir, "documents")
    decisions = d.select(i.cast("string").alias("thread_id"), F.when(i % 5 != 0, "Billing_Issue").alias("predicted_intent"), F.lit("urgent").alias("escalation_tier"))
    hit = lambda rank, doc: F.struct(F.lit(rank).alias("r"), doc.alias("d"))
    first = hit(1, F.concat(F.lit("d"), (i % 50).cast("string")))
    hits = d.where(i % 3 != 0).select(i.cast("string").alias("thread_id"), F.explode(F.when(i % 2 == 0, F.array(first, hit(2, F.lit("gone")))).otherwise(F.array(first))).alias("h"))
    known = spark.range(50).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"), F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("long text "), 30)).otherwise("short").alias("resolution_text"))
    return routing.handoff(decisions, hits.select("thread_id", F.col("h.r").alias("rank"), F.col("h.d").alias("doc_id")), known).select("thread_id", "note")


# Telemetry and volume


@query("""WITH e AS (SELECT event_id, (event_id % 3600)::DOUBLE / 60 AS minutes, floor(event_id % 900 / 60.0)::INT AS sla, event_id % 3 = 0 AS caught FROM events)
SELECT event_id, minutes AS reviewer_minutes, sla AS sla_target_minutes, caught AS error_caught, event_id % 5 <> 0 AS contained FROM e""")
def aliased_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(i, (i % 3600).alias("duration_seconds"), (i % 900).alias("sla_target_seconds"), one_of(["rejected", "approved", "open"], i).alias("status"), (i % 5 == 0).alias("escalated_to_human"))
    return telemetry.containment_aliases(telemetry.review_aliases(e)).select("event_id", "reviewer_minutes", "sla_target_minutes", "error_caught", "contained")


@query("""WITH r AS (SELECT o_orderkey, (o_orderkey % 40)::DOUBLE AS w, (o_orderkey % 7)::DOUBLE AS c FROM orders WHERE o_orderpriority = '1-URGENT'), v AS (SELECT *, w / CASE WHEN c = 0 THEN 0.01 ELSE c END AS ratio FROM r)
SELECT o_orderkey, ratio, (ratio - 1) * 100 AS surplus_percent, CASE WHEN ratio >= 2 THEN 'excellent' WHEN ratio >= 1 THEN 'positive' WHEN ratio >= 0.5 THEN 'marginal' ELSE 'negative' END AS band FROM v""")
def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = telemetry.of_tier(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "escalation_tier"), "1-URGENT")
    return o.select("o_orderkey", telemetry.verdict((k % 40).cast("double"), (k % 7).cast("double")).alias("v")).select("o_orderkey", "v.*")


@query("""WITH m AS (SELECT doc_id, doc_id % 50 / 10::DOUBLE AS mu FROM documents), n AS (SELECT *, 2 / (2 + mu) AS p, 1 - 2 / (2 + mu) AS q FROM m)
SELECT doc_id, round(CASE WHEN mu <= 0 THEN 0 ELSE 1 - p * p * (1 + 2 * q + 3 * q * q) END, 9) AS nb, round(CASE WHEN mu <= 0 THEN 0 ELSE 1 - exp(-mu) * (1 + mu + mu * mu / 2) END, 9) AS poisson FROM n""")
def breach_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = F.col("doc_id") % 50 / 10
    return table(spark, sf_dir, "documents").select("doc_id", F.round(volume.breach_risk(mu, 0.5), 9).alias("nb"), F.round(volume.breach_risk(mu, 0.0), 9).alias("poisson"))


@query("SELECT source AS resolution_text, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def repeated_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.repeated_resolutions(table(spark, sf_dir, "documents").select(F.col("source").alias("resolution_text")))


_MOOD = [0.05, 0.0499, -0.05, -0.2, 0.0, None]


@query("SELECT doc_id, ['positive', 'neutral', 'negative', 'negative', 'neutral', 'neutral'][doc_id % 6 + 1] AS sentiment FROM documents")
def sentiment_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", context.sentiment_category(one_of([None if m is None else str(m) for m in _MOOD], F.col("doc_id")).cast("double")).alias("sentiment"))


# Injected callables, with plain rules in a model's place


def holds(premise: str, claim: str) -> float:
    if claim == "fr":
        raise ValueError("a failed score")
    return float(claim in premise)


def says(question: str, context: str) -> str:
    if question == "fr":
        raise ValueError("a failed judgment")
    return "yes, NO doubt" if question == context else "No."


def answers(question: str) -> str:
    if question == "de":
        raise ValueError("no model")
    return question.upper()


@query("""WITH x AS (SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, lang <> 'fr' AND contains('a en' || chr(10) || source || chr(10) || 'b de', lang) AS supported, lang <> 'fr' AND contains('a en' || chr(10) || source || chr(10) || 'b de' || chr(10) || 'es', lang) AS in_batches,
  CASE WHEN lang <> 'fr' THEN lang = 'en' END AS relevant, CASE WHEN lang = 'fr' THEN 0.0 ELSE contains('en es', lang)::INT::DOUBLE END AS score, lang = 'de' AS failed FROM x""")
def judged_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", "lang", F.array(F.lit("a en"), "source", F.lit("b de"), F.lit("es")).alias("c"))
    return d.select(
        "doc_id", agents.claim_supported(holds, F.col("lang"), F.slice("c", 1, 3)).alias("supported"), agents.supported_in_batches(lambda f, c: bool(holds(c, f)), F.col("lang"), F.col("c")).alias("in_batches"),
        agents.judge_relevant(says, F.col("lang"), F.lit("en")).alias("relevant"), agents.scored(holds, F.lit("en es"), F.col("lang"), failed=0.0).alias("score"), agents.is_error(agents.answered(answers, F.col("lang"))).alias("failed"),
    )


_FACTS = ['```json\n["a", " - b "]\n```', "1. first\n2) second\n\n", "", None]


@query("SELECT doc_id, ['a|b', 'first|second', 'One here.|Two there!', 'One here.|Two there!'][doc_id % 4 + 1] AS facts FROM documents")
def decomposed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(agents.decompose(one_of(_FACTS, F.col("doc_id")), F.lit("One here. Two there!")), "|").alias("facts"))
