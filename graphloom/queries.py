"""Registered queries of the graph operators over the test tables, each with SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.pack import INVERSES, LATIN, ZH
from graphloom.functions.text import clean_text
from graphloom.operators import curate, evaluate, graph, mentions, merge, preprocess, questions, relations, search
from graphloom.plans.commerce import EDGES_SQL, commerce_edges, load

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return preprocess.spread(load(spark, d, "documents").select("doc_id", "text"))


def _sentences(spark, d):
    return preprocess.document_sentences(_docs(spark, d), LATIN)


def _vocabulary(spark, d):
    """Words of six letters or more of the benchmark: (term, etype)."""
    words = load(spark, d, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("term")).where("length(term) >= 6").distinct()
    return words.withColumn("etype", F.when(F.length("term") < 9, "SHORT").otherwise("LONG"))


# Python-style strip and splitting, as SQL.
_PARAS = r"""lines AS (SELECT doc_id, k AS line, trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS text FROM (SELECT doc_id, unnest(string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\[\d+(?:[-,，]\d+)*\]', '', 'g'), chr(10))) AS l, generate_subscripts(string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\[\d+(?:[-,，]\d+)*\]', '', 'g'), chr(10)), 1) AS k FROM documents)),
told AS (SELECT *, regexp_full_match(text, '[A-Z][a-z]{2,20}\.') AS head, coalesce(last_value(CASE WHEN regexp_full_match(text, '[A-Z][a-z]{2,20}\.') THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), '') AS chapter FROM lines WHERE text <> ''),
paras AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1)::INTEGER AS paragraph_id, chapter, text FROM told WHERE NOT head AND NOT regexp_matches(text, '^\d+(?:\.\d+){1,3}\s+.{0,60}$') AND length(text) >= 8)"""
_SENTS = _PARAS + r""",
pieces AS (SELECT doc_id, paragraph_id, chapter, unnest(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$')) AS p, generate_subscripts(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), 1) AS k FROM paras),
sents AS (SELECT doc_id, paragraph_id, chapter, (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, k) - 1)::INTEGER AS sentence_id, trim(p, ' ' || chr(9) || chr(11) || chr(12)) AS text FROM pieces WHERE length(trim(p, ' ' || chr(9) || chr(11) || chr(12))) >= 6)"""
_VOCAB = r"""vocab AS (SELECT DISTINCT term, CASE WHEN length(term) < 9 THEN 'SHORT' ELSE 'LONG' END AS etype FROM (SELECT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS term FROM benchmark) WHERE length(term) >= 6)"""


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\[\d+(?:[-,，]\d+)*\]', '', 'g'), '[ \t　]+', '', 'g')) AS cleaned FROM documents")
def p1_clean_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(clean_text(F.col("text"))).alias("cleaned"))


@query(f"WITH {_PARAS} SELECT doc_id, paragraph_id, chapter, '' AS section, md5(text) AS text FROM paras")
def p2_p3_p4_paragraphs(spark, d):
    return preprocess.paragraphs(_docs(spark, d), LATIN).withColumn("text", F.md5("text"))


@query(f"WITH {_SENTS} SELECT doc_id, paragraph_id, chapter, sentence_id, md5(text) AS text FROM sents")
def p5_sentences(spark, d):
    return _sentences(spark, d).drop("section").withColumn("text", F.md5("text"))


@query(r"""WITH RECURSIVE raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM raw),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
h AS (SELECT *, regexp_matches(bare, '^第\s*[一二三四五六七八九十百0-9]+\s*章|^\d+(?:\.\d+){0,3}\s') AS head FROM b),
s AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY k) AS sec, last_value(CASE WHEN head THEN bare[:60] END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS lab FROM h),
n AS (SELECT doc_id, sec, coalesce(lab, '导言') AS lab, line, row_number() OVER (PARTITION BY doc_id, sec ORDER BY k) AS n FROM s WHERE NOT head AND bare <> ''),
r AS (SELECT doc_id, sec, lab, n, line, 1 AS part, length(line) AS size FROM n WHERE n = 1
  UNION ALL SELECT n.doc_id, n.sec, n.lab, n.n, n.line, CASE WHEN r.size + length(n.line) > 1800 THEN r.part + 1 ELSE r.part END, CASE WHEN r.size + length(n.line) > 1800 THEN length(n.line) ELSE r.size + length(n.line) END FROM r JOIN n ON n.doc_id = r.doc_id AND n.sec = r.sec AND n.n = r.n + 1),
c AS (SELECT doc_id, sec, lab, part, string_agg(line, chr(10) ORDER BY n) AS text, max(part) OVER (PARTITION BY doc_id, sec) AS parts FROM r GROUP BY doc_id, sec, lab, part)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, part) - 1)::INTEGER AS chunk_id, CASE WHEN parts = 1 THEN lab ELSE lab || ' #' || part END AS label, md5(text) AS text FROM c""")
def p6_chunks(spark, d):
    return preprocess.chunks(_docs(spark, d), pack=LATIN).withColumn("text", F.md5("text"))


@query(f"WITH {_PARAS} SELECT doc_id, chapter, md5(string_agg(text, chr(10) ORDER BY paragraph_id)) AS text FROM paras GROUP BY doc_id, chapter")
def p7_chapter_texts(spark, d):
    return preprocess.chapter_texts(preprocess.paragraphs(_docs(spark, d), LATIN)).withColumn("text", F.md5("text"))


@query(f"WITH {_VOCAB} SELECT term, etype FROM vocab")
def s2_vocabulary(spark, d):
    return _vocabulary(spark, d)


@query(f"""WITH {_SENTS}, {_VOCAB}, hits AS (SELECT doc_id, sentence_id, term, text FROM sents JOIN vocab ON contains(text, term))
SELECT doc_id, sentence_id, term AS mention, (i - 1)::INTEGER AS "start" FROM (SELECT doc_id, sentence_id, term, text, unnest(range(1, length(text) - length(term) + 2)) AS i FROM hits) WHERE substring(text, i, length(term)) = term""")
def n1_vocabulary_mentions(spark, d):
    found = mentions.with_mentions(_sentences(spark, d), _vocabulary(spark, d), LATIN, numeric=False, codes=False, dedup=False)
    return mentions.exploded(found).select("doc_id", "sentence_id", "mention", "start")


def _mentioned(spark, d):
    return mentions.with_mentions(_sentences(spark, d), _vocabulary(spark, d), LATIN)


@query()
def n2_n5_mentions(spark, d):
    return mentions.exploded(_mentioned(spark, d)).select("doc_id", "sentence_id", "mention", "start", "end", "etype")


@query()
def x1_x7_trigger_triples(spark, d):
    return relations.trigger_triples(_mentioned(spark, d), LATIN)


@query(f"""WITH {_SENTS}, {_VOCAB}, m AS (SELECT doc_id, sentence_id, term, etype FROM sents JOIN vocab ON contains(text, term))
SELECT DISTINCT a.term AS entity FROM m AS a JOIN m AS b ON a.doc_id = b.doc_id AND a.sentence_id = b.sentence_id AND a.etype <> b.etype""")
def x17_cooccurring(spark, d):
    found = mentions.with_mentions(_sentences(spark, d), _vocabulary(spark, d), LATIN, numeric=False, codes=False, dedup=False)
    return relations.cooccurring(mentions.exploded(found), _vocabulary(spark, d), LATIN)


@query(f"""WITH {_SENTS}, {_VOCAB}, m AS (SELECT DISTINCT term, etype FROM sents JOIN vocab ON contains(text, term))
SELECT term AS head, 'instance_of' AS relation, CASE etype WHEN 'SHORT' THEN 'short term' ELSE 'long term' END AS tail, 0.92::DOUBLE AS score FROM m""")
def x18_type_triples(spark, d):
    found = mentions.exploded(mentions.with_mentions(_sentences(spark, d), _vocabulary(spark, d), LATIN, numeric=False, codes=False, dedup=False))
    return relations.type_triples(found.select(F.col("mention").alias("entity")), _vocabulary(spark, d), LATIN).select("head", "relation", "tail", "score")


@query(f"""WITH {_SENTS}, {_VOCAB}, hits AS (SELECT chapter, term, text FROM sents JOIN vocab ON contains(text, term) WHERE chapter <> ''),
each AS (SELECT chapter, term, text, unnest(range(1, length(text) - length(term) + 2)) AS i FROM hits),
c AS (SELECT chapter, term, count(*) AS n FROM each WHERE substring(text, i, length(term)) = term GROUP BY chapter, term HAVING count(*) >= 2)
SELECT term AS head, 'discussed_in' AS relation, chapter AS tail, (0.55::DOUBLE + least(0.25::DOUBLE, n * 0.02::DOUBLE)) AS score FROM c""")
def x19_chapter_triples(spark, d):
    found = mentions.exploded(mentions.with_mentions(_sentences(spark, d), _vocabulary(spark, d), LATIN, numeric=False, codes=False, dedup=False))
    return relations.chapter_triples(found, _vocabulary(spark, d)).select("head", "relation", "tail", "score")


@query()
def m2_extraction(spark, d):
    from graphloom.plans.extraction import ExtractionConfig, extract

    return extract(_docs(spark, d), _vocabulary(spark, d), ExtractionConfig(pack=LATIN)).edges


@query("""WITH t AS (SELECT l_returnflag AS head, l_linestatus AS relation, 'L' || l_suppkey AS tail, round(l_discount, 2) AS score, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
b AS (SELECT head, relation, tail, max(score) AS score FROM t GROUP BY ALL)
SELECT head, relation, tail, score, 'scan' AS source FROM b""")
def m2_merge_same_source(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("head"), F.col("l_linestatus").alias("relation"), F.concat(F.lit("L"), "l_suppkey").alias("tail"), F.lit("").alias("trigger"), F.lit("scan").alias("source"), F.round("l_discount", 2).alias("score"), F.lit("").alias("chapter"), F.lit("").alias("sentence"), F.lit(0).alias("stage"), F.lit(0).alias("sentence_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return merge.merge_triples(rows).select("head", "relation", "tail", "score", "source")


@query(f"WITH {EDGES_SQL}, e AS (SELECT *, 'rows of ' || relation AS source FROM edges) SELECT NULL AS source, relation, count(*)::BIGINT AS n FROM e GROUP BY relation UNION ALL SELECT source, NULL, count(*)::BIGINT FROM e GROUP BY source UNION ALL SELECT NULL, NULL, count(*)::BIGINT FROM e")
def m8_statistics(spark, d):
    return merge.statistics(commerce_edges(spark, d).withColumn("source", F.concat(F.lit("rows of "), "relation"))).select("source", "relation", "n")


@query(f"WITH {EDGES_SQL} SELECT head, relation, tail, score FROM edges")
def m5_ranked(spark, d):
    return merge.ranked(commerce_edges(spark, d))


@query(f"WITH {EDGES_SQL} SELECT head, relation, tail, score FROM edges")
def g1_edges(spark, d):
    return commerce_edges(spark, d)


@query(f"WITH {EDGES_SQL} SELECT head AS entity FROM edges UNION SELECT tail FROM edges")
def g2_entities(spark, d):
    return graph.entities(commerce_edges(spark, d))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT relation FROM edges")
def g2_relations(spark, d):
    return graph.relations(commerce_edges(spark, d))


@query(f"WITH {EDGES_SQL} SELECT count(*)::BIGINT AS n FROM edges")
def g12_count(spark, d):
    return commerce_edges(spark, d).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT head, relation, tail, max(score) AS score FROM edges WHERE head = 'ASIA' OR tail = 'ASIA' OR head = 'NATION_2' OR tail = 'NATION_2' GROUP BY ALL")
def g3_triples_of(spark, d):
    e = commerce_edges(spark, d)
    return graph.triples_of(e, "ASIA").unionByName(graph.triples_of(e, "NATION_2")).select("head", "relation", "tail", "score").distinct()


@query(f"WITH {EDGES_SQL} SELECT head, relation, tail, score FROM edges WHERE tail = 'NATION_2' AND relation = 'located_at' UNION ALL SELECT head, relation, tail, score FROM edges WHERE head = 'NATION_2'")
def g4_in_and_out_edges(spark, d):
    e = commerce_edges(spark, d)
    return graph.in_edges(e, "NATION_2", "located_at").unionByName(graph.out_edges(e, "NATION_2"))


@query(f"WITH {EDGES_SQL} SELECT head, relation, tail, score FROM edges WHERE relation = 'part_of'")
def g5_with_relation(spark, d):
    return graph.with_relation(commerce_edges(spark, d), "part_of")


@query(f"WITH {EDGES_SQL} SELECT head, relation, tail, score FROM edges WHERE (head = 'NATION_2' AND tail = 'ASIA') OR (head = 'ASIA' AND tail = 'NATION_2')")
def g6_related(spark, d):
    return graph.related(commerce_edges(spark, d), "ASIA", "NATION_2")


_PATH_EDGES = EDGES_SQL + ", u AS (SELECT head AS a, tail AS b FROM edges UNION SELECT tail, head FROM edges)"


@query(f"""WITH {_PATH_EDGES}, pairs AS (SELECT x.n_name AS s, y.n_name AS t FROM nation AS x JOIN nation AS y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name),
two AS (SELECT s, t, 2 AS hops, [s, p.b, t] AS nodes FROM pairs JOIN u AS p ON p.a = s JOIN u AS q ON q.a = p.b AND q.b = t WHERE p.b <> s AND p.b <> t
UNION ALL SELECT s, t, 3, [s, p.b, q.b, t] FROM pairs JOIN u AS p ON p.a = s JOIN u AS q ON q.a = p.b JOIN u AS r ON r.a = q.b AND r.b = t WHERE p.b <> s AND p.b <> t AND q.b <> s AND q.b <> t AND q.b <> p.b
UNION ALL SELECT s, t, 1, [s, t] FROM pairs JOIN u ON a = s AND b = t),
r AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY hops, nodes) AS k FROM two)
SELECT s AS source, t AS target, hops, array_to_string(nodes, '|') AS nodes FROM r WHERE k <= 6""")
def g7_paths(spark, d):
    n = load(spark, d, "nation")
    ends = n.alias("x").join(n.alias("y"), (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_name") < F.col("y.n_name"))).select(F.col("x.n_name").alias("source"), F.col("y.n_name").alias("target"))
    found = graph.paths(commerce_edges(spark, d), ends)
    return found.select("source", "target", "hops", F.array_join("nodes", "|").alias("nodes"))


@query(f"""WITH {_PATH_EDGES}, d1 AS (SELECT DISTINCT r_name AS seed, b AS entity FROM region JOIN u ON a = r_name WHERE b <> r_name),
d2 AS (SELECT DISTINCT d1.seed, u.b AS entity FROM d1 JOIN u ON u.a = d1.entity WHERE u.b <> d1.seed EXCEPT SELECT seed, entity FROM d1)
SELECT r_name AS seed, r_name AS entity, 0 AS depth FROM region UNION ALL SELECT seed, entity, 1 FROM d1 UNION ALL SELECT seed, entity, 2 FROM d2""")
def g8_frontier(spark, d):
    seeds = load(spark, d, "region").select(F.col("r_name").alias("entity"))
    return graph.frontier(commerce_edges(spark, d), seeds, 2)


@query(f"""WITH {EDGES_SQL}, k AS (SELECT * FROM edges WHERE score >= 0.8 AND relation IN ('located_at', 'part_of')), u AS (SELECT head AS a, tail AS b FROM k UNION SELECT tail, head FROM k),
n AS (SELECT 'ASIA' AS e UNION SELECT b FROM u WHERE a = 'ASIA' UNION SELECT y.b FROM u AS x JOIN u AS y ON y.a = x.b WHERE x.a = 'ASIA')
SELECT head, relation, tail, score FROM k WHERE head IN (SELECT e FROM n) AND tail IN (SELECT e FROM n)""")
def g9_filtered_neighbourhood(spark, d):
    return graph.neighbourhood(commerce_edges(spark, d), "ASIA", 2, None, 0.8, ("located_at", "part_of"))


@query(f"WITH {EDGES_SQL} SELECT entity, count(*)::BIGINT AS degree FROM (SELECT head AS entity FROM edges UNION ALL SELECT tail FROM edges) GROUP BY entity")
def g10_degrees(spark, d):
    return graph.degrees(commerce_edges(spark, d))


@query(f"""WITH {EDGES_SQL}, b AS (SELECT head AS entity, head, relation, tail, score FROM edges UNION ALL SELECT tail, head, relation, tail, score FROM edges),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, head, relation, tail) AS k FROM b) SELECT entity, k::INTEGER AS "rank", head, relation, tail, score FROM r WHERE k <= 5""")
def g3_top_neighbours(spark, d):
    return graph.top_neighbours(commerce_edges(spark, d), 5)


@query(f"WITH {EDGES_SQL}, a AS (SELECT DISTINCT head, relation, tail FROM edges WHERE relation = 'part_of'), s AS (SELECT head, relation, tail FROM edges WHERE score >= 0.9 UNION SELECT * FROM a) SELECT s.*, a.head IS NOT NULL AS in_answer FROM s LEFT JOIN a USING (head, relation, tail)")
def g11_highlighted(spark, d):
    e = commerce_edges(spark, d)
    return graph.highlighted(e.where("score >= 0.9"), graph.with_relation(e, "part_of"))


@query(f"WITH {EDGES_SQL} SELECT tail AS head, 'contains' AS relation, head AS tail, score FROM edges WHERE relation = 'located_at'")
def g_inverse_edges(spark, d):
    return graph.inverse_edges(commerce_edges(spark, d), INVERSES)


@query(f"WITH {EDGES_SQL} SELECT relation, count(*)::BIGINT AS n FROM edges GROUP BY relation ORDER BY n DESC, relation LIMIT 20")
def v1_relation_counts(spark, d):
    return graph.relation_counts(commerce_edges(spark, d))


@query(f"""WITH {EDGES_SQL} SELECT head, relation, tail, CASE WHEN relation IN ('located_at', 'part_of') THEN 'place' ELSE 'other' END AS relation_group, CASE WHEN score >= 0.85 THEN 'strong' WHEN score >= 0.65 THEN 'fair' ELSE 'weak' END AS band,
(row_number() OVER (PARTITION BY least(head, tail), greatest(head, tail) ORDER BY head, relation, tail) - 1)::INTEGER AS parallel FROM edges""")
def v2_styled(spark, d):
    return graph.styled(commerce_edges(spark, d), {"place": ("located_at", "part_of")}).drop("score")


def _pred_gold(spark, d):
    """Predicted: parts by type and brand; gold: by type, and by brand for those of size over 25 as another relation."""
    p = load(spark, d, "part")
    pred = p.select(F.col("p_name").alias("head"), F.lit("is_a").alias("relation"), F.col("p_type").alias("tail")).union(p.where("p_size > 10").select("p_name", F.lit("has"), "p_brand"))
    gold = p.where("p_size <= 40").select(F.col("p_name").alias("head"), F.lit("属于").alias("relation"), F.col("p_type").alias("tail")).union(p.select("p_name", F.when(F.col("p_size") > 25, "has_part").otherwise("used_for"), "p_brand"))
    return evaluate.keys(pred), evaluate.keys(gold)


_PG = """pred AS (SELECT DISTINCT p_name AS h, 'is_a' AS r, p_type AS t FROM part UNION SELECT p_name, 'has_part', p_brand FROM part WHERE p_size > 10),
gold AS (SELECT DISTINCT p_name AS h, 'is_a' AS r, p_type AS t FROM part WHERE p_size <= 40 UNION SELECT p_name, CASE WHEN p_size > 25 THEN 'has_part' ELSE 'used_for' END, p_brand FROM part)"""
_RATIOS = "tp::BIGINT AS tp, np::BIGINT AS n_pred, ng::BIGINT AS n_gold, tp / np AS \"precision\", tp / ng AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END AS f1"


def _level(name: str, cols: str, p: str = "pred", g: str = "gold") -> str:
    return f"SELECT '{name}' AS level, (SELECT count(*) FROM (SELECT {cols} FROM {p} INTERSECT SELECT {cols} FROM {g})) AS tp, (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {p})) AS np, (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {g})) AS ng"


@query(f"WITH {_PG}, pe AS (SELECT h AS e FROM pred UNION SELECT t FROM pred), ge AS (SELECT h AS e FROM gold UNION SELECT t FROM gold), l AS ({_level('strict', 'h, r, t')} UNION ALL {_level('pair', 'h, t')} UNION ALL {_level('entity', 'e', 'pe', 'ge')}) SELECT level, {_RATIOS} FROM l")
def e2_e9_levels(spark, d):
    return evaluate.levels(*_pred_gold(spark, d))


@query(f"WITH {_PG} SELECT coalesce(p.h, g.h) AS head, coalesce(p.r, g.r) AS relation, coalesce(p.t, g.t) AS tail, CASE WHEN p.h IS NULL THEN 'fn' WHEN g.h IS NULL THEN 'fp' ELSE 'tp' END AS outcome FROM pred AS p FULL JOIN gold AS g ON p.h = g.h AND p.r = g.r AND p.t = g.t")
def e13_outcomes(spark, d):
    return evaluate.marked(*_pred_gold(spark, d), evaluate.KEY)


@query(f"""WITH {_PG}, rel AS (SELECT DISTINCT r FROM gold), l AS (SELECT r AS relation, (SELECT count(*) FROM pred AS p JOIN gold AS g ON p.h = g.h AND p.r = g.r AND p.t = g.t WHERE g.r = rel.r) AS tp, (SELECT count(*) FROM pred WHERE pred.r = rel.r) AS np, (SELECT count(*) FROM gold WHERE gold.r = rel.r) AS ng FROM rel)
SELECT relation, tp::BIGINT AS tp, np::BIGINT AS n_pred, ng::BIGINT AS n_gold, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS "precision", tp / ng AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END AS f1 FROM l""")
def e10_by_relation(spark, d):
    return evaluate.by_relation(*_pred_gold(spark, d))


@query(f"WITH {_PG}, rel AS (SELECT DISTINCT r FROM gold), l AS (SELECT (SELECT count(*) FROM pred AS p JOIN gold AS g ON p.h = g.h AND p.r = g.r AND p.t = g.t WHERE g.r = rel.r) AS tp, (SELECT count(*) FROM pred WHERE pred.r = rel.r) AS np, (SELECT count(*) FROM gold WHERE gold.r = rel.r) AS ng FROM rel) SELECT round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) END), 9) AS macro_f1 FROM l")
def e11_macro(spark, d):
    return evaluate.macro_f1(evaluate.by_relation(*_pred_gold(spark, d))).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {_PG}, o AS (SELECT h, t, max(r) AS gr FROM gold GROUP BY h, t) SELECT gr AS gold_relation, r AS pred_relation, count(*)::BIGINT AS n FROM pred JOIN o USING (h, t) WHERE r <> gr GROUP BY gr, r ORDER BY n DESC, gr, r LIMIT 12")
def e12_confusions(spark, d):
    return evaluate.confusions(*_pred_gold(spark, d))


@query()
def e8_partial(spark, d):
    return evaluate.partial_prf(*_pred_gold(spark, d))


@query(f"""WITH {_PG}, pe AS (SELECT h AS e FROM pred UNION SELECT t FROM pred), ge AS (SELECT h AS e FROM gold UNION SELECT t FROM gold),
o AS (SELECT coalesce(p.h, g.h) AS h, coalesce(p.r, g.r) AS r, coalesce(p.t, g.t) AS t, p.h IS NULL AS fn FROM pred AS p FULL JOIN gold AS g ON p.h = g.h AND p.r = g.r AND p.t = g.t WHERE p.h IS NULL OR g.h IS NULL),
b AS (SELECT CASE WHEN fn THEN 'fn' ELSE 'fp' END AS outcome, CASE WHEN fn THEN CASE WHEN h IN (SELECT e FROM pe) AND t IN (SELECT e FROM pe) THEN 'A' WHEN h IN (SELECT e FROM pe) THEN 'B' WHEN t IN (SELECT e FROM pe) THEN 'C' ELSE 'D' END
  ELSE CASE WHEN h IN (SELECT e FROM ge) AND t IN (SELECT e FROM ge) THEN 'C' WHEN h IN (SELECT e FROM ge) OR t IN (SELECT e FROM ge) THEN 'D' ELSE 'E' END END AS bucket FROM o)
SELECT outcome, bucket, count(*)::BIGINT AS n FROM b GROUP BY ALL""")
def t3_error_buckets(spark, d):
    return curate.error_buckets(*_pred_gold(spark, d))


@query(f"WITH {_PG}, typed AS (SELECT DISTINCT h FROM gold WHERE r = 'is_a') SELECT h AS head, r AS relation, t AS tail FROM gold UNION ALL SELECT h, r, t FROM pred WHERE r = 'is_a' AND length(h) BETWEEN 2 AND 11 AND NOT regexp_matches(h, '^\\d') AND NOT contains(h, '_') AND NOT regexp_matches(h, '%|倍|m/s|/|°') AND (h, r, t) NOT IN (SELECT h, r, t FROM gold) AND h NOT IN (SELECT h FROM typed)")
def t2_augment_gold(spark, d):
    pred, gold = _pred_gold(spark, d)
    return curate.augment_gold(gold, pred, "is_a")


@query(f"WITH {_VOCAB} SELECT term, etype FROM vocab AS l WHERE NOT (length(term) >= 8 AND EXISTS (SELECT 1 FROM vocab AS s WHERE length(s.term) BETWEEN 2 AND 7 AND NOT regexp_matches(s.term, '^[A-Za-z0-9]') AND contains(l.term, s.term)))")
def t6_prune_long_terms(spark, d):
    return curate.prune_long_terms(_vocabulary(spark, d))


def _sid(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("sid"), "text")


@query("SELECT doc_id AS sid, md5(text) AS text FROM documents WHERE contains(text, 'the') ORDER BY doc_id LIMIT 20")
def c1_search(spark, d):
    return search.search(_sid(spark, d), "the").withColumn("text", F.md5("text"))


@query("SELECT doc_id AS sid, CASE WHEN contains(text, 'eux') THEN 0 WHEN contains(text, 'sch') THEN 1 ELSE 2 END AS arg FROM documents WHERE contains(text, 'eux') OR contains(text, 'sch') OR contains(text, 'ción')")
def c2_search_any(spark, d):
    return search.search_any(_sid(spark, d), "eux", "sch", "ción", limit=None).select("sid", "arg")


@query("SELECT doc_id AS sid FROM documents WHERE contains(text, 'the') AND contains(text, 'ing') AND contains(text, 'ed')")
def c3_search_all(spark, d):
    return search.search_all(_sid(spark, d), "the", "ing", "ed", limit=None).select("sid")


@query("SELECT doc_id AS sid, length(text) AS n FROM (SELECT * FROM documents WHERE contains(text, 'the') AND contains(text, 'ing') ORDER BY doc_id LIMIT 20) ORDER BY length(text), doc_id LIMIT 10")
def c4_search_pair(spark, d):
    return search.search_pair(_sid(spark, d), "the", "ing").select("sid", F.length("text").cast("long").alias("n"))


@query(f"WITH {EDGES_SQL}, e AS (SELECT head AS entity FROM edges UNION SELECT tail FROM edges) SELECT entity, levenshtein(entity, 'INDIAN')::INTEGER AS edits FROM e ORDER BY edits, entity LIMIT 6")
def c5_close_by_edits(spark, d):
    return search.close_by_edits(graph.entities(commerce_edges(spark, d)), "INDIAN")


@query()
def c5_close_matches(spark, d):
    return search.close_matches(graph.entities(commerce_edges(spark, d)), "INDIAN")


FORMS = (("请问{}是什么？", "是什么", "DEFINITION"), ("{}在哪", "在哪", "LOCATION"), ("列举{}", "", "LIST_INSTANCE"), ("{}有什么属性", "有什么属性", "PROPERTY"), ("介绍{}", "", "SUMMARY"), ("{}影响什么", "影响什么", "EFFECT"))


def _asked(spark, d):
    """Nations, suppliers, types and names of parts."""
    n, s, p = (load(spark, d, t) for t in ("nation", "supplier", "part"))
    return n.select(F.col("n_name").alias("entity")).union(s.select("s_name")).union(p.select("p_type")).union(p.select("p_name")).distinct()


def _questions(spark, d):
    forms = F.posexplode(F.array(*(F.lit(f) for f, *_ in FORMS))).alias("k", "form")
    return _asked(spark, d).select("entity", forms).select(F.concat_ws("-", "entity", "k").alias("qid"), F.replace("form", F.lit("{}"), F.col("entity")).alias("question"))


_ASKED = "asked AS (SELECT n_name AS entity FROM nation UNION SELECT s_name FROM supplier UNION SELECT p_type FROM part UNION SELECT p_name FROM part)"


@query(f"WITH {_ASKED} " + " UNION ALL ".join(f"SELECT entity || '-{k}' AS qid, '{'列举' if k == 2 else '介绍' if k == 4 else ''}' || entity || '{tail}' AS q, '{kind}' AS intent FROM asked" for k, (_, tail, kind) in enumerate(FORMS)))
def q1_q2_intents(spark, d):
    q = questions.clean_question(F.col("question"))
    return _questions(spark, d).select("qid", q.alias("q"), questions.intent(q, ZH)["intent"].alias("intent"))


@query(f"WITH {_ASKED} SELECT entity || '-' || k AS qid, entity AS first FROM asked, range(0, 6) AS u(k)")
def q3_entities(spark, d):
    parsed = questions.parse_questions(_questions(spark, d), _asked(spark, d))
    return parsed.select("qid", F.get("entities", F.lit(0)).alias("first"))


@query(f"""WITH {EDGES_SQL}, {_ASKED}, e AS (SELECT head, relation, tail, max(score) AS score FROM edges GROUP BY ALL),
f AS (SELECT entity || '-0' AS qid, 'DEFINITION' AS intent, 8 AS most, e.* FROM asked JOIN e ON head = entity WHERE relation IN ('instance_of', 'is_a')
UNION ALL SELECT entity || '-1', 'LOCATION', 8, e.* FROM asked JOIN e ON head = entity WHERE relation = 'located_at'
UNION ALL SELECT entity || '-2', 'LIST_INSTANCE', 15, e.* FROM asked JOIN e ON tail = entity WHERE relation = 'instance_of'
UNION ALL SELECT entity || '-3', 'PROPERTY', 12, e.* FROM asked JOIN e ON head = entity WHERE relation = 'made_of'
UNION ALL SELECT entity || '-4', 'SUMMARY', 15, e.* FROM asked JOIN e ON head = entity OR tail = entity),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY -score, relation, head, tail) AS k FROM f) SELECT qid, intent, k::INTEGER AS "rank", head, relation, tail, score FROM r WHERE k <= most""")
def q4_q12_retrieval(spark, d):
    return questions.retrieve(questions.parse_questions(_questions(spark, d), _asked(spark, d)), commerce_edges(spark, d))


@query()
def q16_answers(spark, d):
    from graphloom.plans.extraction import answer

    return answer(_questions(spark, d), commerce_edges(spark, d), load(spark, d, "documents").select(F.col("doc_id").alias("sid"), "text"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS \"start\", event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    from graphloom.streaming.incremental import windowed_counts

    return windowed_counts(load(spark, d, "events"), "ts", "event_type")
