"""Queries of row scores and their aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import choice, instructions, sequence, spans, text
from ..operators import aggregates as agg
from .registry import query

#: Gold and predicted return flags: a letter by line number and quantity.
FLAGS = "SELECT l_orderkey, l_suppkey, l_returnflag AS gold, CASE CAST(l_linenumber + l_quantity AS BIGINT) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS pred FROM lineitem"
#: The item of a document is worked out before the join, so that columns alone are compared in it.
PAIRS = "SELECT d.doc_id, d.text AS pred, b.text AS gold FROM (SELECT doc_id, text, doc_id % (SELECT count(*) FROM benchmark) AS item FROM documents) d JOIN benchmark b ON d.item = b.item_id"


def flags(t):
    n = (F.col("l_linenumber") + F.col("l_quantity")).cast("bigint") % 3
    return t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("gold"), F.when(n == 0, "A").when(n == 1, "N").otherwise("R").alias("pred"))


def pairs(t):
    """Each document with a benchmark item as its gold text; the benchmark is a small fixed table."""
    b = t("benchmark").select("item_id", F.col("text").alias("gold"))
    n = b.agg(F.count(F.lit(1)).alias("n"))
    return t("documents").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(b, "item_id").select("doc_id", F.col("text").alias("pred"), "gold")


def six(c):
    return F.round(c, 6)


@query("SELECT source, round(avg(CASE WHEN (n_chars >= 800) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS acc, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def acc_by_source(t):
    right = ((F.col("n_chars") >= 800) == (F.col("quality") == 1)).cast("double")
    return t("documents").select("doc_id", "source", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id").groupBy("source").agg(six(agg.mean(right)).alias("acc"), F.count(F.lit(1)).alias("n"))


F1_SQL = """WITH r AS ({flags}), l AS (SELECT {k} gold AS label, 1 AS g, 0 AS p, CASE WHEN gold = pred THEN 1 ELSE 0 END AS tp FROM r
UNION ALL SELECT {k} pred, 0, 1, 0 FROM r), s AS (SELECT {k} label, sum(g) AS g, sum(p) AS p, sum(tp) AS tp FROM l GROUP BY {k} label)
SELECT {k} round(avg(CAST(2 * tp AS DOUBLE) / (g + p)), 6) AS f1_macro FROM s {group}"""


@query(F1_SQL.format(flags=FLAGS, k="", group=""))
def f1_macro(t):
    return agg.f1_macro(flags(t), "gold", "pred").select(six("f1_macro").alias("f1_macro"))


@query(F1_SQL.format(flags=FLAGS, k="l_suppkey,", group="GROUP BY l_suppkey"))
def f1_macro_by_group(t):
    return agg.f1_macro(flags(t), "gold", "pred", ("l_suppkey",)).select("l_suppkey", six("f1_macro").alias("f1_macro"))


@query(f"""WITH r AS ({FLAGS}), g AS (SELECT gold AS label, CAST(count(*) AS DOUBLE) AS g FROM r GROUP BY 1),
p AS (SELECT pred AS label, CAST(count(*) AS DOUBLE) AS p FROM r GROUP BY 1), j AS (SELECT coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p USING (label)),
s AS (SELECT sum(p * g) AS pt, sum(p * p) AS pp, sum(g * g) AS tt, sum(g) AS s FROM j), c AS (SELECT CAST(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS DOUBLE) AS c FROM r)
SELECT round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc FROM s, c""")
def mcc(t):
    return agg.mcc(flags(t), "gold", "pred").select(six("mcc").alias("mcc"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= l_tax AND l_discount >= l_quantity / 50 THEN 'A' WHEN l_tax >= l_quantity / 50 THEN 'B' ELSE 'C' END AS choice, count(*) AS n
FROM lineitem GROUP BY ALL""")
def choice_argmax(t):
    probs = F.array(*[F.struct(F.lit(c).alias("choice"), p.cast("double").alias("prob")) for c, p in zip("ABC", (F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50))])
    return t("lineitem").select("l_orderkey", "l_linenumber", choice.argmax(probs).alias("choice")).groupBy("l_orderkey", "l_linenumber", "choice").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT o_orderpriority, o_orderkey, CASE WHEN s = 0 THEN o_totalprice > 100000 ELSE o_custkey % 2 = 0 END AS val FROM orders, (SELECT unnest([0, 1]) AS s)),
p AS (SELECT o_orderpriority, o_orderkey, min(CAST(val AS INTEGER)) AS v FROM v GROUP BY ALL) SELECT o_orderpriority, round(avg(v), 6) AS acc FROM p GROUP BY 1""")
def paired_accuracy(t):
    both = t("orders").withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("val", F.when(F.col("s") == 0, F.col("o_totalprice") > 100000).otherwise(F.col("o_custkey") % 2 == 0))
    return agg.paired_accuracy(both, "val", "o_orderkey", ("o_orderpriority",)).select("o_orderpriority", six("acc").alias("acc"))


@query("""WITH s AS (SELECT n_regionkey, n_nationkey, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
c AS (SELECT n_regionkey, avg(v) AS v FROM s GROUP BY 1) SELECT round(avg(v), 6) AS acc FROM c""")
def mean_of_means(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("val", (F.col("c_acctbal") > 0).cast("double"))
    return agg.mean_of_means(rows, "val", "n_nationkey", "n_regionkey").select(six("acc").alias("acc"))


@query("""SELECT (greatest(n_chars // 1000, 1))::VARCHAR || 'k' AS bucket, CAST(greatest(n_chars // 1000, 1) AS INTEGER) AS size, round(avg(CAST(quality AS DOUBLE)), 3) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def length_bucket_mean(t):
    bucket = F.concat(F.greatest(F.floor(F.col("n_chars") / 1000), F.lit(1)).cast("string"), F.lit("k"))
    return agg.bucket_mean(t("documents").select("doc_id", bucket.alias("bucket")).join(t("labels"), "doc_id"), "quality", "bucket")


@query("WITH s AS (SELECT l_linenumber, sum(l_quantity) AS s FROM lineitem GROUP BY 1) SELECT round(avg(s / 34), 6) AS grade_norm FROM s")
def variant_sum_norm(t):
    return agg.variant_sum(t("lineitem"), "l_quantity", "l_linenumber").select(six("grade_norm").alias("grade_norm"))


TAGS = ["t", "a", "o", "zz"]
ENTITIES = r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS entity FROM documents),
g AS (SELECT doc_id, lower(entity[1]) AS tag, entity, count(*) AS g FROM w WHERE lower(entity[1]) IN ('t', 'a', 'o') GROUP BY ALL),
p AS (SELECT doc_id - 1 AS doc_id, tag, entity, g AS p FROM g),
c AS (SELECT doc_id, tag, entity, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p USING (doc_id, tag, entity)),
s AS (SELECT tag, sum(least(g, p)) AS tp, sum(greatest(g - p, 0)) AS fn, sum(greatest(p - g, 0)) AS fp FROM c GROUP BY tag)"""


def entity_counts(t):
    """Words by first letter as entities; the next document's are the predictions."""
    words = t("documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("entity")).withColumn("tag", F.lower(F.substring("entity", 1, 1))).filter(F.col("tag").isin(*TAGS[:3]))
    keys = ["doc_id", "tag", "entity"]
    counts = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # Shifted beside the own ones and summed again, a word's counts meet in one shuffle.
    own, next_ = counts.select(*keys, F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p")), counts.select((F.col("doc_id") - 1).alias("doc_id"), "tag", "entity", F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"))
    return agg.counted(own.unionByName(next_), keys)


@query(ENTITIES + " SELECT tag, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp FROM s")
def ner_counts(t):
    return entity_counts(t).groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])


@query(ENTITIES + " SELECT tag, round(coalesce(2.0 * tp / (2 * tp + fn + fp), 0), 6) AS f1 FROM (SELECT unnest(['t', 'a', 'o', 'zz']) AS tag) LEFT JOIN s USING (tag)")
def ner_f1_macro(t):
    return agg.tag_f1(entity_counts(t), TAGS).select("tag", six("f1").alias("f1"))


MULTI = """WITH a AS (SELECT l_suppkey % 50 AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey % 50 AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'N'),
i AS (SELECT * FROM a INTERSECT ALL SELECT * FROM b), x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
SELECT 'intersect' AS op, k, v, count(*) AS n FROM i GROUP BY ALL UNION ALL SELECT 'subtract', k, v, count(*) FROM x GROUP BY ALL
UNION ALL SELECT 'add', k, v, count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT 'union', k, v, count(*) FROM (SELECT * FROM x UNION ALL SELECT * FROM b) GROUP BY ALL"""


@query(MULTI)
def multiset_ops(t):
    rows = t("lineitem").select((F.col("l_suppkey") % 50).alias("k"), F.col("l_linenumber").alias("v"), "l_returnflag")
    a, b = (rows.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AN")
    out = None
    for op in ("intersect", "subtract", "add", "union"):
        one = agg.multiset(a, b, ["k", "v"], op).select(F.lit(op).alias("op"), "k", "v", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, label AS g, CAST(vec_id % 2 AS INTEGER) AS rel, round(list_sum(list_transform(list_zip(embedding, q), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 4) AS s FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, vec_id) AS k, sum(rel) OVER (PARTITION BY g) AS n FROM d),
e AS (SELECT g, CAST(sum(CASE WHEN k <= n THEN rel ELSE 0 END) AS DOUBLE) / nullif(max(n), 0) AS v FROM r GROUP BY g) SELECT round(avg(v), 6) AS r_precision FROM e""")
def r_precision(t):
    q = t("embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = t("embeddings").crossJoin(F.broadcast(q)).select("vec_id", F.col("label").alias("g"), (F.col("vec_id") % 2).alias("rel"), F.round(dot, 4).alias("s"))
    return agg.r_precision(rows, "g", "rel", "s", "vec_id").select(six("r_precision").alias("r_precision"))


SQUAD = r"""array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"""
WORDS = "list_filter(string_split_regex({0}, '[\\x09-\\x0D ]+'), lambda x: x <> '')"
#: Token lists p and g of x, unnested once and counted.
OVERLAP = """t AS (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i, 1 AS p, 0 AS g FROM x UNION ALL SELECT doc_id, unnest(g), generate_subscripts(g, 1), 0, 1 FROM x),
{grams}c AS (SELECT doc_id, w, sum(p) AS p, sum(g) AS g FROM {rows} GROUP BY ALL), o AS (SELECT doc_id, sum(least(p, g)) AS same, sum(p) AS np, sum(g) AS ng FROM c GROUP BY doc_id)"""
ONES = OVERLAP.format(grams="", rows="t")
TWOS = OVERLAP.format(grams="u AS (SELECT doc_id, p, g, w || ' ' || lead(w) OVER (PARTITION BY doc_id, p ORDER BY i) AS w FROM t), ", rows="u WHERE w IS NOT NULL")
F1 = "round(CASE WHEN coalesce(same, 0) > 0 THEN 2.0 * same / (np + ng) ELSE 0 END, 6)"


@query(f"""WITH q AS MATERIALIZED (SELECT doc_id, {SQUAD.format('pred')} AS a, {SQUAD.format('gold')} AS b FROM ({PAIRS})),
x AS MATERIALIZED (SELECT doc_id, string_split(a, ' ') AS p, string_split(b, ' ') AS g, a = b AS em, a = '' OR b = '' AS none FROM q), {ONES}
SELECT doc_id, round(CASE WHEN none THEN CAST(em AS INTEGER) WHEN coalesce(same, 0) > 0 THEN 2.0 * same / (np + ng) ELSE 0 END, 6) AS f1, CAST(em AS DOUBLE) AS em FROM x LEFT JOIN o USING (doc_id)""")
def squad_f1_em(t):
    plain = pairs(t).select("doc_id", text.squad_normal(F.col("pred")).alias("p"), text.squad_normal(F.col("gold")).alias("g"))
    rows = plain.select("doc_id", (F.col("p") == F.col("g")).cast("double").alias("em"), sequence.overlap()(text.words(F.col("p")), text.words(F.col("g"))).alias("o"))
    empty = (F.col("o.np") == 0) | (F.col("o.ng") == 0)
    f1 = F.when(empty, (F.col("o.np") == F.col("o.ng")).cast("double")).otherwise(text.f_measure(F.col("o.same"), F.col("o.np"), F.col("o.ng")))
    return rows.select("doc_id", six(f1).alias("f1"), "em")


ROUGE = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+'), lambda x: x <> '')"


def rouge_sql(counts):
    return f"""WITH q AS ({PAIRS}), x AS MATERIALIZED (SELECT doc_id, {ROUGE.format('pred')} AS p, {ROUGE.format('gold')} AS g FROM q), {counts}
SELECT doc_id, {F1} AS f FROM x LEFT JOIN o USING (doc_id)"""


def overlap_f1(rows, n, name):
    """F-measure of the n-grams of the token arrays pred and gold; nothing is shuffled."""
    counted = rows.select("doc_id", sequence.overlap(n)(F.col("pred"), F.col("gold")).alias("o"))
    return counted.select("doc_id", six(text.f_measure(F.col("o.same"), F.col("o.np"), F.col("o.ng"))).alias(name))


def rouge_rows(t, n):
    tokens = lambda c: text.rouge_tokens(F.col(c)).alias(c)
    return overlap_f1(pairs(t).select("doc_id", tokens("pred"), tokens("gold")), n, "f")


@query(rouge_sql(ONES))
def rouge_1(t):
    return rouge_rows(t, 1)


@query(rouge_sql(TWOS))
def rouge_2(t):
    return rouge_rows(t, 2)


#: A row of the table of common subsequences as one integer, folded over the places at which the gold text has each word of the other.
@query(f"""WITH q AS ({PAIRS}), x AS MATERIALIZED (SELECT doc_id, {ROUGE.format('pred')} AS p, {ROUGE.format('gold')} AS g FROM q),
k AS (SELECT doc_id, w, sum(CAST(power(2, i - 1) AS HUGEINT)) AS mask FROM (SELECT doc_id, unnest(g) AS w, generate_subscripts(g, 1) AS i FROM x) GROUP BY ALL),
m AS (SELECT t.doc_id, list(mask ORDER BY i) AS ms FROM (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM x) t JOIN k USING (doc_id, w) GROUP BY 1),
f AS (SELECT x.doc_id, len(p) AS np, len(g) AS ng, ms, CAST(power(2, len(g)) AS HUGEINT) - 1 AS whole FROM x JOIN m USING (doc_id)),
r AS (SELECT doc_id, np, ng, ng - bit_count(list_reduce(list_prepend(whole, ms), lambda row, h: ((row + (row & h)) | (row - (row & h))) & whole)) AS same FROM f)
SELECT x.doc_id, round(coalesce(2.0 * same / (np + ng), 0), 6) AS f FROM x LEFT JOIN r USING (doc_id)""")
def rouge_l(t):
    return pairs(t).select("doc_id", six(sequence.rouge_l(text.rouge_tokens(F.col("pred")), text.rouge_tokens(F.col("gold")))).alias("f"))


LIBRA = r"array_to_string(list_transform(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> ''), lambda w: regexp_replace(lower(w), '[^a-zа-яй0-9_]+', '', 'g')), ' ')"


@query(f"""WITH q AS (SELECT p.*, lang FROM ({PAIRS}) p JOIN documents USING (doc_id)), n AS MATERIALIZED (SELECT doc_id, {LIBRA.format('pred')} AS p, {LIBRA.format('gold')} AS g, {LIBRA.format('lang')} AS l FROM q)
SELECT doc_id, CAST(contains(p, g) OR contains(p, l) AS DOUBLE) AS em FROM n""")
def libra_em(t):
    """Best over two gold answers: the benchmark's passage and the name of the language."""
    rows = pairs(t).join(t("documents").select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", text.libra_score(F.lit("em"), F.col("pred"), F.array("gold", "lang")).alias("em"))


@query(f"""WITH q AS ({PAIRS}), x AS MATERIALIZED (SELECT doc_id, {WORDS.format(LIBRA.format('pred'))} AS p, {WORDS.format(LIBRA.format('gold'))} AS g FROM q), {ONES}
SELECT doc_id, {F1} AS f1 FROM x LEFT JOIN o USING (doc_id)""")
def libra_f1(t):
    tokens = lambda c: text.words(text.libra_normal(F.col(c))).alias(c)
    return overlap_f1(pairs(t).select("doc_id", tokens("pred"), tokens("gold")), 1, "f1")


@query("""SELECT event_id, round(CASE WHEN len(n) = 0 THEN 0 ELSE len(list_filter(n, lambda x: x = CAST(user_id AS VARCHAR))) / len(n) END, 6) AS score FROM (SELECT event_id, user_id, regexp_extract_all(props || ' ' || user_id, '[0-9]+') AS n FROM events)""")
def libra_count(t):
    said = F.concat(F.col("props"), F.lit(" "), F.col("user_id").cast("string"))
    return t("events").select("event_id", six(text.libra_count(said, F.col("user_id"))).alias("score"))


EXAM = "SELECT p_partkey, replace(p_name, ' ', ',') AS ans, replace(p_name, ' ', ', ') || CASE WHEN p_size % 2 = 0 THEN ',x' ELSE '' END AS pred, p_size FROM part"


def exam(t):
    return t("part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(",")).alias("ans"), F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.when(F.col("p_size") % 2 == 0, ",x").otherwise("")).alias("pred"), "p_size")


@query(f"""WITH e AS ({EXAM}), s AS (SELECT *, string_split(ans, ',') AS a, list_transform(string_split(pred, ','), lambda x: trim(x)) AS p FROM e)
SELECT p_partkey, CAST(len(list_intersect(list_distinct(a), list_distinct(p))) = len(list_distinct(a)) AND len(list_distinct(a)) = len(list_distinct(p)) AS INTEGER) AS score,
CAST(greatest(0, len(list_intersect(list_distinct(a), list_distinct(p))) - greatest(len(p), len(a)) + len(a)) AS INTEGER) AS graded FROM s""")
def use_multiple_choice(t):
    return exam(t).select("p_partkey", choice.exam_choice(F.col("ans"), F.col("pred")).alias("score"), choice.exam_choice_graded(F.col("ans"), F.col("pred")).alias("graded"))


@query(f"""WITH e AS ({EXAM}), s AS (SELECT *, string_split(ans, ',') AS a, list_transform(string_split(pred, ','), lambda x: trim(x)) AS p FROM e)
SELECT p_partkey, CASE WHEN len(a) = len(p) THEN CAST(len(list_filter(list_zip(a, p), lambda z: z[1] = z[2])) AS INTEGER) ELSE 0 END AS score FROM s""")
def use_matching(t):
    return exam(t).select("p_partkey", choice.exam_matching(F.col("ans"), F.col("pred")).alias("score"))


@query(r"""SELECT p_partkey, CAST(list_contains(string_split(lower(replace(p_name, ' ', ',')), ','), lower(regexp_replace(upper(string_split(p_name, ' ')[1]) || p_size, '[^\p{L}_]', '', 'g'))) AS INTEGER) AS score FROM part""")
def use_text(t):
    said = F.concat(F.upper(F.split("p_name", " ")[0]), F.col("p_size").cast("string"))
    return t("part").select("p_partkey", choice.exam_text(F.lower(F.replace("p_name", F.lit(" "), F.lit(","))), said).alias("score"))


@query(f"""WITH q AS ({PAIRS}), x AS (SELECT doc_id, pred, len({WORDS.format('gold')}) AS s, len({WORDS.format('pred')}) AS p FROM q)
SELECT doc_id, round(CASE WHEN p = 0 THEN 0 ELSE least(p / least(s, 100), least(s, 100) / p) END, 6) AS len_ratio, round(CASE WHEN p = 0 THEN 0 ELSE length(pred) / (1 + p) END, 6) AS symbol_per_token, round(CASE WHEN p = 0 THEN 0 ELSE p / p END, 6) AS tokens_per_word FROM x""")
def copy_len_ratio(t):
    c = text.copy_parts(text.words(F.col("gold")), text.words(F.col("pred")), F.col("pred"), 100)
    return pairs(t).select("doc_id", c.alias("c")).select("doc_id", six("c.len").alias("len_ratio"), six("c.symbol_per_token").alias("symbol_per_token"), six("c.tokens_per_word").alias("tokens_per_word"))


@query("SELECT c_custkey, translate(upper(trim('  ' || replace(c_name, 'C', 'С') || ' ')), 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX') AS plate FROM customer")
def plate_ocr(t):
    return t("customer").select("c_custkey", text.plate(F.concat(F.lit("  "), F.replace("c_name", F.lit("C"), F.lit("С")), F.lit(" "))).alias("plate"))


#: Instructions put to each document's text as a response.
INSTRUCTIONS = [("punctuation:no_comma",), ("length_constraints:number_words", "at least", 100), ("keywords:existence", ["the", "of"]), ("keywords:frequency", "the", "at least", 5), ("detectable_content:number_placeholders", 1), ("detectable_format:number_bullet_lists", 0), ("startend:quotation",), ("keywords:letter_frequency", "e", "at least", 50), ("startend:end_checker", "."), ("detectable_format:title",)]
WS = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
IFEVAL = rf"""WITH c AS (SELECT doc_id, source, regexp_replace(text, '\s+', '', 'g') <> '' AS full_, [
{{'id': 'punctuation:no_comma', 'ok': NOT contains(text, ',')}},
{{'id': 'length_constraints:number_words', 'ok': len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) >= 100}},
{{'id': 'keywords:existence', 'ok': regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)of')}},
{{'id': 'keywords:frequency', 'ok': len(regexp_extract_all(text, '(?i)the')) >= 5}},
{{'id': 'detectable_content:number_placeholders', 'ok': len(regexp_extract_all(text, '\[.*?\]')) >= 1}},
{{'id': 'detectable_format:number_bullet_lists', 'ok': len(regexp_extract_all(text, '(?m)^\s*\*[^*].*$')) + len(regexp_extract_all(text, '(?m)^\s*-.*$')) = 0}},
{{'id': 'startend:quotation', 'ok': length({WS}) > 1 AND left({WS}, 1) = '"' AND right({WS}, 1) = '"'}},
{{'id': 'keywords:letter_frequency', 'ok': length(lower(text)) - length(replace(lower(text), 'e', '')) >= 50}},
{{'id': 'startend:end_checker', 'ok': ends_with(lower(regexp_replace({WS}, '^"+|"+$', '', 'g')), '.')}},
{{'id': 'detectable_format:title', 'ok': len(list_filter(regexp_extract_all(text, '<<[^\n]+>>'), lambda x: regexp_replace(regexp_replace(x, '^<+|>+$', '', 'g'), '\s+', '', 'g') <> '')) > 0}}] AS k FROM documents),
r AS (SELECT doc_id, source, x.id AS instruction_id, string_split(x.id, ':')[1] AS category, full_ AND x.ok AS followed FROM (SELECT doc_id, source, full_, unnest(k) AS x FROM c))"""


def checked(t):
    # The checks in a projection of their own, where what they share is worked out once. Each row has some: a plain explode
    # would look for rows without, and work all of them out a second time.
    return t("documents").select("doc_id", "source", instructions.results(F.col("text"), INSTRUCTIONS).alias("r")).select("doc_id", "source", F.explode_outer("r").alias("r")).select("doc_id", "source", "r.*")


@query(IFEVAL + " SELECT doc_id, instruction_id, followed FROM r")
def ifeval_checks(t):
    return checked(t).select("doc_id", "instruction_id", "followed")


@query(IFEVAL + " SELECT instruction_id, round(avg(CAST(followed AS DOUBLE)), 6) AS accuracy FROM r GROUP BY 1")
def ifeval_by_instruction(t):
    return agg.instruction_accuracy(checked(t)).filter("instruction_id is not null").select("instruction_id", six("accuracy").alias("accuracy"))


@query(IFEVAL + " SELECT category, round(avg(CAST(followed AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT NULL, round(avg(CAST(followed AS DOUBLE)), 6), count(*) FROM r")
def ifeval_by_category(t):
    return agg.instruction_accuracy(checked(t)).filter("instruction_id is null").select("category", six("accuracy").alias("accuracy"), "n")


@query(IFEVAL + " SELECT round(avg(v), 6) AS prompt_level FROM (SELECT doc_id, min(CAST(followed AS INTEGER)) AS v FROM r WHERE category <> 'startend' AND category <> 'detectable_content' AND category <> 'detectable_format' AND instruction_id <> 'punctuation:no_comma' GROUP BY 1)")
def ifeval_prompt_level(t):
    kept = checked(t).filter(~F.col("category").isin("startend", "detectable_content", "detectable_format") & (F.col("instruction_id") != "punctuation:no_comma"))
    return agg.prompt_accuracy(kept, "doc_id").select(six("prompt_level").alias("prompt_level"))


#: Instructions whose checks need features that the SQL engine's patterns lack, or stand-ins for language tools.
def more() -> list[tuple]:
    return [("keywords:forbidden_words", ["idiot", "moron"]), ("language:response_language", "en"), ("length_constraints:number_sentences", "at least", 3), ("length_constraints:number_paragraphs", 1), ("length_constraints:nth_paragraph_first_word", 1, 1, "the"), ("detectable_content:postscript", "P.S."), ("detectable_format:constrained_response", ["My answer is yes."]), ("detectable_format:number_highlighted_sections", 1), ("detectable_format:multiple_sections", "Section", 1), ("detectable_format:json_format",), ("combination:two_responses",), ("combination:repeat_prompt", F.lit("the")), ("change_case:capital_word_frequency", "at least", 2), ("change_case:english_capital", "en"), ("change_case:english_lowercase", "en"), ("multi-turn:constrained_start", "The"), ("detectable_format:rephrase", F.lit("a *b* c")), ("keywords:key_sentences", ["Ti."], 1), ("detectable_content:rephrase_paragraph", F.lit("the of and"), 1, 3)]


LATIN, CYRILLIC = (r"len(regexp_extract_all(text, '\p{" + x + "}'))" for x in ("Latin", "Cyrillic"))
TOKEN_LIST = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')"
OF_LANGUAGE = {k: f"len(list_filter(w, lambda x: list_contains({v.split()!r}, x)))" for k, v in instructions.FREQUENT.items()}
ENGLISH = f"CASE WHEN {LATIN} + {CYRILLIC} = 0 THEN true ELSE {LATIN} >= {CYRILLIC} AND {OF_LANGUAGE['en']} >= greatest({', '.join(v for k, v in OF_LANGUAGE.items() if k != 'en')}) END"
FILLED = "list_filter({0}, lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')"
#: The checks of more(), one by one.
MORE = {
    "keywords:forbidden_words": r"NOT regexp_matches(text, '(?i)\b(idiot|moron)\b')",
    "language:response_language": "english",
    "length_constraints:number_sentences": r"len(regexp_extract_all(text, '[^.!?\s][^.!?]*([.!?]+|$)')) >= 3",
    "length_constraints:number_paragraphs": r"len(list_filter(p, lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) = 1 AND len(list_filter(p[2:len(p) - 1], lambda x: regexp_replace(x, '\s+', '', 'g') = '')) = 0",
    "length_constraints:nth_paragraph_first_word": r"len(" + FILLED.format("q") + r") = 1 AND regexp_extract(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(q[1], '^\s+|\s+$', '', 'g'), '^\S+'), '^''+', ''), '^\"+', '')), '^[^.,?!''\"]*') = 'the'",
    "detectable_content:postscript": r"regexp_matches(lower(text), 'p\.\s?s\.')",
    "detectable_format:constrained_response": "contains(text, 'My answer is yes.')",
    "detectable_format:number_highlighted_sections": r"len(list_filter(regexp_extract_all(text, '\*[^\n*]*\*') || regexp_extract_all(text, '\*\*[^\n*]*\*\*'), lambda x: regexp_replace(replace(x, '*', ''), '\s+', '', 'g') <> '')) >= 1",
    "detectable_format:multiple_sections": r"regexp_matches(text, '\s?Section\s?\d+\s?')",
    "detectable_format:json_format": r"json_valid(regexp_replace(regexp_replace(b, '^```(json|Json|JSON)?', ''), '```$', ''))",
    "combination:two_responses": r"CASE WHEN len(list_filter(r[2:len(r) - 1], lambda x: regexp_replace(x, '\s+', '', 'g') = '')) = 0 AND len(" + FILLED.format("r") + ") = 2 THEN trim(" + FILLED.format("r") + "[1]) <> trim(" + FILLED.format("r") + "[2]) ELSE false END",
    "combination:repeat_prompt": "starts_with(lower(b), 'the')",
    "change_case:capital_word_frequency": r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_''-]+'), lambda x: upper(x) = x AND lower(x) <> x)) >= 2",
    "change_case:english_capital": "upper(text) = text AND lower(text) <> text AND english",
    "change_case:english_lowercase": "lower(text) = text AND upper(text) <> text AND english",
    "multi-turn:constrained_start": r"regexp_matches(text, '(?m)^\s*The.*$')",
    "detectable_format:rephrase": r"regexp_matches(text, '\*.*\*') AND regexp_replace(text, '\*.*\*', '', 'g') = 'a  c'",
    "keywords:key_sentences": r"len(list_intersect(list_distinct(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))), ['Ti.'])) = 1",
    "detectable_content:rephrase_paragraph": "len(list_intersect(list_distinct(w), ['the', 'of', 'and'])) BETWEEN 1 AND 3",
}
MORE_SQL = rf"""WITH d AS MATERIALIZED (SELECT doc_id, text, regexp_replace(text, '\s+', '', 'g') <> '' AS full_, {WS} AS b, {TOKEN_LIST} AS w, string_split_regex(text, '\s?\*\*\*\s?') AS p, string_split(text, chr(10) || chr(10)) AS q, string_split(text, '******') AS r FROM documents),
e AS MATERIALIZED (SELECT *, {ENGLISH} AS english FROM d), c AS (SELECT doc_id, full_, [{', '.join("{'id': '" + k + "', 'ok': " + v + "}" for k, v in MORE.items())}] AS k FROM e)
SELECT doc_id, x.id AS instruction_id, coalesce(full_ AND x.ok, false) AS followed FROM (SELECT doc_id, full_, unnest(k) AS x FROM c)"""


@query(MORE_SQL)
def ifeval_more_checks(t):
    rows = t("documents").select("doc_id", instructions.results(F.col("text"), more()).alias("r"))
    return rows.select("doc_id", F.explode_outer("r").alias("r")).select("doc_id", "r.instruction_id", "r.followed")


CODE = "regexp_replace(regexp_replace(text, '```[^`]+```', '', 'g'), '```', '', 'g')"
PLAIN = f"regexp_replace({CODE}, '`[^`]+`', '', 'g')"


@query(rf"""SELECT doc_id, CAST(length(text) AS INTEGER) AS len_answer, CAST(len(regexp_extract_all({PLAIN}, '(?m)^#{{1,6}}\s')) AS INTEGER) AS header_count,
CAST(len(regexp_extract_all({PLAIN}, '(?m)^\s*\d+\.\s')) + len(regexp_extract_all({PLAIN}, '(?m)^\s*[-*+]\s')) AS INTEGER) AS list_count,
CAST(len(regexp_extract_all({PLAIN}, '\*\*[^*\n]+\*\*')) + len(regexp_extract_all({PLAIN}, '__[^_\n]+__')) AS INTEGER) AS bold_count,
CAST(len(regexp_extract_all({CODE}, '`[^`]+`')) + len(regexp_extract_all(text, '```[^`]+```')) AS INTEGER) AS code_blocks_count FROM documents""")
def style_counts(t):
    return t("documents").select("doc_id", text.style_counts(F.col("text")).alias("s")).select("doc_id", "s.*")


JUDGE = """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) % 10 AS cm, l_suppkey % 10 AS cr, l_partkey % 10 AS lm, l_orderkey % 10 AS lr, l_linenumber AS sm, 4 AS sr FROM lineitem"""


@query(f"""WITH j AS ({JUDGE}), w AS (SELECT *, CASE WHEN cm > cr THEN 'm' WHEN cm < cr THEN 'M' ELSE 'T' END AS c, CASE WHEN lm > lr THEN 'm' WHEN lm < lr THEN 'M' ELSE 'T' END AS l, CASE WHEN sm > sr THEN 'm' WHEN sm < sr THEN 'M' ELSE 'T' END AS s,
CASE WHEN cm + lm > cr + lr THEN 'm' WHEN cm + lm < cr + lr THEN 'M' ELSE 'T' END AS b FROM j),
d AS (SELECT CASE WHEN c <> 'T' AND abs(lm - lr) <= 2 THEN c WHEN c = 'T' THEN CASE WHEN l <> 'T' THEN l ELSE s END WHEN b <> 'T' THEN b ELSE s END AS decision, l_linenumber FROM w)
SELECT l_linenumber, CASE decision WHEN 'T' THEN 'tie' WHEN 'm' THEN 'model_wins' ELSE 'reference_wins' END AS outcome, count(*) AS n FROM d GROUP BY ALL""")
def judge_decision(t):
    j = t("lineitem").select("l_linenumber", F.format_string("text {\"content_m\": {\"score\": %d}, \"content_M\": {\"score\": %d}, \"language_m\": {\"score\": %d}, 'language_M': {\"score\": %d}, \"style_m\": {\"score\": %d}, \"style_M\": {\"score\": 4}}", F.col("l_quantity").cast("bigint") % 10, F.col("l_suppkey") % 10, F.col("l_partkey") % 10, F.col("l_orderkey") % 10, F.col("l_linenumber")).alias("said"))
    return j.select("l_linenumber", choice.judge_outcome(F.col("said"), F.lit("m")).alias("outcome")).groupBy("l_linenumber", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT role, round(avg(CASE WHEN starts_with(ltrim(CASE WHEN conv_id % 3 = 0 THEN ' Yes, ' ELSE 'No, ' END || text), 'Yes') THEN 1.0 ELSE 0.0 END), 6) AS acc, count(*) AS n FROM conversations GROUP BY role")
def details_aggregate(t):
    said = F.concat(F.when(F.col("conv_id") % 3 == 0, " Yes, ").otherwise("No, "), F.col("text"))
    return t("conversations").groupBy("role").agg(six(agg.mean(choice.yes(said))).alias("acc"), F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT vec_id, list_filter(list_transform(range(0, len(embedding)), lambda i: {'i': i, 'x': CAST(embedding[i + 1] AS DOUBLE)}), lambda z: z.i * 4 >= 32) AS t FROM embeddings)
SELECT round(avg(list_sum(list_transform(t, lambda z: z.x)) / len(t)), 6) AS mean_log_prob, count(*) AS n FROM v""")
def ppl_mean(t):
    from ..operators.predict import answer_log_prob

    tokens = F.transform("embedding", lambda x, i: F.struct(x.cast("double").alias("lp"), (i * 4).alias("start")))
    return t("embeddings").select(answer_log_prob(tokens, F.lit(32)).alias("v")).agg(six(F.avg("v")).alias("mean_log_prob"), F.count(F.lit(1)).alias("n"))


@query(r"""SELECT conv_id, turn, CASE WHEN starts_with(ltrim(r), '<think>') THEN trim(regexp_replace(r, '<think>.*?</think>', '', 'gs')) ELSE r END AS answer, string_split(text, '.')[1] AS cut
FROM (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 1 THEN '<think>' || left(text, 20) || '</think> ' || text ELSE text END AS r FROM conversations)""")
def think_strip(t):
    said = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<think>"), F.left("text", F.lit(20)), F.lit("</think> "), F.col("text"))).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", text.strip_think(said).alias("answer"), text.cut_at_stop(F.col("text"), ["."]).alias("cut"))


@query(r"""SELECT conv_id, turn, CASE WHEN contains(text, '.') THEN string_split(text, '.')[1] || '.' ELSE array_to_string(string_split(text, ' ')[1:8], ' ') || ' (cut)' END AS reasoning FROM conversations""")
def reasoning_merge(t):
    from ..operators.predict import close_reasoning

    return t("conversations").select("conv_id", "turn", close_reasoning(F.col("text"), ".", " (cut)", 8).alias("reasoning"))


#: Tokens of the first half of a text against those of all but its first quarter.
OPINIONS = r"""WITH r AS (SELECT conv_id * 100 + turn AS id, length(text) AS n, string_split_regex(text, '\s') AS w FROM conversations), e AS (SELECT id, n, unnest(w) AS token, unnest(range(0, len(w))) AS i FROM r),
o AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
k AS (SELECT id, coalesce(token <> '' AND s < n // 2 AND s + length(token) > 0, false) AS g, coalesce(token <> '' AND s + length(token) > n // 4, false) AS p FROM o),
x AS (SELECT r.id, count(*) FILTER (g) AS g, count(*) FILTER (p) AS p, count(*) FILTER (g AND p) AS both_ FROM r LEFT JOIN k ON k.id = r.id GROUP BY r.id)
"""


@query(OPINIONS + """SELECT round(sum(CASE WHEN g = 0 THEN CAST(p = 0 AS INTEGER) ELSE CAST(both_ AS DOUBLE) / g END) / (count(*) + 1e-16), 6) AS recall,
round(sum(CASE WHEN p = 0 THEN CAST(g = 0 AS INTEGER) ELSE CAST(both_ AS DOUBLE) / p END) / (count(*) + 1e-16), 6) AS "precision" FROM x""")
def opinion_overlap(t):
    x = t("conversations").select(F.length("text").alias("n"), spans.token_offsets(F.col("text")).alias("o"))
    x = x.select(spans.tokens_in(F.col("o"), F.lit(0), F.floor(F.col("n") / 2)).alias("g"), spans.tokens_in(F.col("o"), F.floor(F.col("n") / 4), F.col("n")).alias("p"))
    sums = x.agg(F.sum(spans.coverage(F.col("g"), F.col("p"))).alias("wr"), F.count(F.lit(1)).alias("nr"), F.sum(spans.coverage(F.col("p"), F.col("g"))).alias("wp"), F.count(F.lit(1)).alias("np"))
    return agg.opinion_prf(sums).select(six("precision").alias("precision"), six("recall").alias("recall"))


@query()
def copied_text(t):
    return pairs(t).select("doc_id", sequence.copied(F.col("gold"), F.col("pred")).alias("lcs"))


@query("SELECT conv_id, turn, 'B:' || turn || ';A:' || string_split(text, ' ')[1] || turn AS entities FROM conversations WHERE NOT contains(string_split(text, ' ')[1], '<')")
def nested_entities(t):
    first = F.split("text", " ")[0]
    marked = F.concat(F.lit("<A>"), first, F.lit("<B>"), F.col("turn").cast("string"), F.lit("</B></A>"))
    found = F.transform(sequence.parse_nested(marked), lambda e: F.concat(e["tag"], F.lit(":"), e["entity"]))
    return t("conversations").filter(~first.contains("<")).select("conv_id", "turn", F.array_join(found, ";").alias("entities"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) = l_suppkey AS DOUBLE) AS ok, count(*) AS n FROM lineitem GROUP BY ALL")
def math_equal(t):
    said = F.concat(F.lit("so \\boxed{\\frac{"), (2 * F.col("l_quantity").cast("bigint")).cast("string"), F.lit("}{2}}"))
    return t("lineitem").select("l_orderkey", "l_linenumber", sequence.math_equal(said, F.col("l_suppkey").cast("string")).alias("ok")).groupBy("l_orderkey", "l_linenumber", "ok").agg(F.count(F.lit(1)).alias("n"))
