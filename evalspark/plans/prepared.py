"""Queries of registered tasks that start from raw rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans
from . import tasks
from .parts import evaluated, task_sql
from .registry import TASKS, query

BIO = tasks.TAGS["nerel-bio"]


@query(rf"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations), t AS (SELECT unnest(list_filter(string_split_regex(line, '[\x09-\x0D ]+'), lambda w: w <> '')) AS w FROM l WHERE length(line) > 5),
g AS MATERIALIZED (SELECT {list(BIO)}[ascii(w) % 8 + 1] AS tag, length(w) % 3 <> 0 AS said FROM t), f AS (SELECT unnest({list(BIO)}) AS tag), s AS (SELECT tag, CAST(count(*) FILTER (said) AS DOUBLE) AS tp, count(*) FILTER (NOT said) AS fn FROM g GROUP BY tag),
v AS (SELECT avg(coalesce(2 * tp / (2 * tp + fn), 0)) AS v FROM f LEFT JOIN s USING (tag)) SELECT 'ner/nerel-bio/json' AS task, unnest(['f1-macro', 'score']) AS metric, round(v, 6) AS value FROM v""")
def task_nerel_bio(t):
    """Each word of a turn is an entity, with its kind by its first letter; a model leaves out those of certain lengths."""
    rows = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", spans.token_offsets(F.col("text")).alias("o"))
    kind = lambda w: F.element_at(F.array(*map(F.lit, BIO)), F.ascii(w) % 8 + 1)
    of = lambda f: F.transform("o", f)
    raw = rows.select("id", "text", of(lambda x: kind(x["token"])).alias("span_entity_types"), of(lambda x: x["start"]).alias("span_entity_start_chars"), of(lambda x: x["end"]).alias("span_entity_end_chars"), of(lambda x: x["token"]).alias("span_entity_surface"))
    spec = TASKS["ner/nerel-bio/json"]
    ready = spec.prepared(raw)
    said = F.filter("gold", lambda e: F.length(e["entity"]) % 3 != 0)
    return evaluated(spec.name, ready.withColumn("pred", F.to_json(F.transform(said, lambda e: F.array(e["tag"], e["entity"])))))


@query(r"""WITH p AS MATERIALIZED (SELECT p_partkey, [p_brand, p_type, 'size ' || p_size, p_name] AS own, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () - 1 AS last FROM part),
n AS (SELECT p.p_partkey, p.own, q.pos, unnest([1, 2, 3, 4]) AS k, unnest(q.own) AS c FROM p JOIN p q ON q.pos BETWEEN CASE WHEN p.pos + 5 <= p.last THEN p.pos + 1 ELSE p.pos - 5 END AND CASE WHEN p.pos + 5 <= p.last THEN p.pos + 5 ELSE p.pos - 1 END),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY k, pos) AS i FROM n WHERE NOT list_contains(own, c)), o AS (SELECT p_partkey, list(c) AS more FROM r WHERE i <= 8 GROUP BY p_partkey)
SELECT p_partkey, len(own) + len(more) AS n, array_to_string(list_sort(list_concat(own, more)), '|') AS choices, own[p_partkey % 4 + 1] AS answer FROM p JOIN o USING (p_partkey)""")
def shepherded_choices(t):
    """Parts as questions with four answers, and eight more of the five that follow."""
    letter = F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    raw = t("part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("question"), F.col("p_brand").alias("answerA"), F.col("p_type").alias("answerB"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("answerC"), F.col("p_name").alias("answerD"), letter.alias("correct_answer"))
    ready = TASKS["shlepa/moviesmc"].prepared(raw)
    answer = F.get("choices", F.instr(F.lit(tasks.LETTERS), F.col("gold")) - 1)
    return ready.select(F.col("id").alias("p_partkey"), F.size("choices").cast("bigint").alias("n"), F.array_join(F.array_sort("choices"), "|").alias("choices"), answer.alias("answer"))


IFEVAL = r"r AS MATERIALIZED (SELECT unnest([CASE WHEN doc_id % 2 = 0 THEN w >= doc_id % 1000 ELSE w < doc_id % 1000 END, NOT contains(text, ','), k >= doc_id % 3]) AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' AS ok, doc_id FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w, (length(text) - length(replace(lower(text), lang, ''))) / length(lang) AS k FROM documents))"


@query(task_sql("ifeval_en", IFEVAL, prompt_level="SELECT avg(v) FROM (SELECT min(CAST(ok AS INTEGER)) AS v FROM r GROUP BY doc_id)", inst_level="SELECT avg(CAST(ok AS INTEGER)) FROM r").replace("SELECT 'ifeval_en', 'score', round(avg(value), 6) FROM v", "SELECT 'ifeval_en', 'score', round(avg(value), 6) FROM v WHERE metric = 'prompt_level'"))
def task_ifeval(t):
    """Documents as responses to three instructions each, with arguments of their own."""
    id_ = F.col("doc_id")
    given = lambda **x: F.struct(*[(x[n] if n in x else F.lit(None)).cast("string").alias(n) for n in ("num_words", "relation", "keyword", "frequency")])
    kwargs = F.array(given(num_words=id_ % 1000, relation=F.when(id_ % 2 == 0, "at least").otherwise("less than")), given(), given(keyword=F.col("lang"), relation=F.lit("at least"), frequency=id_ % 3))
    raw = t("documents").select(id_.alias("id"), F.col("text").alias("prompt"), F.array(F.lit("length_constraints:number_words"), F.lit("punctuation:no_comma"), F.lit("keywords:frequency")).alias("instruction_id_list"), kwargs.alias("kwargs"))
    spec = TASKS["ifeval_en"]
    return evaluated(spec.name, spec.prepared(raw).withColumn("pred", F.col("prompt")))


@query(r"""WITH o AS (SELECT conv_id * 100 + turn AS id, list_filter(string_split_regex(text, '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM conversations), v AS (SELECT CASE WHEN len(w) > 3 THEN 1.0 ELSE 0.0 END AS found, CASE WHEN len(w) > 3 AND len(w) % 2 = 0 THEN 1.0 ELSE 0.0 END AS said FROM o),
s AS (SELECT sum(said) AS tp, sum(said) AS np, sum(found) AS nr FROM v), f AS (SELECT tp / (np + 1e-16) AS p, tp / (nr + 1e-16) AS r FROM s) SELECT 'ruopinionne' AS task, unnest(['f1', 'score']) AS metric, round(2 * p * r / (p + r + 1e-16), 6) AS value FROM f""")
def task_opinions_raw(t):
    """Turns of more than three words have an opinion of the author on the second word, in the third; a model finds it in
    turns with an even number of words."""
    rows = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", spans.token_offsets(F.col("text")).alias("o"))
    at = lambda k: F.concat_ws(":", F.get("o", F.lit(k))["start"].cast("string"), F.get("o", F.lit(k))["end"].cast("string"))
    part = lambda surface, place: F.array(F.array(surface), F.array(place))
    one = F.struct(part(F.lit("AUTHOR"), F.lit("NULL")).alias("Source"), part(F.get("o", F.lit(1))["token"], at(1)).alias("Target"), part(F.get("o", F.lit(2))["token"], at(2)).alias("Polar_expression"), F.lit("NEG").alias("Polarity"))
    raw = rows.select("id", "text", F.when(F.size("o") > 3, F.array(one)).otherwise(F.array().cast(f"array<{OPINION}>")).alias("opinions"))
    spec = TASKS["ruopinionne"]
    ready = spec.prepared(raw)
    found = F.filter("gold", lambda g: F.size("tokens") % 2 == 0)
    return evaluated(spec.name, ready.withColumn("found", found))


OPINION = "struct<Source:array<array<string>>,Target:array<array<string>>,Polar_expression:array<array<string>>,Polarity:string>"
