"""Queries of registered tasks, and of row functions that no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import choice, spans, text
from ..operators import prompts, rating, sampling
from . import tasks  # noqa: F401  registers the tasks
from .boards import BATTLES, battles
from .registry import TASKS, query
from .scores import ENTITIES, FLAGS, LIBRA, ONES, PAIRS, SQUAD, WORDS, flags, pairs, six


def evaluated(name, df):
    """A task's metrics and its score."""
    spec = TASKS[name]
    metrics = spec.evaluate(df)
    both = metrics.unionByName(spec.score(metrics).select("task", F.lit("score").alias("metric"), F.col("score").alias("value")))
    return both.select("task", "metric", six("value").alias("value"))


def task_sql(name, prelude, **metrics):
    """Rows (task, metric, value) of SQL expressions, each a query of one value; the first ones are averaged as the score."""
    rows = [f"SELECT '{m}' AS metric, CAST(({q}) AS DOUBLE) AS value" for m, q in metrics.items()]
    return f"WITH {prelude}, v AS MATERIALIZED ({' UNION ALL '.join(rows)}) SELECT '{name}' AS task, metric, round(value, 6) AS value FROM v UNION ALL SELECT '{name}', 'score', round(avg(value), 6) FROM v"


MACRO = "SELECT avg(CAST(2 * tp AS DOUBLE) / (g + p)) FROM (SELECT label, sum(g) AS g, sum(p) AS p, sum(tp) AS tp FROM (SELECT gold AS label, 1 AS g, 0 AS p, CAST(gold = pred AS INTEGER) AS tp FROM r UNION ALL SELECT pred, 0, 1, 0 FROM r) GROUP BY label)"
ACC = "SELECT avg(CAST(gold = pred AS INTEGER)) FROM r"


@query(task_sql("rcb", f"r AS MATERIALIZED ({FLAGS})", acc=ACC, f1_macro=MACRO))
def task_rcb(t):
    return evaluated("rcb", flags(t))


@query(task_sql("rucola", f"r AS MATERIALIZED ({FLAGS})", acc=ACC, mcc="SELECT (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) FROM (SELECT sum(g * p) AS pt, sum(p * p) AS pp, sum(g * g) AS tt, sum(g) AS s FROM (SELECT label, CAST(sum(g) AS DOUBLE) AS g, CAST(sum(p) AS DOUBLE) AS p FROM (SELECT gold AS label, 1 AS g, 0 AS p FROM r UNION ALL SELECT pred, 0, 1 FROM r) GROUP BY label)), (SELECT CAST(sum(CAST(gold = pred AS INTEGER)) AS DOUBLE) AS c FROM r)"))
def task_rucola(t):
    return evaluated("rucola", flags(t))


@query("WITH r AS (SELECT o_orderkey AS id, unnest([CAST(o_totalprice > 100000 AS INTEGER), CAST(o_custkey % 2 = 0 AS INTEGER)]) AS ok FROM orders), p AS (SELECT id, min(ok) AS v FROM r GROUP BY id) SELECT 'parus' AS task, unnest(['acc', 'score']) AS metric, round(avg(v), 6) AS value FROM p")
def task_parus(t):
    """Each order asked twice; a pair is right if both answers are."""
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.lit("1").alias("gold"), F.explode(F.array(F.when(F.col("o_totalprice") > 100000, "1").otherwise("2"), F.when(F.col("o_custkey") % 2 == 0, "1").otherwise("2"))).alias("pred"))
    return evaluated("parus", rows)


@query("WITH s AS (SELECT n_regionkey, n_nationkey, avg(CAST(c_acctbal > 0 AS INTEGER)) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), c AS (SELECT n_regionkey, avg(v) AS v FROM s GROUP BY 1) SELECT 'mmlu_en' AS task, unnest(['acc', 'score']) AS metric, round(avg(v), 6) AS value FROM c")
def task_mmlu(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return evaluated("mmlu_en", rows.select(F.col("n_nationkey").alias("subject"), F.col("n_regionkey").alias("category"), F.lit("A").alias("gold"), F.when(F.col("c_acctbal") > 0, "A").otherwise("B").alias("pred")))


EXAMS = """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'matching' WHEN 1 THEN 'text' ELSE 'multiple_choice' END AS kind, CASE WHEN p_size % 2 = 0 THEN '16' ELSE '7' END AS task, CAST(p_size % 5 AS VARCHAR) AS variant,
string_split(lower(p_name), ' ') AS a, list_transform(string_split(p_name, ' '), lambda x: x || CASE WHEN p_partkey % 4 = 0 AND x < 'm' THEN 'z' ELSE '' END) AS p FROM part"""
EXAM_SCORE = """SELECT *, CASE kind WHEN 'matching' THEN CASE WHEN len(a) = len(p) THEN len(list_filter(list_zip(a, p), lambda z: z[1] = z[2])) ELSE 0 END
WHEN 'text' THEN CAST(list_contains(a, lower(regexp_replace(array_to_string(p, ','), '[^\\p{L}_]', '', 'g'))) AS INTEGER)
ELSE CASE WHEN task = '16' THEN greatest(0, len(list_intersect(list_distinct(a), list_distinct(p))) - greatest(len(p), len(a)) + len(a)) ELSE CAST(len(list_intersect(list_distinct(a), list_distinct(p))) = len(list_distinct(a)) AND len(list_distinct(a)) = len(list_distinct(p)) AS INTEGER) END END AS score FROM e"""


def exams(t):
    size, said = F.col("p_size"), F.split("p_name", " ")
    pred = F.array_join(F.transform(said, lambda x: F.concat(x, F.when((F.col("p_partkey") % 4 == 0) & (x < "m"), "z").otherwise(""))), ", ")
    return t("part").select("p_partkey", F.when(size % 3 == 0, "matching").when(size % 3 == 1, "text").otherwise("multiple_choice").alias("kind"), F.when(size % 2 == 0, "16").otherwise("7").alias("task"), (size % 5).cast("string").alias("variant"), F.replace(F.lower("p_name"), F.lit(" "), F.lit(",")).alias("gold"), pred.alias("pred"))


@query(f"WITH e AS ({EXAMS}) SELECT p_partkey, CAST(score AS INTEGER) AS score FROM ({EXAM_SCORE})")
def exam_scores(t):
    return exams(t).select("p_partkey", choice.exam_score(F.col("kind"), F.col("task"), F.col("gold"), F.col("pred")).cast("int").alias("score"))


@query(f"WITH e AS ({EXAMS}), s AS (SELECT variant, sum(score) / 34 AS v FROM ({EXAM_SCORE}) GROUP BY 1) SELECT 'use' AS task, unnest(['grade_norm', 'score']) AS metric, round(avg(v), 6) AS value FROM s")
def task_use(t):
    return evaluated("use", exams(t))


@query(f"WITH n AS (SELECT {LIBRA.format('text')} AS p, lang, (greatest(n_chars // 1000, 1))::VARCHAR || 'k' AS length FROM documents), b AS (SELECT length, round(avg(CAST(contains(p, lang) AS INTEGER)), 3) AS m FROM n GROUP BY 1) SELECT 'libra/passkey' AS task, unnest(['score', 'score']) AS metric, round(avg(m), 6) AS value FROM b")
def task_libra(t):
    length = F.concat(F.greatest(F.floor(F.col("n_chars") / 1000), F.lit(1)).cast("string"), F.lit("k"))
    return evaluated("libra/passkey", t("documents").select(F.col("text").alias("pred"), F.array("lang").alias("golds"), length.alias("length")))


@query(f"""WITH q AS MATERIALIZED (SELECT doc_id, {SQUAD.format('pred')} AS a, {SQUAD.format('gold')} AS b FROM ({PAIRS})), x AS MATERIALIZED (SELECT doc_id, string_split(a, ' ') AS p, string_split(b, ' ') AS g, a = b AS em, a = '' OR b = '' AS none FROM q), {ONES},
r AS (SELECT CAST(em AS INTEGER) AS em, CASE WHEN none THEN CAST(em AS INTEGER) WHEN coalesce(same, 0) > 0 THEN 2.0 * same / (np + ng) ELSE 0 END AS f1 FROM x LEFT JOIN o USING (doc_id)), v AS (SELECT avg(f1) AS f1, avg(em) AS em FROM r)
SELECT 'multiq' AS task, unnest(['f1', 'em', 'score']) AS metric, round(unnest([f1, em, (f1 + em) / 2]), 6) AS value FROM v""")
def task_multiq(t):
    """The benchmark's passages as questions' answers, documents of up to 300 words as predictions of them."""
    return evaluated("multiq", pairs(t).select("pred", F.array("gold").alias("golds")))


@query(ENTITIES.replace("FROM documents", "FROM (SELECT conv_id * 100 + turn AS doc_id, text FROM conversations)").replace("doc_id - 1 AS doc_id, tag, entity, g AS p", "doc_id, tag, entity, CASE WHEN entity LIKE '%e%' THEN g ELSE 1 END AS p").replace("text, '\\s+'", "regexp_replace(text, '[,\\[\\]:]', '', 'g'), '\\s+'").replace("IN ('t', 'a', 'o')", "IN ('t', 'a', 'o')") + ", f AS (SELECT unnest(['t', 'a', 'o']) AS tag) SELECT 'ner/test/dict' AS task, 'f1-macro' AS metric, round(avg(coalesce(2.0 * tp / (2 * tp + fn + fp), 0)), 6) AS value FROM f LEFT JOIN s USING (tag)")
def task_ner(t):
    """Words by first letter are entities; a model's lines have each word once, or as often as it occurs if it has an e."""
    tags = ("t", "a", "o")
    plain = F.regexp_replace("text", r"[,\[\]:]", "")
    words = F.filter(text.words(plain), lambda w: F.lower(F.substring(w, 1, 1)).isin(*tags))
    gold = F.transform(words, lambda w: F.struct(F.lower(F.substring(w, 1, 1)).alias("tag"), w.alias("entity")))
    of = lambda tag: F.filter(words, lambda w: F.lower(F.substring(w, 1, 1)) == tag)
    said = lambda ws: F.concat(F.filter(ws, lambda w: w.contains("e")), F.array_distinct(F.filter(ws, lambda w: ~w.contains("e"))))
    lines = F.array_join(F.array(*[F.concat(F.lit(f"{tag}: ["), F.array_join(said(of(tag)), ", "), F.lit("]")) for tag in tags]), "\n")
    rows = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("query"), gold.alias("gold"), lines.alias("pred"))
    counts = tasks.entity_scores("dict", tags)(rows)
    return tasks.tag_mean(tags)(counts).select(F.lit("ner/test/dict").alias("task"), F.lit("f1-macro").alias("metric"), six("avg(f1)").alias("value"))


OPINION = "SELECT l_orderkey AS id, row_number() OVER () AS k, CASE WHEN l_linenumber % 3 = 0 THEN [] ELSE [l_linenumber % 4, l_linenumber % 4 + 1] END AS h, [CAST(l_quantity AS INTEGER) % 5, CAST(l_quantity AS INTEGER) % 5 + 1] AS t, [l_partkey % 3, l_partkey % 3 + 1, l_partkey % 3 + 2] AS e, l_returnflag AS p, l_suppkey % 2 = 0 AS g FROM lineitem"
MEETS = "CASE WHEN len(a.{0}) = 0 OR len(b.{0}) = 0 THEN len(a.{0}) = len(b.{0}) ELSE len(list_intersect(a.{0}, b.{0})) > 0 END"
COVERS = "CASE WHEN len(a.{0}) = 0 THEN CASE WHEN len(b.{0}) = 0 THEN 1 ELSE 0 END ELSE CAST(len(list_intersect(a.{0}, b.{0})) AS DOUBLE) / len(a.{0}) END"


@query(f"""WITH o AS MATERIALIZED ({OPINION}), m AS (SELECT a.id, a.k, a.g, max(({' + '.join(COVERS.format(c) for c in 'hte')}) / 3) AS w FROM o a JOIN o b ON a.id = b.id AND a.g <> b.g AND a.p = b.p AND {' AND '.join(MEETS.format(c) for c in 'hte')} GROUP BY ALL),
s AS (SELECT (SELECT coalesce(sum(w), 0) FROM m WHERE NOT g) AS wp, (SELECT count(*) FROM o WHERE NOT g) AS np, (SELECT coalesce(sum(w), 0) FROM m WHERE g) AS wr, (SELECT count(*) FROM o WHERE g) AS nr), v AS (SELECT wp / np AS p, wr / nr AS r FROM s)
SELECT 'ruopinionne' AS task, unnest(['f1', 'score']) AS metric, round(2 * p * r / (p + r), 6) AS value FROM v""")
def task_opinions(t):
    """An order's lines are opinions, those of even suppliers gold ones and the others a model's."""
    n, i = F.col("l_linenumber"), F.col("l_quantity").cast("int") % 5
    o = F.struct(F.when(n % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(n % 4, n % 4 + 1).cast("array<int>")).alias("holder"), F.array(i, i + 1).alias("target"), F.array(*[F.col("l_partkey") % 3 + k for k in range(3)]).cast("array<int>").alias("expr"), F.col("l_returnflag").alias("polarity"))
    even = F.col("l_suppkey") % 2 == 0
    rows = t("lineitem").withColumn("o", o).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(even, F.col("o"))).alias("gold"), F.collect_list(F.when(~even, F.col("o"))).alias("found"))
    return evaluated("ruopinionne", rows)


@query(f"WITH r AS (SELECT conv_id * 100 + turn AS id, text FROM conversations) SELECT id, left(trim(text), 1) AS first, CASE WHEN starts_with('Да, конечно', left(text, 1)) THEN 1 ELSE 0 END AS starts, translate(upper(trim(left(text, 2))), 'АВСЕ', 'ABCE') AS letter FROM r")
def answer_forms(t):
    said = F.col("text")
    return t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), choice.first_character(said).alias("first"), choice.starts_gold(F.lit("Да, конечно"), F.left(said, F.lit(1))).alias("starts"), choice.gold_letter(F.left(said, F.lit(2))).alias("letter"))


@query(rf"""WITH r AS (SELECT conv_id * 100 + turn AS id, {WORDS.format("regexp_replace(text, '[^\\p{L}\\s]', '', 'g')")} AS w FROM conversations), x AS (SELECT id, CASE WHEN len(w) > 0 THEN w[1] ELSE '' END AS a, CASE WHEN len(w) > 1 THEN w[2] ELSE '' END AS b FROM r)
SELECT id, 'A=' || a || CASE WHEN a <> '' AND b <> '' THEN '|' ELSE '' END || b || ';B=' || b AS lines, 'A:' || a || ';B:' || b AS json, b AS inline, 'B:' || b || ';A:' || a || b AS nested, a <> '' AS same FROM x""")
def read_entities(t):
    """Entities as a model may write them: lines by tag, JSON, marks, marks within marks."""
    w = text.words(F.regexp_replace("text", r"[^\p{L}\s]", ""))
    at = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    x = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), w.alias("w")).select("id", at(0).alias("a"), at(1).alias("b"))
    from ..functions import sequence

    lines = spans.parse_tag_lines(F.concat(F.lit("B: [old]\nnot a line\nA: ["), F.col("a"), F.lit(", "), F.col("b"), F.lit("]\nB: ["), F.col("b"), F.lit("]")))
    entry = lambda tag: F.concat(F.lit(f"{tag}="), F.array_join(lines[tag], "|"))
    json = spans.parse_json_entities(F.concat(F.lit('```json\n[["A", "'), F.col("a"), F.lit('"], ["B", "'), F.col("b"), F.lit('"]]\n```')))
    pairs_ = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e[0], F.lit(":"), e[1])), ";")
    marked = F.concat(F.lit("x <B>"), F.col("b"), F.lit("</B>"))
    nested = sequence.parse_nested(F.concat(F.lit("<A>"), F.col("a"), F.lit("<B>"), F.col("b"), F.lit("</B></A>")))
    same = spans.same_text(F.concat(F.lit("<A>"), F.col("a"), F.lit("</A> "), F.col("b")), F.concat("a", "b")) & (F.col("a") != "")
    return x.select("id", F.concat_ws(";", entry("A"), entry("B")).alias("lines"), pairs_(json).alias("json"), F.array_join(spans.parse_inline(marked, "B"), "|").alias("inline"), F.array_join(F.transform(nested, lambda e: F.concat(e["tag"], F.lit(":"), e["entity"])), ";").alias("nested"), same.alias("same"))


@query(rf"""WITH r AS (SELECT conv_id * 100 + turn AS id, text, string_split_regex(text, '\s') AS w FROM conversations), e AS (SELECT id, unnest(w) AS token, unnest(range(0, len(w))) AS i FROM r),
o AS (SELECT *, CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS n FROM o WHERE token <> '')
SELECT id, CAST(count(*) AS INTEGER) AS tokens, CAST(max(s + length(token)) AS INTEGER) AS last, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (s < 25 AND s + length(token) > 8), '') AS touched FROM k GROUP BY id""")
def opinion_tokens(t):
    """Tokens with their places, and those that the characters from 8 to 25 touch."""
    o = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), spans.token_offsets(F.col("text")).alias("o")).filter(F.size("o") > 0)
    return o.select("id", F.size("o").alias("tokens"), F.element_at("o", -1)["end"].alias("last"), F.array_join(F.transform(spans.tokens_in(F.col("o"), F.lit(8), F.lit(25)), lambda i: i.cast("string")), ",").alias("touched"))


@query(r"""WITH r AS (SELECT conv_id * 100 + turn AS id, text, string_split(text, ' ') AS w FROM conversations), x AS (SELECT id, text, w[1] AS a, upper(w[len(w)]) AS b FROM r)
SELECT id, CAST(CASE WHEN a = '' THEN NULL WHEN instr(text, a) > 0 THEN instr(text, a) - 1 END AS INTEGER) AS start, CAST(CASE WHEN b = '' THEN NULL WHEN instr(text, b) > 0 THEN instr(text, b) - 1 WHEN instr(lower(text), lower(b)) > 0 THEN instr(lower(text), lower(b)) - 1 END AS INTEGER) AS any_case, 2 AS valid FROM x WHERE a <> '' AND b <> '' AND NOT regexp_matches(text, '["\\[:cntrl:]]')""")
def located_opinions(t):
    """Phrases found in a text, and the opinions of a model's JSON whose phrases the text has."""
    w = F.split("text", " ", -1)
    x = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", w[0].alias("a"), text.capitals(F.element_at(w, -1)).alias("b")).filter((F.col("a") != "") & (F.col("b") != "") & ~F.col("text").rlike(r'["\\\p{Cntrl}]'))
    one = lambda source, target, polarity, said: F.concat(F.lit(f'{{"Source": "{source}", "Target": "'), target, F.lit(f'", "Polarity": "{polarity}", "Expression": "'), said, F.lit('"}'))
    json = F.concat(F.lit("```json\n["), F.concat_ws(", ", one("NULL", F.col("a"), "POS", F.col("b")), one("AUTHOR", F.col("b"), "NEG", F.col("a")), one("NULL", F.col("a"), "WELL", F.col("b")), one("no such phrase here", F.col("a"), "POS", F.col("b"))), F.lit("]\n```"))
    kept = spans.valid_opinions(F.col("text"), spans.opinions_from_json(json))
    return x.select("id", spans.locate_span(F.col("text"), F.col("a"))["start"].alias("start"), spans.locate_span(F.col("text"), F.col("b"))["start"].alias("any_case"), F.size(kept).alias("valid"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 5 AS a, CAST(floor(o_totalprice) AS BIGINT) % 5 AS b, CAST(year(o_orderdate) AS BIGINT) % 5 AS c FROM orders)
SELECT o_orderkey, NOT ((a > 0 AND a % 2 = 0) OR (b > 0 AND b % 2 = 0 AND (b + 1) // 2 <> (a + 1) // 2) OR (c > 0 AND c % 2 = 0 AND (c + 1) // 2 <> (b + 1) // 2)) AS valid FROM r""")
def bio_checks(t):
    """Three tags of an order: 1 and 2 begin and go on with one entity, 3 and 4 with another."""
    tags = F.array(F.col("o_custkey") % 5, F.floor("o_totalprice") % 5, F.year("o_orderdate") % 5).cast("array<int>")
    return t("orders").select("o_orderkey", spans.bio_valid(tags).alias("valid"))


@query("""WITH g AS (SELECT l_orderkey AS k, l_linenumber AS pos, CASE WHEN l_quantity > 40 THEN 'O' WHEN l_quantity > 20 THEN 'I-' || l_returnflag ELSE 'B-' || l_returnflag END AS tag FROM lineitem), l AS (SELECT *, lag(tag) OVER (PARTITION BY k ORDER BY pos) AS last FROM (SELECT k, pos, min(tag) AS tag FROM g GROUP BY k, pos))
SELECT k, pos, CASE WHEN tag = 'O' THEN tag WHEN last IS NOT NULL AND last <> 'O' AND substr(last, 3) = substr(tag, 3) THEN 'I-' || substr(tag, 3) ELSE 'B-' || substr(tag, 3) END AS tag FROM l""")
def bio_normal(t):
    from pyspark.sql.window import Window

    q = F.col("l_quantity")
    rows = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.when(q > 40, "O").otherwise(F.concat(F.when(q > 20, "I-").otherwise("B-"), F.col("l_returnflag"))).alias("tag")).groupBy("k", "pos").agg(F.min("tag").alias("tag"))
    return rows.select("k", "pos", sampling.normal_bio(F.col("tag"), F.lag("tag").over(Window.partitionBy("k").orderBy("pos"))).alias("tag"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS key, CAST(l_quantity AS INTEGER) % 4 AS e FROM lineitem), n AS (SELECT l_orderkey, key, e, min(l_linenumber) AS first FROM o GROUP BY ALL) SELECT l_orderkey, CAST(count(*) AS INTEGER) AS kept FROM n GROUP BY 1""")
def opinions_once(t):
    """Opinions with one expression token, so that two are the same exactly if all their parts are."""
    o = F.struct(F.col("l_linenumber").alias("n"), F.array("l_returnflag").alias("holder"), F.array("l_linestatus").alias("target"), F.lit("POS").alias("polarity"), F.array(F.col("l_quantity").cast("int") % 4).alias("expr"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(o)).alias("o"))
    return rows.select("l_orderkey", F.size(spans.distinct_opinions(F.col("o"))).alias("kept"))


@query("""SELECT l_orderkey, CASE WHEN n > 1 THEN 'multi' WHEN q > 40 THEN 'src_null' WHEN q > 30 THEN 'src_author' WHEN q > 20 THEN 'multi_expr' ELSE 'default' END AS kind FROM (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1)""")
def row_types(t):
    q = F.col("l_quantity")
    o = F.struct(F.when(q > 40, "NULL").when(q > 30, "AUTHOR").otherwise("x").alias("Source"), F.when((q > 20) & (q <= 30), "two words").otherwise("one").alias("Expression"))
    return t("lineitem").groupBy("l_orderkey").agg(F.collect_list(o).alias("o")).select("l_orderkey", sampling.row_type(F.col("o")).alias("kind"))


@query("SELECT conv_id, string_agg('[' || role || ']:' || chr(10) || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def rendered_prompts(t):
    m = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return m.select("conv_id", prompts.rendered(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("prompt"))


@query("""SELECT p_partkey, 'p ' || p_name || ' of ' || p_brand AS content, 'assistant' AS role, '1) ' || p_name || chr(10) || '2) ' || p_brand AS answers, CAST(len(list_distinct(string_split('yes no ' || p_name, ' '))) AS INTEGER) AS allowed FROM part""")
def filled_templates(t):
    m = F.array(F.struct(F.lit("bot").alias("role"), F.lit("p {name} of {brand}").alias("content")))
    filled = prompts.conversation(m, F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")))[0]
    return t("part").select("p_partkey", filled["content"].alias("content"), filled["role"].alias("role"), prompts.numbered_answers(F.array("p_name", "p_brand")).alias("answers"), F.size(prompts.allowed_words(F.col("p_name"), "yes no")).alias("allowed"))


@query(r"""WITH x AS (SELECT conv_id * 100 + turn AS id, regexp_extract_all(text, '\d+.\d+|[\p{L}\p{N}_]+|\.{3}|[.,!?:;()\[\]«»]') AS w FROM conversations),
e AS (SELECT id, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM x), p AS (SELECT *, lag(t) OVER (PARTITION BY id ORDER BY i) AS last FROM e)
SELECT id, string_agg(CASE WHEN last IS NULL OR t IN ('.', ',', '!', '?', ':', ';', '»', ')', '...') OR last IN ('(', '«') THEN t ELSE ' ' || t END, '' ORDER BY i) AS text FROM p GROUP BY id""")
def joined_tokens(t):
    rows = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), spans.tag_tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return rows.select("id", spans.join_tokens(F.col("w")).alias("text"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS b, CAST(l_quantity AS INTEGER) + l_linenumber AS e, l_returnflag AS tag FROM lineitem), x AS (SELECT l_orderkey, l_linenumber, b, e, tag FROM l UNION ALL SELECT l_orderkey, l_linenumber, b + 1, e + 3, tag FROM l)
SELECT l_orderkey, string_agg(tag || b || '-' || e, ' ' ORDER BY b, e DESC, tag) AS spans FROM x GROUP BY 1""")
def annotated_spans(t):
    """A line of an order as an annotation of two stretches of characters."""
    b = F.col("l_quantity").cast("int")
    line = F.format_string("T%d\t%s %d %d;%d %d\tsome text", "l_linenumber", "l_returnflag", b, b + F.col("l_linenumber"), b + 1, b + F.col("l_linenumber") + 3)
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines")).select("l_orderkey", spans.annotations(F.col("lines")).alias("a"))
    return rows.select("l_orderkey", F.array_join(F.transform("a", lambda x: F.concat(x["tag"], x["begin"].cast("string"), F.lit("-"), x["end"].cast("string"))), " ").alias("spans"))


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT c_custkey, CASE WHEN pos < 10 THEN 'prompt' ELSE 'test' END AS part, CAST(pos % 2 AS INTEGER) AS side, pos BETWEEN 29 AND 33 AS shot FROM r""")
def positional_split(t):
    c = t("customer").select("c_custkey")
    first, others = sampling.positional_split(c, 10, "c_custkey")
    both = first.withColumn("part", F.lit("prompt")).unionByName(others.withColumn("part", F.lit("test")))
    shots = sampling.few_shot(c, 5, "c_custkey", start=29).select("c_custkey", F.lit(True).alias("s"))
    return sampling.parity(both).join(F.broadcast(shots), "c_custkey", "left").select("c_custkey", "part", "side", F.coalesce("s", F.lit(False)).alias("shot"))


@query("SELECT c_custkey, unnest([c_name, c_mktsegment]) AS text, unnest([1, 0]) AS correct FROM customer WHERE c_acctbal > 0")
def right_and_wrong(t):
    rows = sampling.with_gold(t("customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") > 0, "known").alias("gold")), "gold").drop("gold")
    return sampling.both_ways(rows, "c_name", "c_mktsegment")


@query("SELECT r_name AS model, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE upper(s_name) END AS a, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS b FROM supplier, region")
def models_by_questions(t):
    """Every question for every model, with its two answers in the order that the question says."""
    rows = sampling.aligned(t("supplier").select("s_suppkey", F.col("s_name").alias("a"), F.upper("s_name").alias("b"), F.when(F.col("s_suppkey") % 2 == 0, "s").otherwise("i").alias("o")), "a", "b", "o").drop("o")
    return sampling.crossed(rows, t("region").select(F.col("r_name").alias("model")))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT c_nationkey, count(*) FILTER (pos < 5) AS shots, count(*) FILTER (pos >= 5) AS asked FROM r GROUP BY 1")
def subject_split(t):
    shots, asked = sampling.by_subject(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5, "c_custkey")
    n = lambda df, name: df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias(name))
    return n(shots, "shots").join(n(asked, "asked"), "c_nationkey", "left").select("c_nationkey", "shots", F.coalesce("asked", F.lit(0).cast("bigint")).alias("asked"))


@query(BATTLES + " SELECT count(DISTINCT m) AS models, count(*) FILTER (w = 2) AS ties, count(*) FILTER (w < 2) AS decisive FROM (SELECT unnest([model, reference]) AS m, winner AS w FROM b)".replace("count(*) FILTER (w = 2)", "CAST(count(*) FILTER (w = 2) / 2 AS BIGINT)").replace("count(*) FILTER (w < 2)", "CAST(count(*) FILTER (w < 2) / 2 AS BIGINT)"))
def battle_totals(t):
    counts = rating.pair_counts(battles(t))
    n = lambda c: F.sum(c).cast("bigint")
    names = counts.select(F.explode(F.array("model", "reference")).alias("m")).agg(F.countDistinct("m").alias("models"))
    return counts.agg(n(F.col("ties")).alias("ties"), n(F.col("wins") + F.col("losses")).alias("decisive")).join(F.broadcast(names)).select("models", "ties", "decisive")

