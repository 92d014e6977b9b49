"""Queries of models that a corpus teaches (sentences, languages, lemmas), of mathematical answers, joins by interval,
packing and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence, templates
from ..operators import languages, lemmas, optimizer, prompts, sampling, sentences
from .boards import LINES
from .registry import query

TOKENS = r"""t AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS tok FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)),
c AS (SELECT *, regexp_replace(tok, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?]+$', '', 'g') AS core FROM t),
b AS (SELECT *, lower(regexp_replace(core, '[.!?]+$', '')) AS bare FROM c),
m AS MATERIALIZED (SELECT doc_id, i, CASE WHEN regexp_matches(bare, '^[0-9]+([.,:/-][0-9]+)*$') THEN '##' ELSE bare END AS base, regexp_matches(core, '[^.!?]\.$') AS stop, regexp_matches(core, '\.\.$') AS dots,
  regexp_matches(tok, '[!?][^\p{L}\p{N}]*$') OR regexp_matches(tok, '^\.+$') AS hard, regexp_matches(core, '^\p{Lu}') AS upper FROM b),
s AS MATERIALIZED (SELECT *, lead(base) OVER w AS nb, lead(upper) OVER w AS nu FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS MATERIALIZED (SELECT base, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (stop) AS BIGINT) AS k FROM m WHERE base <> '' GROUP BY base),
z AS MATERIALIZED (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(sum(k) AS DOUBLE) AS stops FROM n),
l AS (SELECT *, stops / total AS p, CAST(length(base) - length(replace(base, '.', '')) AS DOUBLE) AS inner_, CAST(length(replace(base, '.', '')) AS DOUBLE) AS letters FROM n, z),
ty AS MATERIALIZED (SELECT base, n, k, CASE WHEN regexp_matches(base, '\p{L}') AND k > 0 THEN round(-2 * (k * ln(p) + CASE WHEN n = k THEN 0 ELSE (n - k) * ln(1 - p) END - k * ln(0.99::DOUBLE) - CASE WHEN n = k THEN 0 ELSE (n - k) * ln(1 - 0.99::DOUBLE) END) * exp(-letters) * (inner_ + 1) * power(letters, CAST(k - n AS DOUBLE)), 6) END AS score FROM l)"""
#: Log-likelihood ratio of c1, c2, c12 and total: each part is k ln p, and 0 for no k.
PART = "CASE WHEN {k} = 0 THEN 0 ELSE ({k}) * ln({p}) END"
LIKE = lambda k, n, p: PART.format(k=k, p=p) + " + " + PART.format(k=f"{n} - ({k})", p=f"1 - {p}")
RATIO = f"-2 * ({LIKE('c12', 'c1', 'c2 / total')} + {LIKE('c2 - c12', '(total - c1)', 'c2 / total')} - ({LIKE('c12', 'c1', 'CAST(c12 AS DOUBLE) / c1')}) - ({LIKE('c2 - c12', '(total - c1)', '(c2 - c12) / (total - c1)')}))"
SPECIAL = r"(base = '##' OR regexp_matches(base, '^\p{L}$'))"
PAIRED = f"""{TOKENS}, a AS MATERIALIZED (SELECT base, nb, CAST(count(*) AS BIGINT) AS c12 FROM s WHERE stop AND base <> '' AND nb <> '' GROUP BY base, nb),
sure AS (SELECT a.* FROM a JOIN ty USING (base) WHERE NOT coalesce(score >= 0.3, false) AND NOT {SPECIAL}),
f AS (SELECT nb, CAST(sum(c12) AS BIGINT) AS c12 FROM sure GROUP BY nb), fx AS (SELECT nb, c12, (SELECT CAST(sum(c12) AS DOUBLE) FROM sure) AS c1, ty.n AS c2, total FROM f JOIN ty ON ty.base = nb, z),
st AS MATERIALIZED (SELECT nb, c12 AS n, score FROM (SELECT *, round({RATIO}, 6) AS score FROM fx) WHERE regexp_matches(nb, '\\p{{L}}') AND score >= 30 AND c12 * total > c2 * c1),
cx AS (SELECT a.base, a.nb, c12, o.k AS c1, w.n AS c2, total FROM a JOIN ty o ON o.base = a.base JOIN ty w ON w.base = nb, z WHERE coalesce(o.score >= 0.3, false) OR {SPECIAL.replace('base', 'a.base')}),
co AS MATERIALIZED (SELECT base, nb, c12 AS n, score FROM (SELECT *, round({RATIO}, 6) AS score FROM cx) WHERE regexp_matches(nb, '\\p{{L}}') AND c12 > 1 AND score >= 7.88 AND c12 * total > c1 * c2)"""


@query(f"WITH {TOKENS} SELECT base, n, k AS n_stop, score, coalesce(score >= 0.3, false) AS abbreviation FROM ty WHERE k > 0")
def sentence_types(t):
    """Types seen with a full stop, and which of them are abbreviations."""
    return sentences.scored(sentences.counted(t("documents"), "text")[0]).filter("n_stop > 0")


@query(f"WITH {PAIRED} SELECT 'starter' AS kind, '' AS base, nb AS next, n, score FROM st UNION ALL SELECT 'collocation', base, nb, n, score FROM co")
def sentence_pairs(t):
    """Words that start sentences, and pairs that a stop doesn't part."""
    types, after = sentences.counts(t("documents"), "text")
    one = sentences.starters(types, after).select(F.lit("starter").alias("kind"), F.lit("").alias("base"), "next", "n", "score")
    return one.unionByName(sentences.collocations(types, after).select(F.lit("collocation").alias("kind"), "base", "next", "n", "score"))


@query(
    rf"""WITH {PAIRED}, e AS (SELECT s.doc_id, CASE WHEN s.nb IS NULL THEN false WHEN hard THEN true WHEN dots THEN nu WHEN stop THEN CASE WHEN co.base IS NOT NULL THEN false WHEN s.base = '##' THEN nu
 WHEN coalesce(ty.score >= 0.3, false) OR regexp_matches(s.base, '^\p{{L}}$') THEN nu AND st.nb IS NOT NULL ELSE true END ELSE false END AS ends
FROM s LEFT JOIN ty ON ty.base = s.base LEFT JOIN st ON st.nb = s.nb LEFT JOIN co ON co.base = s.base AND co.nb = s.nb)
SELECT doc_id, CAST(count(e.doc_id) FILTER (ends) + CASE WHEN count(e.doc_id) > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_sentences FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id"""
)
def sentence_counts(t):
    """Sentences of each document by the model of all."""
    return sentences.per_text(t("documents"), "doc_id", "text").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_sentences"))


GRAMS = r"""w AS MATERIALIZED (SELECT doc_id, lang, '_' || unnest(regexp_extract_all(lower(text), '(\p{L}+)')) || '_' AS word FROM documents),
v AS MATERIALIZED (SELECT DISTINCT word FROM w), vg AS MATERIALIZED (SELECT word, unnest(list_concat(list_concat(list_transform(range(1, length(word) + 1), lambda i: substr(word, i, 1)), list_transform(range(1, length(word)), lambda i: substr(word, i, 2))), list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3)))) AS gram FROM v),
c AS (SELECT lang, word, count(*) AS n FROM w WHERE lang IS NOT NULL GROUP BY ALL), g AS MATERIALIZED (SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM c JOIN vg USING (word) GROUP BY ALL)"""
WEIGHTS = f"""{GRAMS}, k AS MATERIALIZED (SELECT gram FROM g GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {languages.MOST}), kg AS (SELECT g.* FROM g JOIN k USING (gram)), tot AS (SELECT lang, sum(n) AS total FROM kg GROUP BY lang),
wt AS MATERIALIZED (SELECT tot.lang, k.gram, CAST(round(ln((coalesce(kg.n, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * (SELECT count(*) FROM k))) * {languages.SCALE}) AS BIGINT) AS weight FROM k CROSS JOIN tot LEFT JOIN kg ON kg.lang = tot.lang AND kg.gram = k.gram)"""


@query(f"WITH {WEIGHTS} SELECT lang, gram, weight FROM wt")
def language_weights(t):
    return languages.weights(languages.gram_counts(t("documents"), "lang", "text"))


@query(f"WITH {WEIGHTS}, ws AS MATERIALIZED (SELECT word, lang, sum(weight) AS weight FROM vg JOIN wt USING (gram) GROUP BY ALL), dw AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), sc AS (SELECT doc_id, ws.lang, sum(n * weight) AS score FROM dw JOIN ws USING (word) GROUP BY ALL), b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM sc) SELECT d.doc_id, d.lang, b.lang AS guess FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1")
def language_guess(t):
    """The language of each document by the weights that all of them give."""
    d = t("documents")
    return d.select("doc_id", "lang", languages.learn(d, "lang", "text").guess(F.col("text")).alias("guess"))


#: Endings by which the corpus pairs a word with a shorter one of its own: a lexicon for the lemmatiser to learn from.
ENDINGS = ("s", "es", "ed", "ing", "en", "er", "e", "n")
LEXICON = rf"""w AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\p{{L}}+)')) AS word FROM documents),
e AS (SELECT unnest({list(ENDINGS)}) AS ending), x AS (SELECT w.word, v.word AS stem, length(ending) AS k FROM w JOIN e ON ends_with(w.word, ending) AND length(w.word) - length(ending) >= 3 JOIN w v ON v.word = substr(w.word, 1, length(w.word) - length(ending))),
p AS MATERIALIZED (SELECT w.word AS form, coalesce(arg_max(stem, k), w.word) AS lemma FROM w LEFT JOIN x USING (word) GROUP BY w.word)"""
RULES = """c AS (SELECT form, lemma, len(list_filter(range(1, least(length(form), length(lemma)) + 1), lambda i: substr(form, 1, i) = substr(lemma, 1, i))) AS same FROM p),
r AS (SELECT form, length(form) - same AS strip, substr(lemma, same + 1) AS add FROM c), y AS (SELECT right('^' || form, unnest(range(strip, least(strip + 4, length(form) + 1) + 1))) AS suffix, strip, add FROM r),
q AS (SELECT suffix, strip, add, count(*) AS n FROM y GROUP BY ALL), best AS MATERIALIZED (SELECT suffix, strip, add, n FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, strip, add) AS k FROM q) WHERE k = 1),
rules AS MATERIALIZED (SELECT a.* FROM best a LEFT JOIN best b ON a.suffix <> '' AND b.suffix = substr(a.suffix, 2) WHERE b.suffix IS NULL OR a.strip <> b.strip OR a.add <> b.add)"""


def lexicon(t):
    """(form, lemma): each word with the shortest word that it extends by one of the endings, the longest of them."""
    words = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).distinct()
    ends = F.filter(F.array(*map(F.lit, ENDINGS)), lambda e: F.endswith("word", e) & (F.length("word") - F.length(e) >= 3))
    cut = words.select("word", F.explode(ends).alias("e")).select("word", F.length("e").alias("k"), F.expr("substr(word, 1, length(word) - length(e))").alias("stem"))
    found = cut.join(words.select(F.col("word").alias("stem")), "stem").groupBy("word").agg(F.max_by("stem", "k").alias("stem"))
    return words.join(found, "word", "left").select(F.col("word").alias("form"), F.coalesce("stem", "word").alias("lemma"))


@query(f"WITH {LEXICON}, {RULES} SELECT suffix, CAST(strip AS INTEGER) AS strip, add, n FROM rules")
def lemma_rules(t):
    return lemmas.learn_rules(lexicon(t))


@query(f"WITH {LEXICON}, {RULES}, l AS (SELECT form, strip, add, row_number() OVER (PARTITION BY form ORDER BY length(suffix) DESC) AS k FROM p JOIN rules ON ends_with('^' || form, suffix)) SELECT p.form AS word, CASE WHEN k IS NULL THEN p.form ELSE substr(p.form, 1, length(p.form) - strip) || add END AS lemma FROM p LEFT JOIN l ON l.form = p.form AND k = 1")
def word_lemmas(t):
    """Each word of the corpus by the rules that its lexicon teaches."""
    pairs = lexicon(t)
    return lemmas.lemmas_of(pairs.select(F.col("form").alias("word")), lemmas.learn_rules(pairs)).select("word", "lemma")


@query("""SELECT p_partkey, CAST(p_partkey % 3 <> 0 AS DOUBLE) AS product, CAST(p_partkey % 5 <> 0 OR p_size = 1 AS DOUBLE) AS fraction, CAST(true AS DOUBLE) AS set_, CAST(p_partkey % 4 <> 0 AS DOUBLE) AS interval FROM part""")
def math_answers(t):
    """Products multiplied out, fractions reduced, sets in another order and unions of intervals, some of them wrong."""
    a, b, k = F.col("p_size"), F.col("p_partkey") % 7, F.col("p_partkey")
    put = lambda form, **x: prompts.fill(form, **{n: v.cast("string") for n, v in x.items()})
    boxed = lambda c: F.concat(F.lit("\\boxed{"), c, F.lit("}"))
    wrong = F.when(k % 3 == 0, 1).otherwise(0)
    product = sequence.math_equal(boxed(put("{a}x^2+{m}x+{c}", a=a, m=a * b + 2, c=2 * b + wrong)), put("(x+{b})({a}x+2)", a=a, b=b))
    fraction = sequence.math_equal(boxed(put("\\frac{x^{a}-x}{x}", a=a + 1)), put("x^{{a}}-{c}", a=a, c=F.when(k % 5 == 0, F.when(a == 1, 1).otherwise(2)).otherwise(1)))
    set_ = sequence.math_equal(boxed(put("\\{{a}, {b}, \\frac{{k}}{2}\\}", a=a, b=b, k=k)), put("{k}/2; {b}; {a}", a=a, b=b, k=k))
    low = F.when(k % 4 == 0, F.lit("[")).otherwise(F.lit("("))
    interval = sequence.math_equal(boxed(put("(-\\infty;-{a}]\\cup({a};\\infty)", a=a)), put("{low}{a},\\infty)\\cup(-\\infty,-{a}]", a=a, low=low))
    # A small file is one task's; the work is in the answers, not in the bytes.
    return sampling.spread(t("part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", product.alias("product"), fraction.alias("fraction"), set_.alias("set_"), interval.alias("interval"))


@query(LINES + """, p AS (SELECT doc_id, unnest(range(0, length(text) // 97 + 1)) * 97 AS b, text FROM documents) SELECT p.doc_id, line, b - start AS begin, b + 11 - start AS stop FROM p JOIN o ON o.doc_id = p.doc_id AND b >= start AND b + 11 <= start + length(sentence) WHERE length(sentence) > 5""")
def spans_in_lines(t):
    """Stretches of eleven characters at every 97th place of a document, in the lines that hold them whole."""
    d = t("documents")
    at = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 97).cast("int")))
    spans = d.select("doc_id", at.alias("k")).select("doc_id", (F.col("k") * 97).alias("begin"), (F.col("k") * 97 + 11).alias("stop"))
    return sampling.spans_in(sampling.sentences(d, "doc_id", "text"), spans, "doc_id").select("doc_id", F.col("line").cast("bigint").alias("line"), F.col("begin").cast("bigint").alias("begin"), F.col("stop").cast("bigint").alias("stop"))


class Quarters:
    """Four characters are a token, the last of them perhaps fewer, so lengths don't add up."""

    def render(self, texts):
        return "\n\n".join(texts)

    def count(self, prompt):
        return -(-len(prompt) // 4)


@query("""WITH b AS (SELECT text, row_number() OVER (ORDER BY p_partkey) AS k FROM (SELECT p_partkey, p_name || ', ' || p_type AS text FROM part ORDER BY p_partkey LIMIT 64)), u AS (SELECT k, sum(length(text) + 2) OVER (ORDER BY k) AS upto FROM b)
SELECT conv_id, turn, CAST(count(k) AS INTEGER) AS shots FROM conversations LEFT JOIN u ON ceil((upto + length(text)) / 4.0) < 300 GROUP BY conv_id, turn""")
def packed_by_tokens(t):
    """As many parts, as examples before a turn, as fit by a tokenizer whose lengths don't add up."""
    shots = t("part").orderBy("p_partkey").limit(64).select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(", "), "p_type").alias("text"))
    return prompts.pack_rendered(t("conversations").select("conv_id", "turn", "text"), shots, 300, "text", Quarters).select("conv_id", "turn", "shots")


@query("""WITH x AS (SELECT p_partkey, p_size, (48271::BIGINT * p_partkey + 69621 * 7 + 12345) % 2147483647 AS x FROM part), y AS (SELECT *, (x * x + 7) % 2147483647 AS y FROM x), z AS (SELECT *, (y * y + 7) % 2147483647 AS z FROM y), k AS (SELECT *, -ln(((z * 16807 % 2147483647) % 2147483647 + 0.5::DOUBLE) / 2147483647) / p_size AS time FROM z)
SELECT p_partkey, p_size, CAST(row_number() OVER (ORDER BY time, p_partkey) - 1 AS INTEGER) AS turn FROM k ORDER BY time, p_partkey LIMIT 100""")
def weighted_draws(t):
    """A hundred parts, drawn by size without replacement."""
    return optimizer.draws(t("part").select("p_partkey", "p_size"), "p_size", "p_partkey", 100, seed=7)


TEMPLATE = """{{ bos_token }}{% for message in messages %}
{% if loop.first and message.role != 'system' %}[none]
{% endif %}
{% if message['role'] == 'user' %}<u>{{ message['content'] | trim }}</u>
{% elif message['role'] in ['assistant', 'bot'] %}<a>{{ message['content'] }}{{ eos_token }}</a>
{% else %}{# others have no mark #}{{ message['content'] + '.' }}
{%- endif %}
{% endfor %}
{% if add_generation_prompt %}<a>{% endif %}"""


@query(r"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) AND role <> 'system' THEN '[none]' || chr(10) ELSE '' END
|| CASE WHEN role = 'user' THEN '<u>' || regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') || '</u>' || chr(10) WHEN role = 'assistant' THEN '<a>' || text || '#</a>' || chr(10) ELSE text || '.' END AS s FROM conversations)
SELECT conv_id, md5('^' || string_agg(s, '' ORDER BY turn) || CASE WHEN arg_max(role, turn) = 'user' THEN '<a>' ELSE '' END) AS prompt FROM t GROUP BY conv_id""".replace("\\\\", "\\"))
def chat_by_template(t):
    """Conversations by a template with a loop, conditions and filters."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    m = t("conversations").groupBy("conv_id").agg(turns.alias("m"))
    ends = F.element_at("m", -1)["role"] == "user"
    return m.select("conv_id", F.md5(templates.chat(F.col("m"), TEMPLATE, ends, bos_token="^", eos_token="#")).alias("prompt"))
