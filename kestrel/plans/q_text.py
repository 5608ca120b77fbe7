"""Registered text queries over documents, pages, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import scalars as S
from kestrel.operators import text as X
from kestrel.plans.registry import query
from kestrel.session import Tables


@query("n01_clean_whitespace", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g') AS text FROM documents""")
def n01_clean_whitespace(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", S.clean_whitespace("text").alias("text"))


@query("n02_fixed_chunks", """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index,
  CAST(s AS INTEGER) AS char_start, CAST(least(s + 700, length(text)) AS INTEGER) AS char_end, substr(text, s + 1, 700) AS text
FROM (SELECT doc_id, text, unnest(range(0, length(text), 550)) AS s FROM documents WHERE length(text) > 0)""")
def n02_fixed_chunks(spark, sf):
    return X.fixed_chunks(Tables(spark, sf).documents, "text", "doc_id")


@query("n03_sentence_chunks")
def n03_sentence_chunks(spark, sf):
    return X.sentence_chunks(Tables(spark, sf).documents, "text", "doc_id")


@query("n03b_chunk_stats")
def n03b_chunk_stats(spark, sf):
    d = Tables(spark, sf).documents
    return X.chunk_stats(X.sentence_chunks(d, "text", "doc_id").join(d.select("doc_id", "source"), "doc_id"), "source")


@query("n04_table_aware_chunks")
def n04_table_aware_chunks(spark, sf):
    return X.sentence_chunks(Tables(spark, sf).documents, "text", "doc_id", tables=True)


@query("n05_paragraph_chunks")
def n05_paragraph_chunks(spark, sf):
    return X.paragraph_chunks(Tables(spark, sf).documents, "text", "doc_id")


@query("n06_context_prefix", """SELECT doc_id, '[CONTEXT: ' || source || '/' || lang || '] ' || text AS contextual_text,
  text AS restored FROM documents""")
def n06_context_prefix(spark, sf):
    d = Tables(spark, sf).documents.withColumn("ctx", F.concat_ws("/", "source", "lang"))
    w = X.with_context(d, "text", "ctx")
    return w.select("doc_id", "contextual_text", X.strip_context(F.col("contextual_text")).alias("restored"))


@query("n07_row_chunks")
def n07_row_chunks(spark, sf):
    return X.row_chunks(Tables(spark, sf).orders, ["o_orderkey"], 25, source="o_orderstatus")


@query("n08_analysis_text")
def n08_analysis_text(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", S.analysis_text("text").alias("clean"))


@query("n09_page_extraction")
def n09_page_extraction(spark, sf):
    return X.extract_pages(Tables(spark, sf).pages).select("page_id", "url", "title", "description",
                                                           F.length("text").alias("text_chars"),
                                                           F.size("links").alias("n_links"), F.size("tables").alias("n_tables"))


@query("n09b_domain_link_counts")
def n09b_domain_link_counts(spark, sf):
    return X.domain_link_counts(X.page_links(X.extract_pages(Tables(spark, sf).pages)))


@query("n09c_page_table_cells")
def n09c_page_table_cells(spark, sf):
    return X.page_table_cells(X.extract_pages(Tables(spark, sf).pages))


@query("n10_markdown_tables")
def n10_markdown_tables(spark, sf):
    return X.markdown_tables(Tables(spark, sf).documents, "text", "doc_id")


_N11 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS c FROM documents),
w AS (SELECT doc_id, c, length(c) AS chars, list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '') AS ws,
  greatest(len(list_filter(string_split(c, '.'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')), 1) AS sentences FROM t),
m AS (SELECT *, len(ws) AS words, CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE / len(ws) ELSE 0 END AS avg_word_len FROM w)
SELECT doc_id, chars, words, sentences, avg_word_len, words / sentences AS avg_sentence_len,
  CASE WHEN words > 0 THEN len(list_distinct(ws)) / words ELSE 0 END AS lexical_diversity,
  CASE WHEN chars > 0 THEN length(regexp_replace(c, '[^\p{Lu}]+', '', 'g')) / chars ELSE 0 END AS upper_ratio,
  CASE WHEN chars > 0 THEN length(regexp_replace(c, '[^\p{Nd}]+', '', 'g')) / chars ELSE 0 END AS digit_ratio,
  length(regexp_replace(c, '[^.,!?;:]+', '', 'g')) AS punct,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (words / sentences)
    - 84.6::DOUBLE * (avg_word_len / greatest(words, 1)))) AS readability FROM m"""


@query("n11_text_statistics", f"SELECT doc_id, chars, upper_ratio, digit_ratio FROM ({_N11})")
def n11_text_statistics(spark, sf):
    st = X.text_statistics("text")
    return Tables(spark, sf).documents.select("doc_id", *[st[k].alias(k) for k in ("chars", "upper_ratio", "digit_ratio")])


@query("n11b_text_statistics_full", _N11)
def n11b_text_statistics_full(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", *[v.alias(k) for k, v in X.text_statistics("text").items()])


_POS = "[" + ", ".join(f"'{w}'" for w in X.POSITIVE_WORDS) + "]"
_NEG = "[" + ", ".join(f"'{w}'" for w in X.NEGATIVE_WORDS) + "]"


@query("n12_sentiment", f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'),
  lambda w: w <> '')) AS toks FROM conversations),
c AS (SELECT conv_id, turn, len(list_filter(toks, lambda w: list_contains({_POS}, w))) AS positive,
  len(list_filter(toks, lambda w: list_contains({_NEG}, w))) AS negative FROM t)
SELECT conv_id, turn, positive, negative, (positive - negative) / (positive + negative + 1) AS sentiment FROM c""")
def n12_sentiment(spark, sf):
    c = Tables(spark, sf).conversations
    s = X.sentiment("text")
    return c.select("conv_id", "turn", *[s[k].alias(k) for k in ("positive", "negative", "sentiment")])


@query("n13_review_rollup")
def n13_review_rollup(spark, sf):
    return X.review_rollup(Tables(spark, sf).conversations, "text")[1]


@query("n14_pattern_entities")
def n14_pattern_entities(spark, sf):
    return X.pattern_entities(Tables(spark, sf).documents, "text", "doc_id")


_N15 = ["order_date", "revenue", "le", "or_e"]


@query("n15_column_mentions", "\nUNION ALL ".join(
    f"""SELECT conv_id, turn, '{c}' AS "column", f AS form, instr(lower(text), f) AS "offset", instr(lower(text), f) + len(f) - 1 AS "end"
FROM (SELECT *, list_filter(['{c}', '{c.replace('_', ' ')}', '{c.replace('_', '')}'], lambda f: contains(lower(text), f))[1] AS f FROM conversations)
WHERE f IS NOT NULL""" for c in _N15))
def n15_column_mentions(spark, sf):
    return X.column_mentions(Tables(spark, sf).conversations, "text", ["conv_id", "turn"], _N15)


@query("n16_number_extraction")
def n16_number_extraction(spark, sf):
    c = Tables(spark, sf).conversations
    return c.select("conv_id", "turn", X.extract_numbers("text").alias("numbers"), X.proper_nouns("text").alias("names"))


@query("n17_grounding_score")
def n17_grounding_score(spark, sf):
    return X.grounding(Tables(spark, sf).conversations)


_INJ_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}', 'i') THEN '{p}'" for p in X.INJECTION_PATTERNS) + " END"


@query("n18_injection_flag", f"SELECT doc_id, ({_INJ_CASE}) IS NOT NULL AS unsafe, {_INJ_CASE} AS matched_pattern FROM documents")
def n18_injection_flag(spark, sf):
    f = X.injection_flag("text")
    return Tables(spark, sf).documents.select("doc_id", f["unsafe"].alias("unsafe"), f["matched_pattern"].alias("matched_pattern"))


@query("n19_sanitize", r"""SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS text FROM documents""")
def n19_sanitize(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", S.sanitize("text").alias("text"))


TAG_RULES = [("question", r"\?", 1.0), ("greeting", r"\b(hello|hi|bonjour|hola|hallo)\b", 2.0),
             ("numbers", r"\d", 0.5), ("english", r"\b(the|and|of)\b", 1.5), ("french", r"\b(le|la|les|des)\b", 1.5)]


def _tag_sql() -> str:
    tags = sorted({t for t, _, _ in TAG_RULES})
    score = {tag: " + ".join(f"CASE WHEN regexp_matches(text, '{r}', 'i') THEN {w}::DOUBLE ELSE 0 END" for t, r, w in TAG_RULES if t == tag) for tag in tags}
    best = "greatest(" + ", ".join(f"s_{t}" for t in tags) + ")"
    first = " ".join(f"WHEN s_{t} = {best} THEN '{t}'" for t in tags)
    return (f"SELECT conv_id, turn, CASE WHEN {best} = 0 THEN 'general' {first} END AS tag, {best} AS score FROM "
            f"(SELECT conv_id, turn, {', '.join(f'{e} AS s_{t}' for t, e in score.items())} FROM conversations)")


@query("n20_rule_tagging", _tag_sql())
def n20_rule_tagging(spark, sf):
    return X.tag_text(Tables(spark, sf).conversations, "text", ["conv_id", "turn"], TAG_RULES)


@query("n21_user_facts")
def n21_user_facts(spark, sf):
    return X.user_facts(Tables(spark, sf).conversations)


@query("n22_tfidf_features")
def n22_tfidf_features(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text")
    m = X.tfidf(d, "text", vocab=300, min_df=2.0, max_df=0.9, ngram=2)
    return m.transform(d).select("doc_id", "features")


@query("n23_term_relevance")
def n23_term_relevance(spark, sf):
    b = Tables(spark, sf).benchmark
    return b.select("item_id", X.term_relevance(b, "text", "the of and ering").alias("relevance"))
