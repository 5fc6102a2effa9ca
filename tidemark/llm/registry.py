"""Queries opN_<name> over whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, conversation_trie, decontaminate, html_extract, jaccard, mixing, packing, pii, quality, spelling, suffix_dedup, token_binary, toxicity
from tidemark.llm.common import table
from tidemark.llm.tokens import default_path


#: Stands in for the secret that a deployment passes to pii.pseudonymise.
PSEUDONYM_KEY = "public-demonstration-key"


def op1_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PSEUDONYM_KEY)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.encode_documents(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), end_id=2)


def categories() -> dict[str, Column]:
    """The categories of the chain in order, from the label columns."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), categories(), max_labelled=20_000)
    return toxicity.score(docs, chain).drop("text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, mixing.temperature_weights(docs), block_docs=16, with_text=False)
    return mixed.select("doc_id", "source", "block", "place", "slot")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), with_text=False)
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), min_words=50)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), min_length=6, min_count=5, ratio=5, typo_every=199)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_private_data": op1_private_data,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_token_binary": op3_token_binary,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_main_text": op8_main_text,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_decontamination": op13_decontamination,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_MIXING = """
WITH RECURSIVE
docs AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END k, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) o FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) - 1 r FROM docs),
units AS (SELECT k, CAST(greatest(1, round(400 * pow(n, 0.5) / sum(pow(n, 0.5)) OVER ())) AS BIGINT) u FROM (SELECT k, count(*) n FROM docs GROUP BY k)),
w AS (SELECT list(k ORDER BY k) ks, list(u ORDER BY k) us, CAST(sum(u) AS BIGINT) a FROM units),
schedule AS (
    SELECT CAST(-1 AS BIGINT) slot, list_transform(us, lambda x: CAST(0 AS BIGINT)) given, CAST(NULL AS BIGINT) pick FROM w
    UNION ALL
    SELECT slot + 1, list_transform(given, lambda g, j: CASE WHEN j = nxt THEN g + 1 ELSE g END), nxt
    FROM (SELECT slot, given, a, list_sort(list_filter(list_transform(range(1, len(us) + 1), lambda i: CASE WHEN floor(given[i] * a / us[i]) <= slot + 1 THEN {'d': ceil((given[i] + 1) * a / us[i]), 'i': i} END), lambda x: x IS NOT NULL))[1].i nxt FROM schedule, w)
    WHERE slot + 1 < a),
slots AS (SELECT ks[pick] k, us[pick] u, a, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 nth FROM schedule, w WHERE pick IS NOT NULL)
SELECT doc_id, source, CAST(r // 16 AS BIGINT) AS block, CAST(r % 16 AS BIGINT) AS place, CAST((r // 16) // u * a + slot AS BIGINT) AS slot
FROM ranked JOIN slots ON ranked.k = slots.k AND (r // 16) % u = nth"""

_PASSAGES = f"""
WITH docs AS (SELECT row_number() OVER () row_id, doc_id, {_WORDS.format("coalesce(text, '')")} w FROM documents),
windows AS (SELECT row_id, doc_id, len(w) n, i, md5(array_to_string(w[i + 1:i + 50], ' ')) h FROM docs, LATERAL (SELECT unnest(range(0, len(w) - 49)) i) x WHERE len(w) >= 50),
shared AS (SELECT h FROM windows GROUP BY h HAVING min(row_id) <> max(row_id)),
hits AS (SELECT row_id, doc_id, n, i, CASE WHEN i > lag(i) OVER (PARTITION BY row_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY row_id ORDER BY i) IS NULL THEN 1 ELSE 0 END new FROM windows SEMI JOIN shared USING (h)),
spans AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY i) nth FROM hits)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + 50 AS BIGINT) AS end_word, CAST(any_value(n) AS BIGINT) AS n_words FROM spans GROUP BY row_id, doc_id, nth"""

_JACCARD = f"""
WITH RECURSIVE
docs AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w FROM documents),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END s FROM docs, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) i) x WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) n FROM sets GROUP BY doc_id),
prefixes AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) p FROM sets JOIN sizes USING (doc_id) JOIN (SELECT s, count(*) f FROM sets GROUP BY s) USING (s)),
pairs AS (SELECT DISTINCT a.doc_id a, b.doc_id b, a.n an, b.n bn FROM prefixes a JOIN prefixes b ON a.s = b.s AND a.doc_id < b.doc_id WHERE a.p <= a.n - ceil(0.9::DOUBLE * a.n) + 1 AND b.p <= b.n - ceil(0.9::DOUBLE * b.n) + 1 AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, an, bn HAVING 100 * count(*) >= 90 * (an + bn - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a doc_id, min(b) c FROM reached GROUP BY a) USING (doc_id)"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 by its table of 256 entries, which is made by rule: eight shifts of each byte.
_CRC_TABLE = """crc_bits AS (SELECT i, CAST(i AS UBIGINT) c, 0 k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) t FROM crc_bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a string's UTF-8 bytes; the statement must name the table crc."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST('0x' || hex(encode({text}))[CAST(2 * i - 1 AS BIGINT):CAST(2 * i AS BIGINT)] AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT)"


_SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, w, count(*) k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, k, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} h FROM runs, crc),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END word, k FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
places AS (SELECT word, n, i, left(word, i) p, substr(word, i + 2) s FROM vocabulary, LATERAL (SELECT unnest(range(0, length(word))) i) x),
shorter AS (SELECT DISTINCT a.word longer, a.n longer_n, b.word shorter, b.n shorter_n FROM places a JOIN vocabulary b ON b.word = a.p || a.s),
near AS (SELECT a.word, b.word near, b.n near_n FROM places a JOIN places b USING (i, p, s) WHERE a.word <> b.word UNION ALL SELECT longer, shorter, shorter_n FROM shorter UNION ALL SELECT shorter, longer, longer_n FROM shorter),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) k FROM near),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) n_near, CASE WHEN near_n >= 5 * v.n THEN near END form, CASE WHEN near_n >= 5 * v.n THEN near_n END form_n FROM vocabulary v LEFT JOIN best b ON b.word = v.word AND b.k = 1),
followed AS (SELECT word, word root, 0 d FROM forms UNION ALL SELECT f.word, g.form, d + 1 FROM followed f JOIN forms g ON f.root = g.word WHERE g.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, d) root FROM followed GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""

_TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
turns AS (SELECT CAST(conv_id AS BIGINT) conv_id, turn, coalesce(role, '') r, length(coalesce(text, '')) chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || printf('%08x', length(coalesce(text, ''))) code FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(code ORDER BY turn NULLS FIRST, r, code) codes, list(chars ORDER BY turn NULLS FIRST, r, code) chars FROM turns GROUP BY conv_id),
hashed AS (SELECT *, conv_id - conv_id % 100 base, CAST({_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) h FROM own, crc),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.codes[1:h], []), a.codes[h + 1:]) codes, list_concat(coalesce(b.chars[1:h], []), a.chars[h + 1:]) chars FROM hashed a LEFT JOIN own b ON b.conv_id = a.base),
members AS (SELECT conv_id, d depth, array_to_string(codes[1:d], '') k, CASE WHEN d > 0 THEN chars[d] ELSE 0 END chars, d = len(codes) ended FROM rebuilt, LATERAL (SELECT unnest(range(0, len(codes) + 1)) d) x),
nodes AS (SELECT k, depth, min(conv_id) conv_id, count(*) n_convs, any_value(chars) chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '') ends FROM members GROUP BY k, depth),
children AS (SELECT left(k, 40 * (depth - 1)) k, count(*) c FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c, 0) n_children FROM nodes n LEFT JOIN children USING (k)),
below AS (SELECT left(k, 40 * d) k, count(*) FILTER (n_children = 0) n_leaves, sum((n_convs - 1) * chars) saved FROM counted, LATERAL (SELECT unnest(range(0, depth + 1)) d) x GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN below b ON b.k = n.k LEFT JOIN nodes p ON n.depth > 0 AND p.k = left(n.k, 40 * (n.depth - 1))"""

_PLAIN_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LEAKS = f"""
WITH docs AS (SELECT row_number() OVER () row_id, doc_id, {_PLAIN_WORDS} w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) item, {_PLAIN_WORDS} w FROM benchmark),
patterns AS (SELECT DISTINCT item, least(len(w), 10) k, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') p FROM items, LATERAL (SELECT unnest(range(0, greatest(len(w) - 9, 1))) i) x WHERE len(w) > 0),
windows AS (SELECT row_id, k, i, array_to_string(w[i + 1:i + k], ' ') p FROM docs, (SELECT DISTINCT k FROM patterns) y, LATERAL (SELECT unnest(range(0, len(w) - k + 1)) i) x),
hits AS (SELECT row_id, k, i, item FROM windows JOIN patterns USING (k, p)),
words AS (SELECT row_id, count(DISTINCT i + j) n_hit FROM hits, LATERAL (SELECT unnest(range(0, k)) j) x GROUP BY row_id),
named AS (SELECT row_id, count(*) n_items, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT row_id, item FROM hits WHERE item IS NOT NULL) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (row_id) LEFT JOIN named USING (row_id)"""

#: Texts that other models read or fit, keyed digests and the library's ids have no SQL.
ORACLES: dict[str, str] = {"op6_source_mixing": _MIXING, "op9_repeated_passages": _PASSAGES, "op10_ngram_jaccard": _JACCARD, "op11_spelling_variants": _SPELLING, "op12_conversation_trie": _TRIE, "op13_decontamination": _LEAKS}
