"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, label_of, needed, run_words, telling_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.line_dedup import dedup_lines

    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH ls AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, unnest(range(len(parts))) AS p, unnest(parts) AS line FROM ls),
w AS (SELECT doc_id, p, lead(p, 2) OVER d AS q, line AS l0, lead(line) OVER d AS l1, lead(line, 2) OVER d AS l2
      FROM u WHERE regexp_matches(line, '[^ \t\r\f\x0B]') WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
o AS (SELECT *, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, p) AS nth FROM w WHERE q IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS p FROM o WHERE nth > 1)
SELECT u.doc_id, count(*) AS n_lines, count(gone.p) AS n_removed,
       sha256(coalesce(string_agg(u.line, chr(10) ORDER BY u.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.p = u.p GROUP BY u.doc_id
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.suffix_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{label}', {quoted(body.split())})" for body, label in PHRASES.items())
    telling = telling_words(TEMPLATES)
    templates = ", ".join(
        f"('{label_of(name)}', {quoted(words)}, {needed(len(words), THRESHOLD)}, {quoted(sorted(telling[name]))}::VARCHAR[], {needed(len(telling[name]), THRESHOLD)}, {run_words(body)})" for name, body in TEMPLATES.items() if (words := sorted(set(body.split())))
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) t(label, words)), t AS (SELECT * FROM (VALUES {templates}) t(label, words, need, telling, need_telling, run)),
places AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(words)] = words)) AS place FROM d, p),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY r),
likely AS (SELECT r, w, t.* FROM (SELECT r, w, list_distinct(w) AS all_words FROM d), t WHERE len(list_intersect(all_words, words)) >= need),
blocks AS (SELECT r, label, words, need, telling, need_telling, list_distinct(w[b + 1 : b + run]) AS held FROM (SELECT *, unnest(range(len(w))) AS b FROM likely)),
met AS (SELECT r, label, len(list_intersect(held, words)) / len(words) AS share, len(list_intersect(held, telling)) >= need_telling AS told FROM blocks WHERE len(list_intersect(held, words)) >= need),
found AS (SELECT r, label, true AS is_base, 1.0 AS share FROM places UNION ALL SELECT r, label, false, share FROM met WHERE told),
all_met AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS met_labels FROM met GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(met_labels, '') AS met_labels
FROM d LEFT JOIN base ON base.r = d.r LEFT JOIN named ON named.r = d.r LEFT JOIN all_met ON all_met.r = d.r
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.decontaminate import scan

    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS win
       FROM (SELECT item, w, unnest(range(greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.flac import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation whose texts look like control strings.
PROBE_SQL = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.chat import conversation_digests, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PROBE_SQL))
    return conversation_digests(format_conversations(rows))


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text)),
e AS (SELECT *, replace(replace(replace(replace(text, chr(92), chr(92) || '-'), '<', chr(92) || 'l'), '[', chr(92) || 'b'), ']', chr(92) || 'r') AS written,
             replace(replace(replace(replace(role, chr(92), chr(92) || '-'), '<', chr(92) || 'l'), '[', chr(92) || 'b'), ']', chr(92) || 'r') AS written_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(written) + length(written_role) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from keyweave.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > first_id, false)} AS x
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
fails AS (SELECT row_number() OVER () AS r, part, good, toxic, concat(CASE WHEN x.A THEN 'A' ELSE '' END, CASE WHEN x.B THEN 'B' ELSE '' END, CASE WHEN x.C THEN 'C' ELSE '' END, CASE WHEN x.D THEN 'D' ELSE '' END, CASE WHEN x.E THEN 'E' ELSE '' END) AS failed FROM f),
cells AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM fails GROUP BY part, failed),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS c, n, n_good, n_toxic, failed,
             contains(failed, substr(filter_order, step, 1)) AS now, len(list_intersect(string_split(failed, ''), string_split(substr(filter_order, 1, step - 1), ''))) > 0 AND failed <> '' AND step > 1 AS before
      FROM cells, steps),
m AS (SELECT part, filter_order, step, c, sum(n) FILTER (WHERE NOT before AND NOT now) AS kept, sum(n) FILTER (WHERE NOT before AND now) AS removed, sum(n) FILTER (WHERE before AND now) AS redundant,
             sum(n) FILTER (WHERE failed = c) AS unique_fails, sum(n_good) FILTER (WHERE NOT before AND now) AS good_lost, sum(n_toxic) FILTER (WHERE NOT before AND now) AS toxic_lost
      FROM s GROUP BY part, filter_order, step, c)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM m
"""


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.llm.pages import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_flac": op7_flac,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_alignment": op11_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_main_text": op13_main_text,
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op5_license_scan": _license_sql(), "op6_decontamination": OP6_SQL, "op10_chat_format": OP10_SQL, "op12_filter_audit": OP12_SQL}
