"""Registered queries of the corpus operators and, where SQL can say them, their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from crewcast.llm.conversation_repair import damaged, repair_report
from crewcast.llm.decontamination import contaminated
from crewcast.llm.html_text import html_texts
from crewcast.llm.licences import TEMPLATES, licence_matches
from crewcast.llm.line_dedup import line_digests
from crewcast.llm.near_dup import near_duplicates
from crewcast.llm.packing import packed
from crewcast.llm.preferences import neighbour_pairs, preferences
from crewcast.llm.quality_model import quality_scores
from crewcast.llm.quality_rules import quality_rules
from crewcast.llm.ranked_search import ranked_documents
from crewcast.llm.substrings import substring_digests
from crewcast.llm.toxicity import toxicity_scores


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(_documents(spark, folder))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_documents(spark, folder), _labels(spark, folder))


def op4_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licence_matches(_documents(spark, folder))


def op7_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(_documents(spark, folder), _labels(spark, folder))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_documents(spark, folder))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_digests(_documents(spark, folder))


def op8_preference_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All neighbouring conversations; spans as text, "first-end" with commas."""
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    result = preferences(neighbour_pairs(conversations), conversations)
    for side in ("chosen_spans", "rejected_spans"):
        shown = F.transform(side, lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string")))
        result = result.withColumn(side, F.array_join(shown, ","))
    return result


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_texts(spark.read.parquet(f"{folder}/pages.parquet"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(_documents(spark, folder), _labels(spark, folder))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return repair_report(conversations, damaged(conversations))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_documents(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_digests(_documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_licence_scan": op4_licence_scan,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_model": op7_quality_model,
    "op8_preference_formatting": op8_preference_formatting,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ranked_search": op12_ranked_search,
    "op13_line_dedup": op13_line_dedup,
    "pipeline": corpus_pipeline.run,
}

def _values(rows) -> str:
    quoted = lambda v: f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(quoted(v) for v in row)})" for row in rows)


_BIGRAMS = """list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"""
_NORMALISED = """string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"""

SQL: dict[str, str] = {
    "op2_decontamination": """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 3)) AS pos,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) >= 5
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), item_shingles AS (
  SELECT item_id, len(w) AS length,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM item_words WHERE len(w) >= 5
), item_weights AS (
  SELECT item_id, length, s, count(*) AS weight FROM item_shingles GROUP BY ALL
), pairs AS (
  SELECT DISTINCT doc_id, item_id, length, n FROM shingles JOIN item_weights USING (s)
), windows AS (
  SELECT doc_id, item_id, length, n, unnest(range(1, n - least(length, n) + 2)) AS start FROM pairs
), window_weights AS (
  SELECT doc_id, item_id, length, start, s, count(*) AS weight
  FROM windows JOIN shingles USING (doc_id, n)
  WHERE pos BETWEEN start AND start + least(length, n) - 5 GROUP BY ALL
), compared AS (
  SELECT doc_id, item_id, start, any_value(length) - 4 AS item_size, sum(ww.weight) AS size,
         sum(least(ww.weight, coalesce(iw.weight, 0))) AS common
  FROM window_weights ww LEFT JOIN item_weights iw USING (item_id, length, s) GROUP BY ALL
)
SELECT doc_id, item_id, max(common::DOUBLE / (size + item_size - common)::DOUBLE) AS similarity
FROM compared WHERE 100 * common >= 75 * (size + item_size - common) GROUP BY ALL""",
    "op4_licence_scan": f"""
WITH templates(template, licence, text) AS (VALUES {_values((n, *t) for n, t in enumerate(TEMPLATES))}),
template_words AS (SELECT template, licence, {_NORMALISED.format(text="text")} AS words FROM templates),
known AS (SELECT template, licence, {_BIGRAMS} AS b FROM template_words),
texts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, false AS whole_text FROM documents
  UNION ALL SELECT doc_id, text, true FROM documents
), numbered AS (
  SELECT row_number() OVER () AS unit, doc_id, whole_text, {_NORMALISED.format(text="unit")} AS words FROM texts
), units AS (SELECT unit, doc_id, whole_text, {_BIGRAMS} AS b FROM numbered),
unit_bigrams AS (SELECT unit, doc_id, whole_text, len(b) AS n, unnest(b) AS h FROM units),
template_bigrams AS (SELECT template, licence, len(b) AS size, unnest(b) AS h FROM known),
matches AS (
  SELECT doc_id, unit, whole_text, template, licence, round(2.0::DOUBLE * count(*) / (n + size), 6) AS dice
  FROM unit_bigrams JOIN template_bigrams USING (h) GROUP BY doc_id, unit, whole_text, template, licence, n, size
)
SELECT doc_id, licence, max(dice) AS dice, arg_max(whole_text, dice + whole_text::INT * 1e-9) AS whole_text
FROM (
  SELECT * FROM matches WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY dice DESC, template) = 1
) GROUP BY doc_id, licence""",
    "op8_preference_formatting": """
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         '<|' || role || '|>' || chr(10) AS header
  FROM rows
), pairs AS (
  SELECT min(conv_id) AS chosen_id, max(conv_id) AS rejected_id
  FROM rows GROUP BY conv_id >> 1 HAVING min(conv_id) < max(conv_id)
), shared AS (
  SELECT p.*, coalesce((
    SELECT min(coalesce(c.n, r.n)) - 1
    FROM (SELECT * FROM turns WHERE conv_id = p.chosen_id) c
    FULL JOIN (SELECT * FROM turns WHERE conv_id = p.rejected_id) r ON c.n = r.n
    WHERE (c.role, c.text) IS DISTINCT FROM (r.role, r.text)
  ), (SELECT max(n) FROM turns WHERE conv_id = p.chosen_id)) AS k
  FROM pairs p
), placed AS (
  SELECT chosen_id, rejected_id, k, conv_id = chosen_id AS is_chosen, n, role,
         header || text || '<|end|>' || chr(10) AS piece, length(header) AS head,
         sum(length(header || text) + 8) OVER (
           PARTITION BY chosen_id, conv_id ORDER BY n) - length(header || text) - 8 AS before
  FROM shared JOIN turns ON conv_id IN (chosen_id, rejected_id) WHERE n > k
), sides AS (
  SELECT chosen_id, is_chosen, string_agg(piece, '' ORDER BY n) AS text,
         coalesce(string_agg((before + head)::BIGINT || '-' || (before + length(piece))::BIGINT, ',' ORDER BY n)
           FILTER (role = 'assistant'), '') AS spans
  FROM placed GROUP BY ALL
), prompts AS (
  SELECT chosen_id, string_agg(header || text || '<|end|>' || chr(10), '' ORDER BY n) AS prompt
  FROM shared JOIN turns ON conv_id = chosen_id WHERE n <= k GROUP BY ALL
)
SELECT s.chosen_id, s.rejected_id, s.k::INT AS shared_turns, coalesce(p.prompt, '') AS prompt,
       coalesce(c.text, '') AS chosen, coalesce(r.text, '') AS rejected,
       coalesce(c.spans, '') AS chosen_spans, coalesce(r.spans, '') AS rejected_spans
FROM shared s LEFT JOIN prompts p USING (chosen_id)
LEFT JOIN sides c ON c.chosen_id = s.chosen_id AND c.is_chosen
LEFT JOIN sides r ON r.chosen_id = s.chosen_id AND NOT r.is_chosen""",
    "op5_near_duplicates": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.h = y.h AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT b, other FROM reached JOIN links ON a = doc_id
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)""",
    "op6_substring_dedup": """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos,
         unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS s
  FROM words WHERE len(w) >= 50
), firsts AS (
  SELECT s, min(doc_id) AS earliest FROM windows GROUP BY s
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos
  FROM (SELECT doc_id, pos, unnest(range(0, 50)) AS k FROM windows JOIN firsts USING (s) WHERE earliest < doc_id)
), placed AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM placed ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)""",
    "op11_conversation_repair": """
WITH RECURSIVE sums AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
             lambda c: list_transform(range(8), lambda b: ((ascii(c) >> b::INT) & 1)::BIGINT))),
           lambda crc, b: CASE WHEN xor(crc & 1, b) = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END,
           4294967295::BIGINT)) % 20 AS kind
  FROM conversations
), turns AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM sums WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM turns
), faulty AS (
  SELECT conv_id, turn, n, role, text, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN n > min(n) OVER (PARTITION BY conv_id, role, text) THEN 'r'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '-' END AS fault
  FROM numbered
), moves(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(p, q, cost, audit, lines) AS (
  SELECT s, s, 0, '', []::VARCHAR[] FROM range(4) t(s)
  UNION ALL VALUES (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
         (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
), edits AS (
  SELECT conv_id, n, p, p AS q, 2 AS cost, 'D' AS audit, []::VARCHAR[] AS lines FROM faulty, (SELECT s AS p FROM range(4) t(s))
  UNION ALL SELECT conv_id, n, p, q, CASE fault WHEN 't' THEN 5 ELSE 0 END, 'K', [role || ':' || text]
  FROM faulty JOIN moves USING (initial) WHERE fault IN ('-', 't')
  UNION ALL SELECT conv_id, n, p, q, CASE fault WHEN 't' THEN 6 ELSE 1 END, 'R', [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM faulty, moves m WHERE fault IN ('-', 't') AND m.initial <> 's'
), parsed AS (
  SELECT conv_id, 0::BIGINT AS n, q::BIGINT AS state, {'cost': cost::BIGINT, 'audit': audit, 'lines': lines} AS best
  FROM (SELECT DISTINCT conv_id FROM faulty), inserts WHERE p = 0
  UNION ALL
  SELECT e.conv_id, e.n, i.q::BIGINT,
         min({'cost': (x.best.cost + e.cost + i.cost)::BIGINT, 'audit': x.best.audit || e.audit || i.audit, 'lines': x.best.lines || e.lines || i.lines})
  FROM parsed x JOIN edits e ON e.conv_id IS NOT DISTINCT FROM x.conv_id AND e.n = x.n + 1 AND e.p = x.state JOIN inserts i ON i.p = e.q
  GROUP BY e.conv_id, e.n, i.q
), repaired AS (
  SELECT p.conv_id, min(best) AS best
  FROM parsed p JOIN (SELECT conv_id, max(n) AS n FROM faulty GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.n = p.n
  WHERE state IN (0, 3) GROUP BY p.conv_id
), pairs AS (
  SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair, n FROM faulty
), counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'r') AS duplicate, count(*) FILTER (fault = 't') AS truncated
  FROM faulty GROUP BY conv_id
), broken AS (
  SELECT conv_id, count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN broken b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_ranked_search": """
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), lengths AS (SELECT doc, doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
occurrences AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM words) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM occurrences, totals GROUP BY term, docs),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), item_terms AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM item_words) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, doc, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM item_terms JOIN weights USING (term) JOIN occurrences USING (term) JOIN lengths USING (doc), totals GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20""",
    "op13_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (SELECT doc_id, pos, line, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
