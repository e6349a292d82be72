"""The same tables in DuckDB's SQL."""

_RECORDS = """
WITH raw AS (SELECT payload::JSON AS j FROM gold_raw WHERE payload IS NOT NULL AND json_valid(payload)),
unified AS (
  SELECT example_id, question, answer, question_type, level, supporting_facts, context FROM gold
  UNION ALL
  SELECT coalesce(j->>'_id', j->>'id'), j->>'question', j->>'answer', j->>'type', j->>'level',
    CASE json_type(j, '$.supporting_facts')
      WHEN 'ARRAY' THEN list_transform(range(json_array_length(j, '$.supporting_facts')::BIGINT), lambda i:
        CASE WHEN json_type(j, '$.supporting_facts[' || i || ']') = 'NULL' THEN NULL ELSE
        {'title': json_extract_string(j, '$.supporting_facts[' || i || '][0]'),
         'sentence_id': try_cast(json_extract_string(j, '$.supporting_facts[' || i || '][1]') AS INT)} END)
      WHEN 'OBJECT' THEN list_transform(range(json_array_length(j, '$.supporting_facts.title')::BIGINT), lambda i:
        {'title': json_extract_string(j, '$.supporting_facts.title[' || i || ']'),
         'sentence_id': try_cast(json_extract_string(j, '$.supporting_facts.sent_id[' || i || ']') AS INT)}) END,
    CASE json_type(j, '$.context')
      WHEN 'ARRAY' THEN list_transform(range(json_array_length(j, '$.context')::BIGINT), lambda i:
        CASE WHEN json_type(j, '$.context[' || i || ']') = 'NULL' THEN NULL ELSE
        {'title': json_extract_string(j, '$.context[' || i || '][0]'),
         'sentences': CAST(json_extract(j, '$.context[' || i || '][1]') AS VARCHAR[])} END)
      WHEN 'OBJECT' THEN list_transform(range(json_array_length(j, '$.context.title')::BIGINT), lambda i:
        {'title': json_extract_string(j, '$.context.title[' || i || ']'),
         'sentences': CAST(json_extract(j, '$.context.sentences[' || i || ']') AS VARCHAR[])}) END
  FROM raw),
counted AS (SELECT *, count(*)::BIGINT AS n_copies FROM unified GROUP BY ALL),
records AS (SELECT row_number() OVER () AS rid, * FROM counted),
facts AS (
  SELECT rid, example_id, n_copies, i::INT AS fact_index, supporting_facts[i + 1] AS f
  FROM (SELECT *, unnest(range(len(supporting_facts)::BIGINT)) AS i FROM records)),
paragraphs AS (
  SELECT rid, example_id, n_copies, i::INT AS paragraph_index, context[i + 1] AS p
  FROM (SELECT *, unnest(range(len(context)::BIGINT)) AS i FROM records)),
sentences AS (
  SELECT rid, example_id, n_copies, paragraph_index, i::INT AS sentence_index, p.sentences[i + 1] AS sentence
  FROM (SELECT *, unnest(range(len(p.sentences)::BIGINT)) AS i FROM paragraphs))
"""

SQL = {
    "p5_found": _RECORDS
    + """
SELECT DISTINCT f.example_id, f.fact_index, p.paragraph_index, s.sentence_index
FROM facts f JOIN paragraphs p ON f.rid = p.rid AND f.f.title = p.p.title
JOIN sentences s ON s.rid = p.rid AND s.paragraph_index = p.paragraph_index AND s.sentence_index = f.f.sentence_id
WHERE s.sentence IS NOT NULL""",
    "p5_records": _RECORDS + "SELECT example_id, question, answer, question_type, level, n_copies FROM records",
    "p5_paragraphs": _RECORDS
    + "SELECT example_id, paragraph_index, p IS NOT NULL AS present, p.title AS title, n_copies FROM paragraphs",
    "p5_sentences": _RECORDS
    + """SELECT example_id, paragraph_index, sentence_index, sentence IS NOT NULL AS present, sentence, n_copies
FROM sentences""",
    "p5_facts": _RECORDS
    + """SELECT example_id, fact_index, f IS NOT NULL AS present, f.title AS title, f.sentence_id AS sentence_id, n_copies
FROM facts""",
}
