"""Schemas of the inputs and tables, as DDL."""

#: A corpus of articles with paragraphs, and the same with questions.
CORPUS = "data ARRAY<STRUCT<title: STRING, paragraphs: ARRAY<STRUCT<context: STRING>>>>"
READING = (
    "data ARRAY<STRUCT<title: STRING, paragraphs: ARRAY<STRUCT<id: STRING, is_paragraph: BOOLEAN, context: STRING, "
    "qas: ARRAY<STRUCT<id: STRING, question: STRING, is_impossible: BOOLEAN, answers: ARRAY<STRUCT<text: STRING, answer_start: INT>>>>>>>>"
)
#: Open-domain questions.
QUESTIONS = "data ARRAY<STRUCT<id: STRING, question: STRING, answers: ARRAY<STRING>, titles: ARRAY<STRING>, origin: STRING>>"
GENERATED = "question STRING, answer ARRAY<STRING>, answers ARRAY<STRUCT<text: STRING, offset: INT, passage_id: BIGINT>>, hard_neg_pids ARRAY<BIGINT>"
PASSAGES = "id STRING, text STRING, title STRING"
PROVENANCE = "id STRING, input STRING, output ARRAY<STRUCT<answer: STRING, provenance: ARRAY<STRUCT<wikipedia_id: STRING, title: STRING>>>>"
ARTICLES = "id STRING, title STRING, text STRING"
PASSAGE_RESULTS = "id STRING, question STRING, answers ARRAY<STRING>, ctxs ARRAY<STRUCT<title: STRING, text: STRING, has_answer: BOOLEAN>>"
#: Tables of the index.
PHRASES = "doc_idx BIGINT, idx BIGINT, f2o BIGINT, vec ARRAY<DOUBLE>"
POSTINGS = "cluster_id INT, id BIGINT, vec ARRAY<DOUBLE>"
HITS = "qid BIGINT, anchor INT, rank INT, doc_idx BIGINT, start_idx BIGINT, end_idx BIGINT, start_f2o BIGINT, end_f2o BIGINT, score DOUBLE"
_SPAN = "start_token: INT, end_token: INT, start_byte: INT, end_byte: INT"
NATURAL = f"""example_id BIGINT, document_title STRING, document_url STRING, question_text STRING, document_html STRING, document_text STRING,
question_tokens ARRAY<STRING>, document_tokens ARRAY<STRUCT<token: STRING, html_token: BOOLEAN, start_byte: INT, end_byte: INT>>,
long_answer_candidates ARRAY<STRUCT<{_SPAN}, top_level: BOOLEAN>>,
annotations ARRAY<STRUCT<annotation_id: STRING, yes_no_answer: STRING, long_answer: STRUCT<{_SPAN}, candidate_index: INT>, short_answers: ARRAY<STRUCT<{_SPAN}>>>>"""
