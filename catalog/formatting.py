from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from catalog.dirt import LABELLED_DOCUMENTS, duck, labelled_documents
from tabloom.functions import examples
from tabloom.operators import clean
from tabloom.session import stage


@query(
    """SELECT doc_id, to_json({instruction: text, output: concat_ws(chr(10), lang, source)})::VARCHAR AS value
FROM documents"""
)
def format_instruction(spark, folder):
    return examples.to_instruction_jsonl(
        table(spark, folder, "documents"), ["text"], ["lang", "source"], keep=["doc_id"]
    )


@query(
    f"""WITH t AS {duck(LABELLED_DOCUMENTS)}
SELECT doc_id, to_json({{messages: [{{role: 'user', content: concat_ws(chr(10), lang, text)}},
   {{role: 'assistant', content: coalesce(quality::VARCHAR, '')}}]}})::VARCHAR AS value FROM t"""
)
def format_chat(spark, folder):
    return examples.to_chat_jsonl(
        labelled_documents(spark, folder), ["lang", "text"], ["quality"], keep=["doc_id"]
    )


@query(
    """SELECT conv_id, turn, to_json({messages: [{role: 'system', content: 'Answer briefly.'},
   {role: 'user', content: text}]})::VARCHAR AS value FROM conversations"""
)
def format_chat_system(spark, folder):
    return examples.to_chat_jsonl(
        table(spark, folder, "conversations"), ["text", "absent"], system_prompt="Answer briefly.",
        keep=["conv_id", "turn"],
    )


@query(
    """SELECT event_id, to_json({instruction: concat_ws(chr(10), event_type, value::VARCHAR, user_id::VARCHAR),
   "input": props, output: CASE WHEN value > 50 THEN 'True' ELSE 'False' END})::VARCHAR AS value FROM events"""
)
def format_cells(spark, folder):
    events = table(spark, folder, "events").withColumn("high", F.col("value") > 50)
    return examples.to_instruction_jsonl(
        events, ["event_type", "value", "user_id"], ["high"], input_cols=["props"], keep=["event_id"]
    )


def flagship(spark, folder):
    """Documents with labels, one copy each, filled, trimmed, as chat examples."""
    documents = labelled_documents(spark, folder)
    once = stage(clean.fit_deduplicate(documents, ["text"], "doc_id", audit=False).transform(documents))
    labels = once.select("doc_id", "lang", "quality")
    filled = clean.fit_impute(labels).transform(once)
    trimmed = clean.fit_strip_whitespace(filled, audit=False).transform(filled)
    return examples.to_chat_jsonl(trimmed, ["text"], ["quality"], keep=["doc_id"])


@query(
    f"""WITH t AS {duck(LABELLED_DOCUMENTS)},
 once AS (SELECT * FROM t WHERE doc_id IN (SELECT min(doc_id) FROM t GROUP BY text))
SELECT doc_id, to_json({{messages: [
   {{role: 'user', content: trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))}},
   {{role: 'assistant', content: coalesce(quality::DOUBLE,
      (SELECT quantile_cont(quality::DOUBLE, 0.5) FROM once))::VARCHAR}}]}})::VARCHAR AS value FROM once"""
)
def labelled_chat_examples(spark, folder):
    return flagship(spark, folder)
