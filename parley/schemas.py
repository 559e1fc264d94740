"""Schemas of the engine's tables, as DDL."""

RAW_MESSAGE = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string"
MESSAGE = "tweet_id string, author_id string, inbound boolean, created_at timestamp, text string, response_tweet_id string, in_response_to_tweet_id string"
THREAD = f"thread_id string, tweets array<struct<{', '.join(c.replace(' ', ':') for c in MESSAGE.split(', '))}>>, terminal boolean"
CORPUS = "doc_id string, query_text string, resolution_text string"
HIT = "doc_id string, score double, rank int"
REVIEW = "thread_id string, escalation_tier string, reviewer_minutes double, sla_target_minutes int, actual_response_delay_minutes double, error_caught boolean, error_severity string, timestamp timestamp"
CONTAINMENT = "thread_id string, customer_id string, intent string, contained boolean, csat_score double, had_repeat_contact_within_48h boolean, conflicting_signals boolean, first_response_at timestamp"
THREAD_RECORD = "thread_id string, customer_id string, intent string, created_at timestamp"
GOLDEN = "example_id string, query string, retrieved_contexts array<string>, generated_response string, human_score int, annotator_id string, rubric_name string, metadata map<string,string>"
EVALUATION = "item_id string, approach string, response string, declined boolean, error string, context_precision double, context_recall double, faithfulness double, score double"
