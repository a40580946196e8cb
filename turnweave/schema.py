"""Row types of the conversation engine (Spark DDL)."""

MESSAGE = "struct<role:string,content:string>"
HISTORY = f"array<{MESSAGE}>"
TURN = "conv_id bigint, turn_id int, role string, content string, token_count int"
CASE = f"case_id string, category string, history {HISTORY}, query string, gold_answer string, evidence_turn_ids array<int>"
TIERS = ("KEEP_RECENT", "KEEP_FULL", "COMPRESS", "DROP")
