"""Schemas of the persisted relations."""

FEED_ITEM = "source string, id string, title string, abstract string, authors array<string>, feed string, feed_pos int, item_pos int"
NOTE = "file string, basename string, title string, identity string, arxiv string, read_date date, rating string, why string, tags array<string>, status string, body string, touched boolean, inlinks int, seed string"
DIRECTIVES = "body string, labs array<string>, companies array<string>, topics array<string>, authors array<string>"
CANDIDATE = "struct<arxiv:string,pool:string,lexical_score:double,terms:array<string>,model:struct<primitive:string,confidence:double,top:string,fail_reason:string>,posted:boolean,rescued:string,title:string,authors:array<string>,slack_ts:string>"
JOURNAL = f"lane string, run_id string, ts timestamp, feed string, mode string, seed string, slack_channel string, ranking string, candidates array<{CANDIDATE}>"
RECEIPT = "lane string, candidate_arxiv string, run_id string, ts timestamp, primitive string, state_bytes int, distribution string, confidence double, latency_ms int, model_version string"
LEDGER = "lane string, arxiv_id string, label_type string, source string, ts timestamp"
POSTED = "posted array<string>, updated timestamp"
SECTIONS = "arxiv string, abstract string, conclusions string"
PROPOSALS = "map<string,struct<rating:string,confidence:double,distribution:map<string,double>,model_version:string,ts:timestamp>>"
SEED_HIT = "arxiv string, title string, authors array<string>, why string"

#: Closed vocabularies, fixed values.
RATINGS = ("core", "useful", "marginal")
LABEL_TYPES = ("keep", "read-later", "skip", "discussed", "saved-implicit", "unsaved-weak-negative")
RELEVANCE = ("must-read", "worth-reading", "borderline", "unlikely", "irrelevant")
LABEL_SOURCES = ("slack-reaction", "slack-reply", "cli-keep", "checkbox", "vault-arrival", "vault-unsaved")
EXPLICIT_POSITIVE = ("keep", "read-later", "discussed")
CLASS_POSITIVE, CLASS_NEGATIVE = ("keep", "read-later"), ("skip",)

#: An attempt at a step of a day.
ATTEMPT = "lane string, step string, day date, ts timestamp_ntz, ok boolean"
