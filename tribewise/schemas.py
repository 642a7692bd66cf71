"""Record schemas, sentinels and column-name defaults (fixed values).

The raw dumps are JSON lines; only the declared fields are read, anything
else is dropped by the explicit schema.  ``created_utc`` is read as an epoch
in seconds (``bigint``) for both record types so that time deltas are
``bigint`` and never depend on string casts.
"""

# --- fixed values: record layouts and sentinels of the forum dumps ---------
COMMENTS = "comments"
SUBMISSIONS = "submissions"

COMMENTS_DDL = (
    "id STRING, parent_id STRING, score BIGINT, link_id STRING, author STRING, "
    "subreddit STRING, body STRING, created_utc BIGINT"
)
SUBMISSIONS_DDL = (
    "author STRING, created_utc BIGINT, id STRING, score BIGINT, selftext STRING, "
    "title STRING, url STRING, subreddit STRING"
)
SCHEMAS = {COMMENTS: COMMENTS_DDL, SUBMISSIONS: SUBMISSIONS_DDL}

# text column per record type
TEXT_COLUMN = {COMMENTS: "body", SUBMISSIONS: "selftext"}
# prefix of the "fullname" of a record type
FULLNAME_PREFIX = {COMMENTS: "t1_", SUBMISSIONS: "t3_"}

DELETED = "[deleted]"
REMOVED = "[removed]"
DELETED_TEXT_SENTINELS = (REMOVED, DELETED)
USER_PROFILE_PATTERN = "^u_.*"

# default names used across the library
AUTHOR = "author"
COMMUNITY = "subreddit"
COUNT = "count"
CONTEXT_OUT = "subreddit_concat"
CONTEXT_LENGTH = "context_length"
FULLNAME_ID = "fullname_id"
TIME_DELTA = "time_to_comment_in_seconds"
DOC_TEXT = "document_text"
TOKENS = "tokenized"
FILTERED_TOKENS = "tokensNoStopWords"
VECTORIZED = "vectorized"
MISSING_CLUSTER = -1
DEFAULT_TOP_N = 10000
DEFAULT_USER_EXCLUDE = 0.05
