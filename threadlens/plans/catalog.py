"""Registry of named queries: each is (spark, sf_dir) -> DataFrame plus, where
the result is SQL-expressible, the same query as DuckDB SQL over the driver's
tables (the oracle)."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Role CTEs for the oracle: the same posts/comments mapping as sources.roles.

EV_CTES = """
ev AS (SELECT event_id, ts, user_id, event_type, value,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS rn
                            FROM ev) WHERE rn = 1),
posts AS (SELECT k AS post_id, event_type AS subreddit, CAST(user_id AS VARCHAR) AS author,
                 ts AS created_utc, value AS score, event_id AS src_id FROM ev_first),
comments AS (SELECT event_id AS comment_id, k AS post_id, CAST(k AS VARCHAR) AS parent_id,
                    CAST(user_id AS VARCHAR) AS author, ts AS created_utc, value AS score,
                    event_type AS src_type
             FROM ev WHERE event_id NOT IN (SELECT event_id FROM ev_first))
"""

ORD_CTES = """
posts AS (SELECT o_orderkey AS post_id, o_orderpriority AS subreddit,
                 CAST(o_custkey AS VARCHAR) AS author, o_orderdate AS created_utc,
                 o_totalprice AS score, o_orderstatus AS flair FROM orders),
comments AS (SELECT l_orderkey AS post_id, CAST(l_suppkey AS VARCHAR) AS author,
                    l_shipdate AS created_utc, l_quantity AS score,
                    l_linenumber AS comment_line, l_partkey AS comment_part FROM lineitem)
"""

TEXT_CTES = """
ndocs AS (SELECT count(*) AS n FROM documents),
posts_t AS (SELECT p.*, d.text AS title FROM posts p
            LEFT JOIN documents d ON d.doc_id = p.src_id % (SELECT n FROM ndocs)),
comments_t AS (SELECT c.*, d.text AS body FROM comments c
               LEFT JOIN documents d ON d.doc_id = c.comment_id % (SELECT n FROM ndocs))
"""

FLAG_CTES = """
fbase AS (SELECT src_id AS id, author AS username, 'post' AS interaction_type, subreddit,
                 post_id, CAST(NULL AS VARCHAR) AS parent_id, created_utc, CAST(trunc(score) AS INTEGER) AS score
          FROM posts
          UNION ALL
          SELECT comment_id, author, 'comment', src_type, post_id, parent_id, created_utc,
                 CAST(trunc(score) AS INTEGER) FROM comments),
flagged AS (SELECT * FROM fbase
            UNION ALL
            SELECT id + 1000000000, username, interaction_type, subreddit, post_id, parent_id,
                   created_utc, score FROM fbase WHERE subreddit = 'click')
"""

REPLY_CTES = """
replies AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS msg_id,
                   CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) END
                     AS parent_msg_id,
                   conv_id, turn, role || CAST(conv_id % 10 AS VARCHAR) AS author, text
            FROM conversations)
"""


def sql(*ctes: str, body: str) -> str:
    """Compose ``WITH <ctes> <body>``; ``body`` may start with more CTEs
    (then it must begin with a comma-free definition list via ``extra``)."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


# Fixture windows used by the registered queries.
EV_START, EV_END = "2024-01-03", "2024-01-27"
ORD_START, ORD_END = "1996-01-01", "1999-12-31"
ORD_COMMUNITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
EV_COMMUNITIES = ("click", "purchase", "view")


def load_all() -> None:
    """Import every query module so their @register calls run."""
    import importlib
    for m in ("q_graph", "q_ingest", "q_engagement", "q_timeseries", "q_text", "q_ml", "q_reports", "q_streaming"):
        importlib.import_module(f"threadlens.plans.{m}")
