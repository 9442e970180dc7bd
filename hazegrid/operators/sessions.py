"""Research sessions: lists, search, details, removal, knowledge graph.

Where the session table has a ``user_id``, lists, removal and the graph are per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.functions import text as X
from hazegrid.operators.series import nest_pages, top_rows

DETAIL_PAGE = 500
USER = "user_id"


def _user(df: DataFrame) -> list[str]:
    return [USER] if USER in df.columns else []


def of_user(sessions: DataFrame, user: str) -> DataFrame:
    """The sessions that a user may see."""
    return sessions.where(F.col(USER) == user)


def search_sessions(sessions: DataFrame, needle: str) -> DataFrame:
    """Sessions whose title, mode or any tag holds the needle, letter case ignored; blank finds all."""
    wanted = " ".join(needle.split(" ")).strip().lower()
    if not wanted:
        return sessions
    part = F.lit(wanted)
    return sessions.where(
        F.contains(F.lower("title"), part)
        | F.contains(F.lower("mode"), part)
        | F.exists("tags", lambda tag: F.contains(F.lower(tag), part))
    )


def session_list(sessions: DataFrame, tie: str = "session_id") -> DataFrame:
    """Pinned first, then the most recently updated; user by user where there are users."""
    return sessions.orderBy(*_user(sessions), F.desc("pinned"), F.desc("updated_at"), F.asc(tie))


def session_steps(steps: DataFrame, reports: DataFrame) -> DataFrame:
    """Steps with the session of their report, newest first at the sink (see ``newest_first``)."""
    return steps.join(reports.select("report_id", "session_id"), "report_id")


def newest_first(steps: DataFrame) -> DataFrame:
    return steps.orderBy("session_id", F.desc("created_at"))


def session_detail(
    sessions: DataFrame, messages: DataFrame, reports: DataFrame, steps: DataFrame, page_rows: int = DETAIL_PAGE
) -> DataFrame:
    """Sessions with nested messages (oldest first), reports and steps (newest first), one row per page.

    The key is (session, ``page``), for sessions of any length: a page covers ``page_rows`` consecutive numbers
    of ``created_at``, a running number unique per session in each table, so no array grows with the session.
    A session without any rows has one line with a null page.
    """
    parts = []
    for rows, fields, name, newest in (
        (messages, ["role", "content"], "messages", False),
        (reports, ["payload"], "reports", True),
        (steps, ["payload"], "steps", True),
    ):
        nested = nest_pages(rows, ["session_id"], "created_at", fields, page_rows, name)
        if newest:
            nested = nested.withColumn(name, F.sort_array(name, asc=False))
        parts.append(nested)
    joined = parts[0]
    for nested in parts[1:]:
        joined = joined.join(nested, ["session_id", "page"], "full")
    return sessions.join(joined, "session_id", "left")


def remove_sessions(
    removed: DataFrame, sessions: DataFrame, messages: DataFrame, reports: DataFrame, steps: DataFrame, feedback: DataFrame
) -> dict[str, DataFrame]:
    """All tables without the removed sessions and everything that hangs on them.

    With a ``user_id`` in ``removed`` only sessions of that very user go; other requests change nothing.
    """
    gone = removed.select("session_id", *_user(removed)).distinct()
    if _user(removed):
        gone = gone.join(sessions.select("session_id", USER), ["session_id", USER], "left_semi").select("session_id").distinct()
    gone_reports = reports.join(gone, "session_id", "left_semi").select("report_id")
    return {
        "sessions": sessions.join(gone, "session_id", "left_anti"),
        "messages": messages.join(gone, "session_id", "left_anti"),
        "reports": reports.join(gone, "session_id", "left_anti"),
        "steps": steps.join(gone_reports, "report_id", "left_anti"),
        "feedback": feedback.join(gone_reports, "report_id", "left_anti"),
    }


def recent_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    return top_rows(messages, ["session_id"], [F.desc("created_at")], n, ["created_at"])


def newest_steps(steps: DataFrame, n: int = 8) -> DataFrame:
    return top_rows(steps, ["session_id"], [F.desc("created_at")], n, ["created_at"])


def latest_report_query(reports: DataFrame) -> DataFrame:
    """The query of each session's newest report."""
    newest = top_rows(reports, ["session_id"], [F.desc("created_at")], 1, ["created_at"])
    return newest.select("session_id", F.col("query").alias("latest_query"))


def graph_edges(sessions: DataFrame) -> DataFrame:
    """Session to mode and session to each tag, weight 1, repeats kept."""
    source = F.concat(F.lit("session:"), F.col("session_id").cast("string")).alias("source")
    targets = F.concat(
        F.array(F.concat(F.lit("mode:"), F.col("mode"))),
        F.transform("tags", lambda tag: F.concat(F.lit("tag:"), tag)),
    )
    return sessions.select(*_user(sessions), source, F.explode(targets).alias("target"), F.lit(1.0).alias("weight"))


def graph_nodes(sessions: DataFrame) -> DataFrame:
    """Distinct session, mode and tag nodes (of each user)."""

    def node(prefix: str, key: Column, label: Column, group: str) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), key.cast("string")).alias("node_id"), label.alias("label"), F.lit(group).alias("group")
        )

    mode = F.col("mode")
    listed = F.concat(
        F.array(node("session:", F.col("session_id"), F.col("title"), "session"), node("mode:", mode, F.initcap(mode), "mode")),
        F.transform("tags", lambda tag: node("tag:", tag, tag, "tag")),
    )
    return sessions.select(*_user(sessions), F.inline(listed)).dropDuplicates([*_user(sessions), "node_id"])


def parse_payload(df: DataFrame, column: str, schema: str, into: str) -> DataFrame:
    """JSON text column to a typed column; broken text gives null."""
    return df.withColumn(into, F.from_json(column, schema))


def sessions_from_messages(messages: DataFrame) -> DataFrame:
    """Session lines derived from a message table (session_id, created_at, role, content, perhaps user_id).

    The first user message gives title and mode; the distinct roles are the tags.
    """
    asked = F.when(F.col("role") == "user", F.col("created_at"))
    grouped = messages.groupBy("session_id").agg(
        F.min_by("content", asked).alias("_first"),
        F.max("created_at").alias("updated_at"),
        F.sort_array(F.collect_set("role")).alias("tags"),
        F.count_if(F.col("role") == "system").alias("_system"),
        *[F.min(name).alias(name) for name in _user(messages)],
    )
    query = X.clean_query(F.coalesce("_first", F.lit("")))
    return grouped.select(
        "session_id",
        *_user(messages),
        X.session_title(query).alias("title"),
        X.intent(query).alias("mode"),
        (F.col("_system") > 0).alias("pinned"),
        "updated_at",
        "tags",
    )
