"""Subscription lifecycle: auto-expiry (W1), the reminder digest (W9) and
the reminder cycle (W10).

The digest is a set of lines, not one string: one row per candidate plus
header and footer rows, each carrying its sort key, so a horizon with
millions of candidates is still spread over all tasks. A mail sink writes
the lines ordered by ``(section, part, expires_at, line_key)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.expressions import (BULLET, DASH, html_escape, iso_date,
                                           mail_urgency)
from halyard.functions.time import at_for
from halyard.operators import views as V
from halyard.session import pinned
from halyard.sources.fixtures import Tables, overlay
from halyard.sources.tables import log_subject, notification_rows
from halyard.operators.ids import next_id

ACTIVE = "active"
EXPIRED = "expired"

# The digest texts.
MAIL_SUBJECT = "⚠️ CRM Alert: {n} subscription(s) expiring within {days} days"
MAIL_LEAD = "{n} subscription(s) expiring within <strong>{days} days</strong>"
MAIL_COLUMNS = ["Customer", "Email", "Package", "Expires", "Days left", "Price paid"]
SIGN_OFF = "— Subscription reminders"
NOTHING_EXPIRING = "nothing_expiring"


def stale(cp: DataFrame, as_of):
    return (F.col("status") == ACTIVE) & (F.col("expires_at") < at_for(cp, "expires_at", as_of))


def auto_expire(cp: DataFrame, as_of) -> DataFrame:
    """Active subscriptions with ``expires_at < as_of`` (strict) become
    expired, ``updated_at = as_of``. A projection: no shuffle. Idempotent."""
    hit = stale(cp, as_of)
    return cp.select([
        F.when(hit, F.lit(EXPIRED)).otherwise(F.col("status")).alias("status") if c == "status"
        else F.when(hit, at_for(cp, "updated_at", as_of)).otherwise(F.col("updated_at"))
             .alias("updated_at") if c == "updated_at"
        else F.col(c)
        for c in cp.columns])


def auto_expire_count(cp: DataFrame, as_of) -> DataFrame:
    """The number of rows W1 changes, as one row."""
    return cp.agg(F.count_if(stale(cp, as_of)).alias("auto_expired"))


def _count_text(template: str, n: Column, days) -> Column:
    """``template`` with ``{days}`` filled in and ``{n}`` from a Column."""
    fmt = template.replace("%", "%%").replace("{days}", str(days)).replace("{n}", "%d")
    return F.format_string(fmt, n)


def digest_header(candidates: DataFrame, days) -> DataFrame:
    """W9 header: mail subject, logged subject and candidate count, one row."""
    n = candidates.agg(F.count(F.lit(1)).alias("n"))
    return n.select(_count_text(MAIL_SUBJECT, F.col("n"), days).alias("subject"),
                    F.lit(log_subject(days)).alias("log_subject"),
                    F.col("n").alias("recipients"))


def _td(text, cls=None):
    open_tag = F.lit("<td>") if cls is None else F.concat(F.lit('<td class="'), cls, F.lit('">'))
    return F.concat(open_tag, text, F.lit("</td>"))


def _explode_lines(df: DataFrame, lines: list[tuple], expires_at) -> DataFrame:
    """One output row per ``(section, part, line_key, line)`` item of each
    input row."""
    items = F.array(*[F.struct(F.lit(sec).alias("section"), F.lit(part).alias("part"),
                               (key if isinstance(key, Column) else F.lit(key))
                               .cast("bigint").alias("line_key"), line.alias("line"))
                      for sec, part, key, line in lines])
    return (df.select(expires_at.alias("expires_at"), F.explode(items).alias("__e"))
              .select(F.col("__e.section").alias("section"), F.col("__e.part").alias("part"),
                      "expires_at", F.col("__e.line_key").alias("line_key"),
                      F.col("__e.line").alias("line")))


def digest_lines(candidates: DataFrame, days) -> DataFrame:
    """W9 body: ``(section, part, expires_at, line_key, line)`` rows for the
    text and the HTML body. Part 0 is the header, 1 the candidates (earliest
    expiry first, then subscription id), 2 the footer. Candidate lines are
    built where the candidates are; only the count meets in one place. The
    candidates are written once, as the count and the lines both read them."""
    candidates = pinned(candidates, "digest-candidates")
    dleft = F.col("days_left")
    date = iso_date("expires_at")
    text_row = F.concat(F.lit(BULLET + " "), F.col("customer_name"), F.lit(" <"), F.col("email"),
                        F.lit("> — "), F.col("package_name"), F.lit(" — expires "), date,
                        F.lit(" ("), dleft.cast("string"), F.lit("d left)"))
    price = F.when(F.col("price_paid").isNull(), F.lit(DASH)).otherwise(
        F.concat(F.lit("$"), F.col("price_paid")))
    html_row = F.concat(
        F.lit("<tr>"), _td(html_escape("customer_name")), _td(html_escape("email")),
        _td(html_escape("package_name")), _td(date),
        _td(F.concat(dleft.cast("string"), F.lit("d")), mail_urgency(dleft)), _td(price),
        F.lit("</tr>"))
    key = F.col("cp_id")
    rows = _explode_lines(candidates, [("text", 1, key, text_row), ("html", 1, key, html_row)],
                          F.col("expires_at"))

    head = digest_header(candidates, days)
    thead = ("<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in MAIL_COLUMNS)
             + "</tr></thead><tbody>")
    lead = F.concat(F.lit("<p>"), _count_text(MAIL_LEAD, F.col("recipients"), days),
                    F.lit("</p>"))
    fixed = [  # (section, part, line_key, line)
        ("text", 0, 0, F.col("subject")), ("text", 0, 1, F.lit("")),
        ("text", 2, 0, F.lit("")), ("text", 2, 1, F.lit(SIGN_OFF)),
        ("html", 0, 0, lead), ("html", 0, 1, F.lit(thead)),
        ("html", 2, 0, F.lit("</tbody></table>")),
    ]
    ts_type = candidates.schema["expires_at"].dataType.simpleString()
    frame = _explode_lines(head, fixed, F.lit(None).cast(ts_type))
    return frame.unionByName(rows)


def write_digest(lines: DataFrame, path: str, section: str = "text") -> None:
    """Write one body of the digest as text, lines in mail order. The sort
    is a range-partitioned global sort, so the body is spread over tasks
    and the part files, read in name order, hold the lines in order."""
    (lines.where(F.col("section") == section)
     .orderBy("part", F.col("expires_at").asc_nulls_first(), "line_key")
     .select("line").write.mode("overwrite").text(path))


def reminder_digest(candidates: DataFrame, days) -> dict[str, DataFrame]:
    """Header row and body lines of the reminder mail."""
    return {"header": digest_header(candidates, days), "lines": digest_lines(candidates, days)}


def reminder_cycle(t, days, recipient: str, as_of) -> dict[str, DataFrame]:
    """W1, then J5 on the result; the digest and log rows (empty when
    nothing expires) and one summary row: auto-expired count, whether a mail
    is prepared, the reason when not, and the recipient count. The cycle
    never consults the log, so it re-sends each time it runs. The result is
    a mapping whose parts are built on first access."""
    cp = t["customer_packages"]
    new_cp = auto_expire(cp, as_of)
    candidates = V.reminder_rows(overlay(t, customer_packages=new_cp), days, as_of)
    head = digest_header(candidates, days)
    summary = (auto_expire_count(cp, as_of).unionByName(head.select("recipients"),
                                                        allowMissingColumns=True)
               .agg(F.max("auto_expired").alias("auto_expired"),
                    F.max("recipients").alias("recipients")))
    n = F.col("recipients")
    summary = summary.select(
        "auto_expired", (n > 0).alias("email_prepared"),
        F.when(n == 0, F.lit(NOTHING_EXPIRING)).alias("reason"), n.alias("recipients"),
        F.lit(recipient).alias("admin_email"))
    parts = {
        "customer_packages": lambda: new_cp,
        "candidates": lambda: candidates,
        "digest": lambda: digest_lines(candidates, days),
        "header": lambda: head,
        # Numbering the log rows runs jobs; it happens only when asked for.
        "log_rows": lambda: notification_rows(candidates, recipient, days, as_of,
                                              next_id(t, "notification_log")),
        "summary": lambda: summary,
    }
    return Tables(parts)
