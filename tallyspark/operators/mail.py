"""Mail triage: windows, senders, ledger and attachments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import blank_to_empty, po_from_subject, sender_domain

#: Fixed values of the sample data: vendor and the domains that its mail comes from.
DOMAINS = (("Vendor A", "vendor-a.example"), ("Vendor B", "vendor-b.example"), ("Vendor C", "vendor-b.example"))


def date_window(received: Column, start: str | None, end: str | None) -> Column:
    """Whether a time lies in inclusive dates, given in any order; an unreadable bound is ignored; no time fails a bound."""
    low, high = (F.try_to_timestamp(F.lit(x), F.lit("yyyy-MM-dd")).cast("date") if x else F.lit(None).cast("date") for x in (start, end))
    both = low.isNotNull() & high.isNotNull()
    first, last = F.when(both, F.least(low, high)).otherwise(low), F.when(both, F.greatest(low, high)).otherwise(high)
    unbound = first.isNull() & last.isNull()
    inside = (first.isNull() | (received >= first)) & (last.isNull() | (received < F.date_add(last, 1)))
    return unbound | (received.isNotNull() & inside)


def read_state(unread: Column, read: bool, unread_too: bool) -> Column:
    """Both states, one of them, or none."""
    if read and unread_too:
        return F.lit(True)
    return (~unread if read else unread if unread_too else F.lit(False)) if read != unread_too else F.lit(False)


def domains_of(vendors: tuple[str, ...], table: tuple[tuple[str, str], ...] = DOMAINS) -> tuple[str, ...]:
    """Sorted different domains of vendors; unknown names are ignored."""
    return tuple(sorted({d for v, d in table if v in vendors}))


def vendor_domains(vendors: DataFrame, table: DataFrame) -> DataFrame:
    """Sorted different domains of the chosen vendors (column vendor) by a table (vendor, domain); unknown names are ignored."""
    return table.join(vendors.select("vendor").distinct(), "vendor", "left_semi").select("domain").filter("domain is not null").distinct().orderBy("domain")


def from_domains(domain: Column, domains: tuple[str, ...]) -> Column:
    """Whether a sender's domain is one of the domains or lies below one."""
    return reduce(lambda a, b: a | b, [(domain == d) | domain.endswith("." + d) for d in domains], F.lit(False))


def domain_filter(mails: DataFrame, vendors: tuple[str, ...]) -> DataFrame:
    return mails.filter(from_domains(sender_domain(F.col("sender")), domains_of(vendors)))


def wanted_attachments(attachments: Column, extensions: tuple[str, ...]) -> Column:
    """Names with an allowed extension, all if none is given."""
    if not extensions:
        return F.filter(attachments, lambda a: a != "")
    return F.filter(attachments, lambda a: reduce(lambda x, y: x | y, [F.lower(a).endswith(e) for e in extensions]))


def attachment_files(mails: DataFrame, extensions: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """A row for each wanted attachment."""
    return mails.withColumn("file_name", F.explode(wanted_attachments(F.split("attachments", ";"), extensions))).filter("file_name <> ''")


def new_only(mails: DataFrame, ledger: DataFrame) -> DataFrame:
    return mails.join(ledger.select("entry_id"), "entry_id", "left_anti")


def duplicates(mails: DataFrame, ledger: DataFrame) -> DataFrame:
    """Mail in the ledger already, with who and when."""
    return mails.join(first_wins(ledger).select("entry_id", "downloaded_by", "processed_at"), "entry_id")


def first_wins(ledger: DataFrame) -> DataFrame:
    """One row by id, the first processed; ties by who."""
    rest = [c for c in ledger.columns if c != "entry_id"]
    return ledger.groupBy("entry_id").agg(F.min_by(F.struct(*rest), F.struct("processed_at", "downloaded_by")).alias("r")).select("entry_id", "r.*")


def triage(mails: DataFrame, ledger: DataFrame, start: str | None = None, end: str | None = None, read: bool = True, unread: bool = True, vendors: tuple[str, ...] = (), extensions: tuple[str, ...] = (".pdf",), skip_no_po: bool = True) -> DataFrame:
    """(seq, outcome, po): the first reason that stops each mail, else ACCEPTED."""
    known = ledger.select("entry_id", F.lit(True).alias("known")).distinct()
    rows = mails.join(known, "entry_id", "left")
    po, domain = po_from_subject(F.col("subject")), sender_domain(F.col("sender"))
    outcome = F.when(~date_window(F.col("received"), start, end), "SKIP-DATE").when(~read_state(F.col("unread"), read, unread), "SKIP-STATE")
    if vendors:
        outcome = outcome.when(~from_domains(domain, domains_of(vendors)), "SKIP-SENDER")
    outcome = outcome.when(F.col("known"), "SKIP-DUP")
    outcome = outcome.when(po.isNull(), "SKIP-NOPO") if skip_no_po else outcome
    outcome = outcome.when(F.size(wanted_attachments(F.split("attachments", ";"), extensions)) == 0, "SKIP-NOATT").otherwise("ACCEPTED")
    return rows.select("seq", "entry_id", outcome.alias("outcome"), blank_to_empty(po).alias("po"))


def event_counts(activity: DataFrame) -> DataFrame:
    return activity.groupBy("event").agg(F.count("*").alias("n"))


def newest(df: DataFrame, limit: int | None, *keys: str) -> DataFrame:
    """Rows from the newest on; with a limit as top-k, without a full sort."""
    out = df.orderBy(*[F.desc(k) for k in keys])
    return out.limit(limit) if limit else out
