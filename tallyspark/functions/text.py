"""Text, number and date clean-up as Column expressions.

Null and ``''`` mean the same blank throughout; functions return ``''`` for a blank unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning in a comparison.
STOP_WORDS = ("the", "and", "of", "for", "to", "a", "an", "on", "in", "at", "by")
#: Letters that scanning confuses with digits, and the digits.
SCAN_LETTERS, SCAN_DIGITS = "oilsbzgq", "01158260"
#: Written dates, day first before month first; two-digit years last.
DATE_FORMATS = ("d.M.yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy-M-d", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
SHORT_DATE_FORMATS = (("d.M.yy", r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2}$"), ("d/M/yy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"), ("M/d/yy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"))
#: Fixed patterns. Digits are written [0-9]: only ASCII ones count, in Spark and in the compared SQL.
COUNTER_LABEL = r"(?i)^(?:CSN|TSN|CSO|TSO|CSI|TSI|CSR|TSR)\b\s*[:\-]?\s*"
CLEAN_NUMBER = r"^[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?$|^[0-9]+(?:\.[0-9]+)?$"
FIRST_NUMBER = r"-?[0-9]+(\.[0-9]+)?"
EVERY_NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
EVERY_TOKEN = r"\p{Alnum}[\p{Alnum}\-/._]*"
#: Anything but ASCII letters and digits. The named class is one look in a table; [^A-Za-z0-9] is three nested ones and took 45 times as long over report texts.
OTHER = r"[^\p{Alnum}]+"
#: Runs of letters and digits that are no stop words.
EVERY_WORD = r"(?<!\p{Alnum})(?!(?:" + "|".join(STOP_WORDS) + r")(?!\p{Alnum}))\p{Alnum}++"
ORDER_NUMBER = r"\b(4[0-9]{9})\b"
SCHEDULE_WORD = r"(?i)\b(un[\s-]?scheduled|scheduled)\b"
TICK = "[\\u2713\\u2714\\u2611xXY]|yes"
ANY_DATE = r"(?i)\b[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}\b|\b[0-9]{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{2,4}\b"
#: The same, tested only where a digit stands; both forms share the look for a word's edge.
FIRST_DATE = r"(?i)(?=[0-9])\b(?:[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}\b|[0-9]{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{2,4}\b)"
ADDRESS = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def worked_out(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns that are worked out once: as a generator's output no later filter or projection repeats them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def norm_ws(c: Column) -> Column:
    """Runs of white space, no-break and figure spaces included, as one space; trimmed."""
    return F.trim(F.regexp_replace(blank_to_empty(c), "[\\s\\u00A0\\u2007\\u202F]+", " "))


def is_blank(c: Column) -> Column:
    """Whether ``norm_ws`` leaves nothing of a text, by its first other letter."""
    return ~blank_to_empty(c).rlike("[^\\s\\u00A0\\u2007\\u202F]")


def mx_text(c: Column) -> Column:
    """Lower-cased ASCII letters and digits only."""
    return F.regexp_replace(F.lower(blank_to_empty(c)), OTHER, "")


def to_double(c: Column) -> Column:
    """A number in plain or exponent form, else null (no suffix letters, unlike a lenient cast)."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def mx_number(c: Column) -> Column:
    """The first number in a text without its commas, else null."""
    return F.nullif(F.regexp_extract(F.replace(blank_to_empty(c), F.lit(","), F.lit("")), FIRST_NUMBER, 0), F.lit("")).try_cast("double")


def mx_words(c: Column) -> Column:
    """Lower-cased words without stop words, in order, repeats kept; the pattern passes over stop words, as a filter of the list is not compiled."""
    return F.regexp_extract_all(F.lower(blank_to_empty(c)), F.lit(EVERY_WORD), 0)


def scan_fold(c: Column) -> Column:
    """Letters that scanning confuses with digits, as those digits."""
    return F.translate(blank_to_empty(c), SCAN_LETTERS, SCAN_DIGITS)


def numeric_only(c: Column) -> Column:
    """A counter reading without label and commas; blank if the text is anything else."""
    v = F.trim(F.regexp_replace(norm_ws(c), COUNTER_LABEL, ""))
    return let(v, lambda v: F.when(v.rlike(r"(?i)^ESN\b"), "").when(v.rlike(CLEAN_NUMBER), F.replace(v, F.lit(","), F.lit(""))).otherwise(""))


def post_digits(c: Column) -> Column:
    """Digits of a value, or the value if it has none."""
    return let(norm_ws(c), lambda v: F.coalesce(F.nullif(F.regexp_replace(v, "[^0-9]", ""), F.lit("")), v))


def post_schedule(c: Column) -> Column:
    """Scheduled or Unscheduled; a tick mark, or an x or Y anywhere, counts as Scheduled; else unchanged."""

    def of(v: Column) -> Column:
        word = F.lower(F.regexp_extract(v, SCHEDULE_WORD, 1))
        return F.when(word.startswith("un"), "Unscheduled").when(word != "", "Scheduled").when(v.rlike(TICK), "Scheduled").otherwise(v)

    return let(norm_ws(c), of)


def po_from_subject(c: Column) -> Column:
    """The ten digits of an order number that starts with 4, on word bounds; null if there are none."""
    return F.nullif(F.regexp_extract(blank_to_empty(c), ORDER_NUMBER, 1), F.lit(""))


def post_po10(c: Column) -> Column:
    """The same once commas and blanks are removed, then as written; blank if neither has one."""
    return let(norm_ws(c), lambda v: F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(v, "[, ]", ""), ORDER_NUMBER, 1), F.lit("")), F.regexp_extract(v, ORDER_NUMBER, 1)))


def post_date(c: Column) -> Column:
    """A written date as yyyy-MM-dd by the first format that fits; other text unchanged."""

    def of(v: Column) -> Column:
        t = F.trim(F.substring(v, 1, 20))
        tries = [F.try_to_timestamp(F.initcap(t), F.lit(f)) for f in DATE_FORMATS]
        for f, shape in SHORT_DATE_FORMATS:
            year = F.regexp_extract(t, "([0-9]{2})$", 1).try_cast("int")
            stamp = F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f)))
            tries.append(F.when(year >= 69, F.add_months(stamp, -1200).cast("timestamp")).otherwise(stamp))
        return F.when(v.rlike("[0-9]"), F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), v)).otherwise(v)

    return let(norm_ws(c), of)


def trim_at_embedded_label(c: Column, labels: Column, some_label: str | None = None) -> Column:
    """A value cut at the first later word where one to three words are a known label (lower-case array).

    ``some_label``, a pattern that finds any of the labels, spares most values the look through the array; the value must then be a ready column without runs of white space.
    """

    def of(words: Column) -> Column:
        def is_label(i: Column) -> Column:
            probes = [F.regexp_replace(F.lower(F.array_join(F.slice(words, i + 1, F.lit(n)), " ")), "[ :#.,]+$", "") for n in (1, 2, 3)]
            return reduce(lambda a, b: a | b, [(i + n <= F.size(words)) & F.array_contains(labels, p) for n, p in enumerate(probes, 1)])

        at = F.array_min(F.filter(F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), is_label))
        return F.array_join(F.slice(words, 1, F.coalesce(at, F.size(words))), " ")

    # Words are only looked at in a text that holds some label.
    held = lambda v: let(F.lower(v), lambda low: F.exists(labels, lambda x: F.contains(low, x)))
    if some_label:
        return F.btrim(F.when(F.lower(c).rlike(some_label), let(F.split(c, " "), of)).otherwise(c), F.lit(" :,-"))
    cut = let(norm_ws(c), lambda v: F.when(held(v), let(F.split(v, " "), of)).otherwise(v))
    return F.regexp_replace(cut, "^[ :,-]+|[ :,-]+$", "")


def parse_stamp(c: Column) -> Column:
    """'yyyy-MM-dd HH:mm' or 'yyyy-MM-dd' as a timestamp, else null."""
    t = F.trim(blank_to_empty(c))
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))


def sender_domain(c: Column) -> Column:
    """Lower-cased text after the last ``@``; blank if there is none."""
    v = F.lower(F.trim(blank_to_empty(c)))
    return F.when(v.contains("@"), F.substring_index(v, "@", -1)).otherwise("")


def safe_name(c: Column) -> Column:
    """A file name without characters that file systems refuse."""
    return F.trim(F.regexp_replace(blank_to_empty(c), r'[\\/:*?"<>|\r\n\t]', "_"))


def no_po_key(c: Column) -> Column:
    """Folder key of a mail without order number."""
    return F.concat(F.lit("NO_PO_"), F.substring(blank_to_empty(c), 1, 20))


def display_name(c: Column) -> Column:
    """The local part of an address as a name."""
    return F.initcap(F.replace(F.substring_index(blank_to_empty(c), "@", 1), F.lit("."), F.lit(" ")))


def first_present(*columns: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*[F.nullif(norm_ws(c), F.lit("")) for c in columns], F.lit(""))


def matches_any(c: Column, patterns: tuple[str, ...], tidy: bool = False) -> Column:
    """Whether some pattern occurs, ignoring case, in one pass; ``tidy`` if ``norm_ws`` has been at the text."""
    return (c if tidy else norm_ws(c)).rlike("(?i)(?:" + any_pattern(patterns) + ")")


def any_pattern(patterns: tuple[str, ...]) -> str:
    """One pattern of all; those that begin at a word's edge share the look for it, so that other places cost one test."""
    parts = []
    for pattern in patterns:
        if re.search(r"[\[|\\]\||\\[()]|\[", pattern):  # brackets or bars that may be letters
            parts.append(f"(?:{pattern})")
            continue
        depth, part = 0, ""
        for ch in pattern:
            depth += (ch == "(") - (ch == ")")
            if ch == "|" and not depth:
                parts.append(part)
                part = ""
            else:
                part += ch
        parts.append(part)
    edge = [p[2:] for p in parts if p.startswith(r"\b")]
    rest = [p for p in parts if not p.startswith(r"\b")]
    return "|".join([*([r"\b(?:" + "|".join(edge) + ")"] if edge else []), *rest])


def report_tokens(c: Column) -> Column:
    """Different normalised tokens of a text."""
    raw = F.regexp_extract_all(blank_to_empty(c), F.lit(EVERY_TOKEN), 0)
    return F.array_distinct(F.filter(F.transform(raw, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", "")), lambda t: t != ""))


def token_line(c: Column) -> Column:
    """All of ``report_tokens`` in one text, in order, repeats kept, each with a space on either side."""
    joined = F.regexp_replace(F.regexp_replace(blank_to_empty(c), r"[\-/._]+", ""), OTHER, " ")
    return F.concat(F.lit(" "), F.lower(joined), F.lit(" "))


def number_list(c: Column) -> Column:
    """All numbers of a text, repeats kept; a null more where there are none."""
    raw = F.array_join(F.regexp_extract_all(blank_to_empty(c), F.lit(EVERY_NUMBER), 0), " ")
    return F.split(F.replace(raw, F.lit(","), F.lit("")), " ").try_cast("array<double>")


def report_numbers(c: Column) -> Column:
    """Different numbers of a text."""
    raw = F.regexp_extract_all(blank_to_empty(c), F.lit(EVERY_NUMBER), 0)
    return F.array_distinct(F.transform(raw, lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double")))


def any_date(c: Column) -> Column:
    """The first written date of a text, blank if none."""
    return F.regexp_extract(blank_to_empty(c), FIRST_DATE, 0)


def is_address(c: Column) -> Column:
    return F.trim(blank_to_empty(c)).rlike(ADDRESS)


def valid_recipients(addresses: Column) -> Column:
    """Well-formed addresses of an array, joined by commas."""
    return F.array_join(F.filter(addresses, is_address), ",")


def percent_encode(c: Column) -> Column:
    return F.replace(F.url_encode(blank_to_empty(c)), F.lit("+"), F.lit("%20"))


def compose_link(base: str, to: Column, subject: Column, body: Column) -> Column:
    """A mail-compose address with percent-encoded parts."""
    return F.concat(F.lit(base + "?to="), percent_encode(to), F.lit("&subject="), percent_encode(subject), F.lit("&body="), percent_encode(body))


def org_email_ok(c: Column, free_mail: tuple[str, ...]) -> Column:
    """An address with ``@`` whose domain isn't a free-mail one."""
    v = F.lower(F.trim(blank_to_empty(c)))
    return v.contains("@") & ~F.substring_index(v, "@", -1).isin(*free_mail)


def json_values(c: Column) -> Column:
    """A JSON object of values as a map; an empty map if it can't be read."""
    return F.coalesce(F.from_json(blank_to_empty(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
