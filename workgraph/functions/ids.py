"""Issue ids, priorities, ages and journal headings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The allowed statuses, and the priorities from most to least urgent.
STATUSES = ["todo", "doing", "done"]
PRIORITIES = ["must", "high", "normal", "low"]
# Escalation thresholds of a board that sets none.
ESCALATE_HIGH, ESCALATE_MUST = 3, 10
# Separators allowed between a heading's date and title, longest first.
DATE_DASHES = ["—", "–", "--", "-", ":"]

# A word boundary over ASCII letters only, whatever the engine's default is.
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
ID_PATTERN = START + r"([A-Z][A-Z0-9]*)-([0-9]+[a-z]?)" + END
ID_SHAPE = r"^([A-Za-z][A-Za-z0-9]*)-0*([0-9]+)([A-Za-z]?)$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_id(ref, prefix) -> Column:
    """``7``, ``th-7`` and ``TH-7`` all become ``TH-7``; anything else is upper-cased."""
    ref, prefix = F.trim(col(ref)), col(prefix)
    bare = F.regexp_extract(ref, r"^([+-]?\d+)$", 1)
    head = F.regexp_extract(ref, r"^(.+)-(\d+)$", 1)
    tail = F.regexp_extract(ref, r"^(.+)-(\d+)$", 2)
    number = lambda c: c.try_cast("bigint").cast("string")
    return (F.when(ref == "", F.lit(""))
            .when(bare != "", F.concat(prefix, F.lit("-"), number(bare)))
            .when(head != "", F.concat(F.upper(head), F.lit("-"), number(tail)))
            .otherwise(F.upper(ref)))


def id_num(ident) -> Column:
    """The number after the last dash, NULL when there is none."""
    ident = col(ident)
    return F.when(F.contains(ident, F.lit("-")), F.substring_index(ident, "-", -1).try_cast("bigint"))


def issue_num(ident, prefix) -> Column:
    """The number of an id that belongs to this prefix, compared without case."""
    ident, prefix = col(ident), col(prefix)
    number = id_num(ident)
    head = F.regexp_extract(ident, r"^(.+)-[^-]*$", 1)
    return F.when((F.lower(head) == F.lower(prefix)) & (number >= 0), number)


def id_sort_key(ident) -> Column:
    """A string that sorts ids by number first: ``TH-2`` before ``TH-10``; ids without a number follow by their text."""
    number = id_num(ident)
    return F.concat(F.when(number.isNotNull(), F.lpad(number.cast("string"), 19, "0")).otherwise(F.lit("~")), F.lit("|"), col(ident))


def log_id_key(ident) -> Column:
    """Prefix upper-cased, zero padding dropped, letter suffix lower-cased."""
    ident = F.trim(col(ident))
    part = lambda i: F.regexp_extract(ident, ID_SHAPE, i)
    return F.when(ident.rlike(ID_SHAPE),
                  F.concat(F.upper(part(1)), F.lit("-"), part(2), F.lower(part(3)))).otherwise(F.upper(ident))


def quote_regex(text) -> Column:
    """Escape the characters that mean something in a regular expression."""
    return F.regexp_replace(col(text), r"([\\.+*?()|\[\]{}^$])", r"\\$1")


def log_id_regex(ident) -> Column:
    """A pattern that finds an id however its number is padded."""
    ident = F.trim(col(ident))
    part = lambda i: F.regexp_extract(ident, ID_SHAPE, i)
    shaped = F.concat(F.lit("(?i)" + START), part(1), F.lit("-0*"), part(2), part(3), F.lit(END))
    return F.when(ident.rlike(ID_SHAPE), shaped).otherwise(
        F.concat(F.lit(EDGE), quote_regex(ident), F.lit(EDGE)))


def effective_priority(priority) -> Column:
    priority = col(priority)
    return F.when(priority.isNull() | (priority == ""), F.lit("normal")).otherwise(priority)


def stored_priority(priority) -> Column:
    """The default is stored as nothing."""
    priority = col(priority)
    return F.when((priority != "normal") & (priority != ""), priority)


def priority_rank(priority) -> Column:
    """0 for must up to 3 for low; 4 for an unknown word."""
    position = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), effective_priority(priority)).cast("int")
    return F.when(position > 0, position - 1).otherwise(F.lit(len(PRIORITIES)))


def priority_name(rank) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PRIORITIES]), col(rank))


def escalation_floor(waiting, high=ESCALATE_HIGH, must=ESCALATE_MUST) -> Column:
    """What a count of waiting issues is worth alone; a threshold of 0 is off."""
    waiting = col(waiting)
    high = F.lit(high) if isinstance(high, int) else F.coalesce(col(high), F.lit(ESCALATE_HIGH))
    must = F.lit(must) if isinstance(must, int) else F.coalesce(col(must), F.lit(ESCALATE_MUST))
    return (F.when((must > 0) & (waiting >= must), F.lit("must"))
            .when((high > 0) & (waiting >= high), F.lit("high")))


def parse_age(text) -> Column:
    """``30d``, ``2w``, ``48h``, ``1h30m`` or ``0`` as an interval; NULL when malformed."""
    text = F.trim(col(text))
    days = F.regexp_extract(text, r"^(-?\d+)d$", 1).try_cast("int")
    weeks = F.regexp_extract(text, r"^(-?\d+)w$", 1).try_cast("int")
    clock = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, clock, i).try_cast("int"), F.lit(0))
    return (F.when(text.isin("", "0"), F.make_dt_interval(F.lit(0)))
            .when(days.isNotNull(), F.make_dt_interval(days))
            .when(weeks.isNotNull(), F.make_dt_interval(weeks * 7))
            .when(text.rlike(clock), F.make_dt_interval(F.lit(0), part(1), part(2), part(3).cast("decimal(18,6)"))))


def heading_text(line) -> Column:
    return F.trim(F.regexp_replace(col(line), r"^##", ""))


def heading_date(line) -> Column:
    """The date a heading starts with, NULL without one."""
    found = F.regexp_extract(heading_text(line), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


def heading_title(line) -> Column:
    dashes = "|".join(DATE_DASHES)
    return F.trim(F.regexp_replace(heading_text(line), rf"^\d{{4}}-\d{{2}}-\d{{2}} *(?:{dashes})?", ""))


def canonical_heading(date, title) -> Column:
    return F.concat(F.lit("## "), col(date), F.lit(" — "), col(title))


def title_with_id(ident, title) -> Column:
    """Put an id in front of a title that does not already start with it."""
    ident, title = col(ident), col(title)
    kept = ident.isNull() | (ident == "") | F.startswith(F.upper(title), F.upper(ident))
    return F.when(kept, title).otherwise(F.concat(ident, F.lit(": "), title))


# Labels of entry-point kinds in hop and title texts.
ENTRY_LABELS = {
    "main": "main", "init": "init", "http-handler": "handler", "grpc-method": "gRPC method",
    "cobra-command": "cobra command", "test": "test", "unreferenced": "exported function",
    "scenario": "scenario",
}
# Entry-point kinds from most to least specific.
ENTRY_PRIORITY = ["main", "init", "http-handler", "grpc-method", "cobra-command", "test", "custom", "unreferenced"]


def entry_label(kind) -> Column:
    kind = col(kind)
    out = F.lit("entry point")
    for name, label in ENTRY_LABELS.items():
        out = F.when(kind == name, F.lit(label)).otherwise(out)
    return out


def entry_priority(kind) -> Column:
    position = F.array_position(F.array(*[F.lit(k) for k in ENTRY_PRIORITY]), col(kind)).cast("int")
    return F.when(position > 0, position - 1).otherwise(F.lit(len(ENTRY_PRIORITY)))


def _receiver(receiver) -> Column:
    return F.regexp_replace(F.coalesce(col(receiver), F.lit("")), r"^\*", "")


def display_name(receiver, name) -> Column:
    bare = _receiver(receiver)
    return F.when(bare != "", F.concat(bare, F.lit("."), col(name))).otherwise(col(name))


def structural_id(path, receiver, name) -> Column:
    return F.concat(col(path), F.lit("#"), display_name(receiver, name))


def symbol_id(package, receiver, name) -> Column:
    bare = _receiver(receiver)
    return F.when(bare != "", F.concat(col(package), F.lit(".("), bare, F.lit(")."), col(name))) \
        .otherwise(F.concat(col(package), F.lit("."), col(name)))


def fallback_name(ident) -> Column:
    """A readable name for an id no table resolves."""
    ident = col(ident)
    pattern = r"\.\(([^)]+)\)\.([^.]+)$"
    return (F.when(F.contains(ident, F.lit("#")), F.regexp_extract(ident, r"(?s)^[^#]*#(.*)$", 1))
            .when(ident.rlike(pattern), F.concat(F.regexp_extract(ident, pattern, 1), F.lit("."),
                                                 F.regexp_extract(ident, pattern, 2)))
            .when(F.contains(ident, F.lit(".")), F.substring_index(ident, ".", -1))
            .otherwise(ident))


def hop_label(is_entry, entry_kind, receiver, name, changed) -> Column:
    """One hop of a call chain: an entry point by its kind, else the symbol and whether it changed."""
    own = display_name(receiver, name)
    return F.when(col(is_entry), F.concat(entry_label(entry_kind), F.lit(" "), col(name))) \
        .otherwise(F.concat(own, F.when(col(changed), F.lit(" (changed)")).otherwise(F.lit(""))))
