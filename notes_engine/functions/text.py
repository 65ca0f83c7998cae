"""Column functions over text: no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the bullet, separator and time stamp formats.
BULLET = r"(?U)^\s*(?:[-*•●○◦▪▸►▶▫]+|\d+[.)])(?:\s+(.*))?$"
SEPARATOR = r"^\s*[-=*_~]{5,}\s*$"
TIMESTAMP = r"(?:^|(?<=[\s\-–—|•]))(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?!\d)"


def unix_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def let(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def one_blank(x: Column) -> Column:
    return F.regexp_replace(x, r"[ \t]+", " ")


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def bullet_text(line: Column) -> Column:
    return F.regexp_extract(line, BULLET, 1)


def is_separator(line: Column) -> Column:
    return line.rlike(SEPARATOR)


def chunk_count(tokens: Column, budget: int) -> Column:
    """How many chunks of ``budget`` tokens; one for no tokens."""
    if budget <= 0:
        raise ValueError("budget must be positive")
    return F.when(tokens <= 0, 1).otherwise(F.ceil(tokens / budget)).cast("long")


def token_estimate(x: Column) -> Column:
    """Words and single marks: the tokenizer that needs no files."""
    return F.size(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), 0)).cast("long")


def hms(seconds: Column) -> Column:
    """HH:MM:SS; hours are not bounded and negatives are 0."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def stamp_seconds(h: Column, m: Column, s: Column) -> Column:
    """Seconds of h:m:s texts; null if s, or m beside an hour, is 60 or more."""
    hours, minutes, secs = (F.coalesce(F.try_to_number(x, F.lit("999")).cast("int"), F.lit(0)) for x in (h, m, s))
    return F.when((secs >= 60) | ((hours > 0) & (minutes >= 60)), None).otherwise(hours * 3600 + minutes * 60 + secs)


def file_stamp(display: Column) -> Column:
    """A time as part of a file name: digits, and - for a colon."""
    return F.translate(F.regexp_replace(display, r"[^0-9:]", ""), ":", "-")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else 0."""
    return F.when(line.rlike(r"^\s*#{1,6} "), F.length(F.regexp_extract(line, r"^\s*(#+)", 1))).otherwise(0)


def heading_text(line: Column) -> Column:
    """What follows as many characters as the level; an indented heading keeps stray marks."""
    return strip(F.substring(line, heading_level(line) + 1, F.length(line)))


def heading_mark(level: Column) -> Column:
    return F.repeat(F.lit("#"), F.greatest(F.least(level, F.lit(6)), F.lit(1)).cast("int"))


def plain_markdown(x: Column) -> Column:
    """Unix newlines, two in a row at most, none before the text and one after it."""
    return F.concat(strip(F.regexp_replace(unix_newlines(x), r"\n{3,}", "\n\n")), F.lit("\n"))


def compact_date(x: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; anything else as it is."""
    return F.when(F.length(x) == 8, F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))).otherwise(x)


# Forms of dates with a time of day or without; a zone may follow a time.
_DAYS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "dd MMM yyyy", "yyyyMMdd"]
_CLOCK = r"(?i)^(.*?)[T ,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*(Z|GMT|UTC|[+-]\d{2}:?\d{2})?\z"


def iso_date(x: Column) -> Column:
    """A date with its time and zone in ISO form where the text has one of a fixed list of forms, else the text, stripped."""
    t = strip(x)
    timed = t.rlike(_CLOCK)
    get = lambda k: F.regexp_extract(t, _CLOCK, k)
    day = F.regexp_replace(F.when(timed, get(1)).otherwise(t), r"^[A-Za-z]{3,9},\s*", "")  # without the day of the week
    date = F.coalesce(*[F.date_format(F.try_to_timestamp(day, F.lit(f)), "yyyy-MM-dd") for f in _DAYS])
    clock = F.concat_ws(":", F.lpad(get(2), 2, "0"), get(3), F.when(get(4) == "", "00").otherwise(get(4)))
    part = F.when(get(5).rlike("[1-9]"), F.concat(F.lit("."), F.rpad(get(5), 6, "0"))).otherwise("")
    zone = F.when(get(6) == "", "").when(get(6).rlike("(?i)^[zgu]"), "+00:00").otherwise(F.regexp_replace(get(6), r"^(...):?(..)$", "$1:$2"))
    right = (get(2).try_cast("int") < 24) & (get(3).try_cast("int") < 60) & (F.coalesce(get(4).try_cast("int"), F.lit(0)) < 60)
    return F.when(date.isNull(), t).when(~timed, F.concat(date, F.lit("T00:00:00"))).when(right, F.concat(date, F.lit("T"), clock, part, zone)).otherwise(t)


_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_TIME = r"(?i)(?:^|[T\s,])(\d{1,2})(?::(\d{2}))?(?::(\d{2})(?:\.\d+)?)?\s*([ap])\.?m\.?(?:\b|$)|(?:^|[T\s,])(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?"
_DATE_WORDS = r"(?i)^(?:(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?|of|the|at|on|\d+(?:st|nd|rd|th)?)[\s.,/'-]*)+$"


def lenient_date(x: Column, reference: Column) -> Column:
    """A date of loose form as a timestamp in ISO form; fields that the text lacks are those of the date ``reference``; null if it is none.

    Words: names of months and days of the week, ordinals, *of*, *the*, *at*,
    *on*.  Numbers: one of three digits or more is the year, as is one above 31;
    without a month's name, three numbers are year, month and day if the year
    comes first, else month, day and year, or day, month and year where the
    first cannot be a month; two are a year and a month, or month and day.  A
    year of two digits lies within fifty years of the reference.  The day is cut
    to the last one of its month where it comes from the reference.
    """

    def told(s: Column) -> Column:
        day, time = s["day"], s["time"]
        names = F.transform(F.regexp_extract_all(F.lower(day), F.lit(r"[a-z]{3,}"), 0), lambda w: F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(w, 1, 3)))
        month = F.coalesce(F.get(F.filter(names, lambda m: m > 0), F.lit(0)), F.lit(0)).cast("int")
        numbers = F.transform(F.regexp_extract_all(day, F.lit(r"\d+"), 0), lambda d: F.struct(F.length(d).alias("w"), d.try_cast("int").alias("v")))
        return let(F.struct(month.alias("month"), numbers.alias("n"), time.alias("time")), dated)

    def dated(s: Column) -> Column:
        n, size = s["n"], F.size(s["n"])
        v, w = (lambda k: F.get(n, F.lit(k))["v"]), (lambda k: F.get(n, F.lit(k))["w"])
        long_ = lambda k: (w(k) >= 3) | (v(k) > 31)
        none = F.lit(None).cast("int")
        ymd = lambda y, m, d, yw=none: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), yw.alias("w"))
        eight = F.when(w(0) == 8, ymd(F.floor(v(0) / 10000).cast("int"), F.floor(v(0) / 100).cast("int") % 100, v(0) % 100, F.lit(4)))
        named = (
            F.when(size == 0, ymd(none, s["month"], none))
            .when(size == 1, F.when(long_(0), ymd(v(0), s["month"], none, w(0))).otherwise(ymd(none, s["month"], v(0))))
            .when(size == 2, F.when(long_(0), ymd(v(0), s["month"], v(1), w(0))).otherwise(ymd(v(1), s["month"], v(0), w(1))))
        )
        bare = (
            F.when(size == 1, eight.when(long_(0), ymd(v(0), none, none, w(0))).otherwise(ymd(none, none, v(0))))
            .when(size == 2, F.when(long_(0), ymd(v(0), v(1), none, w(0))).when(long_(1), ymd(v(1), v(0), none, w(1))).when(v(0) > 12, ymd(none, v(1), v(0))).otherwise(ymd(none, v(0), v(1))))
            .when(size == 3, F.when(long_(0), ymd(v(0), v(1), v(2), w(0))).when(v(0) > 12, ymd(v(2), v(1), v(0), w(2))).otherwise(ymd(v(2), v(0), v(1), w(2))))
        )
        return let(F.struct(F.when(s["month"] > 0, named).otherwise(bare).alias("d"), s["time"].alias("time")), whole)

    def whole(s: Column) -> Column:
        d, now = s["d"], F.year(reference)
        century = now - now % 100
        near = F.when(century + d["y"] >= now + 50, century + d["y"] - 100).when(century + d["y"] < now - 50, century + d["y"] + 100).otherwise(century + d["y"])
        year = F.when(d["y"].isNull(), now).when((d["w"] <= 2) & (d["y"] < 100), near).otherwise(d["y"])
        month = F.coalesce(d["m"], F.month(reference))
        last = F.dayofmonth(F.last_day(F.try_make_timestamp(year, month, *[F.lit(x) for x in (1, 0, 0, 0)])))
        at = F.coalesce(d["d"], F.least(F.dayofmonth(reference), last))
        return F.when(d.isNotNull(), F.date_format(F.try_make_timestamp(year, month, at, s["time"]["h"], s["time"]["m"], s["time"]["s"]), "yyyy-MM-dd'T'HH:mm:ss"))

    def parted(t: Column) -> Column:
        zone = F.regexp_extract(t, r"(?i)((?<=[\d\s])(?:Z|GMT|UTC)|(?<=:\d{2}|\s)[+-]\d{2}:\d{2})\s*$", 1)
        bare = F.regexp_replace(t, r"(?i)\s*(?:(?<=[\d\s])(?:Z|GMT|UTC)|(?<=:\d{2})\s*[+-]\d{2}:\d{2})\s*$", "")
        got = lambda k: F.regexp_extract(bare, _TIME, k)
        number = lambda *ks: F.coalesce(*[got(k).try_cast("int") for k in ks], F.lit(0))
        half = F.lower(got(4))
        hour = F.when(half == "", number(5)).otherwise(number(1) % 12 + F.when(half == "p", 12).otherwise(0))
        time = F.struct(hour.alias("h"), number(2, 6).alias("m"), number(3, 7).alias("s"))
        day = F.trim(F.regexp_replace(bare, _TIME, " "))
        iso = let(F.struct(day.alias("day"), time.alias("time")), told)
        shown = F.when(zone == "", "").when(zone.rlike("^[+-]"), zone).otherwise("+00:00")
        return F.when(day.rlike(_DATE_WORDS), F.concat(iso, shown))

    return let(strip(x), parted)


def dated(x: Column, reference: Column) -> Column:
    """``iso_date``, else ``lenient_date``, else the text, stripped."""
    strict = iso_date(x)
    return F.when(strict == strip(x), F.coalesce(lenient_date(x, reference), strict)).otherwise(strict)


def value_text(x: Column, kind: str) -> Column:
    """A metadata value of a Spark type as text: nothing for null, dates and times in ISO form."""
    if kind == "date":
        shown = F.date_format(x, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        part = F.when(F.date_format(x, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(x, "SSSSSS")))
        zone = F.lit("") if kind == "timestamp_ntz" else F.date_format(x, "xxx")
        shown = F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), part, zone)
    else:
        shown = x.cast("string")
    return F.coalesce(strip(shown), F.lit(""))


def author_name(x: Column) -> Column:
    """Without a leading by or author, which need not be a word of its own; runs of white space as one space."""
    return squeeze(F.regexp_replace(strip(x), r"(?i)^(by|author)\s*[:\-]?\s*", ""))


def or_default(x: Column, default: str) -> Column:
    """The value, stripped, or a default where it is null or blank."""
    return F.coalesce(F.nullif(strip(x.cast("string")), F.lit("")), F.lit(default))


def quoted(x: Column) -> Column:
    """Every line of a block quote."""
    return F.regexp_replace(x, r"(?m)^", "> ")


def table_cell(x: Column) -> Column:
    return F.replace(F.replace(squeeze(x), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def alignment_rule(style: Column) -> Column:
    """The separator below a table's head for an alignment."""
    return F.when(style.contains("center"), ":---:").when(style.contains("right"), "---:").when(style.contains("left"), ":---").otherwise("---")


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def menu_row(idx: Column, display: Column, tokens: Column, title: Column) -> Column:
    """[00] hh:mm:ss |  2,381 tokens | title; wider values are not cut."""
    n, d = thousands(tokens), display
    pad = lambda v, w, f: F.when(F.length(v) >= w, v).otherwise(f(v, w, " "))
    return F.concat(F.format_string("[%02d] ", idx), pad(d, 8, F.rpad), F.lit(" | "), pad(n, 6, F.lpad), F.lit(" tokens | "), title)


def node_uuid(*keys: Column) -> Column:
    """The same identifier for the same keys, in the shape of a UUID."""
    h = F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
