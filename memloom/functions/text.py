"""Text functions: trimming, tokens, chunks, dates, and the validators of names and values.

Patterns are written so that Java's engine gives the results of a linear-time engine with ASCII
word boundaries: boundaries are explicit, white space is listed, and lines end at line feeds only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\p{Z}\t\n\x0B\f\r\x85]"
LEFT, RIGHT = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
CHUNK, OVERLAP, LEAST = 1600, 320, 50


def trimmed(text: Column) -> Column:
    """text without Unicode white space at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def lowered(text: Column) -> Column:
    """Lower case letter by letter, without context rules."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


# --- chunks ---


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def others(rows: DataFrame, *names: str) -> list[Column]:
    """The columns of rows but for names, which new columns take."""
    return [F.col(f"`{c}`") for c in rows.columns if c not in names]


def fixed_pieces(text: Column, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Trimmed windows of size characters, each overlap into the last; a last window under least characters is joined to
    the one before."""
    overlap = min(max(0, overlap), size - 1)
    step = size - overlap
    can_rest = least > overlap  # else a short window would lie inside the one before

    def fold(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(trimmed(F.concat(last, F.lit(" "), w["piece"]))))
        return F.when(w["rest"] & (F.size(done) > 0), joined).otherwise(F.concat(done, F.array(w["piece"])))

    def cut(t: Column) -> Column:
        n = F.length(t)
        count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
        starts = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, lambda i: F.struct(trimmed(F.substring(t, i * step + 1, F.lit(size))).alias("piece"), ((n - i * step < least) & (i > 0)).alias("rest")))
        windows = F.filter(windows, lambda w: (w["piece"] != "") | w["rest"])
        return F.aggregate(windows, F.array().cast("array<string>"), fold) if can_rest else F.transform(windows, lambda w: w["piece"])

    return bind(trimmed(text), cut)


def fixed_chunks(rows: DataFrame, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """rows with (chunk_index, chunk) of `fixed_pieces`; columns of these names are replaced."""
    return rows.select(*others(rows, "chunk_index", "chunk"), F.posexplode(fixed_pieces(F.col(text), size, overlap, least)).alias("chunk_index", "chunk"))


def stride_chunks(rows: DataFrame, text: str = "text", size: int = CHUNK) -> DataFrame:
    """rows with (chunk_index, chunk): plain strides that give the text back when joined."""
    n = F.greatest(F.length(text), F.lit(1))
    starts = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    return rows.select(*others(rows, "chunk_index", "chunk"), F.posexplode(F.transform(starts, lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))).alias("chunk_index", "chunk"))


def boundary_pieces(text: Column, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """The array of (chunk, line_start, line_end) of a text: windows that end at the last blank line, else the last line
    end, in their back half; the next starts overlap before. Chunks under least characters are left out."""
    overlap = min(max(0, overlap), size - 1)
    # a cut lies past the middle, so a step advances by half a window less the overlap at least
    advance = max(1, size // 2 + 1 - overlap)

    def cut(t: Column) -> Column:
        n = F.length(t)

        def step(state: Column, _: Column) -> Column:
            start, full = state["start"], F.least(state["start"] + size, n)

            def ending(back: Column) -> Column:
                blank, line = F.instr(back, "\n\n"), F.instr(back, "\n")
                blank_at, line_at = full - blank - 1, full - line  # where the mark begins
                return F.when((blank > 0) & (blank_at > start + size // 2), blank_at).when((line > 0) & (line_at > start + size // 2), line_at).otherwise(full)

            end = F.when(full >= n, full).otherwise(bind(F.reverse(F.substring(t, start + 1, full - start)), ending))

            def moved(e: Column) -> Column:
                following = F.when(e < n, e - overlap).otherwise(e)
                new = F.struct(start.alias("start"), e.cast("int").alias("end"), state["line"].alias("line_start"), (state["line"] + ends(start, e)).alias("line_end"))
                return F.struct(following.cast("int").alias("start"), (state["line"] + ends(start, following)).alias("line"), F.concat(state["cuts"], F.array(new)).alias("cuts"))

            return F.when(start >= n, state).otherwise(bind(end, moved))

        def ends(first: Column, upto: Column) -> Column:  # line ends in a stretch, so lines are counted along, not from the start
            part = F.substring(t, first + 1, (upto - first).cast("int"))
            return (F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))).cast("int")

        begin = F.struct(F.lit(0).alias("start"), F.lit(1).alias("line"), F.array().cast("array<struct<start:int,end:int,line_start:int,line_end:int>>").alias("cuts"))
        cuts = F.aggregate(F.sequence(F.lit(1), (F.ceil(n / advance) + 1).cast("int")), begin, step, lambda s: s["cuts"])
        pieces = F.transform(cuts, lambda c: F.struct(trimmed(F.substring(t, c["start"] + 1, c["end"] - c["start"])).alias("chunk"), c["line_start"].alias("line_start"), c["line_end"].alias("line_end")))
        return F.filter(pieces, lambda c: F.length(c["chunk"]) >= least)

    return bind(trimmed(text), cut)


def boundary_chunks(rows: DataFrame, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """rows with (chunk_index, chunk, line_start, line_end) of their `boundary_pieces`."""
    rest = others(rows, "chunk_index", "chunk", "line_start", "line_end")
    whole = rows.select(*rest, F.posexplode(boundary_pieces(F.col(text), size, overlap, least)).alias("chunk_index", "__c"))
    return whole.select(*rest, "chunk_index", "__c.chunk", "__c.line_start", "__c.line_end")


# --- dates ---

# Month names and the forms of dates.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
BLANK = r"[\t\n\f\r ]"
ISO = rf"{LEFT}(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){RIGHT}"
SLASH = rf"{LEFT}(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}){RIGHT}"
MONTH_FIRST = rf"(?i){LEFT}({MONTHS})\.?{BLANK}+(\d{{1,2}})(?:st|nd|rd|th)?,?{BLANK}+(\d{{4}}){RIGHT}"
DAY_FIRST = rf"(?i){LEFT}(\d{{1,2}})(?:st|nd|rd|th)?{BLANK}+({MONTHS})\.?,?{BLANK}+(\d{{4}}){RIGHT}"
DATE_KEY = rf"(?mid)^{BLANK}*(?:date|created|published){BLANK}*:{BLANK}*(.+?){BLANK}*$"


def _date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD if it is a date of the calendar, else null."""
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when((year != "") & (year != "0000"), F.try_to_date(text, "yyyy-MM-dd")).cast("string")


def _month(name: Column) -> Column:
    """The number of a month by its first three letters."""
    at = F.position(F.substring(F.lower(name), 1, 3), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return F.lpad((F.floor((at - 1) / 3) + 1).cast("string"), 2, "0")


def find_date(text: Column) -> Column:
    """The first date, YYYY-MM-DD, in the order year first, slashes (day first if over 12), month first, day first; '' if none.
    Of each form only its first match counts."""

    def dates(t: Column) -> Column:  # in a lambda, so the text is worked out once
        iso, slash, month_first, day_first = ([F.regexp_extract(t, p, k) for k in (1, 2, 3)] for p in (ISO, SLASH, MONTH_FIRST, DAY_FIRST))
        found = F.coalesce(
            _date(*iso),
            F.when(slash[0].try_cast("int") > 12, _date(slash[2], slash[1], slash[0])).otherwise(_date(slash[2], slash[0], slash[1])),
            _date(month_first[2], _month(month_first[0]), month_first[1]),
            _date(day_first[2], _month(day_first[1]), day_first[0]),
            F.lit(""),
        )
        return F.when(t.rlike(r"\d{4}"), found).otherwise("")  # every form has a year; most texts have none

    return bind(text, dates)


def front_matter(text: Column) -> tuple[Column, Column]:
    """(block between --- fences at the very start, or null; the rest)."""
    rest = F.substr(text, F.lit(4))
    at = F.instr(rest, "\n---")
    there = text.startswith("---\n") & (at > 0)
    return F.when(there, F.substr(rest, F.lit(1), at - 1)), F.when(there, F.substr(rest, at + 4)).otherwise(text)


def stem(source: Column) -> Column:
    """The last part of a path without its extension."""
    base = F.regexp_extract(source, r"([^/]*)/*$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def content_date(source: Column, text: Column) -> Column:
    """The date of a text: from its source's name, its front matter's date, or its first ten lines; '' if none."""
    block, body = front_matter(text)
    name = stem(source)
    dates = [find_date(name), find_date(F.translate(name, "-_/", "   ")), find_date(trimmed(F.regexp_extract(block, DATE_KEY, 1))), find_date(F.substring_index(body, "\n", 10))]
    return F.coalesce(*(F.nullif(d, F.lit("")) for d in dates), F.lit(""))


# --- validators: true where a value may be stored ---


def _within(text: Column, most: int) -> Column:
    return F.length(text).between(1, most) & ~F.contains(text, F.lit("\0"))


def valid_name(text: Column) -> Column:
    value = trimmed(text)
    shape = r"^(?:[\p{L}\p{N}]|[\p{L}\p{N}][\p{L}\p{N} .'_-]{0,126}[\p{L}\p{N}])$"
    return F.coalesce(_within(value, 128) & ~value.rlike(r"\.\.|/|\\") & value.rlike(shape), F.lit(False))


def valid_content(text: Column) -> Column:
    return F.coalesce((trimmed(text) != "") & (F.length(text) <= 100_000) & ~F.contains(text, F.lit("\0")), F.lit(False))


def valid_source(text: Column) -> Column:
    return F.coalesce(_within(trimmed(text), 512), F.lit(False))


def valid_fact_value(text: Column) -> Column:
    return fits(trimmed(text))


def fits(value: Column) -> Column:
    """Whether a trimmed value of a fact is in bounds."""
    return F.coalesce(_within(value, 128), F.lit(False))


DAY = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"


def temporal(text: Column, value: Column | None = None) -> Column:
    """The canonical form of a date or UTC datetime ('' stays: unbounded); null if it is neither. value: text trimmed, where it is there."""
    value = trimmed(text) if value is None else value
    real = F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd").isNotNull()
    moment = rf"^{DAY}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:Z|\+00:00)$"
    return F.when(text == "", "").when(value.rlike(f"^{DAY}$") & real, value).when(value.rlike(moment) & real, F.regexp_replace(value, r"\+00:00$", "Z"))


def valid_skill(name: Column, description: Column, content: Column) -> Column:
    return F.coalesce(F.octet_length(trimmed(name)).between(1, 128) & (F.octet_length(content) <= 1_000_000) & (trimmed(content) != "") & (F.octet_length(description) <= 1024), F.lit(False))


def preview(text: Column) -> Column:
    return F.substring(text, 1, 300)
