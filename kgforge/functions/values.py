"""Values as an extractor writes them, brought to their declared type.

Each function gives a value or null; where the text is neither a value of the type nor missing (empty or 'null'), `unreadable` is true
and validation rejects it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a thousands separator, the words for true and false, the names of months.
SEPARATORS = [".", ",", " ", "_"]
TRUE_WORDS = ["true", "yes", "sí", "si", "verdadero", "1"]
FALSE_WORDS = ["false", "no", "falso", "0"]
MONTHS = {
    1: ["january", "jan", "enero", "ene"], 2: ["february", "feb", "febrero"], 3: ["march", "mar", "marzo"], 4: ["april", "apr", "abril", "abr"],
    5: ["may", "mayo"], 6: ["june", "jun", "junio"], 7: ["july", "jul", "julio"], 8: ["august", "aug", "agosto", "ago"],
    9: ["september", "sep", "sept", "septiembre", "setiembre", "set"], 10: ["october", "oct", "octubre"], 11: ["november", "nov", "noviembre"],
    12: ["december", "dec", "diciembre", "dic"],
}
MAX_INTEGER = 2**56 - 1
MAX_FLOAT = 3.4028234663852886e38


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def is_missing(raw: Column) -> Column:
    return raw.isNull() | F.lower(trimmed(raw)).isin("", "null")


def normalize_string(raw: Column, options: list[str] | None = None) -> Column:
    """Trimmed, without null characters; snapped to an option that differs in case only, the exact one first."""
    text = trimmed(F.translate(raw, "\x00", ""))
    value = F.when(~is_missing(text), text)
    if options:
        same = F.filter(F.array(*map(F.lit, options)), lambda o: F.lower(o) == F.lower(value))
        value = F.when(value.isin(options), value).otherwise(F.coalesce(F.get(same, F.lit(0)), value))
    return value


def bound(value: Column, of) -> Column:
    """of(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def digits_and_marks(number: Column) -> Column:
    """sign, groups (what stands between separators) and marks (the separators in order) of a number's text."""
    sign = F.when(F.substring(number, 1, 1).isin("+", "-"), F.substring(number, 1, 1)).otherwise("")
    body = F.when(sign == "", number).otherwise(F.substr(number, F.lit(2)))
    marks = F.filter(F.split(body, ""), lambda c: c.isin(SEPARATORS))
    plain = F.translate(body, "".join(SEPARATORS[1:]), SEPARATORS[0] * (len(SEPARATORS) - 1))
    return F.struct(sign.alias("sign"), F.split(plain, "[.]", -1).alias("groups"), marks.alias("marks"))


def all_digits(groups: Column) -> Column:
    """Whether there is nothing but digits in every group, and some in each."""
    return F.forall(groups, lambda g: (g != "") & (F.translate(g, "0123456789", "") == ""))


def in_threes(groups: Column) -> Column:
    """Whether groups are those of thousands: three digits each, and one to three in the first."""
    return F.length(F.get(groups, F.lit(0))).between(1, 3) & F.forall(F.slice(groups, 2, F.greatest(F.size(groups) - 1, F.lit(0))), lambda g: F.length(g) == 3)


def normalize_integer(raw: Column) -> Column:
    """Digits, or digits grouped in threes by one kind of separator."""

    def read(x: Column) -> Column:
        fine = all_digits(x["groups"]) & ((F.size(x["marks"]) == 0) | (F.size(F.array_distinct(x["marks"])) == 1) & in_threes(x["groups"]))
        return F.when(fine, F.concat(x["sign"], F.array_join(x["groups"], "")).try_cast("bigint"))

    return bound(digits_and_marks(trimmed(raw)), read)


def normalize_float(raw: Column) -> Column:
    """Point or comma for decimals, digits grouped by another separator; a lone point or comma is the decimal one."""

    def read(x: Column) -> Column:
        groups, marks = x["n"]["groups"], x["n"]["marks"]
        n, last = F.size(marks), F.element_at(marks, -1)
        before = F.slice(marks, 1, F.greatest(n - 1, F.lit(0)))
        # a decimal sign is the last mark, and unlike the others
        decimal = (n > 0) & last.isin(".", ",") & ~F.array_contains(before, last)
        whole = F.when(decimal, F.slice(groups, 1, n)).otherwise(groups)
        grouping = F.when(decimal, before).otherwise(marks)
        fine = all_digits(groups) & ((F.size(grouping) == 0) | (F.size(F.array_distinct(grouping)) == 1) & in_threes(whole))
        power = F.coalesce(F.get(x["parts"], F.lit(1)), F.lit("0"))
        fine = fine & (F.size(x["parts"]) <= 2) & (F.translate(F.regexp_replace(power, "^[+-]", ""), "0123456789", "") == "") & power.rlike("[0-9]$")
        number = F.concat(x["n"]["sign"], F.array_join(whole, ""), F.lit("."), F.when(decimal, F.element_at(groups, -1)).otherwise("0"), F.lit("E"), power)
        return F.when(fine, number.try_cast("double"))

    return bound(F.split(trimmed(raw), "[eE]", -1), lambda parts: bound(F.struct(parts.alias("parts"), digits_and_marks(F.get(parts, F.lit(0))).alias("n")), read))


def normalize_boolean(raw: Column) -> Column:
    word = F.lower(trimmed(raw))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a year, month or day that the calendar has, else null; parts are text, empty if there are none."""
    y, m, d = (F.when(x != "", x).try_cast("int") for x in (year, month, day))
    text = F.format_string("%04d-%02d-%02d", y, F.coalesce(m, F.lit(1)), F.coalesce(d, F.lit(1)))
    real = (y >= 1) & F.try_to_date(text).isNotNull()
    return F.when(real, F.when(m.isNull(), F.substring(text, 1, 4)).when(d.isNull(), F.substring(text, 1, 7)).otherwise(text))


# What may follow the number of a day, and what may stand between the parts of a date with a month's name.
ORDINALS = ["º", "°", "st", "nd", "rd", "th"]
LINKS = ["de", "del", "of"]


def normalize_date(raw: Column) -> Column:
    """A partial date from year-first, numeric or named-month forms; of two orders of day and month the one that forms a date, else day first.

    The text falls into runs of digits and of letters, with gaps between them. What the runs are, with how many digits each, says which
    forms come into question, and the gaps whether it is one.
    """
    text = F.lower(trimmed(raw))
    # what belongs to a day's number, or links a month's name with what is beside it, says nothing more
    bare = lambda t: F.regexp_replace(t, rf"(?<=[0-9])(?:{'|'.join(ORDINALS)})(?=[\s,/-])", "")
    loose = lambda t: F.regexp_replace(bare(t), rf"(?<=[\s,/-])(?:{'|'.join(LINKS)})\s+", "")
    run = r"[0-9]+|\p{L}+"
    size = lambda r: F.when(~r.rlike("^[0-9]"), "w").when(F.length(r).isin(1, 2, 4), F.length(r).cast("string")).otherwise("x")
    split = lambda t: F.struct(F.regexp_extract_all(t, F.lit(f"({run})"), F.lit(1)).alias("runs"), F.split(t, run, -1).alias("gaps"))
    numbers = F.create_map(*[F.lit(x) for k, names in MONTHS.items() for n in names for x in (n, str(k))])
    # a name that is no month's gives no date, rather than a year
    month = lambda name: F.coalesce(F.try_element_at(numbers, name), F.lit("0"))
    none = F.lit("")
    date = lambda y, m=none, d=none: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    def read(x: Column) -> Column:
        shape = lambda of: F.array_join(F.transform(x[of]["runs"], size), "")
        part, gap = (lambda of, k: F.get(x[of]["runs"], F.lit(k))), lambda of, k: F.get(x[of]["gaps"], F.lit(k))
        form = lambda of, kinds: (gap(of, 0) == "") & (F.element_at(x[of]["gaps"], -1) == "") & shape(of).rlike(f"^{kinds}$")
        sign, same = gap("text", 1).isin("-", "/", "."), gap("text", 1) == gap("text", 2)
        first, second, third = (part("text", k) for k in range(3))
        swap = (first.try_cast("int") <= 12) & (second.try_cast("int") > 12)
        # an abbreviated name may have its point
        after_name = lambda of, k: F.regexp_replace(gap(of, k), "^[.]", "")
        apart = lambda g: (g != "") & trimmed(g).isin("", "-", "/", ",")
        blank = lambda g: (g != "") & (trimmed(g) == "")
        return (
            F.when(form("text", "4"), date(first))
            .when(form("text", "4[12]") & sign, date(first, second))
            .when(form("text", "[12]4") & sign, date(second, first))
            .when(form("text", "4[12][12]") & sign & same, date(first, second, third))
            .when(form("text", "[12][12]4") & sign & same, date(third, F.when(swap, first).otherwise(second), F.when(swap, second).otherwise(first)))
            .when(form("loose", "[12]w4") & apart(gap("loose", 1)) & apart(after_name("loose", 2)), date(part("loose", 2), month(part("loose", 1)), part("loose", 0)))
            .when(form("bare", "w[12]4") & blank(after_name("bare", 1)) & blank(F.regexp_replace(gap("bare", 2), "^,", "")), date(part("bare", 2), month(part("bare", 0)), part("bare", 1)))
            .when(form("loose", "w4") & apart(after_name("loose", 1)), date(part("loose", 1), month(part("loose", 0))))
        )

    versions = bound(text, lambda t: F.struct(split(t).alias("text"), split(bare(t)).alias("bare"), split(loose(t)).alias("loose")))
    return bound(bound(versions, read), lambda x: partial_date(x["y"], x["m"], x["d"]))


NORMALIZERS = {"string": normalize_string, "integer": normalize_integer, "float": normalize_float, "boolean": normalize_boolean, "date": normalize_date}


def unreadable(raw: Column, value: Column) -> Column:
    return ~is_missing(raw) & value.isNull()


def is_refined_by(coarse: Column, fine: Column) -> Column:
    """Whether a partial date says more than another and nothing else; parts have a fixed width, so text will do."""
    return F.startswith(fine, coarse) & (F.length(fine) > F.length(coarse))


def date_start(date: Column) -> Column:
    return F.to_date(F.rpad(F.concat(date, F.when(F.length(date) == 4, "-01-01").when(F.length(date) == 7, "-01").otherwise("")), 10, " "))


def is_valid(value: Column, data_type: str, options: list | None = None, regex: str | None = None, least=None, most=None) -> Column:
    """Type, options, whole-text pattern and bounds; null is never valid."""
    ok = value.isNotNull()
    if data_type == "integer":
        ok = ok & (F.abs(value) <= MAX_INTEGER)
    if data_type == "float":
        ok = ok & (F.abs(value) <= MAX_FLOAT) & ~F.isnan(value)
    if options:
        ok = ok & value.isin(options)
    if regex:
        ok = ok & value.rlike(rf"\A(?:{regex})\z")
    if least is not None:
        ok = ok & (value >= F.lit(least))
    if most is not None:
        ok = ok & (value <= F.lit(most))
    return F.coalesce(ok, F.lit(False))


def tokens_of_usage(total_input: Column, cached: Column, written: Column, total_output: Column, reasoning: Column) -> list[Column]:
    """Categories that don't overlap, none below zero; what is no number is null."""
    number = lambda c: F.when(c.try_cast("bigint") >= 0, c.try_cast("bigint"))
    i, c, w, o, r = map(number, (total_input, cached, written, total_output, reasoning))
    less = lambda a, *b: F.greatest(a - sum((F.coalesce(x, F.lit(0)) for x in b), F.lit(0)), F.lit(0))
    return [F.when(i.isNotNull(), less(i, c, w)), c, w, F.when(o.isNotNull(), less(o, r)), r]
