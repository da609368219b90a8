"""Fields of a card's OCR text as column expressions.

Classes \\d, \\s and \\b are ASCII here. Every extractor gives null where it
finds nothing; null text gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.reference_data import ADDRESS_STATES, HINDI_HEADERS, ISSUER_EMAILS, NAME_BLACKLIST

# Patterns and formats of the fields.
#: The loose form also fits twelve digits without separators.
ID_SPACED, ID_LOOSE = r"\b([2-9]\d{3}\s+\d{4}\s+\d{4})\b", r"([2-9]\d{3}[^0-9]{0,3}\d{4}[^0-9]{0,3}\d{4})"
VID_SPACED, VID_TIGHT = r"\b([2-9]\d{3}\s+\d{4}\s+\d{4}\s+\d{4})\b", r"\b([2-9]\d{15})\b"
ENROLMENT, ENROLMENT_LABELLED = r"\b(\d{4}[/\s]\d{5}[/\s]\d{5})\b", r"(?i)\bEID[:\s]*(\d{14})\b"
MOBILE = r"\b([6-9]\d{9})\b"
YEAR_OF_BIRTH = r"(?i)(?:Year\s*of\s*Birth|YOB)[:\s]+(\d{4})"
ISSUE_DATE = r"(?i)Issue\s*Date[:\s]+(\d{1,2}[/\-]\d{1,2}[/\-]\d{4})"
SIDE_DOB, SIDE_ADDRESS = r"(?i)\b(DOB|Date\s*of\s*Birth)\b", r"(?i)\b(District|Dist|State|PIN|Pincode)\b"
SIDE_HEADER = r"(?i)Government\s*of\s*India"
GENDER_WORD = r"\b(Male|Female|Transgender|MALE|FEMALE|TRANSGENDER)\b"
MALE_LIKE, FEMALE_LIKE = r"(?i)^M[a-zA-Z@]{1,3}[le]?$", r"(?i)^Fe?m[a-z@]{0,4}le?$"
DOB_ANYWHERE = r"(?i)\b(?:DOB|DOR|D0B)\b"
CARE_OF_LINE = r"(?i)^(?:C/O|S/O|W/O|D/O|F/O)[:\s]+(.+)$"
ADDRESS_CARE_OF = r"(?i)^C[/\\]O[:\s]+([A-Za-z\s.\-']+)"
ADDRESS_PIN = r"\b([1-9]\d{5})\b"
ADDRESS_CLEANING = (
    (r"(\s+[a-z]{1,3}){2,}$", ""),
    (r"\s+[^a-zA-Z0-9]+(?=\s|$)", " "),
    (r"\s+[a-zA-Z]$", ""),
    (r",?\s*(?:\b[a-z]{1,3}\b\s*){3,}", " "),
    (r"\s{2,}", " "),
)
#: Characters that are cut off a line's start and end.
NOISE_START, NOISE_END = " \t\n\x0b\f\r|'`~.-_\\/(", " \t\n\x0b\f\r|'`~.-_\\/)"
DIGITS_MISREAD, DIGITS_MEANT = "OoDQ" "Ili|" "Zz" "Ss" "Gb" "T" "B" "gq", "0000" "1111" "22" "55" "66" "7" "8" "99"
DOB_WORD = r"D(?:OB|OR|0B|08|ate\s*of\s*Birth)"
DOB_SHORT = r"D(?:OB|OR|0B|08)"
PLAIN_DATE = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})"
LABELLED_DATE = "(?i)" + DOB_WORD + r"[:\s]*(\d{1,2})[/.\- ]{0,2}(\d{1,2})[/.\- ]{0,2}(\d{4})"
FUSED_DATE = "(?i)" + DOB_SHORT + r"[:\s]+(\d{1,2})\s+(\d)((?:19|20)\d{2})"
DIGITS_AFTER_DOB = "(?i)" + DOB_SHORT + r"[:\s]*([\d/ .\-]{4,20})"
#: The text from the first label on: no labelled date starts before it.
FROM_LABEL = rf"(?is){DOB_WORD}.*"
HEADER = r"(?i)(government\s+of\s+india|govt\.?\s+of\s+india|भारत\s+सरकार)"
DOB_LINE = r"(?i)\b(DOB|DOR|D0B|Date\s*of\s*Birth)\b"
NAME_LABEL = r"(?i)^(?:Name|Full\s*Name|नाम)\s*[:\-]\s*(.+)$"
#: Line ends but \n.
OTHER_ENDS = r"[\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
DEVANAGARI = r"[\u0900-\u097F]{3,}"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
MALE_LINES = ("MALE", "MATE", "MSLE", "MISO", "OSO", "WISO", "MAL", "MALI", "MAIE", "M0LE", "MOLE")
FEMALE_LINES = ("FEMALE", "FEMLE", "FEMAL", "FEMAIE")
ADDRESS_START = (
    r"(?i)\b(C[/\\]O|S[/\\]O|W[/\\]O|House\s*No|H\.?No|Door\s*No)|"
    r"\b(Near|Opp|Behind|Beside|Next\s*to)\b|\b(Village|Vill\.?|Post|P\.?O\.?|Taluka|Tehsil)\b"
)
ADDRESS_END = r"(?i)\b\d{4}\s+\d{4}\s+\d{4}\b|\bVID\b|Download\s*Date|Issue\s*Date"
GENDER_OR_DOB = r"(?i)\b(Male|Female|Transgender|DOB|DOR)\b"
CARE_OF = (
    r"(?i)\b(?:C[/\\]O|S[/\\]O|W[/\\]O|D[/\\]O|F[/\\]O|Father|Husband|Guardian|Son of|Wife of|Daughter of)"
    r"[\s:,\.]+([A-Za-z][A-Za-z\s.\-']{2,40})"
)
HOUSE = r"(?i)(?:House\s*No|H\.?No|Door\s*No|Plot\s*No|Flat\s*No|#|Room\s*No)[\.:\s]*([A-Za-z0-9/\-]+)"
LANDMARK = r"(?i)(?:Near|Opp\.?|Opposite|Behind|Beside|Next\s*to|Landmark)[\.:\s]+([A-Za-z0-9\s,.\-]{3,40})"
LOCALITY = r"(?i)(?:Village|Vill\.?|Town|City|Locality|Area|Nagar|Mohalla|Colony|Ward)[\.:\s]+([A-Za-z\s.\-]{2,30})"
DISTRICT = r"(?i)(?:Dist\.?|District)[\.:\s]+([A-Za-z\s.\-]{2,25})"
SUBDISTRICT = r"(?i)(?:Sub[\s\-]?Dist\.?|Taluka|Tehsil|Mandal|Block)[\.:\s]+([A-Za-z\s.\-]{2,25})"
ISSUED_BY = "Unique Identification Authority of India"
NAME_MISREAD, NAME_MEANT = "0134568@$!#", "OIEASGBASIH"
NAME_ENDINGS = (
    (r"GHANSHVAN$", "GHANSHYAM"),
    (r"KUMAWAT$", "KUMAVAT"),
    (r"ARAN$", "ARAM"),
    (r"ARN$", "ARM"),
    (r"RAN$", "RAM"),
    (r"RN", "M"),
    (r"([A-Z]{3,})VAN$", "$1YAM"),
    (r"([A-Z]{3,})AN$", "$1AM"),
)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none. The text is searched once."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), 0)


def kept(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value where `test` holds of it, else null. An array of one names it, so that it is computed once."""
    return F.get(F.filter(F.array(value), test), 0)


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is used more than once, or for every element of an array, and computed once."""
    return F.get(F.transform(F.array(value), made), 0)


def _filled(value: Column) -> Column:
    return kept(value, lambda x: x != "")


def lines(text: Column) -> Column:
    """Lines without their ends; none for the end of the text, as an empty last line."""
    parts = F.when(text.rlike(OTHER_ENDS), F.split(text, rf"\r\n|\n|{OTHER_ENDS}", -1)).otherwise(F.split(text, "\n", -1))
    return _with(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def clean_line(line: Column) -> Column:
    return F.rtrim(F.ltrim(line, F.lit(NOISE_START)), F.lit(NOISE_END))


def unique_lines(text: Column) -> Column:
    """Distinct cleaned lines in the order of their first appearance, empty ones left out."""
    return F.array_distinct(F.filter(F.transform(lines(text), clean_line), lambda x: x != ""))


def fixed_digits(value: Column) -> Column:
    """Letters that stand for digits in OCR text put right."""
    return F.translate(value, DIGITS_MISREAD, DIGITS_MEANT)


def _grouped(digits: Column, *sizes: int, separator: str = " ") -> Column:
    parts, at = [], 1
    for n in sizes:
        parts.append(F.substring(digits, at, n))
        at += n
    return F.concat_ws(separator, *parts)


def _regrouped(number: Column, *sizes: int, separator: str = " ") -> Column:
    """The number's digits in groups of these sizes, whatever stands between them."""
    return F.regexp_replace(number, "[^0-9]*".join(rf"(\d{{{n}}})" for n in sizes), separator.join(f"${k + 1}" for k in range(len(sizes))))


def id_number(text: Column) -> Column:
    """Twelve digits as 4-4-4: spaced, then with other separators or none."""
    return _regrouped(F.coalesce(found(text, ID_SPACED), found(text, ID_LOOSE)), 4, 4, 4)


def virtual_id(text: Column) -> Column:
    return _regrouped(F.coalesce(found(text, VID_SPACED), found(text, VID_TIGHT)), 4, 4, 4, 4)


def enrolment_number(text: Column) -> Column:
    """4/5/5 digits; white space but spaces stays; else 14 digits after the label."""
    parts = F.replace(found(text, ENROLMENT), F.lit(" "), F.lit("/"))
    return F.coalesce(parts, _regrouped(found(text, ENROLMENT_LABELLED), 4, 5, 5, separator="/"))


def mobile(text: Column) -> Column:
    return found(text, MOBILE)


def email(text: Column) -> Column:
    """The first address in lower case, null if it is the issuer's."""
    return kept(F.lower(found(text, EMAIL, 0)), lambda first: ~first.isin(*ISSUER_EMAILS))


def year_of_birth(text: Column, last_year: int = 2025) -> Column:
    return kept(found(text, YEAR_OF_BIRTH), lambda year: year.cast("int").between(1900, last_year))


def issue_date(text: Column) -> Column:
    return found(text, ISSUE_DATE)


def _packed(d: Column, m: Column, y: Column) -> Column:
    """A date as one number, for strings of digits. What no day, month or year can be stays none: at most 63, 63 and 99,999."""
    return F.least(y.try_cast("int"), F.lit(99999)) * 4096 + F.least(m.try_cast("int"), F.lit(63)) * 64 + F.least(d.try_cast("int"), F.lit(63))


def unpacked_date(code: Column) -> tuple[Column, Column, Column]:
    """Day, month and year of a packed date."""
    return code.bitwiseAND(63), F.shiftright(code, 6).bitwiseAND(63), F.shiftright(code, 12)


def is_date(code: Column, last_year: int = 2025) -> Column:
    """Whether a packed date is one. Null is none."""
    d, m, y = unpacked_date(code)
    return F.coalesce(d.between(1, 31) & m.between(1, 12) & y.between(1900, last_year), F.lit(False))


def from_label(text: Column) -> Column:
    """The text from its first label of a date on, empty without one."""
    return F.regexp_extract(text, FROM_LABEL, 0)


def digits_behind(near: Column) -> Column:
    """The runs of digits that follow a label; null without a label."""
    return F.when(near != "", F.regexp_extract_all(F.regexp_extract(near, DIGITS_AFTER_DOB, 1), F.lit(r"(\d+)")))


def date_codes(text: Column, near: Column, digits: Column) -> Column:
    """Packed readings of the dates in a text, in order of trust: in between are nulls and numbers that are no dates.

    `near` is `from_label` of the text, `digits` are `digits_behind` that. Given as columns of an earlier step
    they are made once, and all but dates without a label is compiled.
    """
    plain = F.transform(
        F.transform(F.regexp_extract_all(text, F.lit(PLAIN_DATE), F.lit(0)), lambda x: F.split(F.translate(x, ".-", "//"), "/")),
        lambda p: _packed(*(F.get(p, k) for k in (0, 1, 2))),
    )
    # the zero makes a group that is not found a day 0, as a cast that fails throws inside
    groups = lambda pattern: _packed(*(F.concat(F.lit("0"), F.regexp_extract(near, pattern, k)) for k in (1, 2, 3)))
    a, b, n, wide = F.get(digits, 0), F.get(digits, 1), F.size(digits), F.length(F.get(digits, 1))
    behind = F.array(
        groups(LABELLED_DATE),
        groups(FUSED_DATE),
        F.when(n >= 3, _packed(a, b, F.get(digits, 2))),
        F.when((n >= 2) & (wide == 5), _packed(a, F.substring(b, 1, 1), F.substring(b, 2, 4))),
        F.when((n == 2) & (wide == 6), _packed(a, F.substring(b, 1, 2), F.substring(b, 3, 4))),
    )
    # most texts of a pass hold no label, and nothing is looked for in them but plain dates
    return F.concat(plain, F.when(near != "", behind).otherwise(F.array().cast("array<int>")))


def _date(d: Column, m: Column, y: Column) -> Column:
    return F.struct(d.try_cast("int").alias("d"), m.try_cast("int").alias("m"), y.try_cast("int").alias("y"))


def date_candidates(text: Column, swap: bool, last_year: int = 2025) -> Column:
    """array<struct<d,m,y>> of the dates of birth that the text may mean, in order of trust.

    With `swap` day and month change places where only that makes a date;
    otherwise such readings are left out, and repeated ones too.
    """
    plain = F.transform(
        F.transform(F.regexp_extract_all(text, F.lit(PLAIN_DATE), F.lit(0)), lambda x: F.split(x, r"[/.\-]")),
        lambda p: _date(*(F.get(p, k) for k in (0, 1, 2))),
    )
    # one search finds a match, which is then taken apart; without one nothing is cast, as a cast that fails throws inside
    groups = lambda near, pattern: F.transform(
        F.transform(F.filter(F.array(F.regexp_extract(near, pattern, 0)), lambda x: x != ""), lambda x: F.split(F.regexp_replace(x, pattern, "$1/$2/$3"), "/")),
        lambda p: _date(*(F.get(p, k) for k in (0, 1, 2))),
    )

    def fused_digits(c: Column) -> Column:
        a, b = F.get(c, 0), F.get(c, 1)
        n, wide = F.size(c), F.length(b)
        return F.array(
            F.when(n >= 3, _date(a, b, F.get(c, 2))),
            F.when((n >= 2) & (wide == 5), _date(a, F.substring(b, 1, 1), F.substring(b, 2, 4))),
            F.when((n == 2) & (wide == 6), _date(a, F.substring(b, 1, 2), F.substring(b, 3, 4))),
        )

    def labelled(near: Column) -> Column:
        digits = F.regexp_extract_all(F.regexp_extract(near, DIGITS_AFTER_DOB, 1), F.lit(r"(\d+)"))
        return F.concat(groups(near, LABELLED_DATE), groups(near, FUSED_DATE), _with(digits, fused_digits))

    fits = lambda d, m, y: d.between(1, 31) & m.between(1, 12) & y.between(1900, last_year)
    # most texts of a pass hold no label: one search tells, and what needs one is looked for behind it only
    behind = F.transform(F.filter(F.array(F.regexp_extract(text, FROM_LABEL, 0)), lambda x: x != ""), labelled)
    every = F.concat(plain, F.flatten(behind))
    if not swap:
        return F.array_distinct(F.filter(every, lambda x: F.coalesce(fits(x["d"], x["m"], x["y"]), F.lit(False))))
    turned = F.transform(
        every,
        lambda x: F.when(fits(x["d"], x["m"], x["y"]), x).when(
            fits(x["m"], x["d"], x["y"]), F.struct(x["m"].alias("d"), x["d"].alias("m"), x["y"].alias("y"))
        ),
    )
    return F.filter(turned, lambda x: x.isNotNull())


def date_text(date: Column) -> Column:
    """dd/mm/yyyy of a struct<d,m,y>."""
    return F.when(date.isNotNull(), F.format_string("%02d/%02d/%d", date["d"], date["m"], date["y"]))


def date_of_birth(text: Column, last_year: int = 2025) -> Column:
    first = F.slice(date_candidates(text, True, last_year), 1, 1)
    return F.get(F.transform(first, lambda d: date_text(d)), 0)


def repaired_date(dob: Column, last_year: int = 2025) -> Column:
    """Misread digits of one date put right; as it was where no date comes of it."""
    separator = F.when(F.contains(dob, F.lit("/")), "/").when(F.contains(dob, F.lit("-")), "-")
    parts = F.split(F.replace(dob, separator, F.lit("\x00")), "\x00", -1)
    d = fixed_digits(F.trim(F.get(parts, 0))).try_cast("int")
    m = fixed_digits(F.trim(F.get(parts, 1))).try_cast("int")
    y = fixed_digits(F.regexp_replace(F.get(parts, 2), "[^0-9OSsoBbIilGgZzTt]", "")).try_cast("int")
    turned = (m > 12) & d.between(1, 12)
    day, month = F.when(turned, m).otherwise(d), F.when(turned, d).otherwise(m)
    good = (F.size(parts) == 3) & day.between(1, 31) & month.between(1, 12) & y.between(1900, last_year)
    return F.when(good, F.format_string("%02d/%02d/%d", day, month, y)).otherwise(dob)


def gender(text: Column, raw: Column | None = None, cleaned: Column | None = None) -> Column:
    """The word itself, else a short line that reads like it, else an initial after a line with a date of birth."""
    word = F.initcap(found(text, GENDER_WORD))

    def of_line(line: Column) -> Column:
        up = F.upper(line)
        return (
            F.when(line.rlike(MALE_LIKE) | up.isin(*MALE_LINES), "Male")
            .when(line.rlike(FEMALE_LIKE) | up.isin(*FEMALE_LINES), "Female")
        )

    raw = lines(text) if raw is None else raw
    cleaned = F.transform(raw, clean_line) if cleaned is None else cleaned
    short = lambda x: F.length(x).between(2, 12)
    fuzzy = F.get(F.filter(F.transform(F.filter(cleaned, short), of_line), lambda g: g.isNotNull()), 0)
    initial = lambda x: F.when(F.upper(x).startswith("M"), "Male").when(F.upper(x).startswith("F"), "Female")
    after = F.flatten(
        F.transform(
            _places(raw, DOB_ANYWHERE), lambda i: F.transform(F.filter(F.slice(cleaned, i + 2, F.lit(3)), short), initial)
        )
    )
    return F.coalesce(word, fuzzy, F.get(F.filter(after, lambda g: g.isNotNull()), 0))


def _may_be_name(line: Column) -> Column:
    words = F.split(line, r"\s+")
    return (
        F.length(line).between(5, 55)
        & line.rlike(r"^[A-Za-z][A-Za-z\s.\-']+$")
        & F.size(words).between(2, 6)
        & ~F.exists(words, lambda w: F.upper(w).isin(*NAME_BLACKLIST) | (F.length(w) < 2))
    )


def _places(raw: Column, pattern: str) -> Column:
    """Positions, from 0, of the lines that hold the pattern."""
    at = F.transform(raw, lambda x, i: F.when(x.rlike(pattern), i))
    return F.filter(at, lambda i: i.isNotNull())


def _names(cleaned: Column) -> Column:
    """The lines that may be a name, null in place of others."""
    return F.transform(cleaned, lambda x: F.when(_may_be_name(x), x))


def name(text: Column) -> Column:
    """The holder's name: after a header line, else after a label, else the best-looking line."""
    raw = lines(text)
    return _name(raw, _names(F.transform(raw, clean_line)), _places(raw, HEADER), F.get(_places(raw, DOB_LINE), 0))


def _name(raw: Column, names: Column, headers: Column, dob: Column) -> Column:
    first_header = F.get(headers, 0)
    first_of = lambda values: F.get(F.filter(values, lambda x: x.isNotNull()), 0)
    end = F.when((dob > first_header) & (dob > 0), dob).otherwise(first_header + 12)
    between = first_of(F.slice(names, first_header + 2, F.greatest(F.lit(0), end - first_header - 1)))
    after_any = first_of(F.transform(headers, lambda h: first_of(F.slice(names, h + 2, F.lit(11)))))
    with_label = F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x.rlike(NAME_LABEL))
    labelled = F.transform(with_label, lambda x: clean_line(F.regexp_extract(x, NAME_LABEL, 1)))
    first_place = lambda x: F.array_position(raw, x) - 1

    def points(x: Column, line: Column) -> Column:
        words = F.split(line, r"\s+")
        n, li = F.size(words), first_place(x)
        return (
            F.when(line == F.upper(line), 10).otherwise(0)
            + F.when(n.between(2, 4), 8).otherwise(0)
            + F.when(F.forall(words, lambda w: F.length(w) >= 3), 3).otherwise(0)
            + F.when(n >= 3, 5).otherwise(0)
            + F.when(first_header < li, 4).otherwise(0)
            + F.when(li < dob, 4).otherwise(0)
        )

    pairs = F.zip_with(raw, names, lambda x, c: F.struct(x.alias("raw"), c.alias("line")))
    scored = F.transform(
        F.filter(F.transform(pairs, lambda x, i: F.struct(x["raw"], x["line"], i.alias("i"))), lambda x: x["line"].isNotNull()),
        lambda x: F.struct(points(x["raw"], x["line"]).alias("p"), (-x["i"]).alias("k"), x["line"].alias("line")),
    )
    return F.coalesce(between, after_any, F.get(F.filter(labelled, _may_be_name), 0), F.array_max(scored)["line"])


def hindi_name(text: Column, raw: Column | None = None) -> Column:
    def fits(line: Column) -> Column:
        header = F.lit(False)
        for fragment in HINDI_HEADERS:
            header = header | F.contains(line, F.lit(fragment))
        return (
            line.rlike(DEVANAGARI)
            & ~header
            & ~line.rlike(r"(?U)\d")
            & F.size(F.split(line, r"\s+")).between(1, 5)
        )

    raw = lines(text) if raw is None else raw
    # most cards have no such letters: one search tells, and their lines are left alone
    return F.when(text.rlike(DEVANAGARI), F.get(F.filter(F.transform(raw, lambda x: F.trim(x)), fits), 0))


def care_of(text: Column, raw: Column | None = None) -> Column:
    """Two to five words after a label, else a line that starts with one."""
    n_words = lambda x: F.size(F.split(x, r"\s+"))
    labelled = kept(clean_line(F.regexp_extract(text, CARE_OF, 1)), lambda x: (x != "") & n_words(x).between(2, 5))
    raw = lines(text) if raw is None else raw
    own_line = F.filter(
        F.transform(
            F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x.rlike(CARE_OF_LINE)), lambda x: clean_line(F.regexp_extract(x, CARE_OF_LINE, 1))
        ),
        lambda x: (x != "") & n_words(x).between(1, 5) & x.rlike(r"^[A-Za-z\s.\-']+$"),
    )
    return F.coalesce(labelled, F.get(own_line, 0))


def card_side(text: Column) -> Column:
    address = text.rlike(SIDE_ADDRESS)
    return (
        F.when(text.isNull(), None)
        .when(text.rlike(SIDE_DOB), F.when(address, "combined").when(text.rlike(SIDE_HEADER), "front").otherwise("unknown"))
        .when(address, "back")
        .otherwise("unknown")
    )


def address_block(text: Column, raw: Column | None = None) -> Column:
    """The address as one line, null where no block is found: 12 lines at most from its start to a terminator."""
    raw = lines(text) if raw is None else raw
    where = lambda pattern: _places(raw, pattern)
    last = F.coalesce(F.array_max(where(GENDER_OR_DOB)), F.lit(-1))
    start = _with(last, lambda n: n + 1 + F.array_min(_places(F.slice(raw, n + 2, F.size(raw)), ADDRESS_START)))
    number = _with(F.array_min(where(ID_SPACED)), lambda n: F.when(n.isNotNull(), F.greatest(F.lit(0), n - 8)))
    begin = F.coalesce(start, number)
    block = F.transform(F.slice(raw, begin + 1, F.lit(12)), lambda x: F.trim(x))
    stop = lambda b: F.array_min(F.transform(b, lambda x, i: F.when(x.rlike(ADDRESS_END), i)))
    until = _with(block, lambda b: F.slice(b, F.lit(1), F.coalesce(stop(b), F.size(b))))
    bare = F.transform(
        F.filter(until, lambda x: F.length(x) >= 3),
        lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^A-Za-z0-9]{0,3}[A-Z]{1,2}\s+", "")), r"^[^A-Za-z0-9]+", "")),
    )
    out = F.array_join(F.filter(bare, lambda x: F.length(x) >= 3), " ")
    for pattern, put in ADDRESS_CLEANING:
        out = F.trim(F.regexp_replace(out, pattern, put))
    return _filled(out)


def _trimmed(value: Column) -> Column:
    return _filled(F.rtrim(F.trim(value), F.lit(",")))


def _address_parts(block: Column, lower: Column) -> dict[str, Column]:
    care = _filled(clean_line(F.regexp_extract(block, ADDRESS_CARE_OF, 1)))
    landmark = F.rtrim(F.trim(F.regexp_extract(block, LANDMARK, 1)), F.lit(","))
    landmark = F.trim(F.regexp_replace(landmark, r"(\s+[a-z]{1,3}){2,}$", ""))
    landmark = F.rtrim(F.trim(F.regexp_replace(landmark, r",?\s*(?:\b[a-z]{1,3}\b\s*){3,}", " ")), F.lit(","))
    state = F.lit(None).cast("string")
    for known in reversed(ADDRESS_STATES):
        state = F.when(F.contains(lower, F.lit(known.lower())), known).otherwise(state)
    return {
        "house": F.coalesce(care, found(block, HOUSE)),
        "landmark": _filled(landmark),
        "locality": _trimmed(F.regexp_extract(block, LOCALITY, 1)),
        "subdistrict": _trimmed(F.regexp_extract(block, SUBDISTRICT, 1)),
        "district": _trimmed(F.regexp_extract(block, DISTRICT, 1)),
        "state": state,
        "pin": found(block, ADDRESS_PIN),
    }


def address_parts(block: Column, lower: Column | None = None) -> Column:
    """struct of house, landmark, locality, subdistrict, district, state, pin, full of an address block.

    There is no street: no rule names one. `lower`: the block in lower case,
    where it is a column already.
    """
    parts = _address_parts(block, F.lower(block) if lower is None else lower)
    full = F.nullif(F.concat_ws(", ", *parts.values()), F.lit(""))
    return F.struct(*(v.alias(k) for k, v in parts.items()), F.coalesce(full, block).alias("full"))


def corrected_word(word: Column) -> Column:
    out = F.translate(F.upper(word), NAME_MISREAD, NAME_MEANT)
    for pattern, put in NAME_ENDINGS:
        out = F.regexp_replace(out, pattern, put)
    return out


def corrected_name(value: Column) -> Column:
    """Misread letters of a name put right, unless that changes more than three characters."""
    original = F.trim(value)
    fixed = F.array_join(F.transform(F.split(original, r"\s+"), corrected_word), " ")

    def chosen(a: Column, b: Column) -> Column:
        differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
        return F.when(F.size(F.filter(differ, lambda x: x)) > 3, a).otherwise(b)

    # an array of one and a transform name both, so that the word rules run once and not for every letter
    both = F.transform(F.array(F.struct(original.alias("a"), fixed.alias("b"))), lambda p: chosen(p["a"], p["b"]))
    return F.when(original == "", value).otherwise(F.get(both, 0))


def regrouped_id(value: Column) -> Column:
    """Misread digits put right and grouped 4-4-4 where twelve come of it; else as it was."""
    digits = F.regexp_replace(fixed_digits(value), r"[^0-9]", "")
    return F.when(F.length(digits) == 12, _grouped(digits, 4, 4, 4)).otherwise(value)


def with_card_record(df: DataFrame, text_col: str) -> DataFrame:
    """`df` with every field of the card in `text_col`, in place of columns of that name.

    Lines and the address block are columns of their own first, so that each is
    computed once and the projections stay small enough to be compiled.
    """
    text, raw, block = F.col(text_col), F.col("__raw"), F.col("__block")
    staged = (
        df.withColumn("__raw", lines(text))
        .withColumn("__clean", F.transform(raw, clean_line))
        .withColumns({
            "__block": address_block(text, raw), "__names": _names(F.col("__clean")), "__headers": _places(raw, HEADER),
            "__dob": F.get(_places(raw, DOB_LINE), 0),
        })
        .withColumn("__low", F.lower(block))
    )
    parts = _address_parts(block, F.col("__low"))
    record = {
        "name": _name(raw, F.col("__names"), F.col("__headers"), F.col("__dob")),
        "name_hindi": hindi_name(text, raw),
        "dob": date_of_birth(text),
        "year_of_birth": year_of_birth(text),
        "gender": gender(text, raw, F.col("__clean")),
        "id_number": id_number(text),
        "vid": virtual_id(text),
        "enrollment_number": enrolment_number(text),
        "father_husband_name": care_of(text, raw),
        "mobile": mobile(text),
        "email": email(text),
        "address_raw": block,
        "address_house": parts["house"],
        "address_street": F.lit(None).cast("string"),
        "address_landmark": parts["landmark"],
        "address_locality": parts["locality"],
        "address_subdistrict": parts["subdistrict"],
        "address_district": parts["district"],
        "address_state": parts["state"],
        "address_pin": parts["pin"],
        "issue_date": issue_date(text),
        "card_type": card_side(text),
        "issued_by": F.lit(ISSUED_BY),
    }
    return staged.select(*(c for c in df.columns if c not in record), *(c.alias(k) for k, c in record.items()))


def masked(number: Column, separator: str = " ") -> Column:
    """XXXX XXXX and the last four of twelve characters; others as they are, a dash for none."""
    packed = F.replace(number, F.lit(" "), F.lit(""))
    return (
        F.when(F.coalesce(number, F.lit("")) == "", "—")
        .when(F.length(packed) == 12, F.concat(F.lit(separator.join(["XXXX", "XXXX", ""])), F.right(packed, F.lit(4))))
        .otherwise(number)
    )


def masked_or_null(number: Column) -> Column:
    """XXXX-XXXX- and the last four of twelve characters, else null: the audit log's form."""
    packed = F.replace(number, F.lit(" "), F.lit(""))
    return F.when(F.length(packed) == 12, F.concat(F.lit("XXXX-XXXX-"), F.right(packed, F.lit(4))))


def shortened(value: Column, longest: int) -> Column:
    """At most `longest` characters, the last an ellipsis where it was cut; a dash for none."""
    text = F.coalesce(F.nullif(value, F.lit("")), F.lit("—"))
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest - 1)), F.lit("…"))).otherwise(text)
