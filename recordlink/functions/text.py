"""Text functions as Column expressions: name normalisation, print codes, numeric ids, cell clean-up. Null in, null out unless said."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
TYPOGRAPHIC_FROM = "‘’‛“”–—‐‑‒―− "
TYPOGRAPHIC_TO = "'''\"\"-------" + " "
CONFUSED_FROM, CONFUSED_TO = "01l582", "oiisbz"
SEQUENCES = (("rn", "m"), ("vv", "w"))
REGIONS_TWO = ("EN", "FR", "DE", "IT", "PT", "SP", "ES", "JP", "JA", "KR", "AE", "AS", "TC", "SC", "NA", "EU")
REGIONS_ONE = ("E", "A", "F", "G", "I", "P", "S")
LETTERS, DIGITS_FOR_LETTERS = "OILSBZ", "011582"
DIGITS, LETTERS_FOR_DIGITS = "01582", "OISBZ"
CODE_JUNK = " \t\r\n.,;:|/\\[](){}*\"'"
ID_JUNK = CODE_JUNK + "#"
WITH_DASH = r"^([A-Z0-9]{2,6})-([A-Z0-9]{2,7})$"
WITHOUT_DASH = r"^([A-Z]{2,6})([0-9]{2,4})$"
# -------------------------------------------------------------------------------------------------


def _accents() -> tuple[str, str, str, list[tuple[str, str]]]:
    """From Unicode's own decompositions: letters with accents and their bases, bare combining marks, and letters that become several."""
    one, base, many = "", "", []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), 0xFB00, 0xFB01, 0xFB02, 0x2122]:
        ch = chr(cp)
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if plain != ch and len(plain) == 1:
            one, base = one + ch, base + plain
        elif plain != ch and plain:
            many.append((ch, plain))
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return one, base, marks, [("ß", "ss"), *many]


ACCENTED, PLAIN, MARKS, EXPANDED = _accents()


def strip_accents(c: Column) -> Column:
    """Accents removed; case and punctuation stay."""
    return F.translate(F.translate(c, ACCENTED, PLAIN), MARKS, "")


def display(c: Column) -> Column:
    """Typographic marks to ASCII, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, TYPOGRAPHIC_FROM, TYPOGRAPHIC_TO), r"\s+", " "))


def normalize_strict(c: Column) -> Column:
    """The form in which names are compared: ASCII letters, digits, space, apostrophe and hyphen."""
    c = F.translate(c, TYPOGRAPHIC_FROM, TYPOGRAPHIC_TO)
    for a, b in EXPANDED:
        c = F.replace(c, F.lit(a), F.lit(b)) if a in "ßﬀﬁﬂĲĳŉǄǅǆǇǈǉǊǋǌ™¼½¾" else c
    c = F.lower(strip_accents(c))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9 '\-]", " "), r"\s+", " "))


def normalize_fuzzy(c: Column) -> Column:
    """Strict form with look-alike characters and sequences put together."""
    c = F.translate(normalize_strict(c), CONFUSED_FROM, CONFUSED_TO)
    for a, b in SEQUENCES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.translate(c, "-'", ""), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Search tokens: runs of letters and digits of the strict form."""
    return F.regexp_extract_all(normalize_strict(c), F.lit("[a-z0-9]+"), F.lit(0))


def last_is_prefix(c: Column) -> Column:
    return F.coalesce(F.length(F.element_at(F.when(F.size(tokens(c)) > 0, tokens(c)), -1)) >= 2, F.lit(False))


def code_clean(c: Column) -> Column:
    c = F.trim(F.translate(c, TYPOGRAPHIC_FROM[5:12], "-" * 7), F.lit(CODE_JUNK))
    return F.replace(F.upper(c), F.lit(" "), F.lit(""))


def code_parts(t: Column) -> Column:
    """struct(prefix, region, number) of a cleaned print code, or null."""
    dashed, plain = t.rlike(WITH_DASH), t.rlike(WITHOUT_DASH)
    get = lambda i: F.when(dashed, F.regexp_extract(t, WITH_DASH, i)).when(plain, F.regexp_extract(t, WITHOUT_DASH, i))
    return F.when(dashed | plain, F.struct(get(1).alias("prefix"), get(2).alias("tail")))


def with_code(df: DataFrame, raw: str) -> DataFrame:
    """Adds code_text (cleaned), code (prefix, region, number or null), code_canonical and code_variants of column ``raw``.

    Each step is a projection of its own, so that no regular expression runs twice for a row.
    """
    df = df.withColumn("code_text", code_clean(F.col(raw))).withColumn("_p", code_parts(F.col("code_text")))
    tail = F.col("_p.tail")
    two = F.regexp_extract(tail, f"^({'|'.join(REGIONS_TWO)}).{{2,}}$", 1)
    one = F.regexp_extract(tail, f"^([{''.join(REGIONS_ONE)}])[0-9]{{2,}}$", 1)
    df = df.withColumn("_r", F.nullif(F.coalesce(F.nullif(two, F.lit("")), one), F.lit("")))
    number = F.substr(tail, F.coalesce(F.length("_r"), F.lit(0)) + 1)
    # without a region the tail needs a digit: a word with a hyphen is no code
    df = df.withColumn("code", F.when(F.col("_r").isNotNull() | tail.rlike("[0-9]"), F.struct(F.col("_p.prefix").alias("prefix"), F.col("_r").alias("region"), number.alias("number")))).drop("_p", "_r")
    return df.withColumns({"code_canonical": code_canonical(F.col("code_text"), F.col("code")), "code_variants": code_variants(F.col("code_text"), F.col("code"))})


def looks_like_code(p: Column) -> Column:
    return p.isNotNull()


def code_canonical(t: Column, p: Column) -> Column:
    """PREFIX-REGIONNUMBER, or the cleaned text where it is no code."""
    return F.coalesce(F.concat(p["prefix"], F.lit("-"), F.coalesce(p["region"], F.lit("")), p["number"]), t)


def code_variants(t: Column, p: Column, most: int = 6) -> Column:
    """Likely readings of a misread code, the one as read first; none for a blank text, null for null."""
    to_digit = lambda x: F.translate(x, LETTERS, DIGITS_FOR_LETTERS)
    to_letter = lambda x: F.translate(x, DIGITS, LETTERS_FOR_DIGITS)
    join = lambda a, b: F.concat(a, F.lit("-"), F.coalesce(p["region"], F.lit("")), b)
    parsed = F.array(t, join(p["prefix"], to_digit(p["number"])), join(to_letter(p["prefix"]), p["number"]), join(to_letter(p["prefix"]), to_digit(p["number"])))
    last = F.least(F.lit(6), F.length(t) - 2)
    cuts = F.when((F.instr(t, "-") == 0) & (last >= 2), F.transform(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), lambda i: F.concat(F.substring(t, F.lit(1), i), F.lit("-"), F.substr(t, i + 1))))
    loose = F.concat(F.array(t, to_digit(t), to_letter(t)), F.coalesce(cuts, F.array().cast("array<string>")))
    return F.when(t != "", F.slice(F.array_distinct(F.when(p.isNotNull(), parsed).otherwise(loose)), 1, most)).when(t.isNotNull(), F.array().cast("array<string>"))


def clean_id(c: Column) -> Column:
    """The 5 to 8 digits of a printed numeric id, or null: the whole text if it is digits, else the longest (first) run."""
    t = F.translate(F.replace(F.upper(F.trim(c, F.lit(ID_JUNK))), F.lit(" "), F.lit("")), LETTERS, DIGITS_FOR_LETTERS)
    runs = F.regexp_extract_all(t, F.lit("[0-9]{5,8}"), F.lit(0))
    best = F.array_max(F.transform(runs, lambda x, i: F.struct(F.length(x), -i, x.alias("run"))))["run"]
    return F.when(t.rlike("^[0-9]+$"), F.when(F.length(t).between(5, 8), t)).otherwise(best)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def safe_cell(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


# ---- fixed values: fields whose value is masked whole -------------------------------------------
SECRET_FIELDS = ("api_key", "llm_api_key", "authorization", "x-api-key", "token")
# -------------------------------------------------------------------------------------------------


def mask_event(fields: Column) -> Column:
    """A map of an event's fields: those named in ``SECRET_FIELDS`` (in either case) become ``***``, keys inside other values are masked as in ``mask_keys``. Null values and a null map stay."""
    return F.transform_values(fields, lambda k, v: F.when(v.isNull(), v).when(F.lower(k).isin(*SECRET_FIELDS), "***").otherwise(mask_keys(v)))


def mask_keys(c: Column) -> Column:
    """Keys of the form ``sk-...``: the first seven and last four characters stay."""
    c = F.regexp_replace(c, r"(sk-ant-)[A-Za-z0-9_\-]*([A-Za-z0-9_\-]{4})", "$1***$2")
    return F.regexp_replace(c, r"(sk-[A-Za-z0-9]{4})[A-Za-z0-9]{12,}([A-Za-z0-9]{4})", "$1***$2")


def grid_layout(c: Column) -> Column:
    """struct(rows, cols) of ``ROWSxCOLS`` with one or two digits each, or null."""
    t, shape = F.lower(F.trim(c)), "^([1-9][0-9]?)x([1-9][0-9]?)$"
    return F.when(t.rlike(shape), F.struct(F.regexp_extract(t, shape, 1).try_cast("int").alias("rows"), F.regexp_extract(t, shape, 2).try_cast("int").alias("cols")))


def identity_label(name: Column, card_id: Column, marker: Column) -> Column:
    """The label of a candidate that a code or an id brought in."""
    return F.concat(F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Carta #"), card_id.cast("string"))), F.lit(" ("), marker, F.lit(")"))


def stored_score(c: Column) -> Column:
    return F.round(c, 4)


def copy_limit(ban: Column) -> Column:
    return F.when(ban == "Forbidden", 0).when(ban == "Limited", 1).when(ban == "Semi-Limited", 2).otherwise(3)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def edit_similarity_from(a: Column, b: Column, least: Column) -> Column:
    """``edit_similarity`` where it is at least ``least``, else 0; only the diagonal band of the distances that allow it is computed."""
    n = F.greatest(F.length(a), F.length(b))
    most = F.floor((1 - least) * n + 1e-9).cast("int")
    distance = F.call_function("levenshtein", a, b, F.greatest(most, F.lit(0)))
    return F.when(n == 0, F.lit(1.0)).when((most >= 0) & (distance >= 0), 1 - distance / n).otherwise(F.lit(0.0))


#: Letters and the space in three numbers of nine lanes of seven bits, digits in a fourth one of six bits each.
LANES = tuple((chars, 7) for chars in ("abcdefghi", "jklmnopqr", "stuvwxyz ")) + (("0123456789", 6),)


def counts_of_characters(c: Column) -> list[Column]:
    """Four numbers in which every character of ``LANES`` has a lane with as many low bits set as it occurs, as far as the lane goes."""
    out = []
    for chars, bits in LANES:
        total = F.lit(0).cast("long")
        for i, ch in enumerate(chars):
            n = F.least(F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit(""))), F.lit(bits))
            total = total + F.shiftleft(F.pow(F.lit(2.0), n).cast("long") - 1, bits * i)
        out.append(total)
    return out


def least_distance(a: list[Column], b: list[Column], n: Column, m: Column) -> Column:
    """A lower bound of the edit distance of texts of n and m characters by their ``counts_of_characters``, whatever the order of their characters: an insertion or deletion changes one count, a replacement two."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:])), F.bit_count(a[0].bitwiseXOR(b[0])))
    return F.shiftright(apart + F.abs(n - m) + 1, 1)


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")
