"""Column functions over text: cleaning, tokens, headings, references, names.  All of them run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists whose wording decides the results.
TOKEN = "[a-z0-9áéíóúüñ]+"
PAGE_NUMBER = r"^\s*(?:p[áa]g(?:ina)?\.?\s*)?\d{1,4}\s*$"
PIECE_START = r"^\s*(?:[a-zñ]\)|[A-ZÑ]\)|\d{1,2}\.\s|[•\-–]\s)"
SECTION_PATTERNS = (
    r"ART[IÍ]CULO\s+\d+[°ºo]?",
    r"SECCI[OÓ]N\s+\d+(?:\.\d+)*",
    r"CAP[IÍ]TULO\s+[IVXLCDM0-9]+",
    r"T[IÍ]TULO\s+[IVXLCDM0-9]+",
    r"TABLA\s+\d+(?:[.\-]\d+)*",
    r"ANEXO\s+[A-Z0-9]+",
)
HEADINGS = (
    ("titulo", r"^\s*T[IÍ]TULO\s+([IVXLCDM]+|\d+)\b[\s.:–-]*(.{0,120})"),
    ("capitulo", r"^\s*CAP[IÍ]TULO\s+([IVXLCDM]+|\d+)\b[\s.:–-]*(.{0,120})"),
    ("anexo", r"^\s*ANEXO\s+(GENERAL|[A-Z0-9]{1,4})\b[\s.:–-]*(.{0,120})"),
    ("articulo", r"^\s*ART[IÍ]CULO\s+(\d{1,4})[°ºo]?\.?\s*[\s.:–-]*(.{0,120})"),
    ("seccion", r"^\s*SECCI[OÓ]N\s+(\d{1,4}(?:\.\d+)*)\b[\s.:–-]*(.{0,120})"),
)
NUMERAL = r"^\s*(\d{1,4}(?:[.\-]\d{1,3}){1,3})\s+([A-ZÁÉÍÓÚÑ(\"“'].{2,120})"
TABLE_ID = r"(\d+(?:[.\-]\d+)*(?:\.(?-i:[a-zñ])\b|\s*\((?-i:[A-Za-zñ])\))?)"
STRUCT_REF = r"\b(art[ií]culo|tabla|secci[oó]n|cap[ií]tulo|anexo)\s+(\d+(?:[.\-]\d+)*|[ivxlcdm]+\b|general\b)"


def any_case(pattern: str) -> str:
    return "(?iu)" + pattern


def clean_text(text: Column) -> Column:
    """Line ends to LF, tabs, form feeds, vertical tabs and runs of spaces to one space, at most one blank line, no space around line ends."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[\t\f\x0B]", " "), r"\n{3,}", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, " {2,}", " "), r" ?\n ?", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased lexical tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


def line_key(line: Column) -> Column:
    """A line as boilerplate detection compares it: lower case, single spaces, digits as #."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\s+", " "), r"\d", "#")


def collapse_elongations(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)\1{2,}", "$1")


def first_section(text: Column) -> Column:
    """The first pattern that occurs, spaces collapsed; null if none does."""
    found = [F.nullif(F.regexp_replace(F.regexp_extract(text, any_case(p), 0), r"\s+", " "), F.lit("")) for p in SECTION_PATTERNS]
    return F.coalesce(*found)


def source_name(name: Column) -> Column:
    """``Documento`` for none, without a final .pdf, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("Documento")), r"(?i)\.pdf$", ""))


def safe_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_")


def ascii_name(name: Column) -> Column:
    """Accents dropped, other characters to underscores, ``documento`` for nothing."""
    plain = F.translate(name, "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC")
    kept = F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", ""), r"[^A-Za-z0-9_.\-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+$", ""), F.lit("")), F.lit("documento"))


def heading(line: Column) -> Column:
    """struct(kind, number, title) of a heading line, null otherwise; the first pattern in order decides."""
    out = F.lit(None).cast("struct<kind:string,number:string,title:string>")
    letters = F.regexp_count(F.regexp_extract(line, NUMERAL, 2), F.lit("[A-Za-zÁÉÍÓÚÑáéíóúñ]"))
    numeral = F.rlike(line, F.lit(NUMERAL)) & (letters >= 3) & (F.regexp_count(line, F.lit(r"\d")) <= F.length(line) * 0.4)
    cases = [(k, any_case(p), F.rlike(line, F.lit(any_case(p)))) for k, p in HEADINGS] + [("numeral", NUMERAL, numeral)]
    for kind, pattern, fits in reversed(cases):
        one = F.struct(F.lit(kind).alias("kind"), F.regexp_replace(F.trim(F.regexp_extract(line, pattern, 1)), r"\.+$", "").alias("number"), F.trim(F.regexp_extract(line, pattern, 2)).alias("title"))
        out = F.when(fits, one).otherwise(out)
    return out


def table_anchor(line: Column) -> Column:
    """struct(table_id, title, continued) of a line that opens a table, null otherwise."""
    pattern = any_case(r"^\s*Tabla\s+" + TABLE_ID + "(.*)")
    title = F.substring(F.regexp_replace(F.regexp_extract(line, pattern, 2), r"^[ .–\-:]+|[ .–\-:]+$", ""), 1, 160)
    found = F.struct(F.regexp_replace(F.regexp_extract(line, pattern, 1), r"\s+", "").alias("table_id"), title.alias("title"), F.rlike(line, F.lit(any_case("continuaci[oó]n"))).alias("continued"))
    return F.when(F.rlike(line, F.lit(pattern)), found)


#: The kinds of cited parts as they are written with their accents.
ACCENTED = (("ARTICULO", "ARTÍCULO"), ("SECCION", "SECCIÓN"), ("CAPITULO", "CAPÍTULO"))


def all_refs(text: Column) -> Column:
    """Cited parts as ``KIND number``, the kind accented and all letters in upper case, however they are written."""
    kinds = F.regexp_extract_all(text, F.lit(any_case(STRUCT_REF)), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(any_case(STRUCT_REF)), F.lit(2))

    def kind(k: Column) -> Column:
        out = F.upper(k)
        for plain, accented in ACCENTED:
            out = F.when(F.upper(k) == plain, accented).otherwise(out)
        return out

    return F.zip_with(kinds, numbers, lambda k, n: F.concat_ws(" ", kind(k), F.upper(n)))


def struct_refs(text: Column) -> Column:
    """Up to three cited parts."""
    return F.slice(all_refs(text), 1, 3)


def spellings(reference: Column) -> Column:
    """The four spellings of a reference to look for: accented and not, upper case and capitalised."""
    kind, number = F.substring_index(reference, " ", 1), F.substring_index(reference, " ", -1)
    plain = F.translate(kind, "ÍÓ", "IO")
    capital = lambda x: F.concat(F.substring(x, 1, 1), F.lower(F.substring(x, 2, 100)))
    return F.array_distinct(F.array(*(F.concat_ws(" ", x, number) for x in (kind, capital(kind), plain, capital(plain)))))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("/"))), " | "), F.lit(" |"))


def truncated_at_word(text: Column, limit: int) -> Column:
    """Cut at the last space in the upper half of the limit, else hard; ``…`` marks a cut."""
    head = F.substring(text, 1, limit)
    back = F.instr(F.reverse(head), " ")
    cut = F.when((back > 0) & (limit - back >= limit // 2), F.lit(limit) - back).otherwise(limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(head, F.lit(1), cut.cast("int"))), F.lit("…")))
