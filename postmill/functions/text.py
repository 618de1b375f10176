"""Column functions for names, paths, subjects and bodies.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_STEM = 160
#: What html_to_text replaces, in this order, and by what.
HTML_STEPS = (
    (r"(?is)<(script|style)[^>]*>.*?</\1>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"<[^>]+>", " "),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
)


def filled(col: Column) -> Column:
    """Empty strings become null."""
    return F.nullif(col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim all white space, line breaks and Unicode blanks included."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def slug(col: Column, max_length: int = MAX_STEM) -> Column:
    """Lower-case ASCII slug: ``&`` becomes ``and``, other runs become one dash; ``untitled`` when nothing is left, and for null."""
    dashed = F.regexp_replace(F.replace(F.lower(strip(col)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-")
    whole = F.coalesce(filled(F.regexp_replace(dashed, "^-+|-+$", "")), F.lit("untitled"))
    return F.coalesce(filled(F.regexp_replace(F.substring(whole, 1, max_length), "-+$", "")), F.lit("untitled"))


def category_path(col: Column) -> Column:
    """Slash-separated slugs of the non-blank parts; ``general`` when there is none."""
    parts = F.filter(F.split(col, r"[/\\]+"), lambda p: strip(p) != "")
    return F.coalesce(filled(F.array_join(F.transform(parts, lambda p: slug(p)), "/")), F.lit("general"))


def category_directory(base: Column, category: Column, band: Column | None = None) -> Column:
    parts = [base, category_path(category)]
    if band is not None:
        parts.append(F.when(filled(band).isNotNull(), slug(band, 40)))
    return F.concat_ws("/", *parts)


def pack_filename(category: Column, band: Column, sequence: Column, extension: str = "md") -> Column:
    stem = F.concat_ws("-", F.replace(category_path(category), F.lit("/"), F.lit("-")), slug(band, 40),
                       F.format_string("%03d", sequence.cast("int")))
    return F.concat(F.regexp_replace(F.substring(stem, 1, MAX_STEM), "-+$", ""), F.lit("." + extension.lstrip(".")))


def display_name(path: Column) -> Column:
    """Last part of a category path in title case, dashes as blanks; a letter after a digit is capitalised too."""
    words = F.initcap(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lit(" ")))
    pieces = F.regexp_extract_all(words, F.lit(r"[0-9]+[a-z]?|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]")), F.upper(p)).otherwise(p)), "")


def parent_path(path: Column) -> Column:
    """All parts but the last; null at the root."""
    parts = F.split(path, "/")
    return filled(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))


def label_name(label: Column) -> Column:
    return F.replace(F.lower(label), F.lit(" "), F.lit("-"))


def split_labels(header: Column) -> Column:
    """Trimmed non-blank labels of a comma-separated header; an empty array for null."""
    labels = F.filter(F.transform(F.split(header, ","), strip), lambda x: x != "")
    return F.coalesce(labels, F.array().cast("array<string>"))


def safe_filename(original: Column, index: Column) -> Column:
    """Attachment name without odd characters, at most 120 characters plus a short extension."""
    cleaned = F.regexp_replace(original, r"(?U)[^\w.\-]", "_")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, "^[._]+|[._]+$", ""), "_+", "_")
    dot = F.length(cleaned) - F.coalesce(filled(F.instr(F.reverse(cleaned), ".").cast("string")).cast("int"), F.lit(0))
    has_dot = F.contains(cleaned, F.lit("."))
    extension = F.when(has_dot, F.substring(cleaned, dot + 2, F.length(cleaned))).otherwise(cleaned)
    stem = F.when(has_dot, F.substring(cleaned, F.lit(1), dot)).otherwise(F.lit(""))
    short = F.when((extension != "") & (F.length(extension) <= 10), F.concat(F.substring(stem, 1, 120), F.lit("."), extension))
    cut = F.when(F.length(cleaned) > 130, F.coalesce(short, F.substring(cleaned, 1, 120))).otherwise(cleaned)
    return F.coalesce(filled(cut), F.concat(F.lit("attachment-"), index.cast("string")))


def date_band(date: Column) -> Column:
    """First four characters of a date string; ``undated`` for null or empty."""
    return F.coalesce(filled(F.substring(date, 1, 4)), F.lit("undated"))


def attachment_path(base: Column, account: Column, date: Column, message_id: Column, name: Column) -> Column:
    who = F.when(filled(message_id).isNull(), F.lit("unknown")).otherwise(slug(message_id, 60))
    return F.concat_ws("/", base, account, date_band(date), who, safe_filename(name, F.lit(0)))


def subject_root(subject: Column) -> Column:
    """Subject without leading reply and forward marks."""
    return strip(F.regexp_replace(strip(subject), r"(?iU)^(?:\s*(?:re|fwd?)\s*:)+\s*", ""))


def thread_key(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    """First reference, else the parent, else the message itself; null when all are blank."""
    first = F.element_at(F.split(filled(strip(references)), r"(?U)\s+"), 1)
    return F.coalesce(first, filled(strip(in_reply_to)), filled(strip(message_id)))


def html_to_text(html: Column) -> Column:
    """Drop scripts and styles, break at <br>, blank out tags, collapse blanks.  Entities stay as they are."""
    for pattern, by in HTML_STEPS:
        html = F.regexp_replace(html, pattern, by)
    return strip(html)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def body_hash(text: Column) -> Column:
    """SHA-256 hex; null for null or empty."""
    return F.sha2(filled(text).cast("binary"), 256)


def render_message(subject: Column, sender: Column, date: Column, message_id: Column, body: Column) -> Column:
    """Markdown chunk: front matter of the filled fields, then the trimmed body or a stand-in."""
    def line(name: str, col: Column) -> Column:
        return F.when(filled(col).isNotNull(), F.concat(F.lit(f"{name}: "), col))

    text = F.coalesce(filled(strip(body)), F.lit("*(no body)*"))
    return F.concat_ws("\n", F.lit("---"), line("subject", subject), line("from", sender), line("date", date),
                       line("message_id", message_id), F.lit("---"), F.lit(""), text, F.lit(""))


def pack_header(account: Column, email: Column, category: Column, band: Column, sequence: Column,
                messages: Column, exported_at: Column, origin: Column) -> Column:
    """Head of a pack file; the clock comes in as a column."""
    mail = F.when(filled(email).isNotNull(), F.concat(F.lit("account_email: "), email)).otherwise(F.lit(""))

    def line(name: str, col: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), col.cast("string"))

    return F.concat_ws(
        "\n", F.lit("# postmill export"), line("account", account), mail, line("category", category),
        line("date_band", band), line("sequence", sequence), line("messages", messages),
        line("exported_at", exported_at), line("source_db", origin), F.lit(""), F.lit("---"), F.lit(""), F.lit(""))
