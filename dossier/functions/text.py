"""Text and identity columns. All are built-in expressions, so that scans stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes and caps of pages and chunks.
CHUNK_CHARS, CHUNK_OVERLAP = 1200, 150
TEXT_MAX_CHARS, TEXT_MAX_CHUNKS = 2_000_000, 50

# File extensions by what becomes of them, and the reasons for skipping.
GATES = {
    "pdf": ["pdf"],
    "text": ["las", "csv", "txt"],
    "image": ["png", "jpg", "jpeg", "tif", "tiff"],
}
EXCEL, DEFERRED = ["xls", "xlsx", "xlsm", "xlsb"], ["xml", "eml", "zip", "kdex"]
EXCEL_REASON = "skip:excel-family deferred from v1 ingest (plan scope boundary)"
DEFERRED_REASON = " format deferred from v1 ingest (plan scope boundary)"

# White space in the sense of Unicode, with the separators 0x1C to 0x1F.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (trim() alone only removes spaces)."""
    return F.trim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACES}]")


def basename(key: Column) -> Column:
    return F.regexp_extract(key, r"([^/]*)/*$", 1)


def suffix(key: Column) -> Column:
    """The last extension with its dot, lower-cased; '' for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(basename(key), r"[^.].*?(\.[^.]+)$", 1))


def stem(key: Column) -> Column:
    name = basename(key)
    ext = F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)
    return F.when(ext == "", name).otherwise(F.left(name, F.length(name) - F.length(ext)))


def doc_id_for(key: Column) -> Column:
    """A readable slug of the file name and eight digits of the key's SHA-1."""
    slug = F.regexp_replace(F.regexp_replace(stem(key), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.substring(F.lower(slug), 1, 60)
    return F.concat(F.coalesce(F.nullif(slug, F.lit("")), F.lit("doc")), F.lit("-"), F.substring(F.sha1(key.cast("binary")), 1, 8))


def page_id_for(doc_id: Column, page_num: Column) -> Column:
    return F.concat(doc_id, F.lit(":p"), page_num.cast("string"))


def classify(key: Column) -> Column:
    """pdf, text, image, or skip with a reason."""
    ext = F.ltrim(suffix(key), F.lit("."))
    out = F.when(ext.isin(GATES["pdf"]), "pdf")
    for gate in ("text", "image"):
        out = out.when(ext.isin(GATES[gate]), gate)
    out = out.when(ext.isin(EXCEL), EXCEL_REASON).when(ext.isin(DEFERRED), F.concat(F.lit("skip:"), ext, F.lit(DEFERRED_REASON)))
    return out.otherwise(F.concat(F.lit("skip:unsupported extension "), F.when(ext == "", "(none)").otherwise(F.concat(F.lit("."), ext))))


def chunks(text: Column, head: int | None = None) -> Column:
    """Overlapping windows of the stripped text that aren't blank, in order; at most ``head`` of them.

    One pass: a window starts at the beginning, and at each step after which more than the overlap is left.
    """
    step = CHUNK_CHARS - CHUNK_OVERLAP
    windows = rf"(?s)(?:\A|(?=.{{{CHUNK_OVERLAP + 1}}}))(?=(.{{1,{CHUNK_CHARS}}})).{{1,{step}}}"
    pieces = F.filter(F.regexp_extract_all(strip(F.coalesce(text, F.lit(""))), F.lit(windows), F.lit(1)), lambda p: ~is_blank(p))
    return F.slice(pieces, 1, head) if head else pieces


def html_text(html: Column) -> Column:
    """What a page says: without scripts, styles and tags, with runs of white space as one space."""
    body = F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), "[ \\t\\n\\r]+", " "))


def normalize_key(name: Column) -> Column:
    """The key by which names are matched: lower case, spaces as underscores; inner doubles stay."""
    return strip(F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def fragment_key(name: Column) -> Column:
    return F.replace(normalize_key(name), F.lit("#"), F.lit(""))


def strip_county(key: Column) -> Column:
    return F.regexp_replace(key, r"_county(,_(tx|nd))?\z", "")


def strip_well_number(key: Column) -> Column:
    return F.regexp_replace(key, r"_#?\d+[a-z]{0,3}(_st\d+|_rd)?\z", "")


def xml_escape(text: Column) -> Column:
    for plain, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(named))
    return text


def parse_s3_uri(uri: Column) -> Column:
    return F.struct(F.regexp_extract(uri, "^s3://([^/]+)/(.+)$", 1).alias("bucket"), F.regexp_extract(uri, "^s3://([^/]+)/(.+)$", 2).alias("key"))


def allowed_parsed_ref(ref: Column, bucket: str) -> Column:
    """The key of a reference into the runs of that bucket, else null."""
    at = parse_s3_uri(ref)
    return F.when((at["bucket"] == bucket) & at["key"].startswith("runs/"), at["key"])


def cache_key(key: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 24), F.lit(".json"))


def virtual_dir(key: Column) -> Column:
    """The folder in which a document's pages are rendered."""
    return F.concat(F.lit("/"), F.replace(key, F.lit("/"), F.lit("__")), F.lit("--"), F.substring(F.sha2(key, 256), 1, 8))


def around(text: Column, match: Column, margin: int = 150) -> Column:
    """The first place where match stands in text, with margin characters on both sides."""
    at = F.position(match, text)
    start = F.greatest(F.lit(1), at - margin)
    return F.when(at > 0, F.substring(text, start, at + F.length(match) + margin - start))


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value computed once for each row however often it is used, also within lambdas, which else compute it for each element."""
    return F.get(F.transform(F.array(value), made), F.lit(0))
