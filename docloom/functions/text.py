"""Column functions on text, URLs, paths and maps. All stay inside Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import inline

#: Zero-width characters that never reach output text.
ZERO_WIDTH = "\ufeff\u200b\u200c\u200d"
#: What a CSS url() names, up to its quote, bracket or blank.
CSS_URL = r'''(?i)\burl\(\s*["']?\s*([^\s"'()]+)'''
#: What an attribute of a tag in a document names.
REF_ATTRIBUTE = r'''(?i)\s(?:src|href|poster)\s*=\s*["']\s*([^"'<>]+?)\s*["']'''
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

# Callout aliases by kind.
CALLOUT_ALIASES = {
    "note": ["note"],
    "abstract": ["abstract", "summary", "tldr"],
    "info": ["info", "todo"],
    "tip": ["tip", "hint"],
    "success": ["success", "check", "done"],
    "question": ["question", "help", "faq"],
    "warning": ["warning", "warn", "attention"],
    "failure": ["failure", "fail", "missing"],
    "danger": ["danger", "error"],
    "bug": ["bug"],
    "example": ["example"],
    "quote": ["quote", "cite"],
    "important": ["important"],
    "caution": ["caution"],
}
ALIAS_KIND = {alias: kind for kind, aliases in CALLOUT_ALIASES.items() for alias in aliases}

# MIME types by file extension.
MIME_TYPES = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "ico": "image/x-icon",
    "css": "text/css",
    "js": "text/javascript",
    "mjs": "text/javascript",
    "json": "application/json",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "ttf": "font/ttf",
    "otf": "font/otf",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
}
DEFAULT_MIME = "application/octet-stream"


def literal_map(values: dict[str, str]) -> Column:
    """A map literal."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def trim_all(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def slugify(c: Column) -> Column:
    """Lower case; runs of anything but letters, digits and hyphens become one hyphen, none at the ends."""
    dashed = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}-]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")


def html_escape(c: Column) -> Column:
    """& < > and both quotes as character references."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def plain_text(c: Column) -> Column:
    """Visible text of inline Markdown: images become their alt text, links their text, code and emphasis their content, tags go, breaks are blanks; zero-widths go."""
    return F.translate(F.regexp_replace(inline.plain_text(c), r"[\r\n]+", " "), ZERO_WIDTH, "")


def footnote_plain_title(c: Column) -> Column:
    """Tags and control characters out, white space collapsed, 180 characters at most."""
    c = F.regexp_replace(c, "<[^>]*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, "<.*", " "), r"[\n\r\t]", " ")
    c = F.regexp_replace(c, r"\p{Cc}", "")
    return F.left(trim_all(F.regexp_replace(c, r"[\s\p{Z}]+", " ")), F.lit(180))


def canonical_callout_kind(c: Column) -> Column:
    """The kind of a callout alias in any case, null for an unknown one."""
    return F.try_element_at(literal_map(ALIAS_KIND), F.lower(F.trim(c)))


def callout_label(kind: Column) -> Column:
    """A kind's label; Note for an unknown kind."""
    return F.coalesce(F.initcap(F.when(kind.isin(list(CALLOUT_ALIASES)), kind)), F.lit("Note"))


def uuid5_url(name: Column) -> Column:
    """The version 5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def session_key(url: Column) -> Column:
    """The session of a page: UUID of its trimmed URL without fragment; _unbound for a blank one."""
    bare = F.regexp_replace(trim_all(url), "(?s)#.*$", "")
    return F.when(bare == "", F.lit("_unbound")).otherwise(uuid5_url(bare))


def url_key(url: Column) -> Column:
    """Equal for URLs that are one target: trimmed, lower case, no fragment, no trailing slashes (never shorter than https://x)."""
    low = F.regexp_replace(F.lower(trim_all(url)), "(?s)#.*$", "")
    bare = F.regexp_replace(low, "/+$", "")
    return F.when(F.length(low) <= 9, low).when(F.length(bare) < 9, F.left(low, F.lit(9))).otherwise(bare)


def url_path(url: Column) -> Column:
    """The path of a URL without query and fragment; / for a URL that has none."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    path = F.when(F.instr(after, "/") > 0, F.regexp_extract(after, r"(?s)^[^/]*(/.*)$", 1)).otherwise(F.lit("/"))
    return F.regexp_replace(F.when(F.instr(url, "://") > 0, path).otherwise(url), r"(?s)[?#].*$", "")


def ref_extension_mime(ref: Column) -> Column:
    """The MIME type by the extension of a reference without query and fragment."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(ref, r"(?s)[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(literal_map(MIME_TYPES), ext), F.lit(DEFAULT_MIME))


def relative_path(path: Column, root: Column) -> Column:
    """The path below a root; null outside of it."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(path == F.regexp_replace(root, "/+$", ""), F.lit("")).when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path)))


def sanitize_name(c: Column) -> Column:
    """A file name: reserved characters and white space become one underscore; 80 characters at most."""
    marked = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), r"\s+", "_")
    return F.left(F.regexp_replace(marked, "_+", "_"), F.lit(80))


def params_merge(defaults: Column, overrides: Column) -> Column:
    """Shallow merge of two maps; the second wins. Needs spark.sql.mapKeyDedupPolicy=LAST_WIN."""
    return F.map_concat(F.coalesce(defaults, F.create_map().cast("map<string,string>")), F.coalesce(overrides, F.create_map().cast("map<string,string>")))


def parse_param(text: Column) -> Column:
    """k=v as struct(key, value): value is kept as JSON text if it is JSON, else quoted as a JSON string; a blank key raises."""
    key = F.trim(F.regexp_extract(text, r"(?s)^([^=]*)", 1))
    raw = F.regexp_extract(text, r"(?s)^[^=]*=(.*)$", 1)
    is_json = raw.rlike(r'^\s*(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|"[^"\\]*"|\{.*\}|\[.*\])\s*$')
    quoted = F.concat(F.lit('"'), F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.struct(F.when(key == "", F.raise_error(F.lit("blank parameter key"))).otherwise(key).alias("key"), F.when(is_json, F.trim(raw)).otherwise(quoted).alias("value"))


def decode_entities(c: Column) -> Column:
    """Character references as characters: names of HTML 4 and numbers."""
    return inline.entities(c)


def glob_regex(pattern: str) -> str:
    """A URL glob as a regular expression: * spans anything, ? is one character."""
    import re

    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", c) for c in pattern) + "$"


def path_glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: * stays inside a segment, ** spans segments, also none."""
    import re

    quoted = lambda s: re.sub(r"([.+^${}()|\[\]\\?])", r"\\\1", s).replace("*", "[^/]*")
    segments, out = pattern.split("/"), ""
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            out += ".*" if last else "(.*/)?"
        else:
            out += quoted(segment) + ("" if last else "/")
    # A trailing ** also matches the folder itself.
    return "^" + out.replace("/.*", "(/.*)?" if pattern.endswith("/**") else "/.*") + "$"


def path_glob_pattern(pattern: Column) -> Column:
    """A column of path globs as regular expressions, as path_glob_regex makes them."""
    quoted = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\?])", r"\\$1")
    last = F.regexp_replace(quoted, r"(^|/)\*\*$", "$1\ufdd0")
    inner = F.regexp_replace(last, r"(^|/)\*\*(?=/)", "$1\ufdd1")
    single = F.regexp_replace(inner, r"\*+", "[^/]*")
    # ** between folders spans them or none; at the end it also matches the folder itself.
    ended = F.regexp_replace(F.regexp_replace(single, "/\ufdd0$", "(/.*)?"), "^\ufdd0$", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(ended, "\ufdd1/", "(.*/)?"), F.lit("$"))
