"""Scalar functions over labels, paths, routes and statements, as column expressions.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs of an endpoint label: fixed values.
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def plain_label(label: Column) -> Column:
    """Without a leading dot and a trailing pair of parentheses."""
    return F.regexp_replace(label, r"^\.|\(\)\z", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def last_two_segments(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), "/")


def format_label(label: Column, file: Column) -> Column:
    """Plain label with the file's name in parentheses, if there is a file."""
    return F.when(F.coalesce(file, F.lit("")) != "", F.concat(plain_label(label), F.lit(" ("), basename(file), F.lit(")"))).otherwise(plain_label(label))


def endpoint(label: Column) -> Column:
    """struct(method, path) of a label like "GET /x"; null if it is none."""
    text = F.trim(label)
    method = F.upper(F.regexp_extract(text, r"^([^ ]+) ", 1))
    path = F.trim(F.regexp_extract(text, r"(?s)^[^ ]+ (.*)\z", 1))
    return F.when(method.isin(*HTTP_METHODS) & path.startswith("/"), F.struct(method.alias("method"), path.alias("path")))


def join_route(prefix: Column, route: Column) -> Column:
    """prefix and route with a slash between them, of which one of the prefix and one of the route count once."""
    left = F.regexp_replace(prefix, r"/\z", "")
    return F.concat(left, F.when(route.startswith("/"), route).otherwise(F.concat(F.lit("/"), route)))


def table_token(sql: Column) -> Column:
    """The table an INSERT INTO statement names, up to the first odd character; null for any other statement."""
    token = F.regexp_extract(sql, r"^[ \n\r\t]*(?i:INSERT)[ \n\r\t]+(?i:INTO)[ \n\r\t]+([A-Za-z0-9_]+)", 1)
    return F.when(token != "", token)


def normalize_path(path: Column) -> Column:
    """POSIX normal form: slashes only, no empty, "." or foldable ".." segments; "." for nothing left."""
    slashed = F.regexp_replace(path, r"\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    rooted = slashed.startswith("/")

    def fold(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        keep = F.concat(done, F.array(s))
        up = F.when((F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(keep)
        return F.when(s == "..", up).otherwise(keep)

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")
    return F.when(rooted, F.concat(F.lit("/"), folded)).when(folded == "", ".").otherwise(folded)


def hop_label(hop: Column) -> Column:
    return F.when(hop == 0, F.lit("0 (target)")).when(hop > 0, F.concat(F.lit("+"), hop.cast("string"))).otherwise(hop.cast("string"))


def location_text(kind: Column, file: Column, line: Column) -> Column:
    """file:line, or what a node without a place in a file is."""
    named = F.when(kind == "event_topic", "topic").when(kind == "database_table", "table").when(kind == "http_endpoint", "endpoint")
    return F.when(F.coalesce(file, F.lit("")) != "", F.concat(file, F.when(line.isNotNull(), F.concat(F.lit(":"), line.cast("string"))).otherwise(""))).otherwise(named)


def line_of(location: Column) -> Column:
    """12 of "L12"; null if there is no number."""
    return F.expr("int(NULL)") if location is None else F.regexp_extract(F.when(location.rlike(r"^L\d+\z"), location), r"(\d+)", 1).try_cast("int")


def confidence_label(certainty: Column) -> Column:
    return F.when(certainty == "POSSIBLE", "INFERRED").otherwise("EXTRACTED")


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def uri_component(text: Column) -> Column:
    """Percent-encoded UTF-8 of all but letters, digits and - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def uri_decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def safe_filename(name: Column) -> Column:
    """Letters, digits, dot, underscore and dash; other runs become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+\z", "")


def step_text(step: Column, certain: Column) -> Column:
    """1.2.1, with a tilde before it if uncertain."""
    return F.concat(F.when(certain, "").otherwise("~"), F.array_join(step.cast("array<string>"), "."))


def contains_run(longer: Column, shorter: Column) -> Column:
    """Whether shorter stands as one contiguous run in longer."""
    starts = F.sequence(F.lit(1), F.size(longer) - F.size(shorter) + 1)
    return F.when(F.size(longer) >= F.size(shorter), F.exists(starts, lambda i: F.slice(longer, i, F.size(shorter)) == shorter)).otherwise(False)


def parse_depth(raw: str | None) -> int:
    """0 for none, "unlimited", 0, negative or invalid text; else the whole number below it."""
    try:
        value = float(raw) if raw not in (None, "", "unlimited") else 0.0
    except ValueError:
        return 0
    return int(value) if 0 < value < float("inf") else 0


def node_kind(kind: Column, callable_: Column, label: Column) -> Column:
    """A node's kind: as given, else callable, else module by the label's suffix, else symbol."""
    return F.coalesce(kind, F.when(callable_, "callable"), F.when(label.rlike(r"\.[tj]s\z"), "module"), F.lit("symbol"))


def absolute_path(file: Column, root: str) -> Column:
    """The file below root, unless it is absolute; null without a file."""
    slashed = F.regexp_replace(file, r"\\", "/")
    below = F.concat(F.lit(root.replace("\\", "/").removesuffix("/") + "/"), F.regexp_replace(slashed, "^/", ""))
    return F.when(slashed != "", F.when(slashed.rlike("^([a-zA-Z]:)?/"), slashed).otherwise(below if root else slashed))


def editor_url(file: Column, line: Column, root: str, scheme: str = "vscode") -> Column:
    at = F.when(line.isNotNull(), F.concat(F.lit(":"), line.cast("string"))).otherwise("")
    return F.concat(F.lit(f"{scheme}://file/"), absolute_path(file, root), at)


def css_colour(number: Column) -> Column:
    """A whole number as a six-digit hexadecimal colour."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(number)), 6, "0"))


#: Labels and kinds that the optional noise gate hides: fixed values.
NOISE_LABELS = "randomuuid trim touppercase tolowercase json.parse json.stringify object.assign promise then catch finally constructor query connect disconnect listen register inject send end code status log error warn info buildapp start server fastify kafka producer consumer".split()
NOISE_KINDS = ("import", "type", "file", "module")


def is_noise(label: Column, kind: Column, file: Column, *, enabled: bool = False) -> Column:
    """Whether the noise gate hides a node; nothing but missing nodes while it is off."""
    if not enabled:
        return label.isNull()
    plain, path = F.lower(plain_label(label)), F.lower(F.regexp_replace(F.coalesce(file, F.lit("")), r"\\", "/"))
    return label.isNull() | F.coalesce(kind.isin(*NOISE_KINDS), F.lit(False)) | plain.isin(*NOISE_LABELS) | plain.rlike(r"\.[tj]s\z") | path.rlike(r"node_modules|vitest|fastify/lib|server\.ts\z")
